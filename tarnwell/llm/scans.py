"""Noise in text from scanned pages: broken and misread words, running headers, printed page numbers.

Every line of a block is labelled as body, running header, page number, both, or as one at whose end a
word is broken, by a linear conditional model over layout features (what a line repeats in its paper, how a
number on it follows the page, where it stands, how the halves at its end are spelled elsewhere). A form is
misread if a form that looks like it is far more frequent and it is not at home in text that was never read
from a page, which runs on without line ends.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.crf import Chain
from tarnwell.llm.labelled import Writer
from tarnwell.session import cut

RATIO, AT_HOME, KNOWN, SEGMENT = 10, 0.2, 1e-5, 1024
FILTER_BITS, FILTER_SLICES, FLOWING = 1 << 27, 64, 150
LABELS = ["O", "header", "number", "both", "break"]

# Groups of letters that scanners confuse; each is written as its first member when words are compared.
MERGED = (("m", "rn"), ("w", "vv"), ("u", "ii"), ("h", "li"), ("d", "cl"))
CONFUSED = {"c": "e", "0": "o", "1": "l", "5": "s", "9": "g", "†": "t", "α": "a", "y": "v", "b": "h", "8": "h", "6": "h", "ǃ": "i", "|": "l", "ο": "o", "е": "e", "а": "a", "о": "o"}
# Signs that stand for a letter come before the groups, which hold that letter; letters come behind them, as c does for cl.
SIGNS, LETTERS = ({c: e for c, e in CONFUSED.items() if (c in "bcy") == letters} for letters in (False, True))

_WORD = re.compile(r"[\w†]+(?:-[\w†]+)*")
_BROKEN = re.compile(r"[\w†-]*[\w†][-‐¬\xad][^\S\n]*\n\s*[\w†-]+")
_LEFT = re.compile(r"((?:[^\W_]|†)+(?:-(?:[^\W_]|†)+)*)([-‐¬\xad])[^\S\n]*$")
_RIGHT = re.compile(r"\s*((?:[^\W_]|†)+(?:-(?:[^\W_]|†)+)*)")
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
_NUMBERS = (
    ("page of", re.compile(r"\s*page\s+(\d{1,4})\s+of\s+\d{1,4}\s*$", re.I)), ("page", re.compile(r"\s*page\s+(\d{1,4})\s*$", re.I)), ("p.", re.compile(r"\s*pp?\s*\.\s*(\d{1,4})\s*$", re.I)),
    ("[]", re.compile(r"\s*\[\s*(\d{1,4})\s*\]\s*$")), ("()", re.compile(r"\s*\(\s*(\d{1,4})\s*\)\s*$")), ("-", re.compile(r"\s*[-–—]\s*(\d{1,4})\s*[-–—]\s*$")), ("·", re.compile(r"\s*[·•*.|~]\s*(\d{1,4})\s*[·•*.|~]\s*$")),
    ("bare", re.compile(r"\s*(\d{1,4})\s*$")), ("roman", re.compile(r"\s*([ivxlcdm]{1,8})\s*$", re.I)),
)
_GAPS = (("left", re.compile(r"\s*(\d{1,4}|[ivxl]{1,6})(?:\s{2,}|\s*[|·•]\s*)(?=[^\W\d_])(.*)$", re.S)), ("right", re.compile(r"(.*?\S)(?:\s{2,}|\s*[|·•]\s*)(\d{1,4}|[ivxl]{1,6})\s*$", re.S)))
_BANG = re.compile(r"!(?=[a-zß-ÿ])")
_GAP = re.compile(r"\s\s|[|·•]")
_ENDS, _MARKS = frozenset(".!?:;,"), "-‐¬\xad"
_JOURNAL = re.compile(
    r"\b[Vv](?:ol|OL)\.\s*\d|\b(?:et al|ET AL)\.?(?: /|$)|^\W*(?:Preprint|PREPRINT)\b|\b(?:under review|UNDER REVIEW)\b"
    r"|\b(?:Proceedings|Transactions|Journal|Annals|Letters|Archive|Quarterly|Studies|Bulletin|Review|Advances|Communications)\s+(?:of|on|for|in)\s+[A-Z]"
    r"|\b(?:PROCEEDINGS|TRANSACTIONS|JOURNAL|ANNALS|LETTERS|ARCHIVE|QUARTERLY|STUDIES|BULLETIN|REVIEW|ADVANCES|COMMUNICATIONS)\s+(?:OF|ON|FOR|IN)\s+[A-Z]"
)


def roman(text: str) -> int:
    total, last = 0, 0
    for c in reversed(text.lower()):
        value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c]
        total += value if value >= last else -value
        last = max(last, value)
    return total


def outline(word: str) -> str:
    """The word with confusable letters written alike."""
    word = "".join(SIGNS.get(c, c) for c in word.lower())
    for one, several in MERGED:
        word = word.replace(several, one)
    return "".join(LETTERS.get(c, c) for c in word)


def outline_column(word: Column) -> Column:
    word = F.translate(word, "".join(SIGNS), "".join(SIGNS.values()))
    for one, several in MERGED:
        word = F.replace(word, F.lit(several), F.lit(one))
    return F.translate(word, "".join(LETTERS), "".join(LETTERS.values()))


def line_key(line: str) -> str:
    """The letters of a line, confusable ones alike: the same for a running header wherever it is printed."""
    return outline("".join(c for c in line.lower() if c.isalpha() or c in "015†"))


def _number(line: str) -> tuple[str, int, str]:
    """Form of the number on a line ('' for none), its value, and the line without it."""
    if len(line) > 18 and not _GAP.search(line):
        return "", 0, line
    for form, pattern in _NUMBERS if len(line) <= 18 else ():
        m = pattern.match(line)
        if m and (form != "roman" or _ROMAN.match(m[1])):
            return form, roman(m[1]) if form == "roman" else int(m[1]), ""
    for form, pattern in _GAPS:
        m = pattern.match(line)
        if m:
            number, rest = (m[1], m[2]) if form == "left" else (m[2], m[1])
            if number.isdigit() or _ROMAN.match(number):
                return ("gap" if number.isdigit() else "gap roman"), int(number) if number.isdigit() else roman(number), rest
    return "", 0, line


def filled_places(text: str) -> list[int]:
    """Numbers of the lines that are not blank."""
    return [i for i, line in enumerate(text.split("\n")) if line and not line.isspace()]


def cut_lines(lines: list[str], filled: list[int], printed: set[int]) -> list[tuple[int, str, str, str | None]]:
    """(line, left half, mark, right half or None at the end of the block) of lines that end in a mark behind a word; ``printed`` are lines to look past."""
    out = []
    for k, i in enumerate(filled):
        line = lines[i].rstrip()
        m = _LEFT.search(line) if line[-1] in _MARKS else None
        if m and (m[1][-1].isalpha() or m[1][-1] == "†" or m[1][-1] in "0159" and m[1][0].isalpha()):
            behind = next((j for j in filled[k + 1 :] if j not in printed), None)
            n = _RIGHT.match(lines[behind]) if behind is not None else None
            out.append((i, m[1], m[2], n[1] if n else None))
    return out


def cut_features(mark: str, right: str | None, joined: str, halves: str) -> str:
    """Features of a line that ends in a mark: the mark, the half behind it, whether the word is spelled joined or with the mark elsewhere, whether the halves are words."""
    side = "none" if right is None else "low" if right[:1].islower() or right[:1].isdigit() or right[:1] == "†" else "other"
    soft = "cut=" + ("soft" if mark != "-" else "hyphen")
    return "\t".join((soft, "right=" + side, "joined=" + joined, "halves=" + halves, f"{joined}/{halves}/{side}"))


def plausible_lines(text: str, block_type: str | None) -> list[tuple[int, str, str, int, str]]:
    """(line, key, form, value, layout features) of lines that may be printed above or below the text."""
    lines = text.split("\n")
    filled = [i for i, line in enumerate(lines) if line.strip()]
    out = []
    for k, i in enumerate(filled):
        line = lines[i].strip()
        if len(line) > 110 or line[0] == "|" and line[-1] == "|" and line.count("|") > 2 or line[-1] in _ENDS and not line.endswith("et al."):
            continue
        if line[0].islower() and len(line) > 16 and not _GAP.search(line) or line[-1] in _MARKS and line[-2:-1].isalpha():
            continue
        form, value, rest = _number(line)
        first = next((c for c in rest if c.isalnum()), "")
        if not form and (not first or first.islower() or len(rest) < 6 or rest[-1] in ".!?:;," and not rest.endswith("et al.")):
            continue
        if len(rest) and sum(c.isalpha() for c in rest) * 2 < len(rest.replace(" ", "")):
            if not form:
                continue
        before = lines[filled[k - 1]].rstrip() if k else ""
        after = lines[filled[k + 1]].strip() if k + 1 < len(filled) else ""
        letters = [c for c in rest if c.isalpha()]
        features = ["place=" + ("alone" if len(filled) == 1 else "first" if not k else "last" if k == len(filled) - 1 else "middle"), "kind=" + (block_type or "none"), "form=" + (form or "none")]
        features.append(f"few={len(filled) if len(filled) < 4 else 'many'}")
        if letters:
            features.append("caps" if all(c.isupper() for c in letters) else "title" if sum(w[:1].isupper() for w in rest.split()) * 2 > len(rest.split()) else "plain")
            features.append("long" if len(rest) > 60 else "middling" if len(rest) > 25 else "short")
            if _JOURNAL.search(rest):
                features.append("journal")
            if " / " in rest:
                features.append("slash")
            if re.match(r"[A-Z]\. \w[\w'-]+(?: et al\.)?$", " ".join(rest.split())):
                features.append("initialed")
            if re.match(r"(?:\d[\d.]*|[IVX]+\.?|[A-Z]\.)\s", rest):
                features.append("enumerated")
            if re.search(r"\b(?:of|for|and|the|a|to|in|with)$", rest):
                features.append("open end")
        if before:
            features.append("after " + ("stop" if before[-1] in ".!?:\"”" else "broken" if before[-1] in "-‐¬\xad" else "open"))
        if after:
            features.append("before " + ("low" if after[:1].islower() else "number" if _number(after)[0] else "other"))
        features.append("table" if "|" in text or "\t" in text else "text")
        out.append((i, line_key(rest), form, value, "\t".join(features)))
    return out


def _hints(features: str, form: str, page: int | None, pages: int, papers: int, titled: bool, follows: int) -> str:
    """All features of a line, with what its paper and all papers say of it. ``follows``: 2 the number follows the page, 1 only its form is the paper's, 0 neither."""
    if form.endswith("roman") and not follows:  # letters are a number only where they follow the page
        features, form = features.replace("form=" + form, "form=none"), ""
    out = [features, "first page" if page == 1 else "later page", f"pages={min(pages, 4)}", f"papers={'many' if papers >= 3 else 'one'}"]
    if titled:
        out.append("titled")
    if form:
        out.append(f"follows={follows}")
        out.append(f"follows={follows}/{form.split()[0]}")
    place = features.split("\t", 1)[0]
    out.append(f"pages={min(pages, 2)}/{place}/{titled}")
    return "\t".join(out)


class Pages:
    """Invented papers with printed headers and numbers: the labelled table of the line model."""

    def __init__(self, seed: int = 7) -> None:
        self.w = Writer([], [], seed)
        self.r = self.w.r
        words = (("Journal of", "Proceedings of the Society for", "Bulletin of", "Review of", "Advances in", "Communications in", "Annals of"), ("Marine Biology", "Social History", "Crop Science", "Number Theory", "Economic Policy", "Soil Mechanics"))
        self.journals = [f"{a} {b}" for a in words[0] for b in words[1]][::2]

    def _sentence(self) -> str:
        r = self.r
        words = [self.w.coined(r.randint(1, 3)).lower() if r.random() < 0.5 else r.choice(("the", "of", "a", "and", "is", "in", "page", "model", "score", "retrieval", "by", "our", "results", "for", "archive", "letters", "review", "journal")) for _ in range(r.randint(8, 20))]
        if r.random() < 0.4:
            words[r.randrange(len(words))] = self.w.term()
        return " ".join(words).capitalize() + "."

    def _wrapped(self, sentences: int, width: int) -> list[str]:
        lines, line = [], ""
        for word in " ".join(self._sentence() for _ in range(sentences)).split():
            if len(line) + len(word) + 1 > width:
                lines.append(line)
                line = word
            else:
                line = f"{line} {word}".strip()
        return [*lines, line]

    def _broken(self, lines: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Lines some of which end in a broken word, or in a mark that is part of a word's spelling."""
        r, out, carry = self.r, [], ""
        for k, (line, _) in enumerate(lines):
            line, label = carry + line, "O"
            carry = ""
            word = line.split(" ")[-1]
            chance = r.random()
            if chance < 0.16 and word.isalpha() and len(word) > 5 and (k < len(lines) - 1 or chance < 0.05):
                at = r.randint(2, len(word) - 2)
                line, carry, label = line[: len(line) - len(word) + at] + r.choice("----¬\xad"), word[at:] + " ", "break"
            elif chance > 0.93 and k < len(lines) - 1:
                line, carry = f"{line} {self.w.coined(1).lower()}-", f"{r.choice((self.w.coined(1).lower(), self.w.coined(1)))} "
            out.append((line, label))
        return out

    def _evidence(self, broken: bool, right: str | None) -> str:
        """How the halves of a line's end might be spelled elsewhere."""
        r = self.r
        if right is None:
            return cut_features("-", right, "none", "unknown" if broken == (r.random() < 0.95) else "known")
        if broken:
            return cut_features("-", right, *r.choice((("more", "unknown"),) * 8 + (("more", "known"), ("none", "unknown"), ("none", "unknown"))))
        return cut_features("-", right, *r.choice((("less", "known"),) * 6 + (("less", "unknown"), ("none", "known"), ("none", "known"))))

    def paper(self, number: int) -> list[dict]:
        r, w = self.r, self.w
        title = " ".join(w.coined(2).lower() if r.random() < 0.5 else r.choice(("the", "of", "page", "and", "retrieval", "sparse", "scoring", "for")) for _ in range(r.randint(5, 11))).capitalize()
        if r.random() < 0.5:
            title = f"{w.term()}: {title}"
        author = f"{r.choice('ABCDEFGH')}. {w.coined(3)}"
        journal = r.choice(self.journals)
        scanned = r.random() < 0.6
        short = " ".join(title.split()[: r.randint(4, 8)])
        heads = [r.choice((short, short.upper(), f"{author.split()[1].upper()}: {short.upper()}")), r.choice((journal, journal.upper(), f"{author} et al. / {journal} {r.randint(1, 40)}", f"{journal}, Vol. {r.randint(1, 60)}, No. {r.randint(1, 6)}", f"Preprint of {journal} – under review", f"Preprint of {journal} – under review", author, f"{author} et al."))]
        form, base, gap = r.choice(("{}", "— {} —", "- {} -", "[ {} ]", "p. {}", "Page {}", "Page {} of {n}", "· {} ·", "roman")), r.choice((0, 0, 0, r.randint(10, 900))), r.random() < 0.3
        pages, blocks = r.randint(3, 10), []

        def add(kind: str, lines: list[tuple[str, str]], page: int) -> None:
            given = kind if r.random() < 0.75 else r.choice(("paragraph", "unknown", kind))
            blocks.append({"paper": number, "kind": given, "page": page if r.random() < 0.93 else None, "text": "\n".join(t for t, _ in lines), "labels": [y for _, y in lines], "title": title})

        def printed(page: int) -> list[tuple[str, str]]:
            n = page + base
            shown = form.format(n, n=pages + base) if form != "roman" else "".join(s * (n // v % b) for v, s, b in ((10, "x", 10),)) + ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[n % 10]
            if form == "roman" and n >= 40:
                shown = str(n)
            head = heads[page % 2]
            if gap and page > 1:
                return [(f"{n}   {head}" if page % 2 == 0 else f"{head}   {n}", "both")]
            lines = [] if page == 1 and r.random() < 0.9 else [(head, "header")]
            return [*lines, (shown, "number")] if r.random() < 0.9 else lines

        add("title", [(title, "O")], 1)
        add("authors", [(f"{w.coined(3)} {w.coined(3)}, {w.coined(2)} {w.coined(3)}", "O")] if r.random() < 0.6 else [(f"{w.coined(3)} {w.coined(3)}", "O")], 1)
        if r.random() < 0.7:
            add("affiliation", [(f"{r.choice(('Institute of Marine Biology', 'Department of Social History', 'School of Nursing', 'Crop Laboratory', f'{w.coined(2)} Institute of Economic Policy'))}, {w.town()}", "O")], 1)
        if r.random() < 0.3:
            add("footnote", [(f"{r.randint(1, 9)} {self._sentence()[:-1]}", "O")], 1)
        for page in range(1, pages + 1):
            marks = printed(page) if scanned else []
            where = r.random()
            if marks and where < 0.5:
                if r.random() < 0.5:
                    add("metadata" if marks[0][1] != "number" else "page_number", marks, page)
                else:
                    for m in marks:
                        add("page_number" if m[1] == "number" else "metadata", [m], page)
                marks = []
            for k in range(r.randint(3, 6)):
                kind = r.random()
                if kind < 0.12:
                    add("section_title", [(f"{r.randint(1, 7)}{r.choice(('', '.1', '.2'))} {r.choice(('Method', 'Related Work', 'Results', 'Discussion', f'{w.coined(2)} archives', f'{w.coined(2)} studies'))}", "O")], page)
                elif kind < 0.2:
                    add("table_like", [(x, "O") for x in (w.coined(2), *(str(r.randint(1, 400)) for _ in range(r.randint(2, 4))))], page)
                elif kind < 0.26:
                    add("reference", [(f"[{r.randint(1, 60)}] {author.split()[1]}, G. {title[:40]}. {journal} {r.randint(1, 40)}({r.randint(1, 6)}), {r.randint(1, 400)}, {r.randint(1990, 2024)}.", "O")], page)
                elif kind < 0.32:
                    add("list", [(f"{i}. {self._sentence()}", "O") for i in range(1, 4)], page)
                elif kind < 0.36:
                    add("table", [(f"| {w.term()} | {r.randint(1, 99)}.{r.randint(10, 99)} | {r.randint(1, 99)} |", "O") for _ in range(3)], page)
                elif kind < 0.4:
                    if r.random() < 0.5:
                        add("formula", [(f"{r.choice('LQR')}(x) = sum_i w_i * {r.choice(('archive', 'page', 'score'))}_i + 0.{r.randint(100, 999)}", "O")], page)
                    add("code", [(f"def {w.coined(2).lower()}(x, k={r.randint(1, 99)}):", "O"), (f"    {w.coined(2).lower()} = table[{r.randint(1, 99)}]", "O"), ("    return x", "O")], page)
                else:
                    lines = [(line, "O") for line in (self._wrapped(r.randint(2, 7), r.choice((60, 70, 75))) if scanned or r.random() < 0.3 else [self._sentence() + " " + self._sentence()])]
                    if scanned:
                        lines = self._broken(lines)
                    if marks:
                        at = r.choice((0, len(lines), r.randrange(len(lines) + 1)))
                        lines[at:at] = marks
                        marks = []
                    add("paragraph", lines, page)
            if marks:
                add("paragraph", marks, page)
        return blocks

    def examples(self, papers: int = 420) -> list[tuple[list[str], list[int]]]:
        rows, keys, everywhere, numbers = [], defaultdict(set), defaultdict(set), defaultdict(lambda: defaultdict(set))
        forms = defaultdict(lambda: defaultdict(set))
        for n in range(papers):
            for b, block in enumerate(self.paper(n)):
                own = plausible_lines(block["text"], block["kind"])
                rows.append((block, own))
                for i, key, form, value, _ in own:
                    if len(key) >= 8:
                        keys[n, key].add(block["page"] or -b)
                        everywhere[key].add(n)
                    if form and block["page"]:
                        numbers[n][value - block["page"]].add(block["page"])
                        forms[n][value - block["page"]].add(form)
        out = []
        for block, own in rows:
            n = block["paper"]
            best = max(numbers[n], key=lambda shift: (len(numbers[n][shift]), shift), default=None)
            mode = best if best is not None and len(numbers[n][best]) >= 2 else None
            lines, filled = block["text"].split("\n"), filled_places(block["text"])
            tokens = {i: plain_line(k, len(filled)) for k, i in enumerate(filled)}
            for i, key, form, value, features in own:
                follows = 0
                if mode is not None and form:
                    follows = 2 if block["page"] and value - block["page"] == mode else 1 if not block["page"] and form in forms[n][mode] else 0
                tokens[i] = _hints(features, form, block["page"], max(1, len(keys[n, key])), max(1, len(everywhere[key])), is_titled(key, block["title"], block["kind"]), follows)
            for i, _, mark, right in cut_lines(lines, filled, {i for i, *_ in own}):
                evidence = self._evidence(block["labels"][i] == "break", right)
                tokens[i] = evidence if mark == "-" else evidence.replace("cut=hyphen", "cut=soft")
            if tokens:
                out.append((list(tokens.values()), [LABELS.index(block["labels"][i]) for i in tokens]))
        return out


def plain_line(place: int, lines: int) -> str:
    """Features of a line that nothing sets apart."""
    return "plain\tplain=" + ("alone" if lines == 1 else "first" if not place else "last" if place == lines - 1 else "middle")


def is_titled(key: str, title: str | None, kind: str | None) -> bool:
    """Whether a line holds the beginning of its paper's title, and is not the title itself."""
    start = line_key(title or "")
    return len(start) >= 12 and kind != "title" and (start[:12] in key or len(key) >= 12 and start.startswith(key))


_model: list[Chain] = []


def line_model() -> Chain:
    if not _model:
        _model.append(Chain(LABELS, lambda token: token.split("\t") if token else ["edge"], reach=1).fit(Pages().examples(), epochs=30, batch=128, rate=0.2, decay=2e-5, few=3))
    return _model[0]


def label_block(chain: Chain, tokens: list[str]) -> list[str]:
    table = chain.table(["", *tokens])
    at = np.arange(1, len(tokens) + 1)
    emit = chain.emissions(table, np.concatenate([[0] * chain.reach, at, [0] * chain.reach]), at - 1)
    return [LABELS[y] for y in chain.decode(emit, np.array([0]), np.array([len(tokens)]))]


def _lettered(text: str) -> str:
    """The text with exclamation marks within words as letters, which scanners read for an i."""
    return _BANG.sub("ǃ", text) if "!" in text else text


def _unbroken(text: str) -> str:
    """The text without words that go on behind a line end."""
    return _BROKEN.sub(" ", text) if any(m + "\n" in text for m in _MARKS) or "- \n" in text else text


def is_flowing(text: str) -> bool:
    """Whether a text was never read from a page: it is long and runs on without line ends."""
    return len(text) >= FLOWING and "\n" not in text.strip()


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task's blocks: word forms with counts, plausible lines, lines that end in a mark, first words of each block."""
    counts: Counter[str] = Counter()
    flowing: Counter[str] = Counter()
    rows: list[list] = [[] for _ in range(13)]

    def put(*row) -> None:
        for column, value in zip(rows, row):
            column.append(value)

    def put_words() -> None:
        for counted in (counts, flowing):
            for w, n in list(counted.items()):
                if "-" in w:
                    for part in w.split("-"):
                        counted[part] += n
        for w, n in counts.items():
            put("word", None, None, None, None, None, None, flowing.get(w, 0), w, outline(w), n, None, None)
        counts.clear()
        flowing.clear()

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], _SURVEY_NAMES)
        for c in rows:
            c.clear()
        return out

    for batch in batches:
        for block, paper, kind, page, order, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not text:
                continue
            text = _lettered(text)
            found = _WORD.findall(_unbroken(text).lower())
            counts.update(found)
            if is_flowing(text):
                flowing.update(found)
            lines, filled = text.split("\n"), filled_places(text)
            place = {i: k for k, i in enumerate(filled)}
            own = plausible_lines(text, kind)
            for i, key, form, value, features in own:
                put("line", block, paper, page, order, i, place[i], len(filled), key, form, value, features, None)
            printed = {i for i, *_ in own}
            head = next((m[1] for i in filled if i not in printed and (m := _RIGHT.match(lines[i]))), None)
            put("edge", block, paper, page, order, None, None, len(filled), kind or "", None, None, None, head)
            for i, left, mark, right in cut_lines(lines, filled, printed):
                put("cut", block, paper, page, order, i, place[i], len(filled), left, mark, None, None, right)
        if len(counts) > 200_000:
            put_words()
        yield batch_of()
    put_words()
    yield batch_of()


_SURVEY_NAMES = ["what", "block", "paper", "page", "ord", "line", "place", "of", "key", "form", "value", "features", "near"]
_SURVEY = "what string, block long, paper long, page int, ord int, line int, place int, of long, key string, form string, value long, features string, near string"
_NO_RUNNING = ("figure_caption", "table_caption", "table", "table_like", "footnote", "section_title", "title", "authors", "affiliation", "page_number", "metadata", "formula", "code")


def following(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` (``block``, ``paper``, ``ord``) with the nearest ``value`` that is not null behind each in its paper, however far.

    Within segments of ``SEGMENT`` places by a window; over their ends by the first value of each segment, so a paper is never sorted as a whole.
    """
    rows = rows.withColumn("segment", F.floor(F.col("ord") / SEGMENT)).withColumn("own", value)
    inside = Window.partitionBy("paper", "segment").orderBy(F.desc("ord"), F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("paper", "segment").agg(F.min_by("own", F.when(F.col("own").isNotNull(), F.struct("ord", "block"))).alias("first"))
    behind = Window.partitionBy("paper").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("paper", "segment", F.last("first", ignorenulls=True).over(behind).alias("later"))
    found = rows.withColumn("inside", F.last("own", ignorenulls=True).over(inside)).join(firsts, ["paper", "segment"], "left")
    return found.withColumn(name, F.coalesce("inside", "later")).drop("segment", "own", "inside", "later")


class Survey:
    """What the blocks and all their words say; written once, read by the steps below."""

    def __init__(self, blocks: DataFrame, titles: DataFrame | None, names: dict[str, str]) -> None:
        self.spark = blocks.sparkSession
        column = lambda role, kind: F.col(names[role]).cast(kind).alias(role)
        self.given = blocks.select(column("block", "long"), column("paper", "long"), column("kind", "string"), column("page", "int"), column("order", "int"), column("text", "string"))
        self.given = self.given.where(F.col("block").isNotNull() & (F.length("text") > 0))
        self.titles = titles
        self.rows = cut(self.given.mapInArrow(_survey, _SURVEY))
        self.words = cut(self.rows.where("what = 'word'").groupBy(F.col("key").alias("form"), F.col("form").alias("outline")).agg(F.sum("value").alias("n"), F.sum("of").alias("flowing")))
        self.total = self.words.agg(F.sum("n").alias("all_n"), F.sum("flowing").alias("all_flowing"))  # one row

    def bad_forms(self) -> DataFrame:
        """``form`` and ``right`` of misread words: a form that looks alike is at least ``RATIO`` times as frequent, and the form is rare in text without line ends.

        A word that is as much at home there (``AT_HOME`` of its rate elsewhere) is a word of its own, whatever it looks like.
        """
        spelled = self.words.where(~F.col("form").contains("-") & (F.length("form") > 1) & F.col("form").rlike(r"\p{L}|†"))
        best = spelled.groupBy("outline").agg(F.max_by("form", F.struct("n", "form")).alias("right"), F.max("n").alias("most"), F.count("*").alias("forms"))
        both = spelled.join(best.where("forms > 1"), "outline").crossJoin(F.broadcast(self.total))
        read = F.greatest(F.col("all_n") - F.col("all_flowing"), F.lit(1))
        at_home = (F.col("flowing") > 0) & (F.col("flowing") * read >= AT_HOME * (F.col("n") - F.col("flowing")) * F.greatest("all_flowing", F.lit(1)))
        return both.where((F.col("form") != F.col("right")) & (F.col("most") >= RATIO * F.col("n")) & ~F.col("right").rlike(r"\d") & ~at_home).select("form", "right")

    def _line_features(self) -> DataFrame:
        lines = self.rows.where("what = 'line'").drop("what", "near").dropDuplicates(["block", "line"])
        lines = cut(lines)
        keyed = lines.where(F.length("key") >= 8)
        seen = keyed.select("paper", "key", F.coalesce("page", -F.col("block") - 2).alias("at")).distinct().groupBy("paper", "key").agg(F.count("*").alias("pages"))
        papers = seen.groupBy("key").agg(F.count("*").alias("papers"))
        seen = seen.join(papers, "key").where("pages > 1 OR papers > 2")
        numbers = lines.where("form <> '' AND page IS NOT NULL").select("paper", "form", "page", (F.col("value") - F.col("page")).alias("shift")).distinct()
        numbers = numbers.groupBy("paper", "shift", "page").agg(F.collect_set("form").alias("forms")).groupBy("paper", "shift")
        numbers = numbers.agg(F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("forms"))).alias("forms"))
        mode = numbers.where("n > 1").groupBy("paper").agg(F.max_by(F.struct("shift", "forms"), F.struct("n", "shift")).alias("mode"))
        joined = lines.join(seen, ["paper", "key"], "left").join(mode, "paper", "left")
        if self.titles is not None:
            joined = joined.join(self.titles, "paper", "left")
        else:
            joined = joined.withColumn("title", F.lit(None).cast("string"))
        follows = F.when(F.col("value") - F.col("page") == F.col("mode.shift"), 2)
        follows = follows.when(F.col("page").isNull() & F.array_contains("mode.forms", F.col("form")), 1).otherwise(0)
        return joined.select("block", "line", "place", "of", "page", "key", "form", "features", F.coalesce("pages", F.lit(1)).alias("pages"), F.coalesce("papers", F.lit(1)).alias("papers"), "title", follows.alias("follows"))

    def cuts(self) -> DataFrame:
        """``block``, ``line``, ``left``, ``mark``, ``right``, ``next`` (the block the word goes on in), ``joined``, ``word`` (as spelled) and evidence of lines that end in a mark.

        At the end of a block the word goes on in the next block of the paper with running text: captions, tables and notes may lie between, however many.
        """
        found = self.rows.where("what = 'cut'").select("block", "paper", "ord", "line", "place", "of", F.col("key").alias("left"), F.col("form").alias("mark"), F.col("near").alias("right")).dropDuplicates(["block", "line"])
        edges = self.rows.where("what = 'edge'").select("block", "paper", "ord", F.col("key").alias("kind"), "near").dropDuplicates(["block"])
        goes_on = F.when(F.col("near").isNotNull() & ~F.col("kind").isin(*_NO_RUNNING), F.struct("block", "near"))
        ahead = following(edges, goes_on, "behind").select("block", "behind")
        at_end = found.where("right IS NULL").drop("right").join(ahead, "block", "left").withColumn("right", F.col("behind.near")).withColumn("next", F.col("behind.block")).drop("behind")
        found = cut(found.where("right IS NOT NULL").withColumn("next", F.lit(None).cast("long")).unionByName(at_end))
        left, right = F.lower("left"), F.lower(F.coalesce("right", F.lit("")))
        keys = F.array(
            F.struct(F.lit("joined").alias("role"), F.concat(left, right).alias("form")),
            F.struct(F.lit("kept").alias("role"), F.concat(left, F.lit("-"), right).alias("form")),
            F.struct(F.lit("left").alias("role"), F.element_at(F.split(left, "-"), -1).alias("form")),
            F.struct(F.lit("right").alias("role"), F.split(right, "-")[0].alias("form")),
        )
        asked = found.select("block", "line", F.inline(keys)).withColumn("outline", outline_column(F.col("form")))
        best = self.words.groupBy("outline").agg(F.sum("n").alias("n"), F.max_by("form", F.struct("n", "form")).alias("word"))
        best = best.join(asked.select("outline").distinct(), "outline", "left_semi")
        told = asked.join(best, "outline", "left").groupBy("block", "line")
        told = told.pivot("role", ["joined", "kept", "left", "right"]).agg(F.first(F.coalesce("n", F.lit(0))).alias("n"), F.first("word").alias("word"))
        both = found.join(told, ["block", "line"]).crossJoin(F.broadcast(self.total))
        known = F.least("left_n", F.when(F.col("right").isNull(), F.col("left_n")).otherwise(F.col("right_n"))) >= F.greatest(F.lit(2), KNOWN * F.col("all_n"))
        spelled = F.when((F.col("joined_n") == 0) & (F.col("kept_n") == 0) | F.col("right").isNull(), "none").when(F.col("joined_n") > F.col("kept_n"), "more").otherwise("less")
        word = F.when((F.col("joined_n") > F.greatest("left_n", F.col("kept_n"))) | (F.col("joined_n") >= F.greatest(F.lit(2), KNOWN * F.col("all_n"))), F.col("joined_word"))
        return both.select(
            "block", "line", "place", "of", "left", "mark", "right", "next", F.concat("left", F.coalesce("right", F.lit(""))).alias("joined"), word.alias("word"), spelled.alias("spelled"), F.when(known, "known").otherwise("unknown").alias("halves")
        )

    def labels(self) -> tuple[DataFrame, DataFrame]:
        """``block``, ``line``, ``label`` of all lines that are not plain body, and the rows of ``cuts`` whose line is labelled as one with a broken word."""
        shared = self.spark.sparkContext.broadcast(_portable(line_model()))
        cuts = cut(self.cuts())
        ends = cuts.select("block", "line", "place", "of", F.lit(None).cast("int").alias("page"), F.col("mark").alias("key"), F.lit("cut").alias("form"), F.concat_ws("\t", F.coalesce("right", F.lit("")), "spelled", "halves").alias("features"), *[F.lit(None).cast(k).alias(n) for n, k in (("pages", "long"), ("papers", "long"), ("title", "string"), ("follows", "int"))])
        wide = self._line_features().unionByName(ends)

        def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            chain = _restored(shared.value)
            held = None
            for batch in batches:
                held = batch if held is None else pd.concat([held, batch], ignore_index=True)
                last = held.block.iloc[-1] if len(held) else None
                done = held.block != last
                yield _labelled(chain, held[done])
                held = held[~done]
            if held is not None and len(held):
                yield _labelled(chain, held)

        labels = cut(wide.repartition("block").sortWithinPartitions("block", "line").mapInPandas(label, "block long, line int, label string").where("label <> 'O'"))
        return labels.where("label <> 'break'"), cuts.join(labels.where("label = 'break'").select("block", "line"), ["block", "line"], "left_semi")

    def misread(self, bad: DataFrame) -> DataFrame:
        """``block``, ``form``, ``right`` of misread words in blocks.

        One pass over the texts: a filter of ``FILTER_BITS`` bits, of the same size however many forms there are, tells what may be one of them; a join tells what is.
        """

        def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = [_places_of(form) for batch in batches for form in batch.column(0).to_pylist()]
            if places:
                places = np.unique(np.array(places, np.int64))
                size = FILTER_BITS // FILTER_SLICES
                for k in np.unique(places // size).tolist():
                    bits = np.zeros(size, bool)
                    bits[places[places // size == k] % size] = True
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["slice", "bits"])

        def united(group: pa.Table) -> pa.Table:
            bits = np.zeros(FILTER_BITS // FILTER_SLICES // 8, np.uint8)
            for part in group.column("bits").to_pylist():
                bits |= np.frombuffer(zlib.decompress(part), np.uint8)
            return pa.table({"slice": group.column("slice")[:1], "bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})

        parts = bad.select("form").mapInArrow(slices, "slice int, bits binary").groupBy("slice").applyInArrow(united, "slice int, bits binary")
        shared = self.spark.sparkContext.broadcast(dict(map(tuple, parts.collect())))  # FILTER_SLICES rows, FILTER_BITS bits at most

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = FILTER_BITS // FILTER_SLICES // 8
            table = {k: np.frombuffer(zlib.decompress(bits), np.uint8) for k, bits in shared.value.items()}
            known: dict[str, bool] = {}

            def may_be(form: str) -> bool:
                at = _places_of(form)
                part = table.get(at // (8 * size))
                found = known[form] = part is not None and bool(part[at // 8 % size] >> (7 - at % 8) & 1)
                return found

            for batch in batches:
                if len(known) > 1_000_000:
                    known.clear()
                out: list[tuple[int, str]] = []
                for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = set(_FORM.findall(_unbroken(_lettered(text)).lower()))
                    out += [(block, w) for w in own if (known[w] if w in known else may_be(w))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], ["block", "form"])

        return self.given.select("block", "text").mapInArrow(search, "block long, form string").join(bad, "form").select("block", "form", "right")


def _places_of(form: str) -> int:
    return xxhash.xxh3_64_intdigest(form) % FILTER_BITS


_FORM = re.compile(r"[\w†]+")


def _portable(chain: Chain) -> tuple:
    return chain.features, chain.weights, chain.steps


def _restored(parts: tuple) -> Chain:
    chain = Chain(LABELS, lambda token: token.split("\t") if token else ["edge"], reach=1)
    chain.features, chain.weights, chain.steps = parts
    return chain


def _labelled(chain: Chain, rows: pd.DataFrame) -> pd.DataFrame:
    """Labels of the given lines; all lines of their blocks are in the sequence, those not given as plain ones."""
    if not len(rows):
        return pd.DataFrame({"block": [], "line": [], "label": []})
    tokens = []
    for r in rows.itertuples():
        if r.form == "cut":
            right, spelled, halves = r.features.split("\t")
            tokens.append(cut_features(r.key, right or None, spelled, halves))
        else:
            tokens.append(_hints(r.features, r.form, None if r.page != r.page else int(r.page), int(r.pages), int(r.papers), is_titled(r.key, r.title, None), int(r.follows)))
    types = {t: i for i, t in enumerate(("", *(plain_line(k, n) for k, n in ((0, 1), (0, 3), (1, 3), (2, 3)))))}
    coded = np.array([types.setdefault(t, len(types)) for t in tokens], np.int64)
    table = chain.table(list(types))
    block, of = rows.block.to_numpy(), rows.of.to_numpy().astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    run = np.cumsum(np.concatenate([[0], block[1:] != block[:-1]]))
    lengths = of[starts]
    begins = np.cumsum(lengths) - lengths
    sequence = np.full(lengths.sum(), 3)
    sequence[begins], sequence[begins + lengths - 1] = 2, 4
    sequence[begins[lengths == 1]] = 1
    at = begins[run] + rows.place.to_numpy().astype(np.int64)
    sequence[at] = coded
    place = np.arange(len(sequence)) + np.repeat(np.arange(len(starts)), lengths) + 1
    padded = np.zeros(len(sequence) + len(starts) + 1, np.int64)
    padded[place] = sequence
    labels = chain.decode(chain.emissions(table, padded, place - 1), begins, lengths)[at]
    return pd.DataFrame({"block": block, "line": rows.line.to_numpy(), "label": np.array(LABELS, object)[labels]})


NAMES = {"block": "id", "paper": "paper_id", "kind": "block_type", "page": "page_number", "order": "order_index", "text": "content"}


_SPELLED, _HANGING = re.compile(r"[^\W\d_]-$"), re.compile(r"\s*(?:and|or|und|oder|et|ou|to)\b")
RUNNING_KINDS = ("paragraph", "abstract", "list", "content_block", "unknown", "metadata", "page_number", "reference", "footnote")


def _titles(papers: DataFrame | None) -> DataFrame | None:
    if papers is None:
        return None
    return papers.select(F.col("id").cast("long").alias("paper"), F.col("title").cast("string").alias("title")).groupBy("paper").agg(F.max("title").alias("title"))


def mended(text: str, kind: str | None, printed: set[int], cuts: dict[int, str], fixes: dict[str, str]) -> str:
    """The text of a block without printed lines, with broken words joined, misread words put right, and lines of running text joined."""
    out: list[str] = []
    joins = False
    for i, line in enumerate(_lettered(text).split("\n")):
        if i in printed:
            continue
        line = line.rstrip()
        if not joins and kind in RUNNING_KINDS and out and _SPELLED.search(out[-1]) and not _HANGING.match(line):
            out[-1] += line.lstrip()
        elif not joins:
            out.append(line)
        else:
            out[-1] += line.lstrip()
        joins = i in cuts
        if joins:
            out[-1] = out[-1][:-1]
    running = kind in RUNNING_KINDS
    body = "\n".join(out)
    if running:
        body = re.sub(r"(?<=\S)[^\S\n]*\n[^\S\n]*(?=\S)(?!(?:[-*•]|\d+\.)\s)", " ", body)

    def right(m: re.Match) -> str:
        found = fixes.get(m[0].lower())
        if not found:
            return m[0]
        shown = sum(c.isupper() for c in m[0])
        return found.upper() if shown > 1 and not any(c.islower() for c in m[0]) else found.capitalize() if m[0][:1].isupper() else found

    return (_FORM.sub(right, body) if fixes else body).replace("ǃ", "!").strip()


def clean_paragraphs(blocks: DataFrame, papers: DataFrame | None = None, names: dict[str, str] = NAMES) -> DataFrame:
    """``paper``, ``place``, ``paragraph`` (its first block), ``blocks``, ``kind``, ``text``: the clean paragraphs of each paper in reading order.

    Printed lines fall away, words are mended, and a paragraph that breaks off is joined with the
    next block of running text (captions and tables may lie between them) where the
    word or the sentence goes on. Blocks of one id count once; blocks without text of their own
    have no paragraph. Whole papers are never gathered: blocks are matched by (paper, place), and
    the chains of joined blocks are followed by pointer jumping.
    """
    survey = Survey(blocks, _titles(papers), names)
    labels, broken = survey.labels()
    broken = cut(broken)
    fixes = survey.misread(cut(survey.bad_forms()))
    ends = broken.where("word IS NOT NULL").select("block", F.lower("joined").alias("form"), F.col("word").alias("right")).where("form <> right")
    fixes = fixes.unionByName(ends).dropDuplicates(["block", "form"]).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("form", "right"))).alias("fixes"))
    printed = labels.groupBy("block").agg(F.collect_set("line").alias("printed"))
    cuts = broken.groupBy("block").agg(F.collect_set("line").alias("cuts"), F.max("next").alias("next"))
    given = survey.given.dropDuplicates(["block"]).join(printed, "block", "left").join(cuts, "block", "left").join(fixes, "block", "left")

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            listed = lambda x: set() if x is None else set(map(int, x))
            texts = [mended(t, k, listed(p), dict.fromkeys(listed(c), ""), dict(f) if f is not None else {}) for t, k, p, c, f in zip(b.text, b.kind, b.printed, b.cuts, b.fixes)]
            yield pd.DataFrame({"block": b.block, "paper": b.paper, "ord": b.ord, "kind": b.kind, "next": b.next.astype("Int64"), "text": texts})

    columns = given.select("block", "paper", F.col("order").alias("ord"), "kind", "next", "text", "printed", "cuts", "fixes")
    whole = cut(columns.mapInPandas(mend, "block long, paper long, ord int, kind string, next long, text string").where("text <> ''"))
    running = whole.where(F.col("kind").isin("paragraph", "abstract", "content_block", "unknown"))
    # where a block breaks off, the next running text of the paper that begins small goes on
    ends = running.select("block", "paper", "ord", (F.col("next").isNull() & ~F.col("text").rlike(r"[.!?:;。！？)\]\"”]\s*$")).alias("open"), F.col("text").rlike(r"^[\p{Ll}\d(]").alias("small"))
    behind = following(ends, F.struct("block", "small"), "n").where("open AND n.small").select(F.col("block").alias("before"), F.col("n.block").alias("block"))
    links = whole.where("next IS NOT NULL").select(F.col("block").alias("before"), F.col("next").alias("block")).unionByName(behind)
    links = links.join(whole.select("block"), "block", "left_semi")
    heads = cut(links.groupBy("block").agg(F.min("before").alias("head")))
    while True:
        step = heads.join(heads.select(F.col("block").alias("head"), F.col("head").alias("further")), "head", "left")
        step = cut(step.select("block", F.coalesce("further", "head").alias("head"), F.col("further").isNotNull().alias("moved")))
        heads = step.select("block", "head")
        if not step.where("moved").limit(1).count():
            break
    glued = broken.where("next IS NOT NULL").select("block").distinct().withColumn("glued", F.lit(True))
    rows = whole.join(heads, "block", "left").join(glued, "block", "left").withColumn("paragraph", F.coalesce("head", "block"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "block", "text", F.coalesce("glued", F.lit(False)).alias("glued"), "kind")))
    text = F.aggregate("parts", F.struct(F.lit("").alias("t"), F.lit(True).alias("g")), lambda a, x: F.struct(F.concat(a.t, F.when(a.g, F.lit("")).otherwise(F.lit(" ")), x.text).alias("t"), x.glued.alias("g")), lambda a: a.t)
    joined = rows.groupBy("paper", "paragraph").agg(parts.alias("parts"))
    return joined.select("paper", F.col("parts")[0].ord.alias("place"), "paragraph", F.transform("parts", lambda x: x.block).alias("blocks"), F.col("parts")[0].kind.alias("kind"), text.alias("text"))


def find_noise(blocks: DataFrame, papers: DataFrame | None = None, names: dict[str, str] = NAMES) -> DataFrame:
    """``block`` and ``kind`` of noise: ``hyphen``, ``ocr``, ``header``, ``page_number``.

    ``papers`` (``id``, ``title``) helps to know headers that repeat the title. Rows of one block count
    once; null and empty texts have no noise; null pages, sections and types are allowed for. A paper
    of any size is spread by line, by (paper, key) and by block; nothing gathers a whole paper.
    """
    survey = Survey(blocks, _titles(papers), names)
    labels, broken = survey.labels()
    bad = cut(survey.bad_forms())
    found = labels.select("block", F.when(F.col("label") == "both", F.array(F.lit("header"), F.lit("page_number"))).when(F.col("label") == "header", F.array(F.lit("header"))).otherwise(F.array(F.lit("page_number"))).alias("kinds"))
    found = found.select("block", F.explode("kinds").alias("kind"))
    found = found.unionByName(broken.select("block", F.lit("hyphen").alias("kind")))
    found = found.unionByName(broken.where(F.col("word").isNotNull() & (F.lower("joined") != F.col("word"))).select("block", F.lit("ocr").alias("kind")))
    found = found.unionByName(survey.misread(bad).select("block", F.lit("ocr").alias("kind")))
    return found.distinct()
