"""Personal data in free text: a linear-chain conditional random field over word shapes, decoded by Viterbi in numpy batches."""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm import labelled
from tarnwell.llm.crf import Chain

MOST_NAMES, MOST_TYPES, CHARACTERS_AT_ONCE = 1_000_000, 400_000, 1 << 21

_CJK = "぀-ヿ㐀-鿿豈-﫿가-힯"
_TOKEN = re.compile(rf"\s*(?:[{_CJK}]+|[^\W\d_{_CJK}]+(?:['’][^\W\d_{_CJK}]+)*|\d+|[^\w\s]|_)")
LABELS = ["O"] + [f"{p}-{k}" for k in labelled.KINDS for p in "BI"]
_IDEOGRAPH = re.compile(rf"[{_CJK}]")


def tokens(text: str) -> list[str]:
    """The tokens of a text, each with the white space before it."""
    return _TOKEN.findall(text)


_UNLISTED = "\0"  # behind a token of the labelled table: as if the lists of names did not hold it
_FORM = "\1"  # between a digit token, the form of the whole number it belongs to, and the words before that
_COMMON = "\2"  # behind a word with capitals that the text also has in lower case
_JOINTS = frozenset("-./()+")
LONGEST_FORM = 16


_looks: dict[str, tuple[str | None, str | None, bool]] = {}


def _look(token: str) -> tuple[str | None, str | None, bool]:
    """The token's word if it is in lower case, the lower case of its word if that has capitals, and whether it is of digits."""
    word = token.lstrip()
    low = word.lower()
    return (word if word.islower() else None, low if low != word else None, word[-1].isdigit())


def _seen(token: str) -> tuple[str | None, str | None, bool]:
    if len(_looks) > MOST_TYPES:
        _looks.clear()
    found = _looks[token] = _look(token)
    return found


@lru_cache(maxsize=65_536)
def _form_features(form: str) -> tuple[str, ...]:
    total = sum(int(n) for n in re.findall(r"\d+", form))
    return ("number=" + form, f"digits={min(total, 20)}", "marks=" + "".join(sorted(set(re.sub(r"\d", "", form)))))


def with_forms(own: list[str]) -> list[str]:
    """The tokens with what the rest of their text says of them.

    A word with capitals is marked where the text also has it in lower case. Digits carry the form of
    their whole number, lengths of digits with letters and marks, such as ``3-2-4``, and the words before it.
    """
    get = _looks.get
    looks = [get(t) or _seen(t) for t in own]
    low = {x[0] for x in looks}
    low.discard(None)
    out = [t + _COMMON if x[1] in low else t for t, x in zip(own, looks)]
    digits = [i for i, x in enumerate(looks) if x[2]]
    last, k = len(own) - 1, 0

    def joins(i: int, behind: str) -> bool:
        """Whether a token may stand within a number: a mark of numbers, or capitals, more than two only where nothing is between."""
        t = own[i].lstrip()
        return t in _JOINTS or (t.isupper() and t.isascii() and (len(t) < 3 or len(t) < 7 and not behind[0].isspace()))

    while k < len(digits):
        i = j = digits[k]
        while i and j - i < LONGEST_FORM and "\n" not in own[i] and joins(i - 1, own[i]):
            i -= 1
        while j < last and j - i < LONGEST_FORM and "\n" not in own[j + 1] and (own[j + 1][-1].isdigit() or joins(j + 1, own[j + 1])):
            j += 1
        form = "".join(("_" if t[0].isspace() and n else "") + (str(len(t.lstrip())) if t[-1].isdigit() else "A" * len(t.lstrip()) if t[-1].isalpha() else t.lstrip()) for n, t in enumerate(own[i : j + 1]))
        before = [t.strip().lower() for t in own[max(0, i - 6) : i] if t[-1].isalpha()][-3:]
        form = _FORM.join([form.strip("._"), *before])
        while k < len(digits) and digits[k] <= j:
            token = own[digits[k]]
            word = token.lstrip()  # of digits only the first and their number count, so that few types arise
            out[digits[k]] = f"{token[: len(token) - len(word)]}{word[0]}{'0' * (min(len(word), 6) - 1)}{_FORM}{form}"
            k += 1
    return out


_PLAIN = str.maketrans("øđłıæœß", "odliaos")


def folded(word: str) -> str:
    """Lower case without diacritics."""
    low = word.lower()
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFKD", low.translate(_PLAIN)) if not unicodedata.combining(c))


def shape(word: str) -> str:
    first = word[0]
    if first.isdigit():
        return str(min(len(word), 6))
    if not first.isalpha():
        return "mark"
    if first > "\u3000" and _IDEOGRAPH.match(first):
        return "cjk"
    if word.islower():
        return "low"
    if word.isupper():
        return "UP" if len(word) > 1 else "U"
    return "Cap" if first.isupper() and word[1:].islower() else "Mix"


class Features:
    """Features of a token: the word, its shape, its endings, the space before it, and whether it is a known name."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family

    def __call__(self, token: str) -> list[str]:
        if not token:
            return ["edge"]
        unlisted = token.endswith(_UNLISTED)
        token, *number = token.split(_FORM)
        common = _COMMON in token
        word = token.lstrip().rstrip(_UNLISTED + _COMMON)
        space = token[: len(token) - len(token.lstrip())]
        low, form = word.lower(), shape(word)
        out = ["shape=" + form, "gap=" + ("paragraph" if space.count("\n") > 1 else "line" if "\n" in space else "space" if space else "none")]
        if form in "123456":
            form = number[0] if number else ""
            return [*out, "lead=" + word[0], *_form_features(form), *["cue=" + w for w in number[1:]], *["cue1=" + w for w in number[-1:] if len(number) > 1], *["cue2=" + " ".join(number[-2:]) for _ in number[2:3]]]
        out.append("word=" + low)
        if common:
            out += ["common", "common=" + form]
        if form == "cjk":
            out.append("end=" + low[-2:])
        elif len(low) > 4:
            low = folded(word)
            out += ["end=" + low[-3:], "end=" + low[-4:], f"end={low[-4:]}/{form}"]
            if low[:1].isalpha() and form in ("Cap", "UP"):
                out.append("long=" + form)
        if form in ("Cap", "UP", "Mix") and not unlisted:
            low = folded(word)
            parts = low.split("'")
            if low in self.given:
                out.append("given")
            if low in self.family or parts[-1] in self.family:
                out.append("family")
        return out


class Tagger:
    """A fitted chain; ``spans`` gives the personal data of texts."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        given = sorted({n for n, part in names if n and part == "given"})
        family = sorted({n for n, part in names if n and part == "family"})
        known = Features({folded(n) for n in given}, {folded(n).split()[-1] for n in family})
        self.chain = Chain(LABELS, known)
        examples = []
        rng = random.Random(3)
        for row in labelled.table(given, family):
            text = "".join(t for t, _ in row)
            kinds: list[str | None] = []
            begins = set()
            for t, kind in row:
                begins.add(len(kinds))
                kinds += [kind] * len(t)
            own, at, labels, last = tokens(text), 0, [], None
            for t in own:
                first = at + len(t) - len(t.lstrip())
                kind = kinds[first]
                same = kind is not None and kind == last and not any(b in begins for b in range(at, first + 1))
                labels.append(0 if kind is None else LABELS.index(("I-" if same else "B-") + kind))
                last = kind
                at += len(t)
            own = with_forms(own)
            for i, y in enumerate(labels):  # as in long texts: other words come in lower case too, and not every name is in the lists
                if own[i][-1].isalpha():
                    if not y and own[i].lower() != own[i] and rng.random() < 0.5:
                        own[i] += _COMMON
                    elif y and rng.random() < 0.35:
                        own[i] += _UNLISTED
            examples.append((own, labels))
        self.chain.fit(examples, epochs=16)
        self._start()

    def _start(self) -> None:
        self.types: dict[str, int] = {"": 0}
        self.table = self.chain.table([""])

    def __getstate__(self) -> dict:
        return {"chain": self.chain}

    def __setstate__(self, state: dict) -> None:
        self.chain = state["chain"]
        self._start()

    def _learn(self, new: list[str]) -> None:
        """Scores of token types not met before."""
        part = self.chain.table(new)
        known = len(self.types) - len(new)
        if known + len(new) > self.table.shape[1]:  # room for twice as many, so that most batches copy nothing
            grown = np.zeros((len(self.table), 2 * (known + len(new)), self.table.shape[2]), np.float32)
            grown[:, :known] = self.table[:, :known]
            self.table = grown
        self.table[:, known : known + len(new)] = part

    def _types(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if len(self.types) > MOST_TYPES:
            self._start()
        types, stream, counts, new, formed = self.types, [], np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            own = tokens(t) if t else []
            counts[i] = len(own)
            stream += own
            formed += with_forms(own)
        get = types.get
        numbers = [get(t, -1) for t in formed]
        if -1 in numbers:
            for i, n in enumerate(numbers):
                if n < 0:
                    t = formed[i]
                    at = get(t)
                    if at is None:
                        at = types[t] = len(types)
                        new.append(t)
                    numbers[i] = at
            self._learn(new)
        return stream, np.array(numbers, np.int64), counts

    def spans(self, texts: list[str | None]) -> list[tuple[int, str, int, int]]:
        """(text, kind, begin, end) of each finding, in order. Every token of every text is decoded; long lists in portions of whole texts."""
        found, first, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > CHARACTERS_AT_ONCE or i == len(texts) - 1:
                found += [(first + j, *one) for j, *one in self._portion(texts[first : i + 1])]
                first, size = i + 1, 0
        return found

    def _portion(self, texts: list[str | None]) -> list[tuple[int, str, int, int]]:
        stream, types, counts = self._types(texts)
        if not len(types):
            return []
        reach = self.chain.reach
        text_of = np.repeat(np.arange(len(texts)), counts)
        # texts are kept apart by padding types
        place = np.arange(len(types)) + reach * (text_of + 1)
        padded = np.zeros(len(types) + reach * (len(texts) + 1), np.int64)
        padded[place] = types
        emit = self.chain.emissions(self.table, padded, place - reach)
        firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        filled = counts > 0
        labels = self.chain.decode(emit, firsts[filled], counts[filled])
        sizes = np.fromiter(map(len, stream), np.int64, len(stream))
        begin_text = np.cumsum(sizes) - sizes
        found = []
        for i in np.flatnonzero((labels > 0) & (labels % 2 == 1)).tolist():
            j = i + 1
            while j < len(labels) and labels[j] == labels[i] + 1 and text_of[j] == text_of[i]:
                j += 1
            base = begin_text[firsts[text_of[i]]]
            begin = int(begin_text[i] - base) + len(stream[i]) - len(stream[i].lstrip())
            end = int(begin_text[j - 1] - base + sizes[j - 1])
            one = checked(LABELS[labels[i]][2:], texts[text_of[i]], begin, end)
            if one:
                found.append((int(text_of[i]), *one))
        return found


_TRIM = " \t\r\n,;:.|\"'“”(){}[]<>，。；：、/-–"
_AT, _DOT = r"(?:\s*@\s*|\s*[(\[{<]\s*at\s*[)\]}>]\s*|\s+at\s+)", r"(?:\.|\s*[(\[{<]\s*dot\s*[)\]}>]\s*|\s+dot\s+)"
_LETTER = rf"(?:(?![{_CJK}])[\w+-])"
_EMAIL = re.compile(rf"{_LETTER}(?:{_LETTER}|\.)*{_AT}(?:(?![{_CJK}_])[\w-])+(?:{_DOT}(?:(?![{_CJK}_])[\w-])+)+", re.I)
_LOCAL = re.compile(rf"(?:{_LETTER}|\.)*$")
_ID = re.compile(r"(?:[0-9A-Za-z./-]|[^\S\n]|\n(?!\s*\n))*")
_ADDRESS = re.compile(r"\d|(?:flat|apt|suite|unit|room|p\.?\s*o\.?\s*box|postfach|bp)\b|[^\s\d]+(?:\s+[^\s\d]+)?\s+\d", re.I)
_CAPITAL = re.compile(r"(?<![^\W\d_])[^\W\d_a-z][^\W\d_]+")
_FOLLOWED = re.compile(r"\s*(?:et al|\(\d{4}|and [^\W\d_]+ (?:et al|\())")


_PART = re.compile(r"[^\s,]+")
_PARTICLES = frozenset("van von de der den del della da dal di do dos das du la le los las el al bin ibn ben abu ten ter te zu zum zur af av y e i und".split()) - {"i", "und"}
_NO_NAMES = frozenset(w.lower() for w in (*labelled.WORDS, *labelled.OPENERS)) - _PARTICLES
_MODEL = re.compile(r"[^\W\d_A-Z]-?[A-Z]{2,4}$|[a-z]-[A-Z]{1,3}$")  # capitals behind a word, as in names of models


def _name_within(text: str, begin: int, end: int) -> tuple[int, int]:
    """The stretch that can be a name: from the first word that no sentence begins with, up to a small word that is no particle or to a name of a model."""
    start = stop = None
    words, last = 0, ""
    for m in _PART.finditer(text, begin, end):
        word = m[0].strip("\"'“”().;:")
        if start is not None:
            heading = "\n" in text[stop : m.start()] and not text[text.rfind("\n", 0, start) + 1 : start].strip(" #*>")
            sentence = len(last) > 2 and last.endswith(".")
            if (heading or sentence) and words > 1:
                break
            if heading or sentence:  # a line of its own, such as a heading, or the end of a sentence is not the first part of a name
                start, words = None, 0
        if start is None and (not word or word.lower() in _NO_NAMES or word in ("-", "–", "|", "/", "&")):
            continue
        if _MODEL.search(word) or (word.islower() and word not in _PARTICLES) or word in ("|", "/", "–", "-"):
            break
        start, stop = m.start() if start is None else start, m.end()
        words, last = words + 1, m[0]
    return (begin, begin) if start is None else (start, stop)


def checked(kind: str, text: str, begin: int, end: int) -> tuple[str, int, int] | None:
    """The finding without marks around it, or nothing where it lacks what its kind must have."""
    if kind == "email":
        m = _EMAIL.search(text, begin - len(_LOCAL.search(text[max(0, begin - 256) : begin])[0]), min(len(text), end + 256))
        if not m or m.start() >= end:
            return None
        begin, end = m.span()
    if kind in ("address", "name"):
        end = begin + len(re.split(r"\n\s*\n|\n--", text[begin:end].rstrip())[0])
    if kind == "name":
        begin, end = _name_within(text, begin, end)
    left = _TRIM if kind != "phone" else _TRIM.replace("(", "")
    while begin < end and text[begin] in left:
        begin += 1
    right = _TRIM.replace(".", "") if kind == "name" and re.search(r"\b[^\W\d_]\.$", text[begin:end]) else _TRIM
    while end > begin and text[end - 1] in right:
        end -= 1
    if kind == "phone" and text.count("(", begin, end) > text.count(")", begin, end):
        begin += text.startswith("(", begin)
    if kind == "id_number":
        end = begin + len(_ID.match(text[begin:end])[0].rstrip())
    own = text[begin:end]
    digits = sum(c.isdigit() for c in own)
    if kind == "phone":
        good = 7 <= digits <= 15 and not re.search(r"[^\W\d_]", own)
    elif kind == "id_number":
        good = digits >= 5
    elif kind == "address":
        good = digits > 0 and len(own) > 8 and bool(_ADDRESS.match(own))
    else:
        words = [w for w in _PART.findall(own) if _CAPITAL.search(w) and w[0].isupper() or w[:2] in ("O'", "O’", "d'", "D'")]
        good = kind == "email" or len(words) >= 2 and not digits and not _FOLLOWED.match(text, end)
    return (kind, begin, end) if good else None


_fitted: dict[int, Tagger] = {}


def tagger(names: DataFrame, name: str = "person_name", part: str = "name_part") -> Tagger:
    """The chain fitted for a list of known names, which must be a bounded one (``MOST_NAMES``)."""
    rows = sorted((r[0], r[1]) for r in names.select(name, part).where(F.col(name).isNotNull()).distinct().limit(MOST_NAMES + 1).collect())
    if len(rows) > MOST_NAMES:
        raise ValueError(f"the list of known names is sent to every task and may hold {MOST_NAMES} at most")
    key = hash(tuple(rows))
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = Tagger(rows)
    return _fitted[key]


def find_personal_data(df: DataFrame, names: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``kind``, ``surface`` of each distinct finding: as written, with each run of white space made one space.

    Whole texts are read where they lie, without a shuffle of texts. Null and empty texts have no
    findings; repeated rows give each finding once; other columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger(names))
    given = df.select(F.col(doc).alias("doc"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = sorted({(i, kind, " ".join(texts[i][a:b].split())) for i, kind, a, b in shared.value.spans(texts)})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *[pa.array([r[k] for r in rows], pa.string()) for k in (1, 2)]],
                ["doc", "kind", "surface"],
            )

    kind = given.schema["doc"].dataType.simpleString()
    return given.mapInArrow(find, f"doc {kind}, kind string, surface string").distinct().withColumnRenamed("doc", doc)


def mask_personal_data(df: DataFrame, names: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``masked_text``, ``n_masked`` of every row: a placeholder such as ``[EMAIL]`` for each finding, all else as it was. A null text stays null."""
    shared = df.sparkSession.sparkContext.broadcast(tagger(names))
    given = df.select(F.col(doc).alias("doc"), F.col(text).alias("text"))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [0] * len(texts)
            for i, kind, a, b in reversed(shared.value.spans(texts)):
                texts[i] = f"{texts[i][:a]}[{kind.upper()}]{texts[i][b:]}"
                counts[i] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["doc", "masked_text", "n_masked"])

    kind = given.schema["doc"].dataType.simpleString()
    return given.mapInArrow(mask, f"doc {kind}, masked_text string, n_masked int").withColumnRenamed("doc", doc)
