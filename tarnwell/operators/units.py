"""Retrieval units of a paper: its blocks planned, merged, split, parted from figures and tables, and fused with them again.

Every step looks at what the steps before left of the same document, so a document is folded as a
whole, whatever its size: one task holds its blocks. What looks over the whole document (coverage, figures and
tables with the text that names them, doubles) goes by section, reference, page and word, not over all pairs.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import text as T
from tarnwell.operators.chunking import documents_by_arxiv

LEAST, TARGET, MOST, TINY, SHARED, SAME = 180, 400, 800, 50, 0.5, 0.92
UNIT = (
    "document_id long, chunk_index int, content string, token_count int, content_hash string, chunk_type string, section_name string, source_block_ids array<long>, "
    "chunking_strategy string, visual_refs array<string>, quality_flags array<string>, page_from int, page_to int, table_confidence string, source_chunk_ids array<string>, fusion_score double"
)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
FIGURES, TABLES = ("figure_caption",), ("table", "table_caption")
LEFT_OUT = ("reference", "footnote", "figure", "authors", "affiliation", "metadata", "page_number", "date", "image_reference")

_REF = re.compile(r"(?i)\b(?:(figure|fig\.?)|table)\s*(\d+)\b")
_CAPTION = re.compile(r"(?i)^(?:figure|fig\.|table)\s*\d+[:.]")
_NUMBER = re.compile(r"^(\d+(?:\.\d+)*)")
_WORD = re.compile(r"[a-z][\w-]{2,}")
_OPEN_END = re.compile(r"(?i)\band\s*\(\d+\)\s*$")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_TOKEN = re.compile(r"[a-z][a-z0-9_-]{2,}")
_HEADING = re.compile(r"##\s+\d+(?:\.\d+)*\s+.+$")
_VISUAL = re.compile(r"(?i)(?:(?:figure|fig\.)\s*\d+[:.\s]|table )")
STOP = frozenset("the and for with that this from are was were has have its our which when where into than then they their there been also such".split())


@dataclass(frozen=True)
class Source:
    id: int
    kind: str
    section: str
    page: int | None
    order: int
    text: str


@dataclass(frozen=True)
class Unit:
    kind: str
    section: str
    sources: tuple[Source, ...]
    text: str
    strategy: str = "agentic"
    parents: tuple[str, ...] = ()
    score: float | None = None

    @cached_property
    def tokens(self) -> int:
        return max(1, len(self.text.split()))

    @cached_property
    def visual(self) -> bool:
        return self.kind in ("figure_caption", "table")

    @cached_property
    def order(self) -> int:
        return min((s.order for s in self.sources), default=0)

    @cached_property
    def pages(self) -> list[int]:
        return sorted({s.page for s in self.sources if s.page is not None})


@lru_cache(maxsize=4096)
def _refs(text: str) -> tuple[str, ...]:
    return tuple(("Fig. " if m[1] else "Table ") + m[2] for m in _REF.finditer(text))


def refs(text: str) -> list[str]:
    return list(_refs(text))


def ended(text: str, marks: str) -> bool:
    return text.rstrip()[-1:] in tuple(marks)


@lru_cache(maxsize=4096)
def words(text: str) -> frozenset[str]:
    return frozenset(_WORD.findall(text.lower())) - STOP


def similarity(a: str, b: str) -> float:
    x, y = words(a), words(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def lane(kind: str) -> str:
    return "figure" if kind in FIGURES else "table" if kind in TABLES else "body"


def related(a: str, b: str) -> bool:
    """The same section, or one directly below the other by number."""
    if a == b:
        return True
    x, y = _NUMBER.match(a), _NUMBER.match(b)
    return bool(x and y and (x[1].startswith(y[1] + ".") or y[1].startswith(x[1] + ".")))


def joined(units: list[Unit]) -> Unit:
    """Units as one: their blocks in reading order, each once, under the section of the longest."""
    sources = sorted({s.id: s for u in units for s in u.sources}.values(), key=lambda s: (s.order, s.id))
    longest = max(units, key=lambda u: u.tokens)
    return replace(longest, sources=tuple(sources), text="\n\n".join(s.text for s in sources) if sources else "\n\n".join(u.text for u in units))


def planned(blocks: list[Source], most: int = MOST) -> list[Unit]:
    """The rule planner: runs of one section and lane up to the limit; a heading goes with the text behind it, a table with its caption."""
    out: list[Unit] = []
    run: list[Source] = []

    def flush() -> None:
        if run and any(s.kind != "section_title" for s in run):
            where = lane(next(s.kind for s in run if s.kind != "section_title"))
            out.append(Unit({"figure": "figure_caption", "table": "table"}.get(where, "retrieval_unit"), run[-1].section, tuple(run), "\n\n".join(s.text for s in run)))
        run.clear()

    for s in blocks:
        if run:
            body = [r for r in run if r.kind != "section_title"]
            size = sum(len(r.text.split()) for r in run) + len(s.text.split())
            if s.kind == "section_title" or s.section != run[-1].section or body and lane(body[-1].kind) != lane(s.kind) or size > most or lane(s.kind) == "figure" and body:
                flush()
        run.append(s)
    flush()
    return out


def merged_small(units: list[Unit]) -> list[Unit]:
    """Short units join a neighbour of the same or a related section: one that keeps to the target, else one that keeps to the limit."""
    out, i = list(units), 0
    while i < len(out):
        u = out[i]
        if u.tokens < LEAST and not u.visual and not re.search(r"(?i)abstract|introduction", u.section):
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(out) and not out[j].visual and related(u.section, out[j].section)]
            pick = next((j for limit in (TARGET, MOST) for j in near if u.tokens + out[j].tokens <= limit), None)
            if pick is not None:
                a = min(i, pick)
                out[a : a + 2] = [joined(out[a : a + 2])]
                i = max(a - 1, 0)
                continue
        i += 1
    return out


def covered(units: list[Unit], blocks: list[Source]) -> list[Unit]:
    """Blocks that no unit holds go to the first unit of their section at or behind them, else to any of it, else to one of their own."""
    held = {s.id for u in units for s in u.sources}
    out = list(units)
    places: dict[str, list[int]] = {}
    for i, u in enumerate(out):
        if not u.visual:
            places.setdefault(u.section, []).append(i)
    orders = {section: [out[i].order for i in own] for section, own in places.items()}
    rising = {section: all(a <= b for a, b in zip(o, o[1:])) for section, o in orders.items()}
    for s in blocks:
        if s.id in held or s.kind == "section_title" or lane(s.kind) != "body":
            continue
        one = Unit("retrieval_unit", s.section, (s,), s.text)
        if s.section not in places:
            places[s.section], orders[s.section], rising[s.section] = [len(out)], [s.order], True
            out.append(one)
        else:
            own, o = places[s.section], orders[s.section]
            k = bisect_left(o, s.order) if rising[s.section] else next((k for k, x in enumerate(o) if x >= s.order), len(o))
            k = k if k < len(o) else 0
            out[own[k]] = joined([out[own[k]], one])
            o[k] = min(o[k], s.order)
        held.add(s.id)
    return sorted(out, key=lambda u: u.order)


def merged_overlapping(units: list[Unit]) -> list[Unit]:
    out: list[Unit] = []
    for u in units:
        if out and out[-1].section == u.section:
            a, b = {s.id for s in out[-1].sources}, {s.id for s in u.sources}
            if a and b and len(a & b) / min(len(a), len(b)) >= SHARED:
                out[-1] = joined([out[-1], u])
                continue
        out.append(u)
    return out


def split_large(units: list[Unit]) -> list[Unit]:
    """Units above the limit are cut between blocks, or between paragraphs of a block, not behind an open ``and (n)``."""
    out = []
    for u in units:
        if u.tokens <= MOST or u.visual:
            out.append(u)
            continue
        parts = [(s, p) for s in u.sources for p in (s.text.split("\n\n") if len(s.text.split()) > MOST else [s.text])]
        held: list[tuple[Source, str]] = []
        for s, p in parts:
            size = sum(len(t.split()) for _, t in held)
            if held and size + len(p.split()) > MOST and not _OPEN_END.search(held[-1][1]):
                out.append(replace(u, sources=tuple(dict.fromkeys(x for x, _ in held)), text="\n\n".join(t for _, t in held)))
                held = []
            held.append((s, p))
        if held:
            out.append(replace(u, sources=tuple(dict.fromkeys(x for x, _ in held)), text="\n\n".join(t for _, t in held)))
    return out


def parted(units: list[Unit]) -> list[Unit]:
    """Body text apart from figures and tables; the parts of one table are one unit."""
    out: list[Unit] = []
    for u in units:
        body = [s for s in u.sources if lane(s.kind) == "body"]
        visual = [s for s in u.sources if lane(s.kind) != "body"]
        if not visual:
            out.append(u)
            continue
        if any(s.kind != "section_title" for s in body):
            out.append(replace(u, kind="retrieval_unit", sources=tuple(body), text="\n\n".join(s.text for s in body)))
        tables: dict[str, list[Source]] = {}
        pending: list[Source] = []
        for s in visual:
            if s.kind in FIGURES:
                out.append(replace(u, kind="figure_caption", sources=(s,), text=s.text))
            elif s.kind == "table_caption":
                pending.append(s)
            else:
                name = next(iter(refs(" ".join(p.text for p in [*pending, s]))), f"#{s.id}")
                tables.setdefault(name, []).extend([*pending, s])
                pending = []
        for p in pending:
            tables.setdefault(next(iter(refs(p.text)), f"#{p.id}"), []).append(p)
        out += [replace(u, kind="table", sources=tuple(own), text="\n\n".join(s.text for s in own)) for own in tables.values()]
    return out


def rejoined(units: list[Unit]) -> list[Unit]:
    """Body text that breaks off before figures or tables goes on behind them, within four units and a page."""
    out = list(units)
    i = 0
    while i < len(out):
        if not out[i].visual:
            for j in range(i + 2, min(i + 6, len(out))):
                if not all(out[k].visual for k in range(i + 1, j)):
                    break
                if out[j].visual:
                    continue
                a, b = out[i], out[j]
                near = not a.pages or not b.pages or abs(b.pages[0] - a.pages[-1]) <= 1
                unfinished = not ended(a.text, ".!?:;。！？)")
                if a.section == b.section and near and (unfinished or b.text[:1].islower()) and a.tokens + b.tokens <= MOST:
                    out[i] = joined([a, b])
                    del out[j]
                break
        i += 1
    return out


def confidence(text: str) -> str:
    rows = [x for x in text.split("\n") if "|" in x]
    return "high" if len(rows) > 1 and len({x.count("|") for x in rows}) == 1 and any("---" in x for x in rows) else "low"


def one_visual_each(units: list[Unit]) -> list[Unit]:
    """Of figures or tables with the same references in one section the best stays: regular tables, then longer ones, then earlier ones."""
    best: dict[tuple, Unit] = {}
    for u in units:
        if u.visual and (own := tuple(sorted(set(refs(u.text))))):
            value = lambda x: (2 if x.kind == "table" and confidence(x.text) == "high" else 0 if x.kind == "table" else 1, "|" in x.text, x.tokens)
            key = (u.section, u.kind, own)
            if key not in best or value(u) > value(best[key]):
                best[key] = u
    keep = {id(u) for u in best.values()}
    return [u for u in units if not u.visual or not refs(u.text) or id(u) in keep]


def unit_hash(document: int, u: Unit, index: int) -> str:
    return hashlib.sha256(f"{u.strategy}:{document}:{index}:{u.kind}:{u.text}".encode()).hexdigest()


def fused(document: int, units: list[Unit]) -> list[Unit]:
    """Each figure or table with the body text that names it or, within its section and a page, resembles it most."""
    hashes = [unit_hash(document, u, i) for i, u in enumerate(units)]
    by_ref: dict[str, list[int]] = {}
    by_page: dict[tuple[str, int | None], list[int]] = {}
    by_section: dict[str, list[int]] = {}
    pages, sizes = [u.pages for u in units], [0 if u.visual else len(words(u.text)) for u in units]
    for i, u in enumerate(units):
        if not u.visual:
            by_section.setdefault(u.section, []).append(i)
            for q in pages[i] or [None]:
                by_page.setdefault((u.section, q), []).append(i)
            for r in set(refs(u.text)):
                by_ref.setdefault(r, []).append(i)
    found: dict[tuple[str, str], Unit] = {}
    for i, v in enumerate(units):
        if not v.visual or v.kind == "table" and confidence(v.text) == "low":
            continue
        near = lambda j: min((abs(p - q) for p in pages[i] for q in pages[j]), default=0)
        total = lambda j, alike, named: round(min(1.0, alike + max(0.0, 0.2 - 0.1 * near(j)) + 0.2 * (units[j].section == v.section) + 0.7 * named), 3)
        mine = words(v.text)
        best: tuple[float, int] | None = None
        naming = sorted({j for r in set(refs(v.text)) for j in by_ref.get(r, ())})
        for j in [j for j in naming if units[j].section == v.section] or naming:
            few, many = sorted((len(mine), sizes[j]))
            if best is not None and total(j, few / max(many, 1), True) <= best[0]:  # however alike
                continue
            if best is None or total(j, similarity(units[j].text, v.text), True) > best[0]:
                best = total(j, similarity(units[j].text, v.text), True), j
            if best[0] >= 1.0:  # none has more, and of equal ones the first is taken
                break
        if best is None and "conclusion" not in v.section.lower():
            close = {j for p in pages[i] for q in (p - 1, p, p + 1, None) for j in by_page.get((v.section, q), ())} if pages[i] else by_section.get(v.section, ())
            scored = [(s, -j) for j in close if (s := total(j, similarity(units[j].text, v.text), False)) >= 0.18]
            if scored:
                best = max(scored)[0], -max(scored)[1]
        if best is not None:
            score, j = best
            b = units[j]
            text = f"{b.text}\n\nRelated visual/table evidence:\n{v.text}"
            found[hashes[j], hashes[i]] = Unit("fused_evidence", b.section, tuple(sorted({s.id: s for s in (*b.sources, *v.sources)}.values(), key=lambda s: (s.order, s.id))), text, "agentic_fusion", (hashes[j], hashes[i]), score)
    return sorted(distinct(sorted(found.values(), key=lambda u: (-(u.score or 0), -u.tokens, u.order))), key=lambda u: u.order)


def distinct(units: list[Unit]) -> list[Unit]:
    """Units without those that share ``SAME`` of the words of the smaller with one of their section before them.

    Of the smaller's words at most 1 - ``SAME`` are not in the other, so one of that many and two of its rarest is:
    a unit is compared with those alone that hold a rarest word of it, or have a rarest word that it holds.
    """
    parts: dict[str, list[Unit]] = {}
    for u in units:
        parts.setdefault(u.section, []).append(u)
    use: set[int] = set()
    for own in parts.values():
        sets = [words(u.text) for u in own]
        counts = Counter(w for x in sets for w in x)
        holding: dict[str, list[int]] = {}
        rarest: dict[str, list[int]] = {}
        for n, x in enumerate(sets):
            few = sorted(x, key=lambda w: (counts[w], w))[: int((1 - SAME) * len(x)) + 2]
            rivals = {k for w in few for k in holding.get(w, ())} | {k for w in x for k in rarest.get(w, ())}
            if any(len(x & sets[k]) / min(len(x), len(sets[k])) >= SAME for k in rivals):
                continue
            use.add(id(own[n]))
            for w in x:
                holding.setdefault(w, []).append(n)
            for w in few:
                rarest.setdefault(w, []).append(n)
    return [u for u in units if id(u) in use]


def flags(u: Unit) -> list[str]:
    out = []
    if u.tokens < TINY:
        out.append("short_content")
    if not u.visual and not ended(u.text, '.!?:;。！？)]|`"'):
        out.append("unfinished_sentence")
    if re.search(r"[a-z,]\s+(?:Figure|Fig\.|Table)\s*\d+[:.]\s", u.text):
        out.append("caption_inside_sentence")
    if u.kind == "table" and confidence(u.text) == "low":
        out.append("irregular_table")
    if "formula-not-decoded" in u.text:
        out.append("missing_formula")
    return out


def cleaned(units: list[Unit]) -> list[Unit]:
    """Tiny units join the one before of their section, else the one behind."""
    out: list[Unit] = []
    held: Unit | None = None
    for u in units:
        if held is not None and not u.visual and related(held.section, u.section):
            u, held = joined([held, u]), None
        if u.tokens >= TINY or u.visual or re.match(r"[A-Za-z]", u.text) and u.tokens >= 6:
            out.append(u)
        elif out and not out[-1].visual and out[-1].section == u.section:
            out[-1] = joined([out[-1], u])
        else:
            held = u
    return out


Planner = Callable[[list[Source]], list[Unit]]


def units_of(document: int, blocks: list[Source], planner: Planner = planned) -> list[Unit]:
    """All steps for one document, without its noise. A planner that fails or plans nothing gives way to the rule planner."""
    usable = [s for s in blocks if s.kind not in LEFT_OUT and s.text.strip()]
    try:
        units = planner(usable) or planned(usable)
    except Exception:  # noqa: BLE001 - a plugged-in planner may raise anything
        units = planned(usable)
    units = cleaned(merged_small(units))
    for step in (lambda u: covered(u, usable), merged_overlapping, merged_small, split_large, parted, rejoined, one_visual_each):
        units = step(units)
    return units + fused(document, units)


def build_units(documents: DataFrame, blocks: DataFrame, planner: Planner = planned) -> DataFrame:
    """Units of every document with blocks, originals first and fused evidence behind them, numbered within the document."""
    text = F.coalesce(F.nullif("markdown_content", F.lit("")), "content")
    blocks = blocks.where(F.col("block_type").isin(*TABLES) | ~F.coalesce(T.is_noise(text), F.lit(True)))
    placed = blocks.join(documents_by_arxiv(documents), "arxiv_id").select(
        "document_id", "id", "block_type", F.coalesce(F.nullif("section_name", F.lit("")), F.lit("unknown")).alias("section"), "page_number", "order_index", text.alias("text")
    )
    columns = {name: _ARROW[kind] for name, kind in (c.split() for c in UNIT.split(", "))}

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        document = key[0].as_py()
        own = sorted(zip(*(rows.column(c).to_pylist() for c in ("order_index", "id", "block_type", "section", "page_number", "text"))), key=lambda r: r[:2])
        out = []
        for n, u in enumerate(units_of(document, [Source(i, k, s, p, o, t or "") for o, i, k, s, p, t in own], planner)):
            seen, pages = refs(u.text), u.pages
            out.append((
                document, n, u.text, u.tokens, unit_hash(document, u, n), u.kind, u.section, [s.id for s in u.sources], u.strategy, seen, flags(u), pages[0] if pages else None, pages[-1] if pages else None,
                confidence(u.text) if u.kind == "table" else None, list(u.parents), u.score,
            ))
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * len(columns), columns.values())], names=list(columns))

    return placed.groupBy("document_id").applyInArrow(build, UNIT)


def tokens_of(text: str) -> frozenset[str]:
    return frozenset(_TOKEN.findall(_CONTROL.sub("", text).lower()))


def holds_long_part(a: str, b: str, window: int = 240, step: int = 80, least: int = 120) -> bool:
    """Whether the longer text holds the shorter, or a window of it with eight words or more; headings do not count."""
    a, b = (" ".join(re.sub(r"(?m)^##\s*\d+(?:\.\d+)*\s+.*$", " ", _CONTROL.sub("", x)).split()).lower() for x in (a, b))
    if min(len(a), len(b)) < least:
        return False
    shorter, longer = sorted((a, b), key=len)
    size = min(len(shorter), window)
    parts = [shorter, *(shorter[i : i + size] for i in range(0, max(1, len(shorter) - size + 1), step))]
    return any(x in longer and len(tokens_of(x)) >= 8 for x in parts)


def visual_text(kind: str | None, text: str) -> bool:
    return kind in ("figure_caption", "table") or bool(_VISUAL.match(text)) or "|" in text and "---" in text


def beside(a: str | None, b: str | None) -> bool:
    """The same section, or neighbours by number under one parent."""
    if (a or "unknown").strip().lower() == (b or "unknown").strip().lower():
        return True
    x, y = (re.match(r"\s*(\d+(?:\.\d+)*)\b", s or "") for s in (a, b))
    if not x or not y:
        return False
    x, y = ([int(n) for n in m[1].split(".")] for m in (x, y))
    return x[:-1] == y[:-1] and abs(x[-1] - y[-1]) == 1


def doubled(a: tuple, b: tuple) -> bool:
    """Whether of two neighbouring (content, section, kind) one says what the other does: nearly the same words, a long part word for word, and neither a figure or table."""
    if visual_text(a[2], a[0]) or visual_text(b[2], b[0]) or not beside(a[1], b[1]):
        return False
    x, y = tokens_of(a[0]), tokens_of(b[0])
    return bool(x and y) and len(x & y) / min(len(x), len(y)) >= 0.82 and holds_long_part(a[0], b[0])


def title_match(section: str | None, text: str) -> int:
    """How many words of its section's title a text holds, and 10 if it begins with that heading."""
    bare = lambda x: re.sub(r"^\d+(?:\.\d+)*\s+", "", " ".join(re.sub(r"^\s*##\s+", "", x).lower().split()))
    title = set(_TOKEN.findall(re.sub(r"^\s*\d+(?:\.\d+)*\s*", "", (section or "").lower()))) - {"the", "and", "for"}
    first = text.split("\n")[0].strip()
    return sum(w in text.lower() for w in title) + (10 if title and _HEADING.match(first) and bare(first) == bare(section or "") else 0)


def repaired(chunks: DataFrame) -> DataFrame:
    """Chunk boundaries put right within each document: noise lines trimmed, trailing headings moved on, doubles dropped.

    ``chunks`` has ``document_id``, ``chunk_index``, ``content``, ``section_name``, and may have ``chunk_type``; a
    document's chunks are folded in order. Of doubles the one that fits its section's title better stays, else the longer.
    """
    schema = "document_id long, chunk_index int, content string, section_name string"

    def fix(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("chunk_index")
        out: list[list] = []
        kinds: list[str | None] = []
        carried = ""
        for index, content, section, kind in zip(own.chunk_index, own.content, own.section_name, own.chunk_type):
            lines = (content or "").split("\n")
            if carried:
                lines, carried = [carried, *lines], ""
            if len(lines) > 1 and re.match(r"^##\s+\d+(?:\.\d+)*\.?\s+\S", lines[-1]):
                carried = lines.pop()
            text = "\n".join(lines).strip()
            if not text:
                continue
            if out and doubled((*out[-1][2:], kinds[-1]), (text, section, kind)):
                value = lambda s, x: (title_match(s, x), len(x.split()))
                if value(section, text) > value(out[-1][3], out[-1][2]):
                    out[-1], kinds[-1] = [int(key[0]), int(index), text, section], kind
                continue
            if out and out[-1][3] == section:
                if not re.search(r"[.!?:;。！？)\]|`\"]\s*$", out[-1][2]) and text[:1].islower() and not _CAPTION.match(text):
                    out[-1][2] = f"{out[-1][2]} {text}"
                    continue
            out.append([int(key[0]), int(index), text, section])
            kinds.append(kind)
        if carried and out:
            out[-1][2] += f"\n{carried}"
        return pd.DataFrame(out, columns=["document_id", "chunk_index", "content", "section_name"])

    # noise lines at either end fall away; of nothing but noise the last line stays
    lines = F.split("content", "\n")
    good = F.transform(lines, lambda x: ~T.is_noise(x))
    first, behind = F.array_position(good, True), F.array_position(F.reverse(good), True)
    trimmed = F.when(first > 0, F.array_join(F.slice(lines, first.cast("int"), (F.size(lines) - behind - first + 2).cast("int")), "\n")).otherwise(F.element_at(lines, -1))
    given = chunks.select("document_id", F.col("chunk_index").cast("int"), trimmed.alias("content"), "section_name", F.col("chunk_type") if "chunk_type" in chunks.columns else F.lit(None).cast("string").alias("chunk_type"))
    return given.groupBy("document_id").applyInPandas(fix, schema)


def iterate_planner(plan: Callable[[str], str]) -> Planner:
    """A planner from a model that maps a prompt of numbered blocks to JSON with ``chunks`` of ``source_block_ids``; adjacent known ids only."""
    import json

    def run(blocks: list[Source]) -> list[Unit]:
        by_id, place = {s.id: s for s in blocks}, {s.id: i for i, s in enumerate(blocks)}
        answer = plan("\n".join(f"[{s.id}] ({s.kind}) {s.text}" for s in blocks))
        found = re.search(r"\{.*\}", answer, re.S)
        items = json.loads(found[0]).get("chunks", []) if found else []
        out: list[Unit] = []
        for item in items:
            ids = sorted({int(i) for i in item.get("source_block_ids", []) if int(i) in by_id}, key=lambda i: place[i])
            if ids and place[ids[-1]] - place[ids[0]] + 1 == len(ids) and item.get("should_embed", True):
                own = tuple(by_id[i] for i in ids)
                kinds = {lane(s.kind) for s in own}
                out.append(Unit("figure_caption" if kinds == {"figure"} else "table" if kinds == {"table"} else "retrieval_unit", item.get("section_name") or own[0].section, own, "\n\n".join(s.text for s in own)))
        return sorted(out, key=lambda u: u.order)

    return run


