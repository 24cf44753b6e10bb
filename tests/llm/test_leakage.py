import random
import re

from pyspark.sql import functions as F

from tarnwell.llm import leakage

WORD = re.compile(r"[^\W_]+")


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        for i, t in items:
            v = WORD.findall((t or "").lower())
            n = min(13, len(v))
            if n and {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
                out.add((d, i))
    return out


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ITEMS = [(1, LONG), (2, "A short item!"), (3, ""), (4, None), (5, LONG.upper().replace(" ", ", ")), (6, "...")]
DOCS = [
    (1, f"before {LONG} after"), (2, LONG.rsplit(" ", 3)[0]), (3, LONG.rsplit(" ", 2)[0].title()), (4, "It is a SHORT-item, yes"), (5, "a short thing item"), (6, None), (7, ""), (8, "x " * 50_000 + LONG), (9, LONG.split(" ", 2)[2].replace(" ", "_")),
    (10, "one two three " + LONG[14:]), (11, "a short"), (3, LONG.rsplit(" ", 2)[0].title()),
]


def test_matches_brute_force_in_blocks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("item", F.lit(0)).withColumn("n_windows", F.lit(0))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for at_once in (10, 2_000_000):
        found = leakage.leaks(docs, items, at_once=at_once)
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == sorted(brute(DOCS, ITEMS))
    assert leakage.leaks(docs, items.limit(0)).count() == 0 and leakage.leaks(docs.limit(0), items).count() == 0


def test_removal(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = leakage.without_leaks(docs, items).cache()
    rows = {r.doc_id: r for r in clean.collect()}
    assert rows[1].clean_text == "before after" and rows[1].removed_words == 15 and rows[4].clean_text == "It is yes"
    assert rows[6].clean_text is None and rows[5].clean_text == "a short thing item" and rows[11].removed_words == 0
    assert leakage.leaks(clean.withColumnRenamed("clean_text", "text"), items).count() == 0


def removed_by_brute_force(text, items):
    words = list(WORD.finditer(text or ""))
    low = [m[0].lower() for m in words]
    gone = set()
    for _, t in items:
        v = WORD.findall((t or "").lower())
        n = min(13, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(low) - n + 1 if n else 0):
            if tuple(low[k : k + n]) in windows:
                gone.update(range(k, k + n))
    ends = [*[m.start() for m in words[1:]], len(text or "")]
    return "".join([(text or "")[: words[0].start()] if words else (text or ""), *[text[m.start() : e] for i, (m, e) in enumerate(zip(words, ends)) if i not in gone]]), len(gone)


def test_removal_does_not_depend_on_blocks_of_items(spark):
    """Items that overlap in a text are found in the text as it was, whichever blocks they come in."""
    r = random.Random(4)
    vocabulary = [f"t{i}" for i in range(30)]
    base = [r.choice(vocabulary) for _ in range(400)]
    items = [(i, " ".join(base[k : k + n])) for i, (k, n) in enumerate((r.randrange(380), r.choice([2, 8, 13, 20, 30])) for _ in range(40))]
    docs = []
    for d in range(30):
        k = r.randrange(300)
        words = base[k : k + r.randint(5, 90)]
        docs.append((d, " (" + "".join(w + r.choice([" ", ", ", "\n", "İ ", "!"]) for w in words)))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {d: removed_by_brute_force(t, items) for d, t in docs}
    assert any(n for _, n in want.values())
    for at_once in (20, 200, 2_000_000):
        found = {r.doc_id: (r.clean_text, r.removed_words) for r in leakage.without_leaks(df, known, at_once=at_once).collect()}
        assert found == want
