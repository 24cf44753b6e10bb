import random

from pyspark.sql import functions as F

from tarnwell.operators import boundaries

CHUNK = "id long, document_id long, chunk_index int, content string, section_name string, chunk_type string, source_block_ids array<long>"
BLOCK = "id long, paper_id long, order_index int, section_name string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, CHUNK)


def test_sources(spark):
    blocks = spark.createDataFrame(
        [
            (1, 1, 0, "1 Start", "## 1 Start"), (2, 1, 1, "1 Start", "Body of the start."), (3, 1, 2, "2 Next", "## 2 Next"), (4, 1, 3, "2 Next", "Body of the next."), (5, 1, 4, "2 Next", "17"),
            (6, 2, 0, "1 Start", "Text of another paper."), (7, 1, 5, "3 Last", "## 3 Last"), (8, 1, 6, "9 None", "## 9 None"), (9, 1, 7, "1 Start", "a.b@university.example"),
        ],
        BLOCK,
    )
    chunks = frame(
        spark,
        [
            (10, 1, 0, "old", "1 Start", "x", [2, 1, 3, 6, None, 2]),  # ends with the heading of the next
            (11, 1, 1, "old", "2 Next", "x", [4, 5, 999]),
            (12, 1, 2, "old", "3 Last", "x", [7]),  # its own heading comes back to it
            (13, 1, 3, "old", "4 Other", "x", [8]),  # no chunk of that section
            (14, 1, 4, "kept as it is.", "5 Free", "x", None),
            (15, 1, 5, "Some Title", "unknown", "x", []),
            (16, 1, 6, "old", "1 Start", "x", [9]),
        ],
    )
    found = {r.id: r for r in boundaries.sources_repaired(chunks, blocks).collect()}
    assert set(found) == {10, 11, 12, 14}
    assert (found[10].content, list(found[10].source_block_ids), found[10].chunk_index) == ("## 1 Start\n\nBody of the start.", [1, 2], 0)
    assert (found[11].content, list(found[11].source_block_ids), found[11].section_name) == ("## 2 Next\n\nBody of the next.", [3, 4], "2 Next")
    assert found[12].content == "## 3 Last" and found[14].content == "kept as it is."


def test_headings(spark):
    rows = [
        (1, 1, 0, "Body one.\n## 2 Second\nBody two.\n## 2 Second\nmore", "1 First", "x", []),
        (2, 1, 1, "No number here\n## 3 Third\nrest", None, "x", []),
        (3, 2, 0, "Ends with\n\n## 4 Fourth", "3 Third", "x", []),
        (4, 2, 1, "Its body.", "4 Fourth", "x", []),
        (5, 2, 2, "## 5 Fifth", "4 Fourth", "x", []),
        (6, 2, 3, "Elsewhere.", "7 Seventh", "x", []),
    ]
    split = boundaries.headings_split(frame(spark, rows))
    got = sorted((r.id, r.piece, r.section_name, r.content) for r in split.where("document_id = 1").collect())
    assert got == [(1, 0, "1 First", "Body one."), (1, 1, "2 Second", "## 2 Second\nBody two."), (1, 2, "2 Second", "## 2 Second\nmore"), (2, 0, None, "No number here\n## 3 Third\nrest")]
    moved = {r.id: (r.section_name, r.content) for r in boundaries.headings_moved(split.where("document_id = 2")).collect()}
    assert moved == {3: ("3 Third", "Ends with"), 4: ("4 Fourth", "## 4 Fourth\n\nIts body."), 6: ("7 Seventh", "Elsewhere.")}


def test_trimmed(spark):
    rows = [(1, 1, 0, "12\n\nText stays\n7\nand goes on.\nPage 3 of 9\n", "s", "x", []), (2, 1, 1, "4\n5", "s", "x", []), (3, 1, 2, None, "s", "x", [])]
    assert {r.id: r.content for r in boundaries.trimmed(frame(spark, rows)).collect()} == {1: "Text stays\n7\nand goes on."}


def joined_by_hand(rows):
    """What each open chunk takes in, by going through the chunks one by one."""
    taken, out = set(), {}
    for i, (open_end, visual, section) in enumerate(rows):
        if not open_end or visual or i in taken:
            continue
        for j in range(i + 1, min(i + 4, len(rows))):
            if j in taken or rows[j][1]:
                continue
            if rows[j][2] == section:
                taken.add(j)
                out[i] = j
            break
    return out, taken


def test_sentences(spark):
    r = random.Random(3)
    chunks, expected = [], {}
    for document in range(12):
        flags = [(r.random() < 0.5, r.random() < 0.3, r.choice("ab")) for _ in range(40)]
        pairs, taken = joined_by_hand(flags)
        text = [("Table 1 of values" if v else f"words {i}") + (" and" if o else " end.") for i, (o, v, _) in enumerate(flags)]
        for i, (_, visual, section) in enumerate(flags):
            chunks.append((document * 100 + i, document, i, text[i], section, "table" if visual else "x", [i]))
            if i not in taken:
                expected[document * 100 + i] = text[i] + (f"\n\n{text[pairs[i]]}" if i in pairs else "")
    found = boundaries.sentences_joined(frame(spark, chunks).withColumn("piece", F.lit(0)))
    assert {x.id: x.content for x in found.collect()} == expected


def test_all_passes_and_empty_tables(spark):
    none = frame(spark, [(1, 1, 0, "x", "s", "x", [1])]).limit(0)
    blocks = spark.createDataFrame([(1, 1, 0, "1 A", "We go on with"), (2, 1, 1, "1 A", "the rest of it."), (3, 1, 2, "2 B", "## 2 B"), (4, 1, 3, "2 B", "Body.")], BLOCK)
    assert boundaries.validated(none, blocks).count() == 0
    found = boundaries.validated(frame(spark, [(1, 1, 0, "", "1 A", "x", [1]), (2, 1, 1, "", "1 A", "x", [2, 3]), (3, 1, 2, "", "2 B", "x", [4]), (3, 1, 2, "", "2 B", "x", [4])]).dropDuplicates(["id"]), blocks)
    assert {r.id: (r.section_name, r.content) for r in found.collect()} == {1: ("1 A", "We go on with\n\nthe rest of it."), 3: ("2 B", "## 2 B\n\nBody.")}
