from pyspark.sql import functions as F

from tarnwell.llm import scans

SCHEMA = "id long, paper_id long, block_type string, page_number int, order_index int, content string"


def blocks(spark):
    plain = "The retrieval model reads every document and the ranking of a document follows the retrieval model."
    rows = [(1000 + i, 9, "paragraph", 1, i, plain) for i in range(40)]  # spells the words
    head = "Letters on Page Analysis, Vol. 3, No. 2"
    order = 0
    for page in range(1, 7):
        rows += [
            (page * 10, 1, "metadata" if page % 2 else "paragraph", page, order, f"{head}\n— {page + 40} —" if page > 1 else f"— {page + 40} —"),
            (page * 10 + 1, 1, "paragraph", page, order + 1, "The retri-\neval model reads every docu-\nment, and each low-\nresource document."),
            (page * 10 + 2, 1, "table_like", page, order + 2, "Score\n12\n40"),
            (page * 10 + 3, 1, "paragraph", page, order + 3, "A low-resource docurnent follows the rank-"),
            (page * 10 + 4, 1, "figure_caption", page, order + 4, "Figure 1: a caption."),
            (page * 10 + 5, 1, "paragraph", page, order + 5, "ing of every document."),
        ]
        order += 6
    rows += [(900, 2, None, None, 0, None), (901, 2, "paragraph", None, 1, ""), (902, 2, None, None, 2, "x"), (10, 1, "metadata", 1, 0, "— 41 —")]
    return spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(0)).withColumn("kind", F.lit("clash"))


def test_noise(spark):
    found = {(r.block, r.kind) for r in scans.find_noise(blocks(spark)).collect()}
    for page in range(1, 7):
        p = page * 10
        assert (p, "page_number") in found and ((p, "header") in found) == (page > 1)
        assert (p + 1, "hyphen") in found and (p + 3, "hyphen") in found and (p + 3, "ocr") in found
        assert not {(p + 2, "page_number"), (p + 1, "ocr"), (p + 5, "hyphen"), (p + 2, "header")} & found
    assert not [f for f in found if f[0] >= 900]


def test_paragraphs(spark):
    rows = {r.paragraph: r for r in scans.clean_paragraphs(blocks(spark)).collect()}
    assert rows[11].text == "The retrieval model reads every document, and each low-resource document."
    assert rows[13].text == "A low-resource document follows the ranking of every document." and list(rows[13].blocks) == [13, 15]
    assert 10 not in rows and 15 not in rows and rows[12].text == "Score\n12\n40"


def test_empty(spark):
    assert scans.find_noise(blocks(spark).limit(0)).count() == 0 and scans.clean_paragraphs(blocks(spark).limit(0)).count() == 0


def test_parts():
    assert scans.outline("docurnent") == scans.outline("document") and scans.outline("wbcre") == scans.outline("where")
    assert scans._number("— 12 —") == ("-", 12, "") and scans._number("Page 3 of 9") == ("page of", 3, "") and scans._number("iv") == ("roman", 4, "")
    assert scans._number("12   Some Title") == ("gap", 12, "Some Title") and scans._number("Some Title   12")[:2] == ("gap", 12) and scans._number("Some title") == ("", 0, "Some title")
    assert scans.mended("A wo-\nrd and\nP. 3\nmore", "paragraph", {2}, {0: ""}, {"wo": "x"}) == "A word and more"


def test_signs_before_groups(spark):
    """A letter read as a sign is found where it belongs to a group of letters too."""
    pairs = [("base1ine", "baseline"), ("c1uster", "cluster"), ("va1idation", "validation"), ("pipe1ine", "pipeline"), ("wbcre", "where")]
    assert all(scans.outline(a) == scans.outline(b) for a, b in pairs)
    words = spark.createDataFrame([(w,) for p in pairs for w in p], "w string")
    assert all(r.o == scans.outline(r.w) for r in words.select("w", scans.outline_column(F.col("w")).alias("o")).collect())
    plain = [(100 + i, 9, "paragraph", 1, i, "The baseline model reads every cluster of the baseline and the cluster.") for i in range(40)]
    rows = [*plain, (1, 1, "paragraph", 1, 0, "The base1ine model reads every c1uster of the model.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert (1, "ocr") in {(r.block, r.kind) for r in scans.find_noise(df).collect()}
    assert {r.paragraph: r.text for r in scans.clean_paragraphs(df).collect()}[1] == "The baseline model reads every cluster of the model."


def test_real_words_that_look_alike_survive(spark):
    """A rare word that looks like a frequent one is left alone where text that was never read from a page has it too."""
    often = "The farmer had an ear of corn and did eat it, he had a clear view of the modern road and the rest of the herd had seen what the others had been told about."
    seldom = "It was a bad day for the cat, the car and the modem were bad, so the cat sat near the car while the modem was tested by somebody else in the other room of the house."
    rows = [(1000 + i, 8, "paragraph", 1, i, often) for i in range(60)] + [(2000 + i, 8, "paragraph", 1, 100 + i, seldom) for i in range(2)]
    rows += [(10 + i, 1, "paragraph", 1, i, "A bad cat had to eat near the car,\nand the modem was bad for the ear\nof the cat in the modern docurnent.") for i in range(3)]
    rows += [(3000 + i, 8, "paragraph", 1, 300 + i, "Every document names another document, and a document may be read again by everybody who had the document in his hands before that day was over.") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    fixes = scans.Survey(df, None, scans.NAMES).bad_forms()
    assert {r.form for r in fixes.collect()} == {"docurnent"}
    assert {r.block for r in scans.find_noise(df).where("kind = 'ocr'").collect()} == {10, 11, 12}
    text = {r.paragraph: r.text for r in scans.clean_paragraphs(df).collect()}
    assert "A bad cat had to eat near the car, and the modem was bad for the ear of the cat in the modern document." in text[12]


def test_a_word_goes_on_far_behind(spark):
    """However many captions and tables lie between, and over the ends of segments."""
    plain = [(5000 + i, 9, "paragraph", 1, i, "The ranking of every document follows the ranking.") for i in range(30)]
    rows = [(1, 1, "paragraph", 1, 0, "Every document follows the rank-"), *[(10 + i, 1, "table_like", 1, 1 + i, f"{i}\n{i + 1}") for i in range(3000)], (2, 1, "paragraph", 2, 3001, "ing of the next document.")]
    df = spark.createDataFrame([*plain, *rows], SCHEMA)
    found = {r.paragraph: r for r in scans.clean_paragraphs(df).where("paper = 1").collect()}
    assert found[1].text == "Every document follows the ranking of the next document." and list(found[1].blocks) == [1, 2] and 2 not in found


def test_following(spark):
    rows = [(i, i % 2, i * 700, i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "block long, paper long, ord int, good boolean")
    found = {r.block: r.n for r in scans.following(df, F.when(F.col("good"), F.col("block")), "n").collect()}
    assert found == {b: next((c for c, q, o, good in rows if q == p and o > at and good), None) for b, p, at, _ in rows}


def test_breaks_are_labels_of_the_line_model():
    chain = scans.line_model()
    joined = scans.cut_features("-", "ing", "more", "unknown")
    kept = scans.cut_features("-", "resource", "less", "known")
    assert scans.label_block(chain, [scans.plain_line(0, 3), joined, scans.plain_line(2, 3)]) == ["O", "break", "O"]
    assert scans.label_block(chain, [scans.plain_line(0, 3), kept, scans.plain_line(2, 3)]) == ["O", "O", "O"]
