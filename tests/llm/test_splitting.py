from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.llm.splitting import MAX_CHARS, MAX_WORDS, OVERLAP, split_oversized, split_text


def check(text, pieces, overlap=OVERLAP, max_words=MAX_WORDS, max_chars=MAX_CHARS):
    held = set()
    for n, (a, b, _) in enumerate(pieces):
        piece = text[a:b]
        assert len(piece) <= max_chars and len(piece.split()) <= max_words and piece
        held.update(range(a, b))
        if n:
            before = pieces[n - 1][1]
            assert before - overlap <= a and (a <= before or text[before:a].isspace() or a == before)
            assert a < b and b > before
            if a < before and not (a == 0 or text[a - 1].isspace()):
                assert ord(text[a]) > 0x2E80  # only scripts without spaces begin within a run
    assert all(i in held or text[i].isspace() for i in range(len(text)))


SENTENCE = "The ranker reads every page before it scores the next one. "


def test_sentences_paragraphs_and_overlap():
    text = (SENTENCE * 12 + "\n\n") * 6
    pieces = split_text(text)
    check(text, pieces)
    assert {k for *_, k in pieces[:-1]} <= {"sentence", "paragraph"}
    for (a, b, _), (c, _, _) in zip(pieces, pieces[1:]):
        assert text[c:b] == text[max(a, b - OVERLAP) : b].split(" ", 1)[1] or text[c:b] == text[b - OVERLAP : b]


def test_valley_is_chosen():
    one, two = "Vectors index buckets hash projections. " * 25, "Rivers carry gravel towards the delta. " * 25
    pieces = split_text(one + two + one, max_chars=1300, overlap=50)
    assert any(abs(b - len(one.rstrip())) <= 1 for _, b, _ in pieces)


def test_hard_cases():
    for text in ("x" * 7000, "word " * 900, "字" * 5000, "字。" * 2000, "a b " * 700, "| a | b |\n" * 400, "line without end\n" * 300, " " * 3000 + "y" * 10, "e.g. x " * 600):
        check(text, split_text(text))
    assert split_text("short") == [(0, 5, "end")]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n字。-", min_size=0, max_size=400))
def test_any_text(text):
    pieces = split_text(text, max_words=12, max_chars=60, overlap=15)
    if text.strip():
        check(text, [p for p in pieces if text[p[0] : p[1]]], 15, 12, 60)


def test_frame(spark):
    rows = [("b", 1, SENTENCE * 60), ("b", 1, SENTENCE * 60), ("c", 1, "w " * 321), ("c", 2, "w " * 320), ("c", 3, None), ("c", 4, ""), ("b", 5, "x" * 2400), ("b", 6, "x" * 2401)]
    df = spark.createDataFrame(rows, "kind string, item long, content string").withColumn("piece", F.lit("clash"))
    found = split_oversized(df, ["kind", "item"]).toPandas()
    assert set(zip(found.kind, found.item)) == {("b", 1), ("c", 1), ("b", 6)}
    assert found[found.piece_index == 0].shape[0] == 3 and (found.n_words <= 320).all()
    assert split_oversized(df.limit(0), ["kind", "item"]).count() == 0
