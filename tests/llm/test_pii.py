import os
import re
import sys

import pytest
from pyspark.sql import functions as F

from tarnwell.llm import labelled, pii

sys.path.insert(0, os.path.dirname(__file__))

import heldout  # noqa: E402

NAMES = [(n, "given") for n in "Anna Peter Maria Lukas Sophie Marie Hannah Jonas Clara Emil Nora Felix".split()] + [(n, "family") for n in "Miller Schneider Hofmann Petersen Bachmann Novak Lindgren Moreau Fischer Bergmann".split()]


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(NAMES)


def found(tagger, text):
    return {(kind, " ".join(text[a:b].split())) for _, kind, a, b in tagger.spans([text])}


def test_held_out_sentences(tagger):
    """Recall and precision over sentences of other frames, with names that neither the labelled table nor the list of names holds."""
    all_cases = heldout.cases()
    assert len(all_cases) >= 200
    fixed = [p for line in (*labelled.LINES, *labelled.PLAIN) for p in re.split(r"\{\w+\}", line) if len(p.strip()) >= 24]
    assert not [p for p in fixed for text, _ in all_cases if p in text]
    good = told = true = 0
    for text, expected in all_cases:
        got = found(tagger, text)
        good, told, true = good + len(got & expected), told + len(got), true + len(expected)
    assert good / told > 0.9 and good / true > 0.85


def test_every_token_is_decoded(tagger):
    """A finding far from any other is found as near one, and portions of a list give what each text gives alone."""
    texts = ["word " * 30_000 + "write to anna.miller@example.org now", None, "", "Anna Miller wrote.", "tel. +49 30 23125 592", "a b c " * 10]
    alone = [(i, *one) for i, t in enumerate(texts) for _, *one in tagger.spans([t])]
    assert tagger.spans(texts) == alone and {i for i, *_ in alone} == {0, 3, 4}
    assert found(tagger, "Please write to zoë.müller@bücher.example soon.") == {("email", "zoë.müller@bücher.example")}
    assert pii.checked("address", "at 12 " + "Long " * 60 + "Road, Norhaven 00123.", 3, 400) == ("address", 3, 326)  # no finding is too long


def test_findings(tagger):
    text = "Dr. Anna Miller signed.\nPlease contact Jonas Schneider at jonas.schneider (at) example.org or call +49 30 23125 592 ext. 3."
    assert found(tagger, text) == {("name", "Anna Miller"), ("name", "Jonas Schneider"), ("email", "jonas.schneider (at) example.org"), ("phone", "+49 30 23125 592")}
    text = "Participant record: Nora Novak; SSN 078-05-1120; phone (212) 555-0171.\nSend signed forms by post to 12 Elmcroft Street, Apt 3B,\nNorhaven, ZX 00123."
    assert found(tagger, text) == {("name", "Nora Novak"), ("id_number", "078-05-1120"), ("phone", "(212) 555-0171"), ("address", "12 Elmcroft Street, Apt 3B, Norhaven, ZX 00123")}
    assert found(tagger, "Funded under grant no. 405-28-0427. Following Fischer et al. (2017), we report recall@10. See doi 10.5555/1234.567890 for the data.") == set()


def test_frames(spark, tagger):
    names = spark.createDataFrame(NAMES, "person_name string, name_part string")
    text = "My name is Anna\nMiller and I reviewed this section. My name is Anna Miller and I wrote."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "nothing here"), (5, ("plain words here. " * 5000) + "Questions? mailto:a.b@example.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(0)).withColumn("kind", F.lit(0))
    got = sorted(tuple(r) for r in pii.find_personal_data(df, names).collect())
    assert got == [(1, "name", "Anna Miller"), (5, "email", "a.b@example.org")]
    masked = {r.doc_id: r for r in pii.mask_personal_data(df, names).collect()}
    assert masked[1].masked_text == "My name is [NAME] and I reviewed this section. My name is [NAME] and I wrote." and masked[1].n_masked == 2
    assert masked[2].masked_text is None and masked[4].masked_text == "nothing here" and masked[5].masked_text.endswith("mailto:[EMAIL]")
    assert pii.find_personal_data(df.limit(0), names).count() == 0
