import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import agent, chunking, evaluation, parsing, retrieval, store, units


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_store_rules(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id long, source string, title string")
    new = spark.createDataFrame([(None, "a", "n1", 1), (None, "a", "n2", 2), (None, "c", "n3", 3)], "id long, source string, title string, turn int")
    assert rows(store.upsert_keeping_least_id(stored, new, "source", "id", "turn").fillna(0, ["id"]), "id", "source", "title") == [(0, "c", "n3"), (1, "a", "n2"), (2, "a", "y"), (3, "b", "z")]
    assert rows(store.absent_rows(new.select("source", "title", "turn"), stored, ["source"], [F.col("turn")]), "source", "title") == [("c", "n3")]
    assert rows(store.latest_wins(stored, spark.createDataFrame([(9, "b", "q")], stored.schema), ["source"], ["id"]), "source", "id") == [("a", 2), ("b", 9)]
    children = spark.createDataFrame([(1, 10), (3, 30)], "parent long, n int")
    kept, left = store.delete_with_dependants(stored, children, stored.where("source = 'a'"), "id", "parent")
    assert rows(kept, "id") == [(3,)] and rows(left, "n") == [(30,)]
    assert rows(store.missing(stored, children, [("id", "parent")]), "id") == [(2,)]
    with pytest.raises(Exception, match="no row for 7"):
        store.in_order_of(spark.createDataFrame([(7, 1)], "id long, position int"), "position", "id", stored).collect()


def test_fixed_chunks_match_a_plain_loop(spark):
    texts = {1: "word " * 500, 2: "", 3: "  x\r\ny ", 4: "a" * 800, 5: "b" * 801, 6: None}
    found = rows(chunking.fixed_chunks(spark.createDataFrame(list(texts.items()), "id long, content string")), "document_id", "chunk_index", "content")
    expected = []
    for d, t in texts.items():
        t = (t or "").replace("\r\n", "\n").strip()
        at, n = 0, 0
        while t:
            piece = t[at : at + 800].strip()
            if piece:
                expected.append((d, n, piece))
                n += 1
            if at + 800 >= len(t):
                break
            at += 680
    assert found == sorted(expected)


def _index(spark):
    chunks = [(1, "sparse retrieval of pages", 1, "fixed", [1.0, 0.0]), (2, "dense retrieval", 1, "agentic", [0.0, 1.0]), (3, "pages and pages of noise", 2, "agentic_fusion", [1.0, 1.0]), (4, "nothing", 2, "fixed", None)]
    return spark.createDataFrame(chunks, "chunk_id long, content string, paper_id long, chunking_strategy string, embedding array<double>")


def _asked(spark, *extra):
    base = [("q1", "pages retrieval", [1.0, 0.0], None, None), ("q2", "retrieval", None, 1, None), ("q3", "pages", [1.0, 1.0], None, "agentic")]
    return spark.createDataFrame([*base, *extra], "query_id string, query string, vector array<double>, paper_filter long, strategy_filter string")


def test_bm25_matches_the_formula(spark):
    index, n = _index(spark), 4
    lengths = {1: 4, 2: 2, 3: 5, 4: 1}
    mean = sum(lengths.values()) / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda df, tf, d: idf(df) * tf / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / mean))
    found = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25(_asked(spark), index, 10).collect()}
    assert found["q1", 1] == pytest.approx(part(2, 1, 1) * 2, abs=1e-8)
    assert found["q1", 3] == pytest.approx(part(2, 2, 3), abs=1e-8)
    assert {c for q, c in found if q == "q2"} == {1, 2}
    assert {c for q, c in found if q == "q3"} == {3}


def test_bm25_in_blocks_is_that_of_one_block(spark):
    index, asked = _index(spark), _asked(spark, ("q4", "pages retrieval", None, None, None), ("q5", "pages", None, 2, "fixed"), ("q6", None, None, None, None))
    rows = lambda df: sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in df.collect())
    whole = rows(retrieval.bm25(asked, index, 2))
    assert whole == rows(retrieval.bm25(asked, index, 2, rows_a_block=1)) and {q for q, *_ in whole} == {"q1", "q2", "q3", "q4"}
    assert [r[1:] for r in whole if r[0] == "q1"] == [r[1:] for r in whole if r[0] == "q4"]
    same = spark.createDataFrame([(9, "pages", 1, "fixed", None), (9, "pages", 2, "fixed", None), (8, None, 1, "fixed", None)], index.schema)  # one chunk with two papers; one without a text
    found = rows(retrieval.bm25(asked, same, 5))
    assert [(q, c) for q, c, *_ in found] == [("q1", 9), ("q4", 9), ("q5", 9)] and found[0][2] == pytest.approx(2 * math.log(1 + 1.5 / 2.5) / 2.2, abs=1e-8)


def _shuffled_rows(spark):
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_hits_of_a_common_word_are_not_shuffled(spark):
    index = spark.range(600).selectExpr("id AS chunk_id", "concat('common w', id) AS content", "id % 2 AS paper_id", "'fixed' AS chunking_strategy")
    asked = spark.range(300).selectExpr("id AS query_id", "concat('common w', id) AS query", "if(id % 3 = 0, NULL, id % 2) AS paper_filter", "CAST(NULL AS string) AS strategy_filter")
    before = _shuffled_rows(spark)
    assert retrieval.bm25(asked, index, 3).count() == 900
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert _shuffled_rows(spark) - before < 20_000  # 120,000 hits


def test_dense_fused_and_reranked(spark):
    index, asked = _index(spark), _asked(spark)
    dense = {(r.query_id, r.chunk_id): r.score for r in retrieval.dense(asked, index, 10, rows_a_block=1, queries_a_block=1).collect()}
    assert dense["q1", 1] == 1.0 and dense["q1", 3] == pytest.approx((1 + math.sqrt(0.5)) / 2, abs=1e-8) and ("q2", 1) not in dense and {c for q, c in dense if q == "q3"} == {2, 3}
    fused = {(r.query_id, r.chunk_id): r for r in retrieval.hybrid(asked, index, 10).collect()}
    assert fused["q1", 1].score == pytest.approx(1 / 61 + 1 / 61, abs=1e-9) and set(fused["q1", 1].source_scores) == {"bm25", "vector"}
    best = retrieval.rerank(retrieval.hybrid(asked, index, 10), asked, index, 1).where("query_id = 'q1'").first()
    assert (best.chunk_id, best.score, best["rank"]) == (1, 1.0, 1)
    with pytest.raises(ValueError, match="unknown"):
        retrieval.search("other", asked, index)
    assert retrieval.strategy_name("hybrid", use_hyde=True, use_rerank=True) == "hybrid_hyde_rerank"
    assert retrieval.dense(asked.limit(0), index, 3).count() == 0


def test_metrics(spark):
    results = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("a", 30, 3), ("b", 5, 1)], "query_id string, item long, rank int")
    gold = spark.createDataFrame([("a", [20, 30]), ("b", [6]), ("c", [1]), ("d", [])], "query_id string, relevant array<long>")
    found = {r.query_id: r for r in evaluation.ranking_metrics(results, gold, ["query_id"], (1, 3)).collect()}
    assert set(found) == {"a", "b", "c"}
    assert (found["a"].recall_3, found["a"].mrr_3, found["a"].hit_3, found["a"].recall_1) == (1.0, 0.5, 1.0, 0.0)
    assert found["a"].ndcg_3 == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert (found["c"].recall_3, found["c"].mrr_3) == (0.0, 0.0)
    ranks = spark.createDataFrame([(1,), (3,), (None,)], "hit_rank int")
    assert evaluation.hit_summary(ranks).first().asDict() == {"total_queries": 3, "recall_1": 0.333333, "recall_3": 0.666667, "recall_5": 0.666667, "mrr": 0.444444}
    ranks = spark.createDataFrame([(1,), (4,), (None,)], "hit_rank int")
    assert evaluation.hit_summary(ranks).first().mrr == pytest.approx(1.25 / 3, abs=1e-6)
    assert evaluation.shown_accuracy(0.0, 0.5) == 0.5 and evaluation.shown_accuracy(None, 0.5) == 0.5


def test_variants_answers_and_report(spark):
    plan = spark.createDataFrame(
        [([("e", None, (["t"], []), [("v1", None, "fixed", None, None, None, True), ("v2", "bm25", None, None, None, None, None)], None)],)],
        "experiments array<struct<id: string, claim: string, subset_filter: struct<categories: array<string>, tags: array<string>>, variants: array<struct<name: string, strategy: string, chunk_strategy: string, index_name: string, generate: boolean, use_hyde: boolean, use_rerank: boolean>>, metrics: array<string>>>",
    )
    variants = evaluation.variants_of(plan)
    assert rows(variants, "variant", "strategy") == [("e::v1", "hybrid_rerank"), ("e::v2", "bm25")]
    cases = spark.createDataFrame([("1", "t", []), ("2", None, ["x"])], "id string, category string, tags array<string>")
    assert rows(evaluation.cases_of_variants(cases, variants), "id", "variant") == [("1", "e::v1"), ("1", "e::v2")]
    answers = spark.createDataFrame([("q", "v", "The  Answer", ["answer"], ["bad"], ""), ("r", "v", None, [], [], "x")], "qa_id string, variant string, answer string, must_include array<string>, must_not_include array<string>, expected string")
    judges = spark.createDataFrame([("q", "v", False, True, False, 0.5, 1), ("q", "v", True, True, False, 0.9, 2)], "qa_id string, variant string, answer_correct boolean, citation_correct boolean, unsupported_claim boolean, score double, position int")
    assert [(r.qa_id, r.correct, r.answer_correct) for r in evaluation.answer_metrics(answers, judges).orderBy("qa_id").collect()] == [("q", True, True), ("r", False, None)]
    runs = spark.createDataFrame([("v", "ok", 10.0, 1.0, True), ("v", "ok", 20.0, 0.0, None), ("v", "error", None, None, None)], "variant string, status string, latency_ms double, recall_1 double, section_hit boolean")
    summary = evaluation.variant_summary(runs, (1,)).first()
    assert (summary.ok_cases, summary.error_cases, summary.recall_1, summary.section_hit_rate, summary.latency_ms_p50) == (2, 1, 0.5, 0.5, 10.0)
    assert evaluation.report_table([{"a": 1}], [("A", "a"), ("B", "b")]) == "| A | B |\n| --- | ---: |\n| 1 |  |\n"


def test_markdown_and_lines(spark):
    text = "# Paper Title Here\n\nJane Smith and Joe Miller\n\n## Abstract\n\nShort words here that make a text.\n\n## 1 Introduction\n\nBody one.\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n![Figure 1: a plot](x.png)\n\n```\ncode = 1\n```\n\n12\n"
    df = spark.createDataFrame([(1, "p", text), (2, "q", ""), (3, "r", None), (1, "p", text)], "id long, arxiv_id string, markdown string")
    rows = parsing.blocks_of_markdown(df).where("document = 1").orderBy("order_index").collect()
    assert parsing.blocks_of_markdown(df).where("document > 1").count() == 0 and len(rows) % 2 == 0
    rows = rows[::2]  # delivered twice, the same blocks twice
    assert [r.order_index for r in rows] == list(range(len(rows))) and all(len(r.content_hash) == 64 for r in rows)
    found = [(r.block_type, r.section_name) for r in rows]
    assert found[:6] == [("title", None), ("authors", None), ("section_title", "Abstract"), ("paragraph", "Abstract"), ("section_title", "1 Introduction"), ("paragraph", "1 Introduction")]
    assert found[6] == ("table", "1 Introduction") and "12" not in [r.content for r in rows]
    lines = "A Long Title of a Paper\nAbstract\nWe show that a line is bro-\nken and goes on here.\n7\fReferences\n[1] A. Author, a work of some length."
    df = spark.createDataFrame([(1, "p", lines), (2, "q", None)], "id long, arxiv_id string, text string")
    rows = parsing.blocks_of_lines(df).orderBy("order_index").collect()
    kinds = [(r.block_type, r.content, r.page_number) for r in rows]
    assert ("paragraph", "We show that a line is broken and goes on here.", 1) in kinds and kinds[-1] == ("reference", "References [1] A. Author, a work of some length.", 2)


def test_reading_order(spark):
    layout = [(1, 1, 600.0, 310.0, 10.0, 560.0, "right"), (1, 1, 600.0, 20.0, 50.0, 280.0, "left low"), (1, 1, 600.0, 20.0, 10.0, 280.0, "left high"), (1, 1, 600.0, 20.0, 5.0, 280.0, " ")]
    df = spark.createDataFrame(layout, "document int, page int, width double, x0 double, y0 double, x1 double, text string")
    assert [r.text for r in parsing.reading_order(df).orderBy("position").collect()] == ["left high", "left low", "right"]


def _sources():
    long = "retrieval " * 90
    return [
        units.Source(1, "section_title", "1 Method", 1, 0, "## 1 Method"), units.Source(2, "paragraph", "1 Method", 1, 1, f"We use ranking as in Figure 1. {long}and it goes"), units.Source(3, "figure_caption", "1 Method", 1, 2, "Figure 1: ranking of pages by retrieval."),
        units.Source(4, "paragraph", "1 Method", 1, 3, f"on behind the figure with {long}."), units.Source(5, "table_caption", "1 Method", 2, 4, "Table 1: scores of ranking"), units.Source(6, "table", "1 Method", 2, 5, "| a | b |\n| --- | --- |\n| 1 | 2 |"), units.Source(7, "reference", "References", 2, 6, "[1] x"),
    ]


def test_units():
    found = units.units_of(1, _sources())
    kinds = [u.kind for u in found]
    assert kinds.count("figure_caption") == 1 and kinds.count("table") == 1 and "fused_evidence" in kinds
    body = next(u for u in found if u.kind == "retrieval_unit")
    assert [s.id for s in body.sources] == [1, 2, 4]  # the text goes on behind the figure
    table = next(u for u in found if u.kind == "table")
    assert [s.id for s in table.sources] == [5, 6] and units.confidence(table.text) == "high"
    assert all(7 not in [s.id for s in u.sources] for u in found)
    fused = next(u for u in found if u.kind == "fused_evidence" and "Figure 1" in u.text)
    assert len(fused.parents) == 2 and fused.score >= 0.7
    assert units.units_of(1, []) == []
    large = [units.Source(i, "paragraph", "s", 1, i, "word " * 300 + "end.") for i in range(5)]
    assert all(u.tokens <= units.MOST for u in units.units_of(1, large))
    plan = units.iterate_planner(lambda prompt: 'ok {"chunks": [{"source_block_ids": [1, 2]}, {"source_block_ids": [2, 4]}, {"source_block_ids": [3], "should_embed": false}]} end')
    assert [[s.id for s in u.sources] for u in plan(_sources())] == [[1, 2]]
    assert units.units_of(1, _sources(), planner=lambda blocks: 1 / 0)


def test_units_of_large_documents(spark):
    """A document is one whatever its size: texts, captions and doubles far apart meet as they do in a small one."""
    def kept(blocks):
        named = spark.createDataFrame([(5, "x", "arXiv ID: 1234.5678v1")], "id long, source string, content string")
        rows = [("1234.5678v1", b.id, b.kind, b.section, b.page, b.order, b.text, None) for b in blocks]
        df = spark.createDataFrame(rows, "arxiv_id string, id long, block_type string, section_name string, page_number int, order_index int, content string, markdown_content string")
        found = units.build_units(named, df).toPandas().sort_values("chunk_index")
        assert sorted(found.chunk_index) == list(range(len(found)))
        return [(u.chunk_type, u.content, [int(i) for i in u.source_block_ids]) for u in found.itertuples()]

    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    text = lambda i: " ".join(f"w{word(i)}{c}" for c in "klmnopqrst" * 10) + "."
    blocks = [units.Source(i, "paragraph", "1 Method" if i > 2040 else "0 Start", 1 + i // 40, i, text(i)) for i in range(1, 2090)]
    blocks[9] = units.Source(10, "paragraph", "0 Start", 1, 10, "Figure 7 shows it. " + text(10))
    blocks[2079] = units.Source(2080, "figure_caption", "1 Method", 52, 2080, "Figure 7: what is shown.")
    blocks[19] = units.Source(20, "figure_caption", "9 End", 1, 20, "Figure 8: a curve.")
    blocks[2069] = units.Source(2070, "figure_caption", "9 End", 52, 2070, "Figure 8: a curve, in more words.")
    found = kept(blocks)
    assert any(kind == "fused_evidence" and {10, 2080} <= set(ids) for kind, _, ids in found)
    assert [ids for kind, _, ids in found if kind == "figure_caption" and 2080 not in ids] == [[2070]]
    assert any({2047, 2048} <= set(ids) for kind, _, ids in found if kind == "retrieval_unit")
    whole = [(u.kind, u.text, [s.id for s in u.sources]) for u in units.units_of(5, blocks)]
    assert found == whole


def test_fused_doubles():
    rng, names = random.Random(5), [a + b for a in ("alpha", "beta", "gamma", "delta") for b in ("one", "two", "six", "ten", "red", "sea")]
    made = []
    for n in range(400):
        own = rng.sample(names, rng.choice([3, 14, 20]))
        if made and rng.random() < 0.5:
            own = rng.choice(made).text.split()
            own = own[: len(own) - rng.choice([0, 1, 2])] + rng.sample(names, rng.choice([0, 1]))
        made.append(units.Unit("fused_evidence", rng.choice("ab"), (), " ".join(own)))
    wanted = []
    for u in made:
        x = units.words(u.text)
        if not any(k.section == u.section and x and (y := units.words(k.text)) and len(x & y) / min(len(x), len(y)) >= 0.92 for k in wanted):
            wanted.append(u)
    assert [id(u) for u in units.distinct(made)] == [id(u) for u in wanted] and 20 < len(wanted) < 380


def test_boundaries(spark):
    df = spark.createDataFrame([(1, 0, "12\nA text that breaks", "s"), (1, 1, "off and goes on.\n## 2.1 Next", "s"), (1, 2, "Body of the next.", "2.1 Next"), (1, 3, None, "x")], "document_id long, chunk_index int, content string, section_name string")
    assert [r.content for r in units.repaired(df).orderBy("chunk_index").collect()] == ["A text that breaks off and goes on.", "## 2.1 Next\nBody of the next."]


def test_boundaries_doubles(spark):
    """Against a brute-force restatement of the rule, on chunks that nothing else touches."""
    names = [a + b for a in ("alpha", "beta", "gamma", "delta", "omega", "sigma") for b in ("one", "two", "six", "ten", "red", "sea")]
    rng, sections = random.Random(3), ["1.1 Ranking", "1.2 Scores", "1.4 Far", "2.1 Other", None]
    given = []
    for document in range(30):
        last = ""
        for index in range(12):
            own = last.rstrip(".").split() if last and rng.random() < 0.7 else rng.sample(names, rng.choice([12, 30]))
            if last and (way := rng.random()) < 0.8:
                own = rng.sample(own, len(own)) if way < 0.3 else own + rng.sample(names, 2) if way < 0.6 else own[2:]
            last = " ".join(own) + "."
            given.append((document, index, last.capitalize(), rng.choice(sections), rng.choice(["retrieval_unit"] * 5 + ["table"])))

    def double(a, b):
        if "table" in (a[4], b[4]):
            return False
        x, y = (tuple(int(n) for n in (r[3] or "").split(" ")[0].split(".") if n) for r in (a, b))
        if a[3] != b[3] and not (x and y and x[:-1] == y[:-1] and abs(x[-1] - y[-1]) == 1):
            return False
        s, t = (set(r[2].lower().rstrip(".").split()) for r in (a, b))
        short, long = sorted((a[2].lower(), b[2].lower()), key=len)
        held = short in long or any(short[i : i + 240] in long for i in range(0, len(short) - min(240, len(short)) + 1, 80))
        return len(s & t) / min(len(s), len(t)) >= 0.82 and len(short) >= 120 and held

    wanted, only_words = [], 0
    for row in given:
        if wanted and wanted[-1][0] == row[0] and double(wanted[-1], row):
            value = lambda r: (sum(w in r[2].lower() for w in (r[3] or "").lower().split()[1:]), len(r[2].split()))
            wanted[-1] = row if value(row) > value(wanted[-1]) else wanted[-1]
            continue
        only_words += bool(wanted and wanted[-1][0] == row[0] and set(wanted[-1][2].lower().split()) == set(row[2].lower().split()))
        wanted.append(row)
    assert only_words and len(wanted) < len(given) - 10
    df = spark.createDataFrame(given, "document_id long, chunk_index int, content string, section_name string, chunk_type string")
    assert sorted(tuple(r)[:3] for r in units.repaired(df).collect()) == sorted(r[:3] for r in wanted)


def test_policies(spark):
    df = spark.createDataFrame([(1, ""), (2, "hello"), (3, "aaaaaaaaaa"), (4, "How does retrieval work?"), (5, "x" * 1001), (6, "?"), (7, "2 + 2")], "id int, q string")
    found = {r.id: (r.g.reason, r.r.route, r.r.confidence) for r in df.select("id", agent.guard(F.col("q")).alias("g"), agent.route(F.col("q")).alias("r")).collect()}
    assert found[1][0] == "empty_query" and found[3][0] == "repeated_noise" and found[5][0] == "query_too_long" and found[6][0] == "not_enough_meaningful_text"
    assert found[2][1] == "direct_answer" and found[7][1] == "direct_answer" and found[4][1:] == ("local_rag", 0.9)
    outputs = spark.createDataFrame([('{"route": "direct_answer", "confidence": 2}',), ("I say local_rag",), ("{}",), ("?",)], "o string")
    assert [(r.p.route, r.p.confidence) for r in outputs.select(agent.parsed_route(F.col("o")).alias("p")).collect()] == [("direct_answer", 1.0), ("local_rag", 0.7), ("local_rag", 0.5), ("local_rag", 0.5)]
    graded = spark.createDataFrame([("What is in section 3?", ["x"], ["3 Method"]), ("latest news", ["a"], [None]), ("ranking of pages", ["pages and ranking"], [None]), ("ranking of pages", [], [])], "q string, d array<string>, s array<string>")
    assert [r.g.reason for r in graded.select(agent.grade(F.col("q"), F.col("d"), F.col("s")).alias("g")).collect()] == ["section_metadata_match", "query_requires_current_information", "signal_overlap=2/2", "no_documents"]
    assert spark.createDataFrame([('"Rewritten query: sparse pages"',)], "o string").select(agent.cleaned_rewrite(F.col("o"))).first()[0] == "sparse pages"
    asked = spark.createDataFrame([(1, "hello"), (2, "ranking of pages"), (3, "unknown matter")], "query_id int, query string")
    loop = agent.answer_loop(asked, lambda open_: open_.select("query_id", F.array(F.lit("pages and ranking")).alias("documents"), F.array(F.lit(None).cast("string")).alias("sections")), rewrite=lambda q: F.concat(q, F.lit(" again")), most_rewrites=1)
    assert rows(loop, "query_id", "status", "rewrites") == [(1, "direct", 0), (2, "answered", 0), (3, "gave_up", 1)]


def _shuffled_bytes(spark):
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_chunks_are_shuffled_once_for_queries_with_and_without_filter(spark):
    draw = random.Random(5)
    words = [f"{draw.getrandbits(60):015x}" for _ in range(3000)]
    texts = [(i, f"own{i} " + " ".join(draw.choices(words, k=60)), i % 7, "fixed") for i in range(1500)]
    index = spark.createDataFrame(texts, "chunk_id long, content string, paper_id long, chunking_strategy string")
    asked = spark.createDataFrame([(i, f"own{i}", None if i % 2 else i % 7, None) for i in range(40)], "query_id long, query string, paper_filter long, strategy_filter string")
    lexical = retrieval.lexical_index(index)
    before = _shuffled_bytes(spark)
    found = {r.query_id: r.chunk_id for r in retrieval.bm25(asked, lexical, 1, rows_a_block=200).collect()}
    assert found == {i: i for i in range(40)}
    assert _shuffled_bytes(spark) - before < 1.3 * sum(len(t[1]) for t in texts)


def _plain_lists(asked, index, top_k, score):
    """Each query against each row of the index; rows of one chunk count as one where ``score`` sums them."""
    out = {}
    for q in asked:
        hits = score(q, [r for r in index if q["paper_filter"] is None or r["paper_id"] == q["paper_filter"]])
        out[q["query_id"]] = sorted(hits, key=lambda h: (-h[1], h[0]))[:top_k]
    return out


def test_blocks_of_papers_give_what_all_rows_give(spark):
    """Small papers, a large one, no paper, chunks with two papers and chunks that come twice; queries with and without a paper."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    index = []
    for i in range(160):
        row = {"chunk_id": i, "content": " ".join(draw.choices(words, k=draw.randrange(1, 12))), "chunking_strategy": "fixed", "embedding": [draw.uniform(-1, 1) for _ in range(4)]}
        papers = [1] if i % 3 == 0 else [None] if i % 11 == 0 else [draw.randrange(2, 30)]
        index += [row | {"paper_id": p} for p in papers + ([draw.randrange(1, 30)] if i % 9 == 0 else []) + (papers if i % 40 == 0 else [])]
    asked = [{"query_id": f"q{i}", "query": " ".join(draw.choices(words, k=3)), "vector": [draw.uniform(-1, 1) for _ in range(4)], "paper_filter": [None, 1, draw.randrange(1, 32)][i % 3], "strategy_filter": None} for i in range(60)]
    n, sizes, df = len(index), [len(r["content"].split()) for r in index], {w: sum(w in r["content"].split() for r in index) for w in words}
    mean = sum(sizes) / n

    def by_words(q, held):
        found = {}
        for r in held:
            own = r["content"].split()
            for w in set(q["query"].split()) & set(own):
                tf = own.count(w)
                found[r["chunk_id"]] = found.get(r["chunk_id"], 0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
        return [(c, round(s, 9)) for c, s in found.items()]

    def by_vector(q, held):
        cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
        return [(r["chunk_id"], round((1 + cosine(q["vector"], r["embedding"])) / 2, 9)) for r in held]

    rows = spark.createDataFrame(index, "chunk_id long, content string, chunking_strategy string, embedding array<double>, paper_id long")
    queries = spark.createDataFrame(asked, "query_id string, query string, vector array<double>, paper_filter long, strategy_filter string")
    for search, score in ((retrieval.bm25, by_words), (retrieval.dense, by_vector)):
        expected = _plain_lists(asked, index, 5, score)
        for block in (10, 10_000):
            found = {}
            for r in sorted(search(queries, rows, 5, rows_a_block=block).collect(), key=lambda r: r["rank"]):
                found.setdefault(r.query_id, []).append((r.chunk_id, r.score))
            for q, hits in expected.items():
                assert [c for c, _ in found.get(q, [])] == [c for c, _ in hits]
                assert [s for _, s in found.get(q, [])] == pytest.approx([s for _, s in hits], abs=2e-9)
