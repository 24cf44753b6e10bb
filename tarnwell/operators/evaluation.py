"""Scores of ranked results against gold cases: all cases and variants in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions.measures import ideal_gain, mean4, nearest_rank, share_of_known, share_true
from tarnwell.functions.text import normal

TOP_K = (1, 3, 5, 10)


def gold_ids(strategy: Column) -> Column:
    """Gold chunks of a case for a chunking strategy: its own list where that is not empty, else the general one."""
    own = F.try_element_at(F.col("gold_chunk_ids_by_strategy"), strategy)
    return F.array_distinct(F.when(F.size(own) > 0, own).otherwise(F.coalesce("gold_chunk_ids", F.array().cast("array<long>"))))


def variants_of(plan: DataFrame) -> DataFrame:
    """One row for each variant of each experiment: name, retrieval strategy, chunking strategy and the subset it covers."""
    one = plan.select(F.explode("experiments").alias("e")).select("e", F.explode("e.variants").alias("v"))
    hyde, rerank = F.coalesce("v.use_hyde", F.lit(False)), F.coalesce("v.use_rerank", F.lit(False))
    inferred = F.when(hyde & rerank, "hybrid_hyde_rerank").when(rerank, "hybrid_rerank").when(hyde, "hybrid_hyde").otherwise("hybrid_hyde_rerank")
    return one.select(
        F.concat("e.id", F.lit("::"), "v.name").alias("variant"),
        F.coalesce(F.nullif("v.strategy", F.lit("")), inferred).alias("strategy"),
        F.col("v.chunk_strategy").alias("chunk_strategy"),
        F.coalesce("e.subset_filter.categories", F.array().cast("array<string>")).alias("categories"),
        F.coalesce("e.subset_filter.tags", F.array().cast("array<string>")).alias("tags"),
    )


def cases_of_variants(cases: DataFrame, variants: DataFrame) -> DataFrame:
    """Every variant (a short list, sent to all tasks) with the cases of its categories and tags."""
    v = variants.select("variant", "strategy", "chunk_strategy", F.col("categories").alias("v_categories"), F.col("tags").alias("v_tags"))
    fits = (F.size("v_categories") == 0) | F.array_contains("v_categories", F.coalesce("category", F.lit("unknown")))
    fits = fits & ((F.size("v_tags") == 0) | F.arrays_overlap("v_tags", "tags"))
    return cases.join(F.broadcast(v), fits)


def ranking_metrics(results: DataFrame, gold: DataFrame, keys: list[str], top_k: tuple[int, ...] = TOP_K) -> DataFrame:
    """Recall, reciprocal rank, gain and hit of each case at each k.

    ``results`` has ``keys``, ``item`` and ``rank``; ``gold`` has ``keys`` and ``relevant`` (an array). A case
    without results scores 0, one without gold has no row. Items that repeat count each time.
    """
    good = gold.where(F.size("relevant") > 0).select(*keys, "relevant")
    marked = good.join(results.select(*keys, "item", "rank"), keys, "left").withColumn("hit", F.coalesce(F.array_contains("relevant", F.col("item")), F.lit(False)))
    columns = []
    for k in top_k:
        hit = F.col("hit") & (F.col("rank") <= k)
        n = F.sum(F.when(hit, 1).otherwise(0))
        size = F.first(F.size("relevant"))
        columns += [
            F.round(n / size, 6).alias(f"recall_{k}"),
            F.round(F.coalesce(F.lit(1.0) / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)), 6).alias(f"mrr_{k}"),
            F.round(F.coalesce(F.sum(F.when(hit, F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0)))), F.lit(0.0)) / ideal_gain(size, k), 6).alias(f"ndcg_{k}"),
            F.when(n > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
        ]
    return marked.groupBy(*keys).agg(*columns)


def source_metrics(results: DataFrame, cases: DataFrame, keys: list[str], strategy: Column | None = None) -> DataFrame:
    """Which of a case's gold chunks, documents, sections, keywords, pages and visual references its results hold, and whether any does.

    Pages count where cases have ``gold_page_numbers`` and results ``page_number``, references where cases have
    ``gold_visual_refs`` and results ``visual_refs``.
    """
    pages = "gold_page_numbers" in cases.columns and "page_number" in results.columns
    references = "gold_visual_refs" in cases.columns and "visual_refs" in results.columns
    extra = [F.coalesce("gold_page_numbers", F.array().cast("array<int>")).cast("array<int>").alias("g_pages")] if pages else []
    extra += [F.transform(F.coalesce("gold_visual_refs", F.array().cast("array<string>")), normal).alias("g_refs")] if references else []
    wanted = cases.select(
        *keys,
        gold_ids(F.lit(None).cast("string") if strategy is None else strategy).alias("g_chunks"),
        F.coalesce("gold_document_ids", F.array().cast("array<long>")).alias("g_documents"),
        F.transform(F.coalesce("gold_sections", F.array().cast("array<string>")), normal).alias("g_sections"),
        F.transform(F.filter(F.coalesce("gold_keywords", F.array().cast("array<string>")), lambda x: x.isNotNull()), normal).alias("g_keywords"),
        *extra,
    )
    rows = wanted.join(results, keys, "left")
    held = {
        "chunk_hit": F.array_contains("g_chunks", F.col("chunk_id")),
        "document_hit": F.array_contains("g_documents", F.col("document_id")),
        "section_hit": F.array_contains("g_sections", normal(F.coalesce("section_name", F.lit("")))) & F.col("chunk_id").isNotNull(),
        "keyword_hit": F.exists("g_keywords", lambda k: F.contains(normal(F.col("content")), k)),
    }
    if pages:
        held["page_hit"] = F.array_contains("g_pages", F.col("page_number").cast("int"))
    if references:
        held["visual_ref_hit"] = F.arrays_overlap("g_refs", F.transform("visual_refs", normal))
    flags = rows.groupBy(*keys).agg(*[F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False)).alias(n) for n, c in held.items()])
    return flags.withColumn("citation_source_hit", F.greatest(*[F.col(n) for n in held]))


def metrics_with_fallback(results: DataFrame, cases: DataFrame, keys: list[str], top_k: tuple[int, ...] = TOP_K) -> DataFrame:
    """``ranking_metrics`` by gold ``chunks``; where a case has none, by its gold ``documents`` and the documents of its results."""
    by_chunk = F.size(F.coalesce("chunks", F.array().cast("array<long>"))) > 0
    gold = cases.select(*keys, by_chunk.alias("by_chunk"), F.array_distinct(F.when(by_chunk, F.col("chunks")).otherwise(F.coalesce("documents", F.array().cast("array<long>")))).alias("relevant"))
    items = results.join(gold.select(*keys, "by_chunk"), keys).select(*keys, F.when(F.col("by_chunk"), F.col("chunk_id")).otherwise(F.col("document_id")).alias("item"), "rank")
    return ranking_metrics(items, gold, keys, top_k)


def question_chunks(chunks: DataFrame, documents: DataFrame, papers: DataFrame, most: int) -> DataFrame:
    """The first ``most`` planned chunks of each paper to ask about, tables and figures first: ``id``, ``paper_id``, ``source_chunk_id``, ``document_id``, ``category``."""
    visual = F.col("chunk_type").isin("table", "figure_caption", "fused")
    docs = documents.select(F.col("id").alias("document_id"), F.col("source").alias("source_url"))
    rows = chunks.where(F.col("chunking_strategy").isin("agentic", "agentic_fusion") & F.col("section_name").isNotNull()).select(F.col("id").alias("source_chunk_id"), "document_id", "chunk_index", "chunk_type")
    rows = rows.join(docs, "document_id").join(papers.select(F.col("id").alias("paper_id"), "arxiv_id", "source_url"), "source_url")
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.when(visual, 0).otherwise(1), "chunk_index", "source_chunk_id"))
    rows = rows.withColumn("n", place).where(F.col("n") <= most)
    return rows.select(F.concat(F.lit("ablation-"), "arxiv_id", F.lit("-"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("id"), "paper_id", "source_chunk_id", "document_id", F.when(visual, "figure_table").otherwise("method").alias("category"))


def answer_metrics(answers: DataFrame, judges: DataFrame) -> DataFrame:
    """``correct``: the answer holds all it must and nothing it must not; with the judgement of (case, variant), the last one given."""
    last = judges.groupBy("qa_id", "variant").agg(F.max_by(F.struct("answer_correct", "citation_correct", "unsupported_claim", "score"), "position").alias("judge"))
    text = normal(F.coalesce("answer", F.lit("")))
    must = F.when(F.size("must_include") > 0, F.col("must_include")).when(F.col("expected") != "", F.array("expected")).otherwise(F.array().cast("array<string>"))
    good = (text != "") & F.forall(must, lambda t: F.contains(text, normal(t))) & ~F.exists("must_not_include", lambda t: F.contains(text, normal(t)))
    return answers.withColumn("correct", good).join(last, ["qa_id", "variant"], "left").select("qa_id", "variant", "correct", "judge.*")


def variant_summary(rows: DataFrame, top_k: tuple[int, ...] = TOP_K) -> DataFrame:
    """Means, rates and latency percentiles of each variant over its cases without errors."""
    ok = F.col("status") == "ok"
    when_ok = lambda name: F.when(ok, F.col(name))
    columns = [F.sum(F.when(ok, 1).otherwise(0)).alias("ok_cases"), F.sum(F.when(ok, 0).otherwise(1)).alias("error_cases")]
    columns += [mean4(when_ok("latency_ms")).alias("latency_ms_avg"), nearest_rank(when_ok("latency_ms"), 50).alias("latency_ms_p50"), nearest_rank(when_ok("latency_ms"), 95).alias("latency_ms_p95")]
    columns += [mean4(when_ok(f"{m}_{k}")).alias(f"{m}_{k}") for k in top_k for m in ("recall", "mrr", "ndcg", "hit") if f"{m}_{k}" in rows.columns]
    rates = [c for c in ("citation_source_hit", "section_hit", "keyword_hit", "correct") if c in rows.columns]
    known = [c for c in ("answer_correct", "citation_correct", "unsupported_claim") if c in rows.columns]
    good = rows.where(ok)
    summary = rows.groupBy("variant").agg(*columns)
    if rates or known:
        summary = summary.join(good.groupBy("variant").agg(*[share_true(F.col(c)).alias(f"{c}_rate") for c in rates], *[share_of_known(F.col(c)).alias(f"{c}_rate") for c in known]), "variant", "left")
    return summary


def first_hit(results: DataFrame, cases: DataFrame) -> DataFrame:
    """``query_id`` and ``hit_rank``: the first result that is the source chunk, lies in a gold section, or holds a keyword or a gold heading."""
    sections = F.transform(F.coalesce("gold_sections", F.array().cast("array<string>")), normal)
    content = normal(F.col("content"))
    keywords = F.filter(F.coalesce("gold_keywords", F.array().cast("array<string>")), lambda x: x.isNotNull())
    match = (
        F.coalesce(F.col("chunk_id") == F.col("source_chunk_id"), F.lit(False))
        | F.array_contains(sections, normal(F.coalesce("section_name", F.lit(""))))
        | F.exists(keywords, lambda k: F.contains(content, normal(k)))
        | F.exists(sections, lambda s: F.contains(content, F.concat(F.lit("## "), s)))
    )
    rows = cases.join(results, "query_id", "left").withColumn("match", F.coalesce(match, F.lit(False)) & F.col("chunk_id").isNotNull())
    return rows.groupBy("query_id").agg(F.min(F.when(F.col("match"), F.col("rank"))).alias("hit_rank"))


def hit_summary(ranks: DataFrame, *keys: str) -> DataFrame:
    """Recall at 1, 3 and 5 and mean reciprocal rank over ``hit_rank``."""
    at = [F.round(F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in (1, 3, 5)]
    return ranks.groupBy(*keys).agg(F.count("*").alias("total_queries"), *at, F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("hit_rank"), F.lit(0.0))), 6).alias("mrr"))


def paper_key(paper: Column, arxiv: Column) -> Column:
    """How cases are grouped by paper: its id (0 is none), else its arXiv id, else ``unknown``; as text."""
    return F.coalesce(F.nullif(paper, F.lit(0)).cast("string"), F.nullif(arxiv, F.lit("")), F.lit("unknown"))


def question_for(section: Column) -> Column:
    """The question that a section's name suggests."""
    low = F.lower(section)
    holds = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False))
    return (
        F.when(holds("abstract"), "What is the main contribution of the paper?")
        .when(holds("method", "model"), F.concat(F.lit("What method is described in "), section, F.lit("?")))
        .when(holds("result", "performance", "calculate"), F.concat(F.lit("What result is reported in "), section, F.lit("?")))
        .when(holds("conclusion", "consideration", "limitation"), "What limitations or conclusions does the paper discuss?")
        .when(holds("table"), F.concat(F.lit("What does the table in "), section, F.lit(" show?")))
        .otherwise(F.concat(F.lit("What information is discussed in "), section, F.lit("?")))
    )


def report_table(rows: list[dict], columns: list[tuple[str, str]]) -> str:
    """A collected summary as a Markdown table."""
    lines = ["| " + " | ".join(title for title, _ in columns) + " |", "| " + " | ".join("---" if not i else "---:" for i in range(len(columns))) + " |"]
    lines += ["| " + " | ".join(str(r.get(name, "")) for _, name in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def shown_accuracy(judged: float | None, rule: float | None) -> float | None:
    """The judged accuracy where it is known and not 0, else that of the rule."""
    return judged or rule
