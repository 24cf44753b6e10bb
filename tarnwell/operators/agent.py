"""Query guarding, routing, grading and rewriting as columns over query logs; models plug in as functions of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.text import is_current_query, is_direct_query, is_local_query, is_repeated_noise, query_terms, stripped

LONGEST_QUERY = 1000


def guard(query: Column) -> Column:
    """(passed, reason) of a query by rule."""
    text = stripped(F.coalesce(query, F.lit("")))
    reason = (
        F.when(text == "", "empty_query")
        .when(F.length(text) > LONGEST_QUERY, "query_too_long")
        .when(F.regexp_count(text, F.lit(r"[A-Za-z0-9\x{4e00}-\x{9fff}]")) < 2, "not_enough_meaningful_text")
        .when(is_repeated_noise(text), "repeated_noise")
        .otherwise("fallback_rule_passed")
    )
    return F.struct((reason == "fallback_rule_passed").alias("passed"), reason.alias("reason"))


def route(query: Column) -> Column:
    """(route, confidence, reason) of a query by rule."""
    direct, local = is_direct_query(query), is_local_query(query)
    return F.struct(
        F.when(direct, "direct_answer").otherwise("local_rag").alias("route"),
        F.when(direct | local, 0.9).otherwise(0.6).alias("confidence"),
        F.when(direct, "fallback_direct_answer_pattern").when(local, "fallback_local_knowledge_terms").otherwise("fallback_default_local_rag").alias("reason"),
    )


def parsed_route(output: Column) -> Column:
    """(route, confidence, reason) in a model's answer: a JSON object, or a route named in text."""
    text = stripped(output)
    value = F.from_json(text, "route string, confidence string, reason string")
    named = F.regexp_extract(F.lower(text), r"\b(local_rag|direct_answer)\b", 1)
    wanted = F.lower(stripped(F.coalesce(value.route, F.lit(""))))
    is_object = text.startswith("{") & text.endswith("}")
    known = wanted.isin("local_rag", "direct_answer")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.confidence.try_cast("double"), F.lit(0.75))))

    def decision(name: Column, score: Column, reason: Column) -> Column:
        return F.struct(name.alias("route"), score.cast("double").alias("confidence"), reason.alias("reason"))

    return (
        F.when(is_object & known, decision(wanted, confidence, F.coalesce(F.nullif(value.reason, F.lit("")), F.lit("router_decision"))))
        .when(is_object, decision(F.lit("local_rag"), F.lit(0.5), F.lit("llm_unsupported_route")))
        .when(named != "", decision(named, F.lit(0.7), F.lit("router_text_match")))
        .otherwise(decision(F.lit("local_rag"), F.lit(0.5), F.lit("llm_output_unparseable")))
    )


def section_candidates(query: Column) -> Column:
    """Section numbers and names that a query asks for."""
    low = F.lower(F.regexp_replace(stripped(query), r"\s+", " "))
    numbers = F.regexp_extract_all(low, F.lit(r"\b(?:section|chapter)\s+(\d+(?:\.\d+)*)"), F.lit(1))
    names = F.filter(F.array(*[F.when(F.contains(low, F.lit(n)), n) for n in ("abstract", "conclusion", "introduction")]), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(numbers, names))


def grade(query: Column, documents: Column, sections: Column) -> Column:
    """(relevant, sufficient, score, reason, useful) of retrieved texts and their section names, both arrays in rank order."""
    context = F.lower(F.array_join(documents, "\n"))
    low, wanted = F.lower(query), section_candidates(query)
    places = F.sequence(F.lit(1), F.greatest(F.size(documents), F.lit(1)))
    holds = lambda i: F.exists(wanted, lambda c: F.contains(F.lower(F.coalesce(F.get(sections, i - 1), F.lit(""))), c) | F.contains(F.lower(F.substring(F.get(documents, i - 1), 1, 300)), c))
    useful = F.filter(places, holds)
    written = F.exists(useful, lambda i: stripped(F.get(documents, i - 1)) != "")
    asked = query_terms(query)
    met = F.size(F.filter(asked, lambda t: F.contains(context, t)))
    enough = met >= F.greatest(F.lit(1), F.least(F.lit(2), F.size(asked)))
    none, every = F.array().cast("array<int>"), places
    named = F.greatest(*[F.contains(low, F.lit(n)) & F.contains(context, F.lit(n)) for n in ("langgraph", "langchain")])

    def decision(relevant: Column, sufficient: Column, score: Column, reason: Column, ids: Column) -> Column:
        return F.struct(relevant.alias("relevant"), sufficient.alias("sufficient"), score.cast("double").alias("score"), reason.alias("reason"), ids.alias("useful"))

    no, yes = F.lit(False), F.lit(True)
    return (
        F.when(F.size(documents) == 0, decision(no, no, F.lit(0.0), F.lit("no_documents"), none))
        .when(is_current_query(query), decision(no, no, F.lit(0.0), F.lit("query_requires_current_information"), none))
        .when((F.size(wanted) > 0) & (F.size(useful) > 0), decision(yes, written, F.when(written, 0.95).otherwise(0.7), F.when(written, "section_metadata_match").otherwise("section_metadata_match_empty_content"), useful))
        .when(named, decision(yes, yes, F.lit(0.9), F.lit("term_overlap"), every))
        .when(F.size(asked) == 0, decision(no, no, F.lit(0.0), F.lit("no_query_terms"), none))
        .otherwise(decision(enough, enough, F.least(F.lit(1.0), met / F.greatest(F.lit(1), F.size(asked))), F.concat(F.lit("signal_overlap="), met.cast("string"), F.lit("/"), F.size(asked).cast("string")), F.when(enough, every).otherwise(none)))
    )


def cleaned_rewrite(output: Column) -> Column:
    """A model's rewritten query without quotes and labels around it."""
    quotes = "[\"'`“”‘’\\s]"
    bare = lambda c: F.regexp_replace(c, f"^{quotes}+|{quotes}+$", "")
    return bare(F.regexp_replace(bare(output), r"(?i)^(?:改写后的查询|改写查询|重写后的查询|rewritten query|query)\s*[:：]\s*", ""))


def context_prompt(query: Column, contents: Column, sections: Column) -> Column:
    """Retrieved texts numbered, with their sections, in front of the question."""
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(contents), F.lit(1))), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.coalesce(F.get(sections, i - 1), F.lit("")), F.lit("\n"), F.coalesce(F.get(contents, i - 1), F.lit(""))))
    return F.concat(F.lit("Context:\n"), F.array_join(parts, "\n\n"), F.lit("\n\nQuestion: "), query)


def answer_loop(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rewrite: Callable[[Column], Column] = lambda q: q, most_rewrites: int = 3) -> DataFrame:
    """``query_id``, ``status``, ``rewrites``, ``useful`` of each query.

    Each round retrieves and grades all queries still open at once; those found insufficient go on with
    a rewritten query until ``most_rewrites``, or at once where the rewriting changes nothing.
    ``retrieve`` returns ``query_id``, ``documents`` and ``sections``.
    """
    from tarnwell.session import cut

    checked = queries.withColumn("guard", guard(F.col("query"))).withColumn("route", route(F.col("query")))
    done = checked.where("NOT guard.passed OR route.route = 'direct_answer'").select("query_id", F.when(~F.col("guard.passed"), "rejected").otherwise("direct").alias("status"), F.lit(0).alias("rewrites"), F.array().cast("array<int>").alias("useful"))
    still = checked.where("guard.passed AND route.route <> 'direct_answer'").drop("guard", "route")
    for turn in range(most_rewrites + 1):
        found = still.join(retrieve(still), "query_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>"))).withColumn("sections", F.coalesce("sections", F.array().cast("array<string>")))
        graded = cut(found.withColumn("grade", grade(F.col("query"), F.col("documents"), F.col("sections"))).withColumn("next", rewrite(F.col("query"))))
        over = F.col("grade.sufficient") | F.lit(turn == most_rewrites) | (F.col("next") == F.col("query"))
        done = done.unionByName(graded.where(over).select("query_id", F.when(F.col("grade.sufficient"), "answered").otherwise("gave_up").alias("status"), F.lit(turn).alias("rewrites"), F.col("grade.useful").alias("useful")))
        still = graded.where(~over).withColumn("query", F.col("next")).select(*queries.columns)
        if not still.limit(1).count():
            break
    return done
