"""The registered queries of the core, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.functions import hashing, measures, text
from tarnwell.operators import agent, chunking, evaluation, parsing, retrieval, store, units
from tarnwell.session import cut
from tarnwell.sources.tables import load_table, once, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "hybrid_search"
MODEL = "quill-embed-64"
K = 10


def query(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return once(load_table(spark, d, "paper_blocks").drop("created_at", "metadata"), "id")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return once(load_table(spark, d, "document_chunks").drop("created_at", "metadata"), "id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return once(load_table(spark, d, "paper_documents").drop("created_at"), "id")


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return once(load_table(spark, d, "papers").drop("created_at"), "id")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return once(load_table(spark, d, "qa_ablation_sample30"), "id")


_B = "b AS (SELECT DISTINCT ON (id) * FROM paper_blocks)"
_C = "c AS (SELECT DISTINCT ON (id) * FROM document_chunks)"
_D = "d AS (SELECT DISTINCT ON (id) * FROM paper_documents)"
_P = "p AS (SELECT DISTINCT ON (id) * FROM papers)"
_Q = "q AS (SELECT DISTINCT ON (id) * FROM qa_ablation_sample30)"

# Scans, listings, point and list lookups


def _text(column: str) -> str:
    """A timestamp as text, which compares alike everywhere."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def _stamp(column: str) -> Column:
    return F.date_format(F.col(column).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query(f"WITH {_P} SELECT id, arxiv_id, title, {_text("published_at AT TIME ZONE 'UTC'")} AS published_at FROM p ORDER BY p.published_at DESC NULLS LAST, id DESC LIMIT 20")
def papers_by_recency(spark: SparkSession, d: str) -> DataFrame:
    """The 20 newest papers."""
    papers = _papers(spark, d).select("id", "arxiv_id", "title", "published_at")
    return papers.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(20).withColumn("published_at", _stamp("published_at"))


@query(f"WITH {_B} SELECT paper_id, order_index, id, block_type, content FROM b WHERE should_embed")
def embeddable_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks to embed, in reading order."""
    return _blocks(spark, d).where("should_embed").select("paper_id", "order_index", "id", "block_type", "content").orderBy("paper_id", "order_index", "id")


@query(f"WITH {_B}, {_P} SELECT id, arxiv_id FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.paper_id = p.id)")
def papers_without_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Papers not parsed yet."""
    return store.missing(_papers(spark, d).select("id", "arxiv_id"), load_table(spark, d, "paper_blocks"), [("id", "paper_id")])


@query(f"WITH {_B}, hashes AS (SELECT content_hash FROM b WHERE block_type = 'abstract') SELECT id, paper_id FROM b WHERE content_hash IN (SELECT content_hash FROM hashes)")
def blocks_by_hash_list(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose content is that of some abstract."""
    blocks = _blocks(spark, d).select("id", "paper_id", "block_type", "content_hash")
    return blocks.join(blocks.where("block_type = 'abstract'").select("content_hash").distinct(), "content_hash", "left_semi").select("id", "paper_id")


@query(f"WITH {_D} SELECT id, source FROM d WHERE starts_with(source, 'https://')")
def documents_by_source_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where(F.col("source").startswith("https://")).select("id", "source")


@query(
    f"""WITH {_C}, {_Q}, wanted AS (SELECT id AS case_id, unnest(range(1, len(gold_chunk_ids) + 1)) AS position, unnest(gold_chunk_ids) AS chunk_id FROM q)
SELECT case_id, position, chunk_id, c.document_id FROM wanted LEFT JOIN c ON c.id = chunk_id"""
)
def gold_chunks_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The gold chunks of each case in the order of its list, with their documents."""
    wanted = _cases(spark, d).select(F.col("id").alias("case_id"), F.posexplode("gold_chunk_ids").alias("position", "chunk_id")).withColumn("position", F.col("position") + 1)
    return wanted.join(_chunks(spark, d).select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id", "left").select("case_id", "position", "chunk_id", "document_id")


# Write rules


@query(
    f"""WITH {_C}, {_D} SELECT count(*) FILTER (WHERE content_hash IN (SELECT content_hash FROM d)) AS with_document_text, count(*) AS chunks FROM c"""
)
def chunks_with_known_hash(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks hold the whole text of a document."""
    known = _documents(spark, d).select("content_hash").distinct().withColumn("known", F.lit(1))
    return _chunks(spark, d).select("content_hash").join(known, "content_hash", "left").agg(F.count("known").alias("with_document_text"), F.count("*").alias("chunks"))


@query("SELECT id, paper_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS n FROM (SELECT DISTINCT id, paper_id, content_hash FROM paper_blocks)) WHERE n = 1")
def blocks_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that an empty store takes: the first of each content."""
    rows = load_table(spark, d, "paper_blocks").select("id", "paper_id", "content_hash")
    return store.absent_rows(rows, rows.limit(0), ["content_hash"], [F.col("id")])


@query(
    f"""WITH s AS (SELECT DISTINCT ON (id) id, arxiv_id, title, created_at FROM papers),
n AS (SELECT arxiv_id, max(created_at) AS created_at FROM papers GROUP BY 1)
SELECT s.arxiv_id, s.title, {_text("n.created_at AT TIME ZONE 'UTC'")} AS created_at FROM s JOIN n USING (arxiv_id)"""
)
def papers_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Papers after all deliveries: the latest row of each arXiv id."""
    rows = load_table(spark, d, "papers").select("arxiv_id", "title", "created_at")
    return store.latest_wins(rows.limit(0), rows, ["arxiv_id"], ["created_at"]).withColumn("created_at", _stamp("created_at"))


@query(
    f"""WITH {_D}, {_P}, new AS (SELECT source_url AS source, 'abstract of ' || coalesce(title, '') AS title FROM p),
least AS (SELECT source, min(id) AS id FROM d GROUP BY 1)
SELECT d.id, d.source, CASE WHEN new.source IS NOT NULL AND d.id = least.id THEN new.title ELSE d.title END AS title
FROM d LEFT JOIN least USING (source) LEFT JOIN new USING (source)
UNION ALL SELECT NULL, source, title FROM new WHERE source NOT IN (SELECT source FROM d)"""
)
def documents_upserted_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents updated from the papers' abstracts by source; ids stay."""
    stored = _documents(spark, d).select("id", "source", "title")
    new = _papers(spark, d).select(F.lit(None).cast("long").alias("id"), F.col("source_url").alias("source"), F.concat(F.lit("abstract of "), F.coalesce("title", F.lit(""))).alias("title"), F.col("id").alias("turn"))
    return store.upsert_keeping_least_id(stored, new, "source", "id", "turn")


@query(f"WITH {_C} SELECT id, document_id FROM c WHERE id NOT IN (SELECT chunk_id FROM chunk_embeddings WHERE model_name = '{MODEL}')")
def chunks_without_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Chunks still to embed."""
    done = load_table(spark, d, "chunk_embeddings").where(F.col("model_name") == MODEL)
    return store.missing(_chunks(spark, d).select("id", "document_id"), done, [("id", "chunk_id")])


@query(
    f"""WITH {_C}, {_D}, gone AS (SELECT id FROM d WHERE coalesce(title, '') = ''),
e AS (SELECT DISTINCT ON (id) * FROM chunk_embeddings)
SELECT e.id, e.chunk_id FROM e WHERE chunk_id NOT IN (SELECT id FROM c WHERE document_id IN (SELECT id FROM gone))"""
)
def embeddings_after_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings left after the chunks of documents without a title are deleted."""
    gone = _documents(spark, d).where(F.coalesce("title", F.lit("")) == "").select(F.col("id").alias("document_id"))
    lost = _chunks(spark, d).join(gone, "document_id", "left_semi").select(F.col("id"))
    embeddings = once(load_table(spark, d, "chunk_embeddings").select("id", "chunk_id"), "id")
    return store.delete_with_dependants(_chunks(spark, d), embeddings, lost, "id", "chunk_id")[1].select("id", "chunk_id")


@query(f"SELECT event_id, {_text('ts')} AS ts, event_type FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 1000")
def newest_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The log of the last 1,000 events."""
    return store.newest(load_table(spark, d, "events").select("event_id", "ts", "event_type"), [F.desc("ts"), F.desc("event_id")], 1000).withColumn("ts", _stamp("ts"))


@query(f"""WITH {_Q} SELECT id, 'answer:' || sha256('{{"query": "' || replace(replace(query, '\\', '\\\\'), '"', '\\"') || '", "top_k": 5}}') AS cache_key FROM q""")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache key of each case's query."""
    return _cases(spark, d).select("id", hashing.request_key("answer", query=hashing.json_text(F.col("query")), top_k=F.lit("5")).alias("cache_key"))


@query("SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE ts + INTERVAL 1 DAY > now")
def live_cache_entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as cache rows that live a day, at the time of the last one."""
    events = load_table(spark, d, "events").select("event_id", "ts")
    now = events.agg(F.max("ts").alias("now"))
    return store.live_entries(events.crossJoin(F.broadcast(now)).withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 1 DAY")), F.col("now")).select("event_id")


# Text predicates


@query(
    rf"""WITH {_B}, t AS (SELECT id, trim(regexp_replace(content, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), E' \t\n\r') AS t FROM b),
n AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS s, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) > 1 OR contains(t, '|') OR contains(t, chr(9)) AS several FROM t),
f AS (SELECT *, regexp_full_match(t, '\d{{1,3}}|(?i:i|ii|iii|iv|v|vi|vii|viii|ix|x)') AS is_page,
    regexp_full_match(trim(regexp_replace(s, '^#{{1,6}}\s*', '')), '\d{{1,3}}\s*[·•]\s+.+|.+\s*[·•]\s+\d{{1,3}}|(?i:page)\s+\d{{1,3}}(\s+(?i:of)\s+\d{{1,3}})?') AS is_header,
    regexp_full_match(s, '(19|20)\d{{2}}|(?i:{text.MONTH})\.?\s+(19|20)\d{{2}}|\d{{1,2}}\s+(?i:{text.MONTH})\.?\s+(19|20)\d{{2}}|(?i:{text.MONTH})\.?\s+\d{{1,2}},?\s+(19|20)\d{{2}}|(19|20)\d{{2}}[-/]\d{{1,2}}([-/]\d{{1,2}})?') AS is_date,
    regexp_matches(lower(t), '^(arxiv:|preprint|submitted to|under review)|arxiv\.org|all rights reserved|creative commons|copyright|license') AS is_licence,
    length(t) <= 24 AND (regexp_full_match(regexp_replace(t, '\s+', '', 'g'), '[\d,*†‡§]+') OR regexp_full_match(t, '(\d+[,\s]*){{1,6}}') OR regexp_full_match(t, '[¹²³⁰-⁹]+')) AS is_mark FROM n)
SELECT id, is_page, is_header, is_date, is_licence, is_mark, t = '' OR (NOT several AND (is_page OR is_header OR is_date OR is_licence OR is_mark)) AS noise,
    t <> '' AND (is_page OR is_header OR is_mark) AS boundary FROM f"""
)
def block_noise(spark: SparkSession, d: str) -> DataFrame:
    """Which blocks are page numbers, headers, dates, licence lines or footnote marks."""
    one = text.stripped(text.sanitized(F.col("content")))
    blocks = _blocks(spark, d).select("id", "content", one.alias("t"))
    t = F.col("t")
    return blocks.select(
        "id", text.is_page_number(t).alias("is_page"), text.is_running_header(t).alias("is_header"), text.is_date(t).alias("is_date"), text.is_licence_line(t).alias("is_licence"),
        text.is_footnote_mark(t).alias("is_mark"), text.is_noise(F.col("content")).alias("noise"), text.is_boundary_noise(F.col("content")).alias("boundary"),
    )


@query(
    f"""WITH {_B}, n AS (SELECT id, CASE WHEN lower(trim(block_type)) IN {text.BLOCK_TYPES} THEN lower(trim(block_type)) ELSE 'unknown' END AS kind FROM b)
SELECT id, kind, kind IN {text.EMBEDDABLE_TYPES} AS embeddable FROM n"""
)
def block_types(spark: SparkSession, d: str) -> DataFrame:
    """Known type of each block, and whether it is embedded."""
    return _blocks(spark, d).select("id", text.block_type(F.col("block_type")).alias("kind"), text.is_embeddable(F.col("block_type")).alias("embeddable"))


def _kind_sql(first: str, t: str, place: str) -> str:
    titles = ", ".join(f"'{x}'" for x in text.SECTION_TITLES)
    low = rf"lower(trim(regexp_replace({first}, '^\d+(\.\d+)*\s+', '')))"
    pair = r"(^|[^\p{L}\p{N}_])[A-Z][a-z]+%s[A-Z][a-z]+[0-9]*($|[^\p{L}\p{N}_])"  # word edges are those of all letters
    names = rf"""({first} <> '' AND length({first}) <= 220 AND NOT regexp_matches({first}, '(?i)^(Algorithm|Figure|Fig\.|Table)\s*\d+\b') AND (contains({first}, '@')
        OR (regexp_matches({first}, '(?i)\band\b|\b,\b') AND regexp_matches({first}, '{pair % " "}')) OR (regexp_matches({first}, '{pair % "[[:space:]]+"}') AND len(list_filter(regexp_split_to_array({first}, '\s+'), lambda x: x <> '')) <= 18)))"""
    return rf"""CASE WHEN {t} = '' THEN 'unknown' WHEN {place} = 0 AND length({first}) <= {text.LONGEST_TITLE} THEN 'title'
    WHEN {place} <= {text.NAMES_WITHIN} AND regexp_matches({first}, '{text.AFFILIATION}') THEN 'affiliation' WHEN {place} <= {text.NAMES_WITHIN} AND {names} THEN 'authors'
    WHEN {low} = 'abstract' OR starts_with(lower({first}), 'abstract') THEN 'abstract' WHEN {low} = 'references' THEN 'reference' WHEN {low} = 'appendix' THEN 'appendix' WHEN {low} IN ({titles}) THEN 'section_title'
    WHEN regexp_matches({first}, '(?i)^(figure|fig\.)\s*\d+[:.\s]') THEN 'figure_caption' WHEN regexp_matches({first}, '(?i)^table\s*\d+[:.\s]') THEN 'table_caption'
    WHEN regexp_matches({t}, '{text.TABLE_LINE}') OR length({t}) - length(replace({t}, chr(9), '')) >= 4 THEN 'table' WHEN regexp_matches({first}, '(?i)^(algorithm\s*\d+|procedure|pseudo\s*code|pseudocode)\b') THEN 'algorithm'
    WHEN NOT regexp_matches({t}, '^(\.\.\.|\[[.\s]*\])$') AND (regexp_matches({t}, '\n( {{4}}|\t)') OR regexp_matches({t}, '{text.CODE}')) THEN 'code'
    WHEN length({t}) <= 500 AND regexp_matches({t}, '{text.FORMULA}') AND regexp_matches({t}, '{text.FORMULA_SIGN}') THEN 'formula'
    WHEN regexp_matches({first}, '(?i)^\[\d+\]|\bet al\.\b|^references$') THEN 'reference' WHEN regexp_matches({first}, '^[-*•]') THEN 'list' ELSE 'paragraph' END"""


@query(rf"WITH {_B}, t AS (SELECT id, order_index, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t FROM b), f AS (SELECT *, trim(regexp_extract(t, '([^\s][^\n\r]*)', 1)) AS first FROM t) SELECT id, {_kind_sql('first', 't', 'order_index')} AS kind FROM f")
def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kind of each block as its first line and its place say."""
    return _blocks(spark, d).select("id", text.block_kind(F.col("content"), F.col("order_index")).alias("kind"))


@query(
    rf"""WITH {_B} SELECT id, regexp_matches(trim(content, E' \n\t\r'), '(?i)^(figure|fig\.|table)\s*\d+[:.]') AS caption, contains(content, '|') AND contains(content, '---') AS markdown_table,
length(trim(content, E' \n\t\r')) >= 20 AND regexp_matches(content, '[A-Za-z\x{{4e00}}-\x{{9fff}}]') AS meaningful,
len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS words FROM b"""
)
def block_features(spark: SparkSession, d: str) -> DataFrame:
    content = F.col("content")
    return _blocks(spark, d).select("id", text.is_caption(content).alias("caption"), text.has_markdown_table(content).alias("markdown_table"), text.is_meaningful(content).alias("meaningful"), text.word_count(content).alias("words"))


@query(
    rf"""WITH {_C} SELECT id, [CASE WHEN regexp_matches(lower(x), '^table') THEN 'Table ' ELSE 'Fig. ' END || regexp_extract(x, '(\d+)', 1)
FOR x IN regexp_extract_all(content, '(?i)\b(figure|fig\.?|table)\s*\d+\b')] AS refs FROM c"""
)
def visual_references(spark: SparkSession, d: str) -> DataFrame:
    """Figures and tables each chunk names, in order, with repeats."""
    return _chunks(spark, d).select("id", text.visual_refs(F.col("content")).alias("refs"))


@query(f"WITH {_D} SELECT id, sha256(trim(replace(content, E'\\r\\n', E'\\n'), E' \\n\\t\\r')) AS hash, content_hash = sha256(trim(replace(content, E'\\r\\n', E'\\n'), E' \\n\\t\\r')) AS same FROM d")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash of each document's text, and whether the stored one is the same."""
    own = hashing.content_hash(F.col("content"))
    return _documents(spark, d).select("id", own.alias("hash"), (own == F.col("content_hash")).alias("same"))


@query(rf"WITH {_D} SELECT id, nullif(trim(regexp_extract(content, '(?m)^arXiv ID:\s*(.+)$', 1)), '') AS arxiv_id, nullif(trim(regexp_extract(content, '(?m)^Authors:\s*(.+)$', 1)), '') AS authors FROM d")
def document_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that a document's text names on lines of their own."""
    return _documents(spark, d).select("id", text.field_of(F.col("content"), "arXiv ID").alias("arxiv_id"), text.field_of(F.col("content"), "Authors").alias("authors"))


# Counts


@query(f"WITH {_C} SELECT chunking_strategy, chunk_type, count(*) AS n FROM c GROUP BY ALL")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).groupBy("chunking_strategy", "chunk_type").agg(F.count("*").alias("n")).orderBy("chunking_strategy", "chunk_type")


@query(f"WITH {_B} SELECT block_type, count(*) AS n FROM b GROUP BY 1")
def block_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).groupBy("block_type").agg(F.count("*").alias("n"))


@query(f"WITH {_C} SELECT chunking_strategy, coalesce(round(avg(token_count), 2), 0) AS avg_tokens FROM c GROUP BY 1")
def average_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Mean of all stored token counts of each strategy."""
    rows = _chunks(spark, d)
    return rows.groupBy("chunking_strategy").agg(F.coalesce(F.round(F.avg("token_count"), 2), F.lit(0.0)).alias("avg_tokens"))


@query(f"WITH {_C} SELECT document_id, count(*) AS chunks, count(*) > 80 AS many FROM c GROUP BY 1")
def chunks_per_document(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("chunks")).withColumn("many", F.col("chunks") > 80)


@query(
    rf"""WITH {_C}, w AS (SELECT chunking_strategy, content, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS n FROM c)
SELECT chunking_strategy, count(*) AS chunks, count(*) FILTER (WHERE n < 50) AS short_chunks, count(*) FILTER (WHERE regexp_matches(content, '^#+[^\n]*$')) AS heading_only,
count(*) FILTER (WHERE NOT regexp_matches(content, '[.!?:;。！？)\]|`"]\s*$') AND NOT regexp_matches(trim(content, E' \n\t\r'), '(?i)^(figure|fig\.|table)\s*\d+[:.]')) AS unfinished,
round(avg(n), 2) AS avg_words, min(n) AS min_words, max(n) AS max_words FROM w GROUP BY 1"""
)
def chunk_quality(spark: SparkSession, d: str) -> DataFrame:
    return chunking.quality_report(_chunks(spark, d))


@query("SELECT event_type, count(*) AS n, round(list_sort(list(value))[1 + CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT)], 3) AS p50, round(list_sort(list(value))[1 + CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT)], 3) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of each kind of event."""
    events = load_table(spark, d, "events")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), measures.nearest_rank(F.col("value"), 50).alias("p50"), measures.nearest_rank(F.col("value"), 95).alias("p95"))


# Chunking

_FIXED = rf"""t AS (SELECT id AS document_id, trim(replace(content, E'\r\n', E'\n'), E' \n\t\r\x0b\x0c') AS t FROM d),
w AS (SELECT document_id, i, trim(t[i * 680 + 1 : i * 680 + 800], E' \n\t\r\x0b\x0c') AS content FROM (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((length(t) - 800) / 680.0) AS BIGINT)))) AS i FROM t WHERE length(t) > 0)),
fixed AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS chunk_index, content, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS token_count, sha256(content) AS content_hash FROM w WHERE content <> '')"""


@query(f"WITH {_D}, {_FIXED} SELECT document_id, chunk_index, content, token_count, content_hash FROM fixed")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 800 characters with 120 in common."""
    return chunking.fixed_chunks(_documents(spark, d)).select("document_id", "chunk_index", "content", "token_count", "content_hash")


@query(f"WITH {_D}, {_FIXED} SELECT document_id, chunk_index, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY document_id, chunk_index) AS n FROM fixed) WHERE n = 1")
def fixed_chunks_stored(spark: SparkSession, d: str) -> DataFrame:
    """Windows that a store with unique contents keeps."""
    return chunking.one_of_each_hash(chunking.fixed_chunks(_documents(spark, d))).select("document_id", "chunk_index", "content_hash")


@query(
    rf"""WITH {_B}, {_D}, m AS (SELECT nullif(trim(regexp_extract(content, '(?m)^arXiv ID:\s*(.+)$', 1)), '') AS arxiv_id, min(id) AS document_id FROM d WHERE NOT contains(source, '#block:') GROUP BY 1),
j AS (SELECT b.*, m.document_id, coalesce(nullif(section_name, ''), 'unknown') AS section FROM b JOIN m USING (arxiv_id)),
rows AS (
    SELECT document_id, order_index AS chunk_index, block_type AS chunk_type, section, [id] AS ids, content FROM j WHERE block_type IN {chunking.SINGLE}
    UNION ALL SELECT document_id, min(order_index), 'paragraph', section, list(id ORDER BY order_index, id), string_agg(coalesce(nullif(markdown_content, ''), content), E'\n\n' ORDER BY order_index, id) FROM j WHERE block_type IN {chunking.GROUPED} GROUP BY document_id, section)
SELECT document_id, chunk_index, chunk_type, section AS section_name, ids AS source_block_ids, trim(content, E' \n\t\r') AS content FROM rows"""
)
def block_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by kind of block, running text joined by section."""
    return chunking.block_chunks(_documents(spark, d), _blocks(spark, d)).select("document_id", "chunk_index", "chunk_type", "section_name", "source_block_ids", "content")


@query(
    rf"""WITH {_C}, h AS (SELECT id, document_id, chunk_index, nullif(list_extract(regexp_extract_all(content, '(?m)^##\s+(.+)$', 1), -1), '') AS h FROM c)
SELECT id, trim(last_value(h IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS UNBOUNDED PRECEDING)) AS section_name FROM h"""
)
def sections_filled_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).select("id", "document_id", F.struct("chunk_index", "id").alias("chunk_index"), "content")
    return chunking.forward_filled_sections(rows).select("id", "section_name")


@query(
    rf"""WITH {_C}, w AS (SELECT id, document_id, chunking_strategy, chunk_index, list_distinct(regexp_extract_all(lower(content), '[a-z][\w-]{{2,}}')) AS w FROM c),
n AS (SELECT *, lead(id) OVER o AS next_id, lead(w) OVER o AS v FROM w WINDOW o AS (PARTITION BY document_id, chunking_strategy ORDER BY chunk_index, id)),
k AS (SELECT *, len(list_intersect(w, v)) AS shared, len(list_distinct(list_concat(w, v))) AS all_words, least(len(w), len(v)) AS least_words FROM n WHERE next_id IS NOT NULL)
SELECT id AS chunk_id, next_id AS next_chunk_id, round(greatest(CASE WHEN all_words > 0 THEN shared / all_words ELSE 0 END, CASE WHEN least_words > 0 THEN shared / least_words ELSE 0 END), 6) AS score FROM k"""
)
def neighbour_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Words that neighbouring chunks of one document and strategy have in common."""
    rows = _chunks(spark, d).select("document_id", F.struct("chunking_strategy", "chunk_index", "id").alias("chunk_index"), "content")
    scored = chunking.neighbour_scores(rows).where("chunk_index.chunking_strategy = next_index.chunking_strategy")
    return scored.select(F.col("chunk_index.id").alias("chunk_id"), F.col("next_index.id").alias("next_chunk_id"), "score")


@query(
    f"""WITH {_B}, {_P}, parts AS (SELECT paper_id AS id, string_agg(coalesce(nullif(markdown_content, ''), content), E'\\n\\n' ORDER BY order_index, b.id) AS body FROM b WHERE should_embed AND trim(coalesce(nullif(markdown_content, ''), content), E' \\n\\t\\r') <> '' GROUP BY 1)
SELECT id, title, source_url AS source, '# ' || coalesce(title, '') || E'\\n\\narXiv ID: ' || arxiv_id || E'\\nAuthors: ' || array_to_string(authors, ', ') || E'\\nCategories: ' || array_to_string(categories, ', ') || E'\\nPDF: ' || coalesce(pdf_url, '') || E'\\n\\n' || coalesce(nullif(body, ''), abstract, '') AS content
FROM p LEFT JOIN parts USING (id)"""
)
def paper_documents_built(spark: SparkSession, d: str) -> DataFrame:
    """The document of each paper from its blocks."""
    return parsing.paper_text(_papers(spark, d), _blocks(spark, d))


@query()
def markdown_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Typed blocks of the documents read as Markdown."""
    return parsing.blocks_of_markdown(spread(load_table(spark, d, "documents").select("doc_id", "source", "text")), doc="doc_id", name="source", text="text")


@query()
def lines_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Typed blocks of the documents read as extracted lines."""
    return parsing.blocks_of_lines(spread(load_table(spark, d, "documents").select("doc_id", "source", "text")), doc="doc_id", name="source", text="text")


@query()
def planned_units(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval units built from the blocks of each paper, with fused evidence."""
    return units.build_units(_documents(spark, d), _blocks(spark, d))


# Index and retrieval

_INDEX = f"""{_C}, {_D}, {_P}, e AS (SELECT DISTINCT ON (chunk_id) chunk_id, embedding FROM chunk_embeddings WHERE model_name = '{MODEL}'),
idx AS (SELECT e.chunk_id, e.embedding, c.document_id, c.content, c.section_name, c.chunk_type, c.chunking_strategy, d.title AS document_title, p.id AS paper_id, p.arxiv_id
    FROM e JOIN c ON c.id = e.chunk_id JOIN d ON d.id = c.document_id LEFT JOIN p ON p.source_url = split_part(d.source, '#', 1))"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    embeddings = once(load_table(spark, d, "chunk_embeddings").where(F.col("model_name") == MODEL).select("chunk_id", "model_name", "embedding"), "chunk_id")
    return retrieval.index_rows(embeddings, _chunks(spark, d), _documents(spark, d), _papers(spark, d), MODEL)


@query(f"WITH {_INDEX} SELECT chunk_id, document_id, section_name, chunk_type, document_title, paper_id, arxiv_id FROM idx")
def index_feed(spark: SparkSession, d: str) -> DataFrame:
    """What the index holds of each embedded chunk."""
    return _index(spark, d).select("chunk_id", "document_id", "section_name", "chunk_type", "document_title", "paper_id", "arxiv_id")


@query(f"WITH {_C}, {_D}, {_P} SELECT c.id AS chunk_id, p.id AS paper_id, p.arxiv_id, c.section_name FROM c JOIN d ON d.id = c.document_id JOIN p ON p.source_url = split_part(d.source, '#', 1) WHERE coalesce(c.section_name, '') <> ''")
def question_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a section, with their papers."""
    docs = _documents(spark, d).select(F.col("id").alias("document_id"), F.split_part("source", F.lit("#"), F.lit(1)).alias("source_url"))
    papers = _papers(spark, d).select(F.col("id").alias("paper_id"), "arxiv_id", "source_url")
    chunks = _chunks(spark, d).where(F.coalesce("section_name", F.lit("")) != "").select(F.col("id").alias("chunk_id"), "document_id", "section_name")
    return chunks.join(docs, "document_id").join(papers, "source_url").select("chunk_id", "paper_id", "arxiv_id", "section_name")


@query(
    rf"""WITH {_INDEX}, t AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM idx)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM t) GROUP BY ALL) GROUP BY 1"""
)
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the index with the number of chunks and occurrences."""
    return retrieval.postings(_index(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


_WORDS = ("chunk_id", "paper_id", "chunking_strategy", "content")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The cases as queries; the vector of a case is that of its source chunk, as no model is at hand."""
    vectors = once(load_table(spark, d, "chunk_embeddings").where(F.col("model_name") == MODEL).select("chunk_id", "embedding"), "chunk_id")
    cases = _cases(spark, d).select(F.col("id").alias("query_id"), "query", F.col("paper_id").alias("paper_filter"), F.lit(None).cast("string").alias("strategy_filter"), F.col("source_chunk_id").alias("chunk_id"))
    return cases.join(vectors, "chunk_id", "left").select("query_id", "query", F.col("embedding").alias("vector"), "paper_filter", "strategy_filter")


_SEARCH = rf"""{_Q}, {_INDEX},
t AS (SELECT chunk_id, paper_id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM idx),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
post AS (SELECT chunk_id, paper_id, length, term, count(*) AS tf FROM (SELECT chunk_id, paper_id, len(w) AS length, unnest(w) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
qt AS (SELECT DISTINCT q.id AS query_id, q.paper_id AS paper_filter, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+')) AS term FROM q),
bm_all AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
    FROM qt JOIN post USING (term) JOIN df USING (term), stats WHERE paper_filter IS NULL OR paper_filter = post.paper_id GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm_all),
good AS (SELECT * FROM idx WHERE len(embedding) = 64 AND list_bool_and([isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
qv AS (SELECT q.id AS query_id, q.paper_id AS paper_filter, e.embedding AS v FROM q JOIN e ON e.chunk_id = q.source_chunk_id WHERE len(e.embedding) = 64 AND list_bool_and([isfinite(x) FOR x IN e.embedding]) AND list_bool_or([x <> 0 FOR x IN e.embedding])),
vec_all AS (SELECT query_id, chunk_id, round((1 + list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[])) / 2, 9) AS score FROM qv JOIN good ON paper_filter IS NULL OR paper_filter = good.paper_id),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vec_all),
fused AS (SELECT query_id, chunk_id, round(coalesce(1.0 / (60 + b.rank), 0) + coalesce(1.0 / (60 + v.rank), 0), 12) AS score, CASE WHEN b.rank IS NULL THEN 1 ELSE 0 END AS s, coalesce(b.rank, v.rank) AS r
    FROM (SELECT * FROM bm WHERE rank <= 40) b FULL JOIN (SELECT * FROM vec WHERE rank <= 40) v USING (query_id, chunk_id)),
hybrid_all AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s, r, chunk_id) AS rank FROM fused),
hybrid AS (SELECT query_id, chunk_id, score, rank FROM hybrid_all WHERE rank <= 10)"""


@query(f"WITH {_SEARCH} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks for each case by its words, within its paper."""
    return retrieval.bm25(cut(_asked(spark, d)), retrieval.stored(_index(spark, d), *_WORDS), K).withColumn("score", F.round("score", 6))


@query(f"WITH {_SEARCH} SELECT query_id, chunk_id, round(score, 6) AS score FROM vec WHERE rank <= 10")
def dense_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest chunks for each case, within its paper."""
    return retrieval.dense(cut(_asked(spark, d)), retrieval.stored(_index(spark, d), "chunk_id", "paper_id", "chunking_strategy", "embedding"), K).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SEARCH} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM hybrid")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and dense results fused by reciprocal rank."""
    return retrieval.search("hybrid", _asked(spark, d), _index(spark, d), K).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def _found_in_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Fused results, and the index they come from: joined and written once for both."""
    index = retrieval.stored(_index(spark, d), *_WORDS, "embedding", "document_id", "section_name")
    return retrieval.search("hybrid", _asked(spark, d), index, K, kept=True).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank"), index


@query()
def hybrid_hyde_rerank_search(spark: SparkSession, d: str) -> DataFrame:
    """Fused results of queries and expanded queries, reranked by shared terms."""
    asked, index = _asked(spark, d), _index(spark, d)
    expanded = retrieval.hashed_vectors(asked.drop("vector"), "query").select("query_id", "query", "vector", "paper_filter", "strategy_filter")
    return retrieval.search("hybrid_hyde_rerank", asked, index, K, expanded=expanded).select("query_id", "chunk_id", "score", "rank")


@query(
    f"""WITH {_SEARCH}, u AS (SELECT query_id, chunk_id, score, 0 AS position FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, score, 1 FROM vec WHERE rank <= 10),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, position) AS n FROM u) WHERE n = 1)
SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position, chunk_id) AS rank FROM one) WHERE rank <= 10"""
)
def results_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each chunk over both searches."""
    asked, index = cut(_asked(spark, d)), retrieval.stored(_index(spark, d))
    by_words, by_vector = cut(retrieval.bm25_lists(asked, index, K)), cut(retrieval.dense_lists(asked, index, K))
    both = retrieval.ranked(by_words).withColumn("position", F.lit(0)).unionByName(retrieval.ranked(by_vector).withColumn("position", F.lit(1)))
    return retrieval.best_of_each_chunk(both.drop("rank"), K).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


# Evaluation

_METRICS = """g AS (SELECT id AS query_id, list_distinct(gold_chunk_ids) AS relevant FROM q WHERE len(gold_chunk_ids) > 0),
m AS (SELECT g.query_id, len(relevant) AS size, h.rank, coalesce(list_contains(relevant, h.chunk_id), false) AS hit FROM g LEFT JOIN hybrid h USING (query_id))"""


def _metric_columns() -> str:
    out = []
    for k in evaluation.TOP_K:
        ideal = f"list_sum([1.0 / log2(i + 1) FOR i IN range(1, 1 + least(any_value(size), {k}))])"
        out += [
            f"round(count(*) FILTER (WHERE hit AND rank <= {k}) / any_value(size), 6) AS recall_{k}",
            f"round(coalesce(1.0 / min(rank) FILTER (WHERE hit AND rank <= {k}), 0), 6) AS mrr_{k}",
            f"round(coalesce(sum(1.0 / log2(rank + 1)) FILTER (WHERE hit AND rank <= {k}), 0) / {ideal}, 6) AS ndcg_{k}",
            f"CAST(count(*) FILTER (WHERE hit AND rank <= {k}) > 0 AS DOUBLE) AS hit_{k}",
        ]
    return ", ".join(out)


@query(f"WITH {_SEARCH}, {_METRICS} SELECT query_id, {_metric_columns()} FROM m GROUP BY 1")
def case_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank, gain and hit of the fused search for each case."""
    results = hybrid_search(spark, d).select("query_id", F.col("chunk_id").alias("item"), "rank")
    gold = _cases(spark, d).select(F.col("id").alias("query_id"), F.array_distinct("gold_chunk_ids").alias("relevant"))
    return evaluation.ranking_metrics(results, gold, ["query_id"])


@query(
    f"""WITH {_SEARCH}, r AS (SELECT query_id, h.chunk_id, document_id, lower(trim(regexp_replace(coalesce(section_name, ''), '\\s+', ' ', 'g'))) AS section, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS content FROM hybrid h JOIN idx USING (chunk_id)),
n AS (SELECT id, gold_chunk_ids, gold_document_ids, [lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) FOR s IN coalesce(gold_sections, [])] AS sections, [lower(trim(regexp_replace(k, '\\s+', ' ', 'g'))) FOR k IN coalesce(gold_keywords, []) IF k IS NOT NULL] AS keywords FROM q),
f AS (SELECT n.id AS query_id, coalesce(bool_or(list_contains(gold_chunk_ids, chunk_id)), false) AS chunk_hit, coalesce(bool_or(list_contains(gold_document_ids, document_id)), false) AS document_hit,
    coalesce(bool_or(list_contains(sections, section)), false) AS section_hit, coalesce(bool_or(len(list_filter(keywords, lambda k: contains(content, k))) > 0), false) AS keyword_hit FROM n LEFT JOIN r ON r.query_id = n.id GROUP BY 1)
SELECT *, chunk_hit OR document_hit OR section_hit OR keyword_hit AS citation_source_hit FROM f"""
)
def case_sources(spark: SparkSession, d: str) -> DataFrame:
    """What of each case's gold the fused results hold."""
    found, index = _found_in_index(spark, d)
    results = found.join(index.select("chunk_id", "document_id", "section_name", "content"), "chunk_id")
    return evaluation.source_metrics(results.drop("score", "rank"), _cases(spark, d).withColumn("query_id", F.col("id")), ["query_id"])


@query(
    f"""WITH {_SEARCH}, {_METRICS}, v AS (SELECT 'bm25' AS variant, query_id, chunk_id, rank FROM bm WHERE rank <= 10 UNION ALL SELECT 'dense', query_id, chunk_id, rank FROM vec WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM hybrid),
x AS (SELECT names.variant, g.query_id, len(relevant) AS size, v.rank, coalesce(list_contains(relevant, v.chunk_id), false) AS hit FROM g CROSS JOIN (SELECT unnest(['bm25', 'dense', 'hybrid']) AS variant) names LEFT JOIN v ON v.query_id = g.query_id AND v.variant = names.variant),
c1 AS (SELECT variant, query_id, {_metric_columns()} FROM x GROUP BY 1, 2)
SELECT variant, count(*) AS ok_cases, {", ".join(f"round(avg({m}_{k}), 3) AS {m}_{k}" for k in evaluation.TOP_K for m in ("recall", "mrr", "ndcg", "hit"))} FROM c1 GROUP BY 1"""
)
def variant_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics of three search strategies over all cases, in one job."""
    asked, index = cut(_asked(spark, d)), retrieval.stored(_index(spark, d))
    wide = retrieval.OVERFETCH * K
    lists = {"bm25": cut(retrieval.bm25_lists(asked, index, wide)), "vector": cut(retrieval.dense_lists(asked, index, wide))}
    by_words, by_vector, fused = retrieval.ranked(lists["bm25"]), retrieval.ranked(lists["vector"]), retrieval.fused_lists(lists)
    runs = None
    for name, found in (("bm25", by_words.where(F.col("rank") <= K)), ("dense", by_vector.where(F.col("rank") <= K)), ("hybrid", retrieval.top(fused, K, F.col("first_seen.source"), F.col("first_seen.rank")))):
        one = found.select(F.lit(name).alias("variant"), "query_id", F.col("chunk_id").alias("item"), "rank")
        runs = one if runs is None else runs.unionByName(one)
    gold = _cases(spark, d).select(F.col("id").alias("query_id"), F.array_distinct("gold_chunk_ids").alias("relevant"), F.explode(F.array(F.lit("bm25"), F.lit("dense"), F.lit("hybrid"))).alias("variant"))
    scored = evaluation.ranking_metrics(runs, gold, ["variant", "query_id"])
    means = [F.round(F.avg(f"{m}_{k}"), 3).alias(f"{m}_{k}") for k in evaluation.TOP_K for m in ("recall", "mrr", "ndcg", "hit")]
    return scored.groupBy("variant").agg(F.count("*").alias("ok_cases"), *means)


_RANKS = """r AS (SELECT query_id, rank, h.chunk_id, lower(trim(regexp_replace(coalesce(section_name, ''), '\\s+', ' ', 'g'))) AS section, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS content FROM hybrid h JOIN idx USING (chunk_id)),
n AS (SELECT id, paper_id, arxiv_id, source_chunk_id, [lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) FOR s IN coalesce(gold_sections, [])] AS sections, [lower(trim(regexp_replace(k, '\\s+', ' ', 'g'))) FOR k IN coalesce(gold_keywords, []) IF k IS NOT NULL] AS keywords FROM q),
ranks AS (SELECT n.id AS query_id, any_value(paper_id) AS paper_id, any_value(arxiv_id) AS arxiv_id, min(rank) FILTER (WHERE chunk_id = source_chunk_id OR list_contains(sections, section) OR len(list_filter(keywords, lambda k: contains(content, k))) > 0 OR len(list_filter(sections, lambda s: contains(content, '## ' || s))) > 0) AS hit_rank
    FROM n LEFT JOIN r ON r.query_id = n.id GROUP BY 1)"""


def _hit_ranks(spark: SparkSession, d: str) -> DataFrame:
    found, index = _found_in_index(spark, d)
    results = found.join(index.select("chunk_id", "section_name", "content"), "chunk_id")
    cases = _cases(spark, d).select(F.col("id").alias("query_id"), "paper_id", "arxiv_id", "source_chunk_id", "gold_sections", "gold_keywords")
    return evaluation.first_hit(results, cases).join(cases.select("query_id", "paper_id", "arxiv_id"), "query_id")


@query(f"WITH {_SEARCH}, {_RANKS} SELECT query_id, hit_rank FROM ranks")
def first_hits(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the first result that matches a case."""
    return _hit_ranks(spark, d).select("query_id", "hit_rank")


@query(
    f"""WITH {_SEARCH}, {_RANKS} SELECT coalesce(CAST(nullif(paper_id, 0) AS VARCHAR), nullif(arxiv_id, ''), 'unknown') AS paper, count(*) AS total_queries, round(avg(CASE WHEN hit_rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1,
round(avg(CASE WHEN hit_rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(coalesce(1.0 / hit_rank, 0)), 6) AS mrr FROM ranks GROUP BY 1"""
)
def hits_by_paper(spark: SparkSession, d: str) -> DataFrame:
    ranks = _hit_ranks(spark, d).withColumn("paper", evaluation.paper_key(F.col("paper_id"), F.col("arxiv_id")))
    return evaluation.hit_summary(ranks, "paper")


@query(f"WITH {_Q} SELECT id, strategy, list_sort(list_distinct(CASE WHEN len(coalesce(gold_chunk_ids_by_strategy[strategy], [])) > 0 THEN gold_chunk_ids_by_strategy[strategy] ELSE gold_chunk_ids END)) AS gold FROM q, (SELECT unnest(['fixed', 'agentic', 'fused']) AS strategy)")
def gold_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Gold chunks of each case for each chunking strategy."""
    cases = _cases(spark, d).select("*", F.explode(F.array(F.lit("fixed"), F.lit("agentic"), F.lit("fused"))).alias("strategy"))
    return cases.select("id", "strategy", F.array_sort(evaluation.gold_ids(F.col("strategy"))).alias("gold"))


@query(
    f"""WITH {_C} SELECT id, CASE WHEN contains(l, 'abstract') THEN 'What is the main contribution of the paper?' WHEN contains(l, 'method') OR contains(l, 'model') THEN 'What method is described in ' || section_name || '?'
WHEN contains(l, 'result') OR contains(l, 'performance') OR contains(l, 'calculate') THEN 'What result is reported in ' || section_name || '?' WHEN contains(l, 'conclusion') OR contains(l, 'consideration') OR contains(l, 'limitation') THEN 'What limitations or conclusions does the paper discuss?'
WHEN contains(l, 'table') THEN 'What does the table in ' || section_name || ' show?' ELSE 'What information is discussed in ' || section_name || '?' END AS question FROM (SELECT *, lower(section_name) AS l FROM c WHERE coalesce(section_name, '') <> '')"""
)
def generated_questions(spark: SparkSession, d: str) -> DataFrame:
    """A question for each chunk with a section."""
    return _chunks(spark, d).where(F.coalesce("section_name", F.lit("")) != "").select("id", evaluation.question_for(F.col("section_name")).alias("question"))


@query()
def extracted_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", text.keywords_of(F.col("content")).alias("keywords"))


# Query policies

_GUARD = """CASE WHEN t = '' THEN 'empty_query' WHEN length(t) > 1000 THEN 'query_too_long' WHEN len(regexp_extract_all(t, '[A-Za-z0-9\\x{4e00}-\\x{9fff}]')) < 2 THEN 'not_enough_meaningful_text'
WHEN length(c) >= 8 AND len(list_distinct(string_split(c, ''))) <= 2 THEN 'repeated_noise' ELSE 'fallback_rule_passed' END"""
_DIRECT = "regexp_full_match(query, '(?i)\\s*(你好[吗呀]?|hello|hi|\\d+\\s*[+\\-*/]\\s*\\d+)\\s*')"
_LOCAL = " OR ".join(f"contains(lower(query), '{w}')" for w in text.LOCAL_TERMS)


@query(
    f"""WITH {_Q}, x AS (SELECT id, query, trim(query, E' \\n\\t\\r') AS t, regexp_replace(query, '\\s+', '', 'g') AS c FROM q)
SELECT id, {_GUARD} AS guard, CASE WHEN {_DIRECT} THEN 'direct_answer' ELSE 'local_rag' END AS route, CAST(CASE WHEN {_DIRECT} OR {_LOCAL} THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence FROM x"""
)
def query_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Guard and route of each case's query by rule."""
    rows = _cases(spark, d).select("id", agent.guard(F.col("query")).alias("g"), agent.route(F.col("query")).alias("r"))
    return rows.select("id", F.col("g.reason").alias("guard"), F.col("r.route").alias("route"), F.col("r.confidence").alias("confidence"))


@query()
def graded_results(spark: SparkSession, d: str) -> DataFrame:
    """Whether the three best fused results suffice for each case, by rule."""
    asked, index = _asked(spark, d), _index(spark, d)
    rows = retrieval.hybrid(asked, retrieval.stored(index), 3).join(_chunks(spark, d).select(F.col("id").alias("chunk_id"), "content", "section_name"), "chunk_id")
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content", "section_name"))).alias("r"))
    graded = asked.select("query_id", "query").join(lists, "query_id", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<rank:int,content:string,section_name:string>>")))
    decision = agent.grade(F.col("query"), F.transform("r", lambda x: x.content), F.transform("r", lambda x: x.section_name))
    return graded.select("query_id", decision.alias("g")).select("query_id", "g.relevant", "g.sufficient", F.round("g.score", 6).alias("score"), "g.reason")


@query(f"SELECT {_text("date_trunc('hour', ts)")} AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_hour_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by a stream over the events, read to its end."""
    from tarnwell.streaming.ingest import hourly_totals

    return hourly_totals(spark, f"{d}/events.parquet").withColumn("hour", _stamp("hour"))


# More of the inventory


@query(
    f"""WITH {_P}, x AS (SELECT id, unnest(categories) AS category FROM p)
SELECT category, id, n AS place FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id) AS n FROM (SELECT DISTINCT category, id FROM x)) WHERE n <= 5"""
)
def candidates_by_category(spark: SparkSession, d: str) -> DataFrame:
    """The first five papers of each category, as a sample of candidates."""
    rows = _papers(spark, d).select("id", F.explode("categories").alias("category")).distinct()
    place = F.row_number().over(Window.partitionBy("category").orderBy("id"))
    return rows.withColumn("place", place).where("place <= 5").select("category", "id", "place")


@query(f"WITH {_D} SELECT split_part(source, '#', 1) AS page, max(id) AS id, count(*) AS parts FROM d GROUP BY 1")
def latest_document_of_each_page(spark: SparkSession, d: str) -> DataFrame:
    """The last document of each source page, and how many there are."""
    rows = _documents(spark, d).select(F.split_part("source", F.lit("#"), F.lit(1)).alias("page"), "id")
    return rows.groupBy("page").agg(F.max("id").alias("id"), F.count("*").alias("parts"))


@query("SELECT chunk_id, model_name, min(id) AS id FROM chunk_embeddings GROUP BY 1, 2")
def embeddings_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings that an empty store takes: the first of each chunk and model."""
    rows = load_table(spark, d, "chunk_embeddings").select("id", "chunk_id", "model_name")
    return store.absent_rows(rows, rows.limit(0), ["chunk_id", "model_name"], [F.col("id")]).select("chunk_id", "model_name", "id")


@query("SELECT model_name, count(DISTINCT chunk_id) AS chunks, count(DISTINCT len(embedding)) AS lengths FROM chunk_embeddings GROUP BY 1")
def embeddings_by_model(spark: SparkSession, d: str) -> DataFrame:
    rows = load_table(spark, d, "chunk_embeddings").select("model_name", "chunk_id", F.size("embedding").alias("n"))
    return rows.groupBy("model_name").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct(F.when(F.col("n") >= 0, F.col("n"))).alias("lengths"))


@query(f"WITH {_INDEX} SELECT indexed, embedded, indexed = embedded AS agree FROM (SELECT count(DISTINCT chunk_id) AS indexed FROM idx), (SELECT count(DISTINCT chunk_id) AS embedded FROM chunk_embeddings WHERE model_name = '{MODEL}')")
def index_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index holds every embedding of its model."""
    from tarnwell.plans.pipeline import reconcile

    return reconcile(_index(spark, d), load_table(spark, d, "chunk_embeddings"), MODEL)


@query(
    rf"""WITH {_B}, t AS (SELECT id, trim(content, E' \n\t\r') AS t FROM b)
SELECT id, length(t) >= 8 AND (len(regexp_extract_all(t, '\b\d+(?:\.\d+)?%?\b')) >= 3 OR (len(regexp_extract_all(t, '\d')) / length(t) > 0.35 AND len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) >= 3)
OR len(regexp_extract_all(t, '\|')) + len(regexp_extract_all(t, '\t')) + len(regexp_extract_all(t, '\s{{2,}}')) >= 2) AS numeric_heavy FROM t"""
)
def numeric_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that are mostly numbers."""
    return _blocks(spark, d).select("id", text.is_numeric_heavy(F.col("content")).alias("numeric_heavy"))


@query()
def block_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Code, formulas, tables, names, headings and captions behind links, by pattern."""
    c = F.col("content")
    flags = {"code": text.is_code(c), "formula": text.is_formula(c), "table": text.is_table(c), "authors": text.is_author_line(c), "affiliation": text.is_affiliation_line(c), "heading": text.is_clear_heading(F.col("block_type"), c), "regular_table": text.table_is_regular(c)}
    return _blocks(spark, d).select("id", *[v.alias(k) for k, v in flags.items()], text.embedded_caption(c)["kind"].alias("caption_behind_link"), text.trailing_heading(c).alias("trailing_heading"))


@query(f"WITH {_B} SELECT id, array_to_string(list_slice(list_filter(string_split(content, chr(10)), lambda x: trim(x, E' \n\t\r') <> ''), 1, 7), chr(10)) AS first_rows FROM b WHERE block_type = 'table'")
def table_previews(spark: SparkSession, d: str) -> DataFrame:
    """Header, separator and five rows of each table."""
    return _blocks(spark, d).where("block_type = 'table'").select("id", text.first_rows(F.col("content")).alias("first_rows"))


@query(
    f"""WITH {_B}, {_C}, s AS (SELECT DISTINCT id, unnest(source_block_ids) AS block_id FROM c)
SELECT s.id, list_sort(list_distinct(list(page_number) FILTER (WHERE page_number IS NOT NULL))) AS pages, string_agg(content, E'\n\n' ORDER BY paper_id, order_index, block_id) AS content FROM s JOIN b ON b.id = block_id GROUP BY 1"""
)
def chunks_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk from its source blocks in reading order, with their pages."""
    wanted = _chunks(spark, d).select("id", F.explode(F.array_distinct("source_block_ids")).alias("block_id"))
    blocks = _blocks(spark, d).select(F.col("id").alias("block_id"), "paper_id", "order_index", "page_number", "content")
    parts = F.array_sort(F.collect_list(F.struct("paper_id", "order_index", "block_id", "content")))
    rows = wanted.join(blocks, "block_id").groupBy("id").agg(F.array_sort(F.collect_set("page_number")).alias("pages"), F.array_join(F.transform(parts, lambda x: x.content), "\n\n").alias("content"))
    return rows.withColumn("pages", F.when(F.size("pages") > 0, F.col("pages")))


@query(
    rf"""WITH {_B}, x AS (SELECT id, paper_id, block_type, order_index, unnest(list_distinct([CASE WHEN regexp_matches(lower(x), '^table') THEN 'Table ' ELSE 'Fig. ' END || regexp_extract(x, '(\d+)', 1)
    FOR x IN regexp_extract_all(content, '(?i)\b(figure|fig\.?|table)\s*\d+\b')])) AS ref, list_distinct(regexp_extract_all(lower(content), '[a-z]{{3,}}')) AS w FROM b),
m AS (SELECT v.id AS visual_id, t.id AS text_id, t.order_index AS o, round(max(len(list_intersect(v.w, t.w)) / len(list_distinct(list_concat(v.w, t.w)))), 6) AS score
    FROM x v JOIN x t USING (paper_id, ref) WHERE v.block_type IN ('figure_caption', 'table_caption') AND t.block_type = 'paragraph' GROUP BY 1, 2, 3)
SELECT visual_id, text_id, score FROM (SELECT *, row_number() OVER (PARTITION BY visual_id ORDER BY score DESC, o, text_id) AS n FROM m) WHERE n = 1"""
)
def visual_bindings(spark: SparkSession, d: str) -> DataFrame:
    """For each caption the paragraph of its paper that names the same figure or table and has most words in common."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([a-z]{3,})"), F.lit(1)))
    rows = _blocks(spark, d).select("id", "paper_id", "block_type", "order_index", F.explode(F.array_distinct(text.visual_refs(F.col("content")))).alias("ref"), words.alias("w"))
    visual = rows.where(F.col("block_type").isin("figure_caption", "table_caption")).select("paper_id", "ref", F.col("id").alias("visual_id"), F.col("w").alias("v"))
    body = rows.where("block_type = 'paragraph'").select("paper_id", "ref", F.col("id").alias("text_id"), "order_index", "w")
    scored = visual.join(body, ["paper_id", "ref"]).withColumn("score", F.round(measures.jaccard(F.col("v"), F.col("w")), 6))
    best = scored.groupBy("visual_id").agg(F.max_by(F.struct("text_id", "score"), F.struct("score", -F.col("order_index"), -F.col("text_id"))).alias("b"))
    return best.select("visual_id", "b.text_id", "b.score")


@query()
def boundaries_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Planned chunks with boundaries put right."""
    return units.repaired(_chunks(spark, d).where("chunking_strategy = 'agentic'"))


@query(
    f"""WITH {_SEARCH}, wide AS (SELECT query_id, chunk_id, rank FROM hybrid_all WHERE rank <= 20),
w AS (SELECT query_id, chunk_id, rank AS before, list_distinct(regexp_extract_all(lower(q.query), '[\\p{{L}}\\p{{N}}]+')) AS a, list_distinct(regexp_extract_all(lower(idx.content), '[\\p{{L}}\\p{{N}}]+')) AS b FROM wide JOIN q ON q.id = query_id JOIN idx USING (chunk_id)),
z AS (SELECT query_id, chunk_id, before, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END, 9) AS score FROM w)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, chunk_id) AS rank FROM z) WHERE rank <= 10"""
)
def hybrid_rerank_search(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best fused results of each case, reranked by shared terms."""
    found = retrieval.search("hybrid_rerank", _asked(spark, d), _index(spark, d), K)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {_SEARCH.replace("paper_filter IS NULL OR paper_filter = post.paper_id", "(paper_filter IS NULL OR paper_filter = post.paper_id) AND post.chunk_id IN (SELECT chunk_id FROM idx WHERE chunking_strategy IN ('agentic', 'agentic_fusion', 'fused'))")}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10"""
)
def planned_chunk_search(spark: SparkSession, d: str) -> DataFrame:
    """Search by words among planned and fused chunks alone."""
    asked = cut(_asked(spark, d).withColumn("strategy_filter", F.lit("agentic")))
    return retrieval.bm25(asked, retrieval.stored(_index(spark, d), *_WORDS), K).withColumn("score", F.round("score", 6))


_PLAN = (("retrieval::bm25", "bm25", "fixed", ()), ("retrieval::hybrid", "hybrid", "agentic", ()), ("lookup::dense", "dense", "agentic", ("lookup",)))


@query(
    f"""WITH {_Q}, v AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{s}', '{c}', {list(k)}::VARCHAR[])" for n, s, c, k in _PLAN)}) AS t(variant, strategy, chunk_strategy, categories))
SELECT q.id, variant, strategy, chunk_strategy FROM q, v WHERE len(categories) = 0 OR list_contains(categories, coalesce(category, 'unknown'))"""
)
def benchmark_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases of each variant of an experiment plan."""
    variants = spark.createDataFrame([(n, s, c, list(k), []) for n, s, c, k in _PLAN], "variant string, strategy string, chunk_strategy string, categories array<string>, tags array<string>")
    return evaluation.cases_of_variants(_cases(spark, d).select("id", "category", "tags"), variants).select("id", "variant", "strategy", "chunk_strategy")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Events by kind and a property of their JSON."""
    rows = load_table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_C} SELECT id, unnest(range(0, len(parts))) AS part, unnest(parts) AS content FROM (SELECT id, string_split(regexp_replace(content, '\\n(##\\s+\\d)', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM c)"""
)
def chunks_at_headings(spark: SparkSession, d: str) -> DataFrame:
    """Chunks cut before numbered headings within them."""
    return _chunks(spark, d).select("id", F.posexplode(text.at_headings(F.col("content"))).alias("part", "content"))


@query(
    f"""WITH {_C} SELECT id, unnest(range(0, len(parts))) AS part, unnest(parts) AS content FROM (SELECT id, string_split(regexp_replace(content, '(?i)(.)\\b((?:Table|Figure|Fig\\.)\\s*\\d+[:.]\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM c)"""
)
def chunks_at_captions(spark: SparkSession, d: str) -> DataFrame:
    """Chunks cut before captions within them."""
    return _chunks(spark, d).select("id", F.posexplode(text.at_captions(F.col("content"))).alias("part", "content"))


@query(
    f"""WITH {_INDEX}, m AS (SELECT idx.chunk_id, idx.paper_id, idx.section_name, c.metadata AS m FROM idx JOIN c ON c.id = idx.chunk_id)
SELECT chunk_id, coalesce(m.paper_id, paper_id) AS paper_id, coalesce(nullif(m.section, ''), section_name) AS section, m.page_range AS page_range, coalesce(len(m.quality_flags), 0) AS flags FROM m"""
)
def index_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of the index: what a chunk says of itself goes before what its paper says."""
    own = once(load_table(spark, d, "document_chunks").select(F.col("id").alias("chunk_id"), F.col("metadata").alias("m")), "chunk_id")
    rows = _index(spark, d).select("chunk_id", "paper_id", "section_name").join(own, "chunk_id")
    return rows.select(
        "chunk_id", F.coalesce("m.paper_id", "paper_id").alias("paper_id"), F.coalesce(F.nullif("m.section", F.lit("")), "section_name").alias("section"), F.col("m.page_range").alias("page_range"),
        F.greatest(F.size("m.quality_flags"), F.lit(0)).alias("flags"),
    )


@query()
def planning_windows(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in windows of at most 800 words for a planner."""
    return chunking.planning_windows(_blocks(spark, d))


@query()
def neighbours_held(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of which a long part occurs in the next one of their document and strategy."""
    order = Window.partitionBy("document_id", "chunking_strategy").orderBy("chunk_index", "id")
    rows = _chunks(spark, d).withColumn("next_content", F.lead("content").over(order)).where("next_content IS NOT NULL")
    return rows.select("id", text.contains_long_part(F.col("content"), F.col("next_content")).alias("held"), text.needs_second_look(F.col("content")).alias("second_look"))


@query(
    f"""WITH {_C}, e AS (SELECT DISTINCT ON (id) * FROM chunk_embeddings), n AS (SELECT model_name, count(DISTINCT chunk_id) AS embedded FROM e GROUP BY 1)
SELECT model_name, (SELECT count(*) FROM c) AS chunks, embedded, (SELECT count(*) FROM c) - embedded AS missing FROM n"""
)
def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with and without an embedding, by model."""
    rows = load_table(spark, d, "chunk_embeddings").groupBy("model_name").agg(F.countDistinct("chunk_id").alias("embedded"))
    chunks = load_table(spark, d, "document_chunks").agg(F.countDistinct("id").alias("chunks"))
    return rows.crossJoin(F.broadcast(chunks)).select("model_name", "chunks", "embedded", (F.col("chunks") - F.col("embedded")).alias("missing"))


from tarnwell.plans import lookups  # noqa: E402, F401 - adds its queries to these
