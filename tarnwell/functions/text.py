"""Text predicates and normalisers as columns, evaluated by the engine without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Block types, words and patterns that decide how a line or block is read.
BLOCK_TYPES = (
    "title", "abstract", "section_title", "paragraph", "content_block", "figure", "image_reference", "figure_caption", "table", "table_caption", "formula", "code",
    "algorithm", "list", "footnote", "reference", "appendix", "authors", "affiliation", "table_like", "date", "page_number", "metadata", "unknown",
)
EMBEDDABLE_TYPES = ("title", "abstract", "section_title", "paragraph", "content_block", "figure_caption", "table_caption", "table", "code", "algorithm")
SECTION_TITLES = (
    "abstract", "introduction", "related work", "background", "method", "methods", "methodology", "approach", "experiments", "experimental setup", "results", "discussion",
    "conclusion", "conclusions", "references", "appendix",
)
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
YEAR = r"(?:19|20)\d{2}"
AFFILIATION = r"(?i)\b(Department of|School of|University|Institute|College|Laboratory|Lab|Faculty|Email|E-mail|@)\b"
SILENT_TYPES = ("title", "authors", "affiliation", "date", "page_number", "metadata")
NAMES_WITHIN, LEAST_MEANINGFUL, LONGEST_TITLE = 6, 20, 220
LINE_ENDS = r"\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029"
LETTERS = r"[A-Za-z\x{4e00}-\x{9fff}]"
IMAGE, HEADING = r"^!\[([^\]]*)\]\(([^)]+)\)", r"^#{1,6}\s+(.+)$"
HEADING_FIRST = r"^#{1,6}[^\S\n]+\S|^\d+(?:\.\d+)*[^\S\n]+[A-Z][^\n.]{1,160}(?:\n|$)"
NUMBERED_HEADING = r"^\d+(?:\.\d+)*\s+[A-Z][^\n.]{1,160}$"
CODE = (
    r"(?im)^\s*(?:def|class|import|from|for|while|if|elif|else|try|except|return)\b|^\s*\{.+:.+\}\s*$|^\s*\[[^\]]+:.+\]\s*$|^\s*[-\w]+:\s*[^,]+$"
    r"|^\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|WITH)\b|^\s*(?:curl|uv|python|pip|docker|git|npm)\b"
)
FORMULA, FORMULA_SIGN = r"\\[a-zA-Z]+|[αβγλμσ∑∫√≈≤≥≠∞]|\b[a-zA-Z]\s*=\s*", r"[=\\αβγλ∑∫]"
TABLE_LINE = r"(?m)^\s*\|.+\|\s*$|^\s*[-+]{3,}\s*$"
NAME_PAIR, NAME_PAIR_MARKED = r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+[0-9*†‡§¶]*\b"
CAPTION_WITHIN = r"(?i)\b(?:Table|Figure|Fig\.)\s*\d+[A-Za-z]?\s*[:.]\s*"
LINK_TERMS = ("http", "github", "huggingface", "physionet", "link")
PLAIN_HEADING, WORDS_OF_HEADING = r"^(?:\d+(?:\.\d+)*\s+)?[A-Z][\w/&: -]+$", 12
METADATA_TERMS, METADATA_DATE, METADATA_WORDS = ("university", "department of", "school of", "institute", "affiliation"), r"^(?:19|20)\d{2}(?:[-/]\d{1,2}){0,2}$", r"\b(?:author|authors|copyright|license)\b"
BREAKS_OFF = r"(?i)(?:\band\s*\(\d+\)|\bsuch as|\bincluding|\bwhere|\bbecause|\blet|[:,;])\s*$"
NUMBERED_H2 = r"^##\s+\d+(?:\.\d+)*\s+.+$"
WORDS_OF_TITLE, FRONT_MATTER_TERMS, RIGHTS_TERMS = 14, ("@", "university", "department of", "school of", "affiliation"), ("arxiv.org", "copyright", "license")
OPEN_ENDS = r"(?i)\b(?:and|or|where|because|therefore|including|such as|with|by|for|to|in)\s*$|[,;:]\s*$|\b(?:and|or)\s*\(\d+\)\s*$"
LOCAL_TERMS = ("langchain", "langgraph", "rag", "retrieval", "知识库", "文档", "检索")
CURRENT_TERMS = ("today", "current", "latest", "news", "weather", "price", "schedule", "现在", "今天", "最新", "新闻", "实时", "天气", "价格", "日程")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def starts_with_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.startswith(w)
    return out


def sanitized(text: Column) -> Column:
    """Without control characters other than line feeds, carriage returns and tabs."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n\r\t]]", "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def single_spaced(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def cleaned(text: Column, is_clean: bool = False) -> Column:
    """Without control characters and white space around it; ``is_clean`` says that the text is so already, which keeps plans small."""
    return text if is_clean else stripped(sanitized(text))


def normal(text: Column) -> Column:
    """Lower case with single spaces: how sections, keywords and references are compared."""
    return single_spaced(F.lower(text))


def filled_lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    lines = F.transform(F.split(text, rf"\r\n|[{LINE_ENDS}]"), stripped)
    return F.filter(lines, lambda x: x != "")


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; null where there is none."""
    return F.nullif(stripped(F.regexp_extract(text, rf"(?U)(\S[^{LINE_ENDS}]*)", 1)), F.lit(""))


def has_several_lines(text: Column) -> Column:
    """Whether more than one line is not blank."""
    return text.rlike(rf"(?U)\S\s*[{LINE_ENDS}]\s*\S")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def token_estimate(text: Column) -> Column:
    """Words between white space, at least one."""
    words = word_count(text)
    return F.when(words > 0, words).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def block_type(value: Column) -> Column:
    low = F.lower(stripped(sanitized(value)))
    return F.when(low.isin(*BLOCK_TYPES), low).otherwise("unknown")


def is_embeddable(value: Column) -> Column:
    return block_type(value).isin(*EMBEDDABLE_TYPES)


def field_of(content: Column, name: str) -> Column:
    """Value behind ``name:`` on a line of its own, null where there is none."""
    value = F.regexp_extract(content, rf"(?m)^{name}:\s*(.+)$", 1)
    return F.nullif(stripped(value), F.lit(""))


def heading_section(content: Column) -> Column:
    """Section that the first line names with a second-level heading."""
    name = F.regexp_extract(first_line(sanitized(content)), r"^##\s+(.+)$", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        name = F.replace(name, F.lit(entity), F.lit(char))
    return F.nullif(stripped(name), F.lit(""))


def section_of(content: Column, planned: Column, otherwise: Column) -> Column:
    return F.coalesce(heading_section(content), F.nullif(planned, F.lit("")), otherwise)


# Noise


def is_page_number(text: Column) -> Column:
    return text.rlike(r"^(?:\d{1,3}|(?i:i|ii|iii|iv|v|vi|vii|viii|ix|x))$")


def is_date(text: Column) -> Column:
    one = single_spaced(text)
    forms = (YEAR, rf"(?i:{MONTH})\.?\s+{YEAR}", rf"\d{{1,2}}\s+(?i:{MONTH})\.?\s+{YEAR}", rf"(?i:{MONTH})\.?\s+\d{{1,2}},?\s+{YEAR}", rf"{YEAR}[-/]\d{{1,2}}(?:[-/]\d{{1,2}})?")
    return one.rlike("^(?:" + "|".join(forms) + ")$")


def is_licence_line(text: Column) -> Column:
    low = F.lower(text)
    return starts_with_any(low, ("arxiv:", "preprint", "submitted to", "under review")) | any_of(low, ("arxiv.org", "all rights reserved", "creative commons", "copyright", "license"))


def is_running_header(text: Column) -> Column:
    one = stripped(F.regexp_replace(single_spaced(text), r"^#{1,6}\s*", ""))
    return one.rlike(r"^(?:\d{1,3}\s*[·•]\s+.+|.+\s*[·•]\s+\d{1,3}|(?i:page)\s+\d{1,3}(?:\s+(?i:of)\s+\d{1,3})?)$")


def is_footnote_mark(text: Column) -> Column:
    compact = F.regexp_replace(text, r"(?U)\s+", "")
    return (F.length(text) <= 24) & (compact.rlike(r"^[\d,*†‡§]+$") | text.rlike(r"^(?:\d+[,\s]*){1,6}$") | text.rlike("^[¹²³⁰-⁹]+$"))


def is_table_or_several_lines(text: Column) -> Column:
    return has_several_lines(text) | F.contains(text, F.lit("|")) | F.contains(text, F.lit("\t"))


def is_noise(content: Column, is_clean: bool = False) -> Column:
    """Empty, or one line that is a page number, running header, date, licence or footnote mark."""
    text = cleaned(content, is_clean)
    single = is_page_number(text) | is_running_header(text) | is_date(text) | is_licence_line(text) | is_footnote_mark(text)
    return (text == "") | (~is_table_or_several_lines(text) & single)


def is_boundary_noise(content: Column) -> Column:
    text = stripped(sanitized(content))
    return (text != "") & (is_page_number(text) | is_running_header(text) | is_footnote_mark(text))


def is_noise_line(text: Column) -> Column:
    one = stripped(text)
    low = F.lower(one)
    return is_noise(one) | one.rlike(r"^\d+$") | (F.length(one) <= 2) | is_licence_line(low) & ~F.contains(low, F.lit("arxiv.org")) | low.isin("doi", "www", "http", "https")


# Kinds of blocks


def is_bracket_fragment(text: Column) -> Column:
    return stripped(text).rlike(r"^(?:\.\.\.|\[[.\s]*\])$")


def is_code(text: Column) -> Column:
    return ~is_bracket_fragment(text) & (text.rlike(r"\n(?: {4}|\t)") | text.rlike(CODE))


def is_formula(text: Column) -> Column:
    return (F.length(text) <= 500) & text.rlike(FORMULA) & text.rlike(FORMULA_SIGN)


def is_table(text: Column) -> Column:
    return text.rlike(TABLE_LINE) | (F.regexp_count(text, F.lit("\t")) >= 4)


def is_author_line(text: Column, is_clean: bool = False) -> Column:
    one = cleaned(text, is_clean)
    caption = one.rlike(r"(?i)^(?:Algorithm|Figure|Fig\.|Table)\s*\d+\b")
    several = one.rlike(r"(?i)\band\b|\b,\b") & one.rlike(NAME_PAIR)
    pair = one.rlike(NAME_PAIR_MARKED) & (word_count(one) <= 18)
    return (one != "") & (F.length(one) <= 220) & ~caption & (F.contains(one, F.lit("@")) | several | pair)


def is_affiliation_line(text: Column, is_clean: bool = False) -> Column:
    return (text if is_clean else sanitized(text)).rlike(AFFILIATION)


def plain_kind(text: Column, first: Column | None = None, is_clean: bool = False) -> Column:
    """Kind of a block by its first line (``first`` where it is known), wherever it stands: the first rule that holds."""
    clean = cleaned(text, is_clean)
    first = F.coalesce(first_line(clean), F.lit("")) if first is None else first
    low = F.lower(stripped(F.regexp_replace(first, r"^\d+(\.\d+)*\s+", "")))
    return (
        F.when(clean == "", "unknown")
        .when((low == "abstract") | F.lower(first).startswith("abstract"), "abstract")
        .when(low == "references", "reference")
        .when(low == "appendix", "appendix")
        .when(low.isin(*SECTION_TITLES), "section_title")
        .when(first.rlike(r"(?i)^(?:figure|fig\.)\s*\d+[:.\s]"), "figure_caption")
        .when(first.rlike(r"(?i)^table\s*\d+[:.\s]"), "table_caption")
        .when(is_table(clean), "table")
        .when(first.rlike(r"(?i)^(?:algorithm\s*\d+|procedure|pseudo\s*code|pseudocode)\b"), "algorithm")
        .when(is_code(clean), "code")
        .when(is_formula(clean), "formula")
        .when(first.rlike(r"(?i)^\[\d+\]|\bet al\.\b|^references$"), "reference")
        .when(first.rlike(r"^[-*•]"), "list")
        .otherwise("paragraph")
    )


def block_kind(text: Column, order: Column) -> Column:
    """Kind of a block by its place and its first line: a title comes first, names stand near the beginning."""
    clean = stripped(sanitized(text))
    first = F.coalesce(first_line(clean), F.lit(""))
    names = names_kind(first)
    return F.when(clean == "", "unknown").when((order == 0) & (F.length(first) <= LONGEST_TITLE), "title").when((order <= NAMES_WITHIN) & names.isNotNull(), names).otherwise(plain_kind(text))


def is_meaningful(text: Column) -> Column:
    one = stripped(text)
    return (F.length(one) >= LEAST_MEANINGFUL) & one.rlike(LETTERS)


def is_numeric_heavy(text: Column, is_clean: bool = False) -> Column:
    one = text if is_clean else stripped(text)
    digits, tokens = F.regexp_count(one, F.lit(r"\d")), F.greatest(F.lit(1), word_count(one))
    numbers = F.regexp_count(one, F.lit(r"\b\d+(?:\.\d+)?%?\b"))
    gaps = F.regexp_count(one, F.lit(r"\|")) + F.regexp_count(one, F.lit(r"\t")) + F.regexp_count(one, F.lit(r"\s{2,}"))
    return (F.length(one) >= 8) & ((numbers >= 3) | ((digits > F.length(one) * 0.35) & (tokens >= 3)) | (gaps >= 2))


def is_clear_heading(kind: Column, text: Column) -> Column:
    first = F.coalesce(first_line(sanitized(text)), F.lit(""))
    return first.rlike(r"^#{1,6}\s+\S+") | (kind == "section_title") | first.rlike(NUMBERED_HEADING)


def names_kind(text: Column, is_clean: bool = False) -> Column:
    """``affiliation`` or ``authors`` for a line of institutions or names, else null."""
    return F.when(is_affiliation_line(text, is_clean), "affiliation").when(is_author_line(text, is_clean), "authors")


def may_be_title(one: Column) -> Column:
    """Whether a heading or paragraph without white space around it is fit to be a title where none is marked."""
    return F.length(one).between(12, LONGEST_TITLE) & ~is_numeric_heavy(one, True) & one.rlike(LETTERS)


def settled_kind(kind: Column, text: Column, is_clean: bool = False) -> Column:
    """The few kinds that blocks of a converted document are brought down to."""
    clean = cleaned(text, is_clean)
    return (
        F.when(clean == "", F.when(kind.isin("figure", "image_reference"), "image_reference").otherwise("unknown"))
        .when(is_image_reference(clean, True), "image_reference")
        .when(has_markdown_table(clean), "table")
        .when((kind != "title") & ((kind == "section_title") | clean.rlike(HEADING_FIRST)), "section_title")
        .when(kind.isin(*SILENT_TYPES, "reference"), kind)
        .otherwise("paragraph")
    )


def is_table_row(line: Column) -> Column:
    return line.startswith("|") & line.endswith("|") & (F.regexp_count(line, F.lit(r"\|")) >= 2)


def has_markdown_table(text: Column) -> Column:
    return F.contains(text, F.lit("|")) & F.contains(text, F.lit("---"))


def is_caption(text: Column) -> Column:
    return stripped(sanitized(text)).rlike(r"(?i)^(?:Figure|Fig\.|Table)\s*\d+[:.]")


def is_image_reference(text: Column, is_clean: bool = False) -> Column:
    one = F.lower(cleaned(text, is_clean))
    return one.startswith("<!-- image") & one.endswith("-->")


def embedded_caption(text: Column) -> Column:
    """(prefix, caption, kind) where a caption follows a link or a note on one line, else null."""
    clean = stripped(sanitized(text))
    at = F.regexp_instr(clean, F.lit(CAPTION_WITHIN))
    prefix, caption = stripped(F.substr(clean, F.lit(1), at - 1)), stripped(F.substr(clean, at))
    low = F.lower(prefix)
    metadata = any_of(low, LINK_TERMS) | prefix.rlike(r"^(?:\d+\s+[^.]+\.?\s*){1,4}$")
    kind = F.when(F.lower(caption).startswith("table"), "table_caption").otherwise("figure_caption")
    return F.when((at > 1) & (prefix != "") & metadata, F.struct(prefix.alias("prefix"), caption.alias("caption"), kind.alias("kind")))


def visual_refs(text: Column) -> Column:
    """Figures and tables named in a text, as ``Fig. n`` and ``Table n``, in order, with repeats."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b((?:Figure|Fig\.?|Table)\s*\d+)\b"), F.lit(1))
    return F.transform(
        found,
        lambda x: F.concat(F.when(F.lower(x).startswith("table"), F.lit("Table ")).otherwise(F.lit("Fig. ")), F.regexp_extract(x, r"(\d+)", 1)),
    )


def last_line(text: Column) -> Column:
    lines = filled_lines(text)
    return F.get(lines, F.size(lines) - 1)


def ends_unfinished_enumeration(text: Column) -> Column:
    return F.get(F.split(text, "\n"), 0).rlike(r"(?i)^.*\band\s*\(\d+\)\s*$") & ~F.contains(text, F.lit("\n"))


def trailing_heading(text: Column) -> Column:
    """A numbered second-level heading on the last line, else null."""
    last = last_line(text)
    return F.when(last.rlike(r"^##\s+\d+(?:\.\d+)*\.?\s+\S"), last)


def table_is_regular(text: Column) -> Column:
    """A separator row, and the same number of cells in every row."""
    rows = F.filter(filled_lines(text), lambda x: F.contains(x, F.lit("|")))
    widths = F.array_distinct(F.transform(rows, lambda x: F.regexp_count(x, F.lit(r"\|"))))
    return (F.size(rows) >= 2) & (F.size(widths) == 1) & F.exists(rows, lambda x: x.rlike(r"---"))


def first_rows(table: Column, rows: int = 5) -> Column:
    """Header, separator and the first ``rows`` rows of a table."""
    lines = F.filter(F.split(table, "\n"), lambda x: stripped(x) != "")
    return F.array_join(F.slice(lines, 1, rows + 2), "\n")


def retrieval_text(text: Column) -> Column:
    """Without image comments and runs of blank lines."""
    one = F.regexp_replace(text, r"(?is)<!--\s*image.*?-->", "")
    return stripped(F.regexp_replace(one, r"\n{3,}", "\n\n"))


def at_headings(text: Column) -> Column:
    """The text cut before each numbered second-level heading within it."""
    return F.split(F.regexp_replace(text, r"\n(##\s+\d)", "\u0001$1"), "\u0001")


def at_captions(text: Column) -> Column:
    """The text cut before each figure or table caption within it."""
    return F.split(F.regexp_replace(text, r"(?i)(.)\b((?:Table|Figure|Fig\.)\s*\d+[:.]\s)", "$1\u0001$2"), "\u0001")


def contains_long_part(a: Column, b: Column, window: int = 240, step: int = 80, least: int = 120) -> Column:
    """Whether some window of ``a``, or all of it where it is shorter, occurs in ``b``."""
    one, other = single_spaced(a), single_spaced(b)
    last = F.greatest(F.floor((F.length(one) - window) / step), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(one, i * step + 1, F.lit(window)))
    return (F.length(one) >= least) & F.exists(parts, lambda x: F.contains(other, x))


def json_object(text: Column) -> Column:
    """From the first brace to the last, null where there are none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def needs_second_look(text: Column) -> Column:
    """Short units with a figure, table or formula."""
    return (token_estimate(text) < 80) & (is_caption(text) | has_markdown_table(text) | is_formula(text))


# Queries


def is_local_query(query: Column) -> Column:
    return any_of(F.lower(query), LOCAL_TERMS)


def is_current_query(query: Column) -> Column:
    return any_of(F.lower(query), CURRENT_TERMS)


def is_direct_query(query: Column) -> Column:
    return query.rlike(r"(?i)^\s*(?:你好[吗呀]?|hello|hi|\d+\s*[+\-*/]\s*\d+)\s*$")


def is_repeated_noise(query: Column) -> Column:
    compact = F.regexp_replace(query, r"(?U)\s+", "")
    return (F.length(compact) >= 8) & (F.size(F.array_distinct(F.split(compact, ""))) <= 2)


def keywords_of(content: Column, most: int = 4) -> Column:
    """Capitalised words, acronyms and numbers, the first few distinct ones; long words where there are none."""
    found = F.regexp_extract_all(content, F.lit(r"\b([A-Z][A-Za-z/&-]{2,}|[A-Z]{2,}\s*\d*[A-Z]?|\d+(?:\.\d+)?%?)\b"), F.lit(1))
    kept = F.filter(F.transform(found, single_spaced), lambda x: (F.length(x) >= 2) & ~F.lower(x).isin("the", "this", "that"))
    kept = F.slice(F.array_distinct(kept), 1, most)
    words = F.transform(F.split(content, r"(?U)\s+"), lambda x: F.regexp_replace(x, r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", ""))
    long = F.array_distinct(F.slice(F.filter(words, lambda x: F.length(x) > 5), 1, 3))
    return F.when(F.size(kept) > 0, kept).otherwise(long)


def query_terms(query: Column) -> Column:
    """Numbers, acronyms and words of three letters or more, distinct, in lower case, without question words."""
    found = F.regexp_extract_all(query, F.lit(r"(\d+(?:\.\d+)*|[a-zA-Z][a-zA-Z0-9]*|[\x{4e00}-\x{9fff}]+)"), F.lit(1))
    asked = ("about", "chapter", "discuss", "discussed", "does", "explain", "section", "what", "which")
    good = F.filter(found, lambda x: x.rlike(r"^\d") | ((F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) >= 2)) | (F.length(x) >= 3))
    return F.array_distinct(F.filter(F.transform(good, F.lower), lambda x: ~x.isin(*asked)))


def is_heading_text(content: Column) -> Column:
    """One line that is a second-level heading, or a short capitalised one without a full stop."""
    lines = filled_lines(sanitized(content))
    one = F.get(lines, 0)
    plain = (word_count(one) <= WORDS_OF_HEADING) & ~one.endswith(".") & one.rlike(PLAIN_HEADING)
    return F.coalesce((F.size(lines) == 1) & (one.startswith("## ") | plain), F.lit(False))


def looks_like_metadata(content: Column) -> Column:
    """Empty, an address, an institution, a date, or a few words on authors and rights."""
    one = stripped(sanitized(content))
    low = F.lower(one)
    return (one == "") | F.contains(one, F.lit("@")) | any_of(low, METADATA_TERMS) | one.rlike(METADATA_DATE) | (word_count(one) <= WORDS_OF_HEADING) & low.rlike(METADATA_WORDS)


def breaks_off(content: Column) -> Column:
    """Ends in words or marks that want to go on, or leaves a bracket open."""
    one = stripped(sanitized(content))
    count = lambda mark: F.regexp_count(one, F.lit("\\" + mark))
    return (one != "") & (one.rlike(BREAKS_OFF) | (count("(") > count(")")) | (count("[") > count("]")))


def looks_like_front_matter(content: Column) -> Column:
    """Empty, an address or institution, authors, or a line on rights or the archive."""
    low = F.lower(stripped(sanitized(content)))
    return (low == "") | any_of(low, (*FRONT_MATTER_TERMS, *RIGHTS_TERMS)) | starts_with_any(low, ("authors", "arxiv:"))


def is_visual_text(content: Column) -> Column:
    """A caption, or a Markdown table."""
    one = stripped(sanitized(content))
    return one.rlike(r"(?i)^(?:figure|fig\.)\s*\d+[:.\s]") | F.lower(one).startswith("table ") | has_markdown_table(one)


def ends_open(content: Column) -> Column:
    """Whether the last line ends in a word or mark that wants to go on, or leaves a round bracket open."""
    last = F.coalesce(F.try_element_at(filled_lines(sanitized(content)), F.lit(-1)), F.lit(""))
    return (last != "") & (last.rlike(OPEN_ENDS) | (F.regexp_count(last, F.lit(r"\(")) > F.regexp_count(last, F.lit(r"\)"))))
