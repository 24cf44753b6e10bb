"""Hashes that identify contents and requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.functions.text import stripped


def content_hash(content: Column) -> Column:
    """SHA-256 of the text with single line feeds and without white space around it."""
    return F.sha2(stripped(F.replace(content, F.lit("\r\n"), F.lit("\n"))).cast("binary"), 256)


def request_key(namespace: str, **fields: Column) -> Column:
    """``namespace:`` and the hash of the fields, sorted by name, as JSON with a space behind commas and colons."""
    parts = [F.concat(F.lit(f'"{name}": '), F.coalesce(column, F.lit("null"))) for name, column in sorted(fields.items())]
    return F.concat(F.lit(f"{namespace}:"), F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256))


def json_text(value: Column) -> Column:
    """A JSON string literal of plain text."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))
