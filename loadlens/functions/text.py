"""Column expressions on text: words, links, request strings, log lines, JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType

# Patterns and formats of the input files.
WORD = r"[\p{L}\p{N}]+"
HREF = r'href="([^"]+)"'
ARTICLE_LINK = r"<target>([^<]+)</target>"
REDIRECT = r"^#REDIRECT .*"
ISO_INSTANT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
RUN_LABEL = "yyyy-MM-dd-HH-mm-ss"


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def links_of(body: Column, pattern: str = HREF) -> Column:
    """Targets of all links of a page body, in order and with repeats."""
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(1))


def is_redirect(text: Column, pattern: str = REDIRECT, strict: bool = False) -> Column:
    """True for a text that only points elsewhere.

    By default the first line decides.  ``strict`` replaces the match by ``true``
    and asks that nothing else is left, so a mark followed by more lines is no
    redirect.
    """
    first = text.rlike(pattern)
    if not strict:
        return first
    return first & (F.lower(F.regexp_replace(text, pattern, "true")) == "true")


def parse_instant(text: Column) -> Column:
    """ISO text with a 24-hour clock to a timestamp; NULL when it does not fit."""
    return F.try_to_timestamp(text, F.lit(ISO_INSTANT))


def run_label(ts: Column) -> Column:
    """Name of a run made from its start time."""
    return F.date_format(ts, RUN_LABEL)


def json_field(text: Column, path: str, default: str) -> Column:
    """One field of a JSON text, or the default when it is missing."""
    return F.coalesce(F.get_json_object(text, path), F.lit(default))


def json_path(text: Column, schema: str | DataType, path: str) -> Column:
    """The node of a nested JSON text under a path such as ``tree.0.children``."""
    node = F.from_json(text, schema)
    for step in path.split("."):
        node = node[int(step)] if step.isdigit() else node[step]
    return node


def request_field(request: Column, name: str) -> Column:
    """One decoded parameter of a request string (``+`` stands for a blank)."""
    query = F.regexp_extract(request, r"[?&]" + name + r"=([^&#]*)", 1)
    return F.when(request.rlike(r"[?&]" + name + "="), F.try_url_decode(query))


def request_terms(request: Column, name: str = "q") -> Column:
    """Words asked for by a request string."""
    return tokens_of(request_field(request, name))


def extract_id(line: Column, pattern: str) -> Column:
    """First capture group of a log line, NULL when the pattern is not in it."""
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))


def shard_of(key: Column, shards: int) -> Column:
    """Shard number of a key, from the first 32 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10)
    return F.pmod(bits.cast("bigint"), F.lit(shards).cast("bigint"))
