"""Quality rules on the words and lines of a text, and on lines that many documents of a host share.

Rules of one text are array functions on its row; nothing is shuffled for them.

Lines are normalised (white space runs become one blank, A-Z lower case) and
hashed.  Equal texts of a host are one document: they are brought together first, with
map-side combine, so a group of copies, however large, counts its lines once.  Each distinct text
counts each of its lines once for its host; those counts, too, are combined before they
are shuffled, so a very common line or a very large host makes no large group.  A
line is common when it is in more than ``most_docs`` distinct texts of its host and in
more than ``share`` of them.  Common lines are taken out, and a text is depleted when the words
that remain are fewer than ``least_words`` or less than ``least_left`` of all.

Hashes of lines have 64 bits: two lines of one host with one hash would be counted as one.  Texts are told apart
by MD5.  Arrays of a row take some 100 bytes for each word while the row is judged, so an
executor of 3 GB takes texts of some million words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions.joins import checked_join
from loadlens.llm.common import spare, stored

# Fixed values of the rules.
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WIDTH = 3
LEAST_WORDS = 50
#: A line is common in more than this many distinct texts of a host and in more than this share of them.
MOST_DOCS, SHARE = 10, 0.001
#: Share of a text's words that has to remain without its common lines.
LEAST_LEFT = 0.5

_BREAKS = r"[\x20\x09-\x0D]+"
_BLANKS = r"[\x20\x09\x0B-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    """Words of a text in order: runs without ASCII white space."""
    flat = F.trim(F.regexp_replace(text, _BREAKS, " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def repeated_words(words: Column) -> Column:
    """Number of words in runs of three words that are found twice or more in the text.

    Runs are sorted by hash, next to each other when equal; the places of the repeated
    ones, sorted again, cover the words to count.  No step compares a run with all others.
    """

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WIDTH)
        hashed = F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)]).alias("h"), i.alias("i")))
        return F.when(F.size(w) > WIDTH, F.sort_array(hashed))

    def places(s: Column) -> Column:
        def twice(i: Column) -> Column:
            here = F.get(s, i)["h"]
            return here.eqNullSafe(F.get(s, i - 1)["h"]) | here.eqNullSafe(F.get(s, i + 1)["h"])

        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), twice)
        return F.sort_array(F.transform(found, lambda i: F.get(s, i)["i"]))

    def cover(seen: Column, i: Column) -> Column:
        return F.struct((seen["n"] + i + WIDTH - F.greatest(i, seen["end"])).alias("n"), (i + WIDTH).alias("end"))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(p, start, cover, lambda seen: seen["n"])

    found = bound(bound(bound(words, runs), lambda s: F.when(s.isNotNull(), bound(s, places))), covered)
    return F.coalesce(found, F.lit(0)).cast("long")


def rules(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text that is not NULL."""
    lines = F.filter(F.split(text, "\n"), lambda line: _without(line, SPACE) != "")
    counts = bound(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")),
    )
    return [
        counts.alias("_counts"),
        F.length(_without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        bound(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
    ]


def normal_line(line: Column) -> Column:
    """A line with A-Z lower-cased and runs of blanks as one blank, none at its ends."""
    return F.translate(F.trim(F.regexp_replace(line, _BLANKS, " ")), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    """Struct of hash ``h`` and ``words`` of every line, the hash NULL without a word."""
    # Blanks are joined in the whole text; a line then only has one at its ends to lose.
    lines = F.split(F.translate(F.regexp_replace(text, _BLANKS, " "), _UPPER, _LOWER), "\n")

    def measured(line: Column) -> Column:
        n = F.length(line) - F.length(F.translate(line, " ", "")) + 1
        return F.struct(
            F.when(line != "", F.xxhash64(line)).alias("h"), F.when(line != "", n).otherwise(0).cast("int").alias("words")
        )

    return F.transform(lines, lambda line: bound(F.trim(line), measured))


def _named(docs: DataFrame, text: str, host: str) -> list[Column]:
    """Host and digest that name a distinct text; a missing host is a host of its own."""
    return [
        F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("")).alias("_host"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_digest"),
    ]


def distinct_texts(docs: DataFrame, text: str, host: str) -> DataFrame:
    """One row per host and text that has a line with a word: _host, _digest, _lines (stored)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*_named(docs, text, host), _lines(body).alias("_lines"))
    some = rows.where(F.exists("_lines", lambda line: line["h"].isNotNull()))
    return stored(some.groupBy("_host", "_digest").agg(F.any_value("_lines").alias("_lines")), "texts")


def common_lines(texts: DataFrame, most_docs: int = MOST_DOCS, share: float = SHARE) -> DataFrame:
    """(_host, h, docs) of the lines above both limits, from ``distinct_texts`` (stored)."""
    each = texts.select("_host", F.explode(F.array_distinct(F.transform("_lines", lambda line: line["h"]))).alias("h"))
    counted = each.where("h is not null").groupBy("_host", "h").agg(F.count(F.lit(1)).alias("docs"))
    often = stored(counted.where(F.col("docs") > most_docs), "lines")
    hosts = stored(texts.groupBy("_host").agg(F.count(F.lit(1)).alias("of")), "hosts")
    sizes = often.groupBy("_host").agg(F.count(F.lit(1)).alias("rows"))
    found = checked_join(often, hosts, ["_host"], sizes)
    return stored(found.where(F.col("docs") > F.col("of") * share).drop("of"), "common")


def _removed(texts: DataFrame, common: DataFrame) -> DataFrame:
    """Every place of a common line: _host, _digest, place, words."""
    places = texts.select("_host", "_digest", F.posexplode("_lines").alias("place", "line"))
    rows = places.select("_host", "_digest", "place", F.col("line.h").alias("h"), F.col("line.words").alias("words"))
    sizes = common.select("_host", "h", F.col("docs").alias("rows"))
    return checked_join(rows.where("h is not null"), common.drop("docs"), ["_host", "h"], sizes)


def judged(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    most_docs: int = MOST_DOCS,
    share: float = SHARE,
    least_words: int = LEAST_WORDS,
    least_left: float = LEAST_LEFT,
) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct, and that column's name.

    The struct has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_common_words (words in common lines), base_failed and kept.  The name is one that
    ``docs`` lacks; all other columns stay as they are.  A NULL text is an empty one and fails the base
    rules, a NULL host is a host of its own.  Repeated rows stay, each with the same verdict. An empty table
    gives no rows.
    """
    texts = distinct_texts(docs, text, host)
    places = _removed(texts, common_lines(texts, most_docs, share))
    lost = stored(places.groupBy("_host", "_digest").agg(F.sum("words").alias("_lost")), "lost")
    whole, found = spare(docs, "_row"), spare(docs, "_quality")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), *_named(docs, text, host))
    # Rows of one text and host are copies; they are counted only where the lost words are too many to broadcast.
    sizes = rows.groupBy("_host", "_digest").agg(F.count(F.lit(1)).alias("rows"))
    known = checked_join(rows, lost, ["_host", "_digest"], sizes, "left")
    body = F.coalesce(F.col(f"{whole}.`{text}`"), F.lit(""))
    known = known.select(whole, F.coalesce("_lost", F.lit(0)).alias("_lost"), *rules(body))
    n, repeated = F.col("_counts.n"), F.col("_counts.repeated")
    failed = (n < LEAST_WORDS) | (repeated * 100 > n * 50)
    left = n - F.col("_lost")
    verdict = F.struct(
        n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"),
        F.col("_lost").alias("n_common_words"), failed.alias("base_failed"),
        (~failed & (left >= least_words) & (left >= n * least_left)).alias("kept"),
    )
    return known.select(f"{whole}.*", verdict.alias(found)), found


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that pass all rules; columns and texts stay as they are."""
    rows, found = judged(docs, **settings)
    return rows.where(f"`{found}`.kept").drop(found)


def without_common_lines(
    docs: DataFrame, text: str = "text", host: str = "source", most_docs: int = MOST_DOCS, share: float = SHARE
) -> DataFrame:
    """``docs`` with the common lines of each host taken out of the texts; other columns stay as they are."""
    texts = distinct_texts(docs, text, host)
    places = _removed(texts, common_lines(texts, most_docs, share))
    gone = stored(places.groupBy("_host", "_digest").agg(F.collect_list("place").alias("_gone")), "gone")
    whole = spare(docs, "_row")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), *_named(docs, text, host))
    sizes = rows.groupBy("_host", "_digest").agg(F.count(F.lit(1)).alias("rows"))
    known = checked_join(rows, gone, ["_host", "_digest"], sizes, "left")

    def cleaned(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        left = F.transform(F.array_except(every, F.col("_gone")), lambda i: F.get(lines, i))
        return F.array_join(left, "\n")

    old = F.col(f"{whole}.`{text}`")
    new = F.when(F.col("_gone").isNull(), old).otherwise(bound(F.split(old, "\n"), cleaned))
    columns = [new.alias(c) if c == text else F.col(f"{whole}.`{c}`") for c in docs.columns]
    return known.select(*columns)


SQL = rf"""
with d as materialized (
  select row_number() over () as id, doc_id, coalesce('h' || source, '') as host, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
runs as (
  select id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as run
  from (select id, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select id, i from runs qualify count(*) over (partition by id, run) > 1),
covered as (
  select id, count(distinct i + k) as n from twice cross join (select unnest([0, 1, 2]) as k) group by id),
raw as (select id, unnest(string_split(t, chr(10))) as line from d),
dup as (
  select id, count(*) - count(distinct line) as n from raw where regexp_matches(line, '[^\x20\x09-\x0D]') group by id),
texts as (select host, t, min(id) as id from d group by host, t),
lines as (
  select host, t, translate(trim(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' '), '{_UPPER}', '{_LOWER}') as line
  from texts join raw using (id) where regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts as (select host, count(distinct t) as n from lines group by host),
common as (
  select host, line from lines join hosts using (host)
  group by host, line, n having count(distinct t) > {MOST_DOCS} and count(distinct t) > n * {SHARE}),
lost as (
  select host, t, sum(len(string_split(line, ' '))) as n from lines join common using (host, line) group by host, t),
s as (
  select doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words, coalesce(lost.n, 0)::bigint as n_common_words
  from d left join covered using (id) left join dup using (id) left join lost using (host, t))
select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words)
    and n_words - n_common_words >= {LEAST_WORDS} and n_words - n_common_words >= n_words * {LEAST_LEFT} as kept
from s
"""
