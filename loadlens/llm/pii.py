"""Personal data: patterns, and information-theoretic sanitisation of what stands around them.

Patterns find the protected entities: e-mail addresses, IP addresses, card and phone
numbers.  A term goes with an entity in a text if it stands within ``REACH`` characters of it, or,
wherever it stands, if a word of the entity (an address made from a name) begins with the same four letters.  It discloses the
entity as far as the corpus says so:

    disclosure(e, t) = PMI(e, t) / IC(e)
    PMI = log2(n(e, t) * N / (n(e) * n(t)))      IC = log2(N / n(e))

with N texts, n(e) texts that hold the entity, n(t) texts that hold the term anywhere, and
n(e, t) texts in which the term goes with the entity.  It is 1 for a term
that occurs with this entity and nowhere else.

Few texts prove little: most rare words stand next to some entity by chance.  So a pair is told from chance
by the lower end of its count, n(e, t) less its square root, whose disclosure has to reach ``GENERALISE``, too.  That leaves
out all pairs of a single text, but for terms that look like a name there: with a capital inside a sentence, or a word of the entity.

Every place of a disclosing term in a text with the entity counts, near or far.  From ``GENERALISE`` on a term is
replaced by its class, from ``REMOVE`` on it is removed.

All of it is DataFrame functions.  Counts run over all texts and are combined before
they are shuffled; what travels is (entity, term) pairs, not texts.  Terms and entities of a text are
sorted and met by cells of its length, so a text with very many of both costs rows in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions.joins import checked_join
from loadlens.llm.common import spare, stored

# The patterns of the contract.  Possessive quantifiers and the look-behinds
# give the same matches in linear time: where a match cannot start at the first
# character of a run, or after the match before, it cannot start later in the run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of the kind has.
_SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Texts that must show a pair for ``disclosures``, unless told otherwise; sanitising takes all pairs.
SUPPORT = 3
GENERALISE, REMOVE = 0.5, 0.9
#: Characters between an entity and a term that goes with it, and the length of a cell of text.
REACH, CELL = 80, 256
#: Letters with which a term and a word of an address made from it begin.
STEM = 4

_SPAN = "array<struct<start:int,stop:int,value:string>>"
_TERM = r"\p{L}{3,}"
_TERMS = "array<struct<start:int,stop:int,value:string,name:boolean>>"
#: What stands before a term that opens a sentence.
_OPENS = r"(?:^|[.!?\n])[^\p{L}\p{N}]*$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(digit)

    in_range = (n >= 16) & (n <= 19)
    checked = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0
    return F.when(in_range, checked).otherwise(False)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(_IP),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _running(numbers: Column, join=lambda x, y: x + y) -> Column:
    """Running sums of an array, or maxima of numbers from 0 on, in n log n steps."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers).cast("double"))).cast("int"))

    def double(sums: Column, step: Column) -> Column:
        back = F.pow(F.lit(2), step).cast("int")
        return F.transform(
            sums, lambda x, i: join(x, F.when(i >= back, F.element_at(sums, i - back + 1)).otherwise(0))
        )

    return F.aggregate(steps, numbers, double)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _located(matches: Column, gaps: Column) -> Column:
    """Spans from the matches and the text before, between and after them: their lengths, added up."""
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))

    def spans(pairs: Column) -> Column:
        ends = _running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["value"]), F.lit(0))))
        return F.zip_with(pairs, ends, lambda p, stop: F.struct(
            (stop - F.length(p["value"])).alias("start"), stop.alias("stop"), p["value"].alias("value"), p["gap"].alias("gap")
        ))

    return F.filter(_let(pairs, spans), lambda s: s["value"].isNotNull())


def _spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind; failing matches are dropped and not tried again."""
    pattern, none = PATTERNS[kind], F.array().cast(_SPAN)

    def located(matches: Column) -> Column:
        every = _let(F.split(text, pattern, -1), lambda gaps: _located(matches, gaps))
        valid = F.filter(every, lambda s: _VALID[kind](s["value"]))
        plain = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))
        return F.when(F.exists(matches, _VALID[kind]), plain).otherwise(none)

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    return F.when(F.contains(text, F.lit(_SIGN[kind])), found).otherwise(none) if _SIGN[kind] else found


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with a struct ``_pii`` of one array of spans per kind.

    A span has start, stop (code points, stop exclusive) and value.  NULL is an empty text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("_pii", F.struct(*[_spans(body, k).alias(k) for k in PATTERNS]))


def _terms(text: Column, spans: Column) -> Column:
    """Terms of a text outside of ``spans``: structs (start, stop, value, name), lower-cased.

    ``name`` is true for one with a capital, and not all in capitals, inside a sentence.  Spans by start and terms by end are sorted together: a span overlaps a
    term if the furthest end of those before it lies behind the term's start.
    """
    every = _located(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.split(text, _TERM, -1))

    def entry(at: Column, span: int, start: Column, stop: Column, value: Column, name: Column) -> Column:
        columns = {"at": at, "span": F.lit(span), "start": start, "stop": stop, "value": value, "name": name}
        return F.struct(*[x.alias(c) for c, x in columns.items()])

    def term(t: Column) -> Column:
        name = t["value"].rlike(r"^\p{Lu}.*\p{Ll}") & ~t["gap"].rlike(_OPENS)
        return entry(t["stop"], 0, t["start"], t["stop"], F.lower(t["value"]), name)

    none = F.lit(None)
    listed = F.transform(spans, lambda s: entry(s["start"], 1, s["start"], s["stop"], none.cast("string"), none.cast("boolean")))

    def free(entries: Column) -> Column:
        reach = _running(F.transform(entries, lambda e: F.when(e["span"] == 1, e["stop"]).otherwise(0)), F.greatest)
        both = F.zip_with(entries, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r")))
        left = F.filter(both, lambda b: (b["e"]["span"] == 0) & (b["r"] <= b["e"]["start"]))
        return F.transform(left, lambda b: F.struct(*[b["e"][c].alias(c) for c in ("start", "stop", "value", "name")]))

    entries = F.sort_array(F.concat(F.transform(every, term), listed))
    return _let(entries, lambda es: F.when(F.size(es) > 0, free(es)).otherwise(F.array().cast(_TERMS)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Read every text once: doc_id, ``_hash`` of the text, spans, entities and, if there are any, all terms (stored)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("_hash"), body.alias("text"))
    return stored(_occurrences(entities(rows)), "pii")


def disclosures(scanned: DataFrame, docs: DataFrame, text: str = "text", support: int = SUPPORT) -> DataFrame:
    """(kind, entity, term, n_pair, n_entity, n_term, name, disclosure, least) of all pairs in ``support`` texts or more.

    ``scanned`` is the scan of ``docs``.  Each row is one text; repeated rows count each time.  ``least`` is the
    disclosure at the lower end of the pair's count, NULL for a single text that does not show a name.
    """
    return _disclosures(stored(_pairs(scanned), "pairs"), scanned, docs, text, support)


def _disclosures(pairs: DataFrame, scanned: DataFrame, docs: DataFrame, text: str, support: int) -> DataFrame:
    n_pair = pairs.groupBy("kind", "entity", F.col("value").alias("term")).agg(F.count(F.lit(1)).alias("n_pair"), F.max("name").alias("name"))
    n_pair = stored(n_pair.where(F.col("n_pair") >= support), "counts")
    named = scanned.select(F.explode(_names(F.col("_entities"))).alias("e")).select("e.kind", "e.entity")
    n_entity = named.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)
    wanted = stored(n_pair.select("term").distinct(), "terms")
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(_TERM), F.lit(0)), F.lower))
    # Counted before the join: what travels is one row per term and task.  ``wanted`` names a
    # term once, and an inner join, unlike a semi join, is not moved below the count.
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n_term = stored(terms.join(wanted, "term"), "terms")
    # One row: the number of texts.
    texts = F.broadcast(scanned.agg(F.count(F.lit(1)).alias("_n")))
    # An entity may go with very many terms, and a term with very many entities.
    by_entity = n_pair.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("rows"))
    by_term = n_pair.groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    known = checked_join(n_pair, stored(n_entity, "entities"), ["kind", "entity"], by_entity)
    known = checked_join(known, n_term, ["term"], by_term).crossJoin(texts)
    content = F.log2(F.col("_n") / F.col("n_entity"))

    def share(count: Column) -> Column:
        pmi = F.log2(count * F.col("_n") / (F.col("n_entity") * F.col("n_term")))
        return F.when(content > 0, pmi / F.when(content > 0, content)).otherwise(0.0)

    n = F.col("n_pair")
    least = F.when(n > 1, share(n - F.sqrt(n))).when(F.col("name"), share(n))
    return known.select("kind", "entity", "term", "n_pair", "n_entity", "n_term", "name", share(n).alias("disclosure"), least.alias("least"))


def _names(entities: Column) -> Column:
    """The distinct entities of a text without their places."""
    return F.array_distinct(F.transform(entities, lambda e: F.struct(e["kind"].alias("kind"), e["entity"].alias("entity"))))


def _pairs(scanned: DataFrame) -> DataFrame:
    """doc_id, _hash, _row, kind, entity, value, name: every term of a text that goes with an entity of it, once.

    ``_row`` tells texts apart, so repeated rows of one id and text count each time.
    """
    rows = scanned.where(F.size("_entities") > 0)
    own = ["doc_id", "_hash", "_row"]
    found = rows.select(*own, F.explode("_entities").alias("e")).select(*own, "e.*")
    terms = rows.select(*own, F.explode("_terms").alias("t")).select("_row", F.col("t.start").alias("at"), "t.value", "t.name")
    cell = F.floor(F.col("at") / CELL).alias("cell")
    cells = F.explode(F.sequence(F.floor((F.col("start") - REACH) / CELL), F.floor((F.col("stop") + REACH) / CELL))).alias("cell")
    near = found.select(*own, "kind", "entity", "start", "stop", cells).join(terms.select("*", cell), ["_row", "cell"])
    near = near.where((F.col("at") >= F.col("start") - REACH) & (F.col("at") <= F.col("stop") + REACH))
    # A word of an address made from a name begins like it.
    stems = F.transform(F.split("entity", r"\P{L}+"), lambda w: F.left(w, F.lit(STEM)))
    mails = found.where("kind = 'email'").select(*own, "kind", "entity", F.explode(F.array_distinct(stems)).alias("stem"))
    alike = mails.where(F.length("stem") == STEM).join(terms.withColumn("stem", F.left("value", F.lit(STEM))), ["_row", "stem"])
    columns = [*own, "kind", "entity", "value"]
    both = near.select(*columns, "name").unionByName(alike.select(*columns, F.lit(True).alias("name")))
    return both.groupBy(*columns).agg(F.max("name").alias("name"))


def _occurrences(found: DataFrame) -> DataFrame:
    """Add ``_entities`` (kind, entity, start, stop) and ``_terms`` (places of all terms of a text with entities)."""

    def named(kind: str) -> Column:
        return F.transform(
            F.col(f"_pii.{kind}"),
            lambda s: F.struct(F.lit(kind).alias("kind"), F.lower(s["value"]).alias("entity"), s["start"].alias("start"), s["stop"].alias("stop")),
        )

    names = F.concat(*map(named, PATTERNS))
    places = F.struct(*[
        F.transform(F.col(f"_pii.{k}"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias(k)
        for k in PATTERNS
    ])
    kept = [c for c in found.columns if c not in ("text", "_pii")]
    spans = F.concat(*[F.col(f"_pii.{k}") for k in PATTERNS])
    terms = F.when(F.size(names) > 0, _terms(F.col("text"), spans)).otherwise(F.array().cast(_TERMS))
    return found.select(*kept, F.monotonically_increasing_id().alias("_row"), places.alias("_pii"), names.alias("_entities"), terms.alias("_terms"))


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, one span array per kind, ``terms`` (start, stop, removed).

    ``terms`` are all places of the terms that disclose an entity of the text.  Rows without
    doc_id and repeated doc_ids are told apart by their text; equal rows get equal
    spans; other columns are not read; an empty table gives no rows.
    """
    scanned = scan(docs, doc_id, text)
    pairs = stored(_pairs(scanned), "pairs")
    strong = _disclosures(pairs, scanned, docs, text, support=1)
    strong = strong.where((F.col("disclosure") >= GENERALISE) & (F.col("least") >= GENERALISE))
    strong = stored(strong.select("kind", "entity", F.col("term").alias("value"), "n_pair", "n_term", "disclosure"), "strong")
    by = ["kind", "entity", "value"]
    sizes = strong.select(*by, F.col("n_pair").alias("rows"))
    told = checked_join(pairs, strong.select(*by, "disclosure"), by, sizes).select("_row", "value", "disclosure")
    # What several texts have shown holds for a text that has both far apart, too.
    shown = strong.where("n_pair > 1").select(*by, "disclosure")
    held = scanned.where(F.size("_entities") > 0)
    values = held.select("_row", F.explode(F.array_distinct(F.transform("_terms", lambda t: t["value"]))).alias("value"))
    met = checked_join(values, shown, ["value"], strong.groupBy("value").agg(F.max("n_term").alias("rows")))
    named = held.select("_row", F.explode(_names(F.col("_entities"))).alias("e")).select("_row", "e.*")
    told = told.unionByName(met.join(named, ["_row", "kind", "entity"]).select("_row", "value", "disclosure"))
    told = told.groupBy("_row", "value").agg(F.max("disclosure").alias("d"))
    words = held.select("_row", F.explode("_terms").alias("t")).select("_row", "t.start", "t.stop", "t.value")
    # A list holds at most the terms of a text.
    place = F.struct("start", "stop", (F.col("d") >= REMOVE).alias("removed"))
    added = words.join(told, ["_row", "value"]).groupBy("_row").agg(F.sort_array(F.collect_list(place)).alias("terms"))
    joined = scanned.join(added, "_row", "left")
    none = F.array().cast("array<struct<start:int,stop:int,removed:boolean>>")
    return joined.select("doc_id", "_hash", *[F.col(f"_pii.{k}").alias(k) for k in PATTERNS], F.coalesce("terms", none).alias("terms"))


def _labels(kind: str, name: str) -> Column:
    return F.transform(name, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def span_table(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, base_sha256 and spans, from the rows of ``sanitised``."""
    base = F.array_join(F.concat(*[_labels(k, k) for k in PATTERNS]), ",")
    every = F.array_join(F.concat(*[_labels(k, k) for k in PATTERNS], _labels("term", "terms")), ",")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"),
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``_redacted`` (a longer name if there is one): the text with entities and disclosing terms replaced.

    Entities become ``<email>`` and so on, generalised terms ``<name>`` (capitalised) or ``<word>``,
    removed terms nothing.  Overlapping spans are replaced once, by the first of them.
    """
    found = sanitised(docs, doc_id, text)

    def masks(kind: str) -> Column:
        return F.transform(
            kind, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(f"<{kind}>").alias("mark"))
        )

    marks = F.concat(*map(masks, PATTERNS), F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.when(s["removed"], "").alias("mark"))))
    whole, key, named = spare(docs, "_row"), spare(docs, "_id"), spare(docs, "_h")
    marked = found.select(F.col("doc_id").alias(key), F.col("_hash").alias(named), F.sort_array(marks).alias("_marks")).dropDuplicates([key, named])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole))
    body = F.coalesce(F.col(f"{whole}.`{text}`"), F.lit(""))
    joined = rows.join(marked, F.col(f"{whole}.`{doc_id}`").eqNullSafe(F.col(key)) & (F.xxhash64(body) == F.col(named)), "left")

    def add(done: Column, s: Column) -> Column:
        word = F.substr(body, s["start"] + 1, s["stop"] - s["start"])
        general = F.when(word.rlike(r"^\p{Lu}"), "<name>").otherwise("<word>")
        piece = F.concat(F.substr(body, done["at"] + 1, s["start"] - done["at"]), F.coalesce(s["mark"], general))
        fresh = F.struct(F.concat(done["out"], piece).alias("out"), s["stop"].alias("at"))
        return F.when(s["start"] >= done["at"], fresh).otherwise(done)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    end = lambda done: F.concat(done["out"], F.substr(body, done["at"] + 1, F.length(body)))
    marks = F.coalesce("_marks", F.array().cast("array<struct<start:int,stop:int,mark:string>>"))
    return joined.select(f"{whole}.*", F.aggregate(marks, start, add, end).alias(spare(docs, "_redacted")))
