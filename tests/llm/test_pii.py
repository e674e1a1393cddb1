"""Personal data: spans against Python's regular expressions, disclosure against plain counts."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loadlens.llm import pii

# The patterns of the contract.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in PLAIN.items()}


def odd_texts():
    draw = random.Random(4)
    parts = ["a@b.cc", "_x@d.ee", ".", "1.2.3.4", "4111 1111 1111 1111", "5555-5555-5555-4444", "+1 (234) 567-8901", " ", "9", "256.1.1.1", "@", "007.010.1.255", "é\U0001f600"]
    texts = ["".join(draw.choice("ab1.@+- (é\U0001f600\n4_%") for _ in range(draw.randint(0, 60))) for _ in range(400)]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) for _ in range(400)]
    return [*texts, None, "", "1" * 40_000, "a" * 40_000, "a.b@" * 5000, "+1 " * 10_000, "x@y." + "a." * 9000 + "c", "+1 234 567 8901 " * 2000]


def test_base_spans(spark):
    texts = odd_texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit("clash"))
    got = {r.doc_id: r for r in pii.span_table(pii.sanitised(table.repartition(4))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = plain_spans(text)
        base = ",".join(f"{k}:{a}:{b}" for k, spans in want.items() for a, b in spans)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [len(s) for s in want.values()], text
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), text
        assert got[i].spans.startswith(base)


@pytest.fixture(scope="module")
def story(spark):
    mail = "zoe@acme.example.com"
    rows = [(i, f"please call the zebrafish lady at {mail} about report") for i in range(6)]
    rows += [(10 + i, f"please call the office at user{i}@b.example.com about report {i}") for i in range(20)]
    rows += [(40 + i, "a report about the office and nothing else, please call") for i in range(30)]
    return spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")


def test_disclosing_terms(spark, story):
    found = {(r.entity, r.term): r for r in pii.disclosures(pii.scan(story), story).collect()}
    row = found["zoe@acme.example.com", "zebrafish"]
    assert (row.n_pair, row.n_entity, row.n_term) == (6, 6, 6) and row.disclosure == pytest.approx(1)
    common = found["zoe@acme.example.com", "please"]
    want = math.log2(6 * 57 / (6 * 56)) / math.log2(57 / 6)
    assert common.n_term == 56 and common.disclosure == pytest.approx(want)
    assert {e for e, _ in found} == {"zoe@acme.example.com"}  # others have too little support


def test_terms_are_removed_and_base_spans_stay(spark, story):
    rows = {r.doc_id: r for r in pii.span_table(pii.sanitised(story)).collect()}
    text = "please call the zebrafish lady at zoe@acme.example.com about report"
    at = text.index("zebrafish")
    assert f"term:{at}:{at + 9}" in rows[0].spans.split(",") and rows[0].spans.startswith("email:34:54")
    assert "term" not in rows[12].spans and rows[99].spans == ""
    clean = {r.doc_id: r._redacted for r in pii.redact(story).collect()}
    assert clean[0] == "please call the   at <email> about report"
    assert clean[99] == "" and clean[41].startswith("a report")


def test_pii_edges(spark):
    mail = "a@b.cc"
    rows = [(None, mail), (None, mail), (5, mail), (5, "x " + mail), (5, mail)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.span_table(pii.sanitised(table))
    assert sorted((str(r.doc_id), r.spans) for r in got.collect()) == sorted(
        [("None", "email:0:6"), ("None", "email:0:6"), ("5", "email:0:6"), ("5", "email:2:8"), ("5", "email:0:6")]
    )
    assert pii.redact(table).count() == 5
    assert pii.sanitised(table.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, story, plan):
    assert not re.search("Python|Pandas|Arrow", plan(pii.sanitised(story)))


def test_a_term_of_a_single_text_is_found(spark):
    rows = [(1, "please call Quillfeather at quill@b.example.com"), *((i, f"please call the desk {i}") for i in range(2, 40))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.span_table(pii.sanitised(table)).collect()}
    assert "term:12:24" in got[1].split(",") and "term:0:6" not in got[1].split(",") and got[2] == ""


def test_ordinary_words_of_the_given_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.span_table(pii.sanitised(docs)).collect()
    held = {r.doc_id: r for r in rows if r.n_email + r.n_ip + r.n_card + r.n_phone}
    assert held and all("term:" not in r.spans for r in rows if r.doc_id not in held)
    words = sum(len(re.findall(r"[^\W\d_]{3,}", d.text or "")) for d in docs.collect() if d.doc_id in held)
    marked = sum(r.spans.count("term:") for r in held.values())
    assert marked < 0.1 * words


def test_planted_names_are_found_and_words_beside_them_are_not(spark):
    """Invented prose with names planted next to addresses: precision and recall of the marked terms."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars between 400 and 3000").orderBy("doc_id").limit(300).collect()]
    draw, rows, planted = random.Random(13), [], {}
    for i, text in enumerate(docs):
        text = re.sub("[@+0-9]", "", text)
        if i % 3 == 0:
            name = "".join(draw.choice(["bar", "quo", "zel", "min", "fra", "tov"]) for _ in range(3)).capitalize()
            words = text.split(" ")
            at = draw.randrange(len(words))
            words.insert(at, f"write to {name} at {name.lower()}{i}@mail.example.com or")
            text, planted[i] = " ".join(words), name.lower()
        rows.append((i, text))
    found = pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    terms = [(r.doc_id, texts[r.doc_id][t.start : t.stop].lower()) for r in found for t in r.terms]
    good = sum(planted.get(i) == t for i, t in terms)
    assert good >= 0.9 * len(terms)
    assert {i for i, t in terms if planted.get(i) == t} == set(planted)


def plain_terms(texts, n_all):
    """Marked places by plain loops over all texts."""
    found, n_term = [], {}
    for text in texts:
        spans = [(k, text[a:b].lower(), a, b) for k, v in plain_spans(text).items() for a, b in v]
        terms = []
        for m in re.finditer(r"[^\W\d_]{3,}", text):
            if not any(a < m.end() and b > m.start() for _, _, a, b in spans):
                before = re.split(r"[^\W\d_]{3,}", text[: m.start()])[-1]
                name = m.group()[0].isupper() and not m.group().isupper() and not re.search(r"(?:^|[.!?\n])[\W_]*$", before)
                terms.append((m.start(), m.end(), m.group().lower(), name))
        for t in {m.group().lower() for m in re.finditer(r"[^\W\d_]{3,}", text)}:
            n_term[t] = n_term.get(t, 0) + 1
        found.append((spans, terms))
    pairs, n_entity = {}, {}
    for spans, terms in found:
        mine = {}
        for k, e, a, b in spans:
            for s, _, t, name in terms:
                alike = k == "email" and len(t) >= 4 and t[:4] in {w[:4] for w in re.split(r"[\W\d_]+", e)}
                if a - 80 <= s <= b + 80 or alike:
                    mine[k, e, t] = mine.get((k, e, t), False) or (name if a - 80 <= s <= b + 80 else False) or alike
        for e in {(k, e) for k, e, _, _ in spans}:
            n_entity[e] = n_entity.get(e, 0) + 1
        for p, name in mine.items():
            n, known = pairs.get(p, (0, False))
            pairs[p] = n + 1, known or name
        spans.append(mine)
    strong = {}
    for (k, e, t), (n, name) in pairs.items():
        content = math.log2(n_all / n_entity[k, e])
        share = lambda c: math.log2(c * n_all / (n_entity[k, e] * n_term[t])) / content if content > 0 else 0
        least = share(n - math.sqrt(n)) if n > 1 else share(n) if name else -1
        if share(n) >= 0.5 and least >= 0.5:
            strong[k, e, t] = n, share(n)
    out = []
    for spans, terms in found:
        mine = spans.pop()
        held = {(k, e) for k, e, _, _ in spans}
        worst = {}
        for (k, e, t), (n, d) in strong.items():
            if (k, e, t) in mine or (n > 1 and (k, e) in held):
                worst[t] = max(d, worst.get(t, 0))
        out.append([(s, b, worst[t] >= 0.9) for s, b, t, _ in terms if t in worst])
    return out


def test_term_spans_against_plain_loops(spark):
    draw = random.Random(14)
    people = ["Marta", "Ömer", *(f"{a}{b}sted" for a in ("Hol", "Ring", "Fal", "Øst", "Ekk") for b in ("ma", "ki", "ru"))]
    rows = []
    for i in range(400):
        words = [draw.choice(["desk", "report", "called", "the", "Office", f"rare{chr(97 + draw.randrange(26))}{chr(97 + draw.randrange(26))}x", "über", "plan."]) for _ in range(draw.randrange(3, 60))]
        for _ in range(draw.randrange(3)):
            p = draw.choice(people)
            words.insert(draw.randrange(len(words)), draw.choice([f"{p} {p.lower()}@x{draw.randrange(2)}.example.com", f"{p} +1 (234) 567-8{people.index(p):03}", "10.0.0.7", p]))
        rows.append(" ".join(words))
    got = {r.doc_id: [(t.start, t.stop, t.removed) for t in r.terms] for r in pii.sanitised(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == plain_terms(rows, len(rows))
    assert sum(map(len, got.values())) > 30


def test_a_text_with_very_many_entities(spark):
    """10,000 addresses and as many names: rows grow with the text, not with its square."""
    text = " ".join(f"Name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} u{i}@b.example.com" for i in range(10_000))
    table = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")
    scanned = pii.scan(table)
    assert pii._pairs(scanned).count() < 10_000 * 20
    got = {r.doc_id: r for r in pii.span_table(pii.sanitised(table)).collect()}
    assert got[1].n_email == 10_000 and got[2].spans == ""
    clash = table.withColumns({c: F.lit("x") for c in ("_id", "_h", "_marks", "_row", "_redacted", "_hash")}).limit(1)
    assert pii.redact(clash).columns == [*clash.columns, "_redacted_"]


def test_terms_far_from_the_entity_are_found_in_all_places(spark):
    far = "Quillfeather writes. " + "the desk " * 40 + "quill@b.example.com " + "the desk " * 40 + "quillfeather"
    rows = [(1, far), *((i, "writes to the desk") for i in range(2, 40))]
    got = {r.doc_id: r.spans for r in pii.span_table(pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [s for s in got[1].split(",") if "term" in s] == ["term:0:12", f"term:{len(far) - 12}:{len(far)}"]
