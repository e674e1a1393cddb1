"""Column expressions on hand-written values."""

import pytest
from pyspark.sql import functions as F

from loadlens.functions import measures, text


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "body, loose, strict",
    [
        ("#REDIRECT [[Other]]", True, True),
        ("#REDIRECT [[Other]]\n{{R from move}}", True, False),
        ("Text about #REDIRECT [[Other]]", False, False),
        ("first\n#REDIRECT [[Other]]", False, False),
        ("#REDIRECT", False, False),
        ("", False, False),
    ],
)
def test_redirects(spark, body, loose, strict):
    assert one(spark, body, text.is_redirect) is loose
    assert one(spark, body, lambda c: text.is_redirect(c, strict=True)) is strict


@pytest.mark.parametrize(
    "stamp, shown",
    [
        ("2010-07-05T13:04:09Z", "2010-07-05 13:04:09"),
        ("2010-07-05T12:04:09Z", "2010-07-05 12:04:09"),
        ("2010-07-05T00:00:00Z", "2010-07-05 00:00:00"),
        ("2010-07-05 13:04:09", None),
        ("", None),
        (None, None),
    ],
)
def test_instants_use_a_24_hour_clock(spark, stamp, shown):
    got = one(spark, stamp, lambda c: F.date_format(text.parse_instant(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == shown


def test_request_parameters(spark):
    url = "http://h:1/select?df=text&fl=id&q=Computer+Science%21#x"
    assert one(spark, url, lambda c: text.request_field(c, "df")) == "text"
    assert one(spark, url, lambda c: text.request_field(c, "fl")) == "id"
    assert one(spark, url, lambda c: text.request_field(c, "q")) == "Computer Science!"
    assert one(spark, url, text.request_terms) == ["computer", "science"]
    assert one(spark, url, lambda c: text.request_field(c, "rows")) is None
    assert one(spark, "/select?q=", lambda c: text.request_field(c, "q")) == ""
    assert one(spark, "/select?q=100%", lambda c: text.request_field(c, "q")) is None


def test_words_links_and_ids(spark):
    assert one(spark, "Été 2024, don't-stop", text.tokens_of) == ["été", "2024", "don", "t", "stop"]
    page = '<a href="/a">x</a> <a href="/b?c=1">y</a> <a href="/a">z</a>'
    assert one(spark, page, text.links_of) == ["/a", "/b?c=1", "/a"]
    line = "INFO Connected to cluster with app ID app-20141110-0003"
    assert one(spark, line, lambda c: text.extract_id(c, r"(app-\d+-\d+)")) == "app-20141110-0003"
    assert one(spark, "nothing here", lambda c: text.extract_id(c, r"(app-\d+-\d+)")) is None


def test_json_fields(spark):
    body = '{"status": "busy", "tree": [{"children": [{"t": "x"}, {"t": "y"}]}]}'
    assert one(spark, body, lambda c: text.json_field(c, "$.status", "idle")) == "busy"
    assert one(spark, body, lambda c: text.json_field(c, "$.other", "idle")) == "idle"
    assert one(spark, "broken", lambda c: text.json_field(c, "$.status", "idle")) == "idle"
    schema = "tree array<struct<children:array<struct<t:string>>>>"
    children = one(spark, body, lambda c: text.json_path(c, schema, "tree.0.children"))
    assert [c.t for c in children] == ["x", "y"]


def test_shards_are_stable_and_even(spark):
    ids = spark.range(3000).select(text.shard_of(F.col("id"), 3).alias("s"))
    sizes = {r.s: r["count"] for r in ids.groupBy("s").count().collect()}
    assert set(sizes) == {0, 1, 2} and max(sizes.values()) < 1.2 * min(sizes.values())


def test_rates(spark):
    # 3 MiB in 750 usec, and 6 million bytes in 4000 usec.
    rate = one(spark, 3 << 20, lambda c: measures.mib_per_s(c, F.lit(750.0)), "long")
    assert rate == pytest.approx(4000.0)
    assert one(spark, 6_000_000, lambda c: measures.mbit_per_s(c, F.lit(4000.0)), "long") == (
        pytest.approx(12_000.0)
    )
    assert one(spark, 5, lambda c: measures.mib_per_s(c, F.lit(0)), "long") is None


@pytest.mark.parametrize("size, group", [(0, 0), (1, 1), (2, 2), (3, 2), (1023, 512), (1024, 1024)])
def test_size_classes(spark, size, group):
    assert one(spark, size, measures.size_class, "long") == group


def test_buckets_also_before_the_epoch(spark):
    assert one(spark, 1_999_999, lambda c: measures.bucket_ms(c, 1000), "long") == 1000
    assert one(spark, -1, lambda c: measures.bucket_ms(c, 1000), "long") == -1000
