"""Readers and writers on hand-written files."""

import pytest
from pyspark.sql import functions as F

from loadlens.sources import files, reports, runs

RULE = "-" * 47

REPORT = f"""

{RULE}
Read latency between x2 and x1
{RULE}
---------------------------------------------------------------------------------------
 Mtu             : 1024[B]
---------------------------------------------------------------------------------------
 #bytes #iterations    t_min[usec]    t_max[usec]  t_typical[usec]
 2       1000          1.11           12.50        1.20   
---------------------------------------------------------------------------------------
 #bytes #iterations    t_min[usec]    t_max[usec]  t_typical[usec]
 2       1000          1.12           13.50        1.30   
---------------------------------------------------------------------------------------


{RULE}
Write bandwidth between x2 and x1
{RULE}
 #bytes     #iterations    BW peak[MB/sec]    BW average[MB/sec]   MsgRate[Mpps]
 32768      4000           6000.25            5999.75\t\t   0.096000
 32768      4000           not a row


{RULE}
Connect
{RULE}
6144000 bytes in 0.01 seconds = 13000.50 Mbit/sec
1000 iters in 0.01 seconds = 4.25 usec/iter


{RULE}
Streams
{RULE}
------------------------------------------------------------
[  3] local 10.0.0.1 port 41000 connected with 10.0.0.2 port 5201
[ ID] Interval       Transfer     Bandwidth
[  3]  0.0-10.0 sec  4.50 GBytes  3.75 Gbits/sec
[ 10]  0.0-10.0 sec  900 MBytes  750 Mbits/sec
[SUM]  0.0-10.0 sec  5.40 GBytes  4.50 Gbits/sec


{RULE}
Sizes
{RULE}
#---------------------------------------------------
       #bytes #repetitions      t[usec]   Mbytes/sec
            0         1000         1.75         0.00
         1024          640        20.50      2900.25


{RULE}
Messages
{RULE}
tool: [Total Run] RunTime=1.250 sec; SentMessages=1001; ReceivedMessages=1000
tool: [Valid Duration] RunTime=1.125 sec; SentMessages=900; ReceivedMessages=899
tool: \x1b[2;35m====> avg-lat=  5.500 (std-dev=0.250)\x1b[0m
tool: # dropped messages = 1; # duplicated messages = 2; # out-of-order messages = 3
tool: \x1b[2;35mTotal 900 observations\x1b[0m; each percentile contains 9.00 observations
tool: ---> <MAX> observation =   30.500
tool: ---> percentile  99.99 =    9.125
tool: ---> percentile  50.00 =    5.250
tool: ---> <MIN> observation =    5.125
"""


@pytest.fixture
def report(spark, tmp_path):
    (tmp_path / "one.txt").write_text(REPORT)
    (tmp_path / "two.txt").write_text("no title\n5 iters in 1.0 seconds = 2.5 usec/iter\n")
    return reports.parse_perf_report(spark, str(tmp_path / "*.txt"))


def test_report(report, both_ways):
    rows = report.orderBy("file", "line_no").collect()
    got = [(r.section, r.table_no, r.metric, r.key, r.value, r.unit) for r in rows]
    latency, rate = "Read latency between x2 and x1", "Write bandwidth between x2 and x1"

    def block(section, table, key, *figures):
        return [(section, table, m, key, v, u) for m, v, u in figures]

    want = (
        block(latency, 1, "2", ("iterations", 1000, "count"), ("latency_min", 1.11, "usec"),
              ("latency_max", 12.5, "usec"), ("latency_typical", 1.2, "usec"))
        + block(latency, 2, "2", ("iterations", 1000, "count"), ("latency_min", 1.12, "usec"),
                ("latency_max", 13.5, "usec"), ("latency_typical", 1.3, "usec"))
        + block(rate, 3, "32768", ("iterations", 4000, "count"), ("bandwidth_peak", 6000.25, "MB/sec"),
                ("bandwidth_average", 5999.75, "MB/sec"), ("message_rate", 0.096, "Mpps"))
        + block("Connect", 3, "6144000", ("seconds", 0.01, "sec"), ("pingpong_rate", 13000.5, "Mbit/sec"))
        + block("Connect", 3, "1000", ("seconds", 0.01, "sec"), ("pingpong_time", 4.25, "usec/iter"))
        + block("Streams", 4, "3", ("transfer", 4.5, "GBytes"), ("bandwidth", 3.75, "Gbits/sec"))
        + block("Streams", 4, "10", ("transfer", 900, "MBytes"), ("bandwidth", 750, "Mbits/sec"))
        + block("Streams", 4, "SUM", ("transfer", 5.4, "GBytes"), ("bandwidth", 4.5, "Gbits/sec"))
        + block("Sizes", 5, "0", ("repetitions", 1000, "count"), ("time", 1.75, "usec"),
                ("rate", 0, "Mbytes/sec"))
        + block("Sizes", 5, "1024", ("repetitions", 640, "count"), ("time", 20.5, "usec"),
                ("rate", 2900.25, "Mbytes/sec"))
        + block("Messages", 5, "Total Run", ("run_time", 1.25, "sec"), ("sent", 1001, "count"),
                ("received", 1000, "count"))
        + block("Messages", 5, "Valid Duration", ("run_time", 1.125, "sec"), ("sent", 900, "count"),
                ("received", 899, "count"))
        + block("Messages", 5, "valid", ("latency_average", 5.5, "usec"), ("latency_stddev", 0.25, "usec"),
                ("dropped", 1, "count"), ("duplicated", 2, "count"), ("out_of_order", 3, "count"),
                ("observations", 900, "count"), ("per_percentile", 9, "count"))
        + block("Messages", 5, "MAX", ("percentile", 30.5, "usec"))
        + block("Messages", 5, "99.99", ("percentile", 9.125, "usec"))
        + block("Messages", 5, "50.00", ("percentile", 5.25, "usec"))
        + block("Messages", 5, "MIN", ("percentile", 5.125, "usec"))
        + block(None, 0, "5", ("seconds", 1.0, "sec"), ("pingpong_time", 2.5, "usec/iter"))
    )
    assert sorted(got, key=str) == sorted(((s, t, m, k, float(v), u) for s, t, m, k, v, u in want), key=str)
    assert {r.occurrence for r in rows} == {1}


def test_both_sides_of_a_report_are_told_apart(spark, both_ways):
    side = ["7 bytes in 0.5 seconds = {} Mbit/sec", "[ ID] Interval       Transfer     Bandwidth", "[ 10]  0.0-10.0 sec  {}.5 GBytes  2.5 Gbits/sec"]
    lines = ["", "", RULE, "Both", RULE, *[x.format(1) for x in side], *[x.format(2) for x in side]]
    table = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    rows = reports.report_rows(table).collect()
    names = [(r.file, r.section, r.table_no, r.metric, r.key, r.occurrence) for r in rows]
    assert len(set(names)) == len(names) == 8
    rates = {(r.table_no, r.occurrence): r.value for r in rows if r.metric == "pingpong_rate"}
    # The second figure stands below the first side's table.
    assert rates == {(0, 1): 1.0, (1, 1): 2.0}
    assert sorted(r.value for r in rows if r.metric == "transfer") == [1.5, 2.5]


def test_a_data_row_between_rules_is_no_title(spark):
    rows = ["", "", RULE, "Title", RULE, "text", RULE, "row", RULE, "", RULE, "", RULE]
    lines = spark.createDataFrame(
        [("f", i + 1, r) for i, r in enumerate(rows)], "file string, line_no long, line string"
    )
    titles = reports.with_titles(lines).where("title IS NOT NULL").collect()
    assert [(r.line_no, r.title) for r in titles] == [(4, "Title")]


def test_lines_of_a_file_read_in_many_blocks(spark, tmp_path, both_ways):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = files.read_lines(spark, str(tmp_path / "big.txt"))
        assert lines.rdd.getNumPartitions() > 4
        got = {r.line_no: r.line for r in files.number_lines(lines).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i + 1: f"line {i}" for i in range(5000)}


def test_articles(spark, tmp_path):
    file = tmp_path / "dump.tsv"
    file.write_text('1\tA "quoted" title\t2010\t<a>"b"</a>\\n\ttext\n2\t# B\t2010\t\t\n3\tshort\n')
    got = [tuple(r) for r in files.read_articles_tsv(spark, str(file)).collect()]
    assert got[0] == ('A "quoted" title', '<a>"b"</a>\\n')
    assert got[1][0] == "# B" and not got[1][1]
    assert got[2] == ("short", None)


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "text": "one", "more": 1}\n{"id": "2", broken\n')
    (tmp_path / "b.ndjson").write_text('{"id": "3", "text": "three"}\n')
    (tmp_path / "c.txt").write_text('{"id": "4", "text": "four"}\n')
    rows = files.read_json_docs(spark, str(tmp_path)).collect()
    assert sorted((r.id, r.text) for r in rows if r._broken is None) == [("1", "one"), ("3", "three")]
    assert [r._broken for r in rows if r._broken is not None] == ['{"id": "2", broken']


def test_json_arrays_and_the_last_of_an_id(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"id": "1", "text": "old"},\n {"id": "2", "text": "two"},\n {"id": "2", "text": "again"}\n]\n')
    (tmp_path / "b.json").write_text('{"id": "1",\n "text": "new"}')
    (tmp_path / "c.json").write_text('[{"id": "9", "text"')
    rows = files.read_json_docs(spark, str(tmp_path), whole_files=True)
    assert sorted(map(tuple, files.last_docs(rows).collect())) == [("1", "new"), ("2", "again")]
    assert [(r.file.rsplit("/")[-1], r.broken) for r in files.broken_docs(rows).collect()] == [("c.json", 1)]


def test_wiki_pages(spark, tmp_path):
    page = """<page><title>{t}</title><id>{i}</id><revision><id>{r}</id>
      <timestamp>{at}</timestamp><contributor><username>u{i}</username><id>7</id></contributor>
      <text xml:space="preserve">{text}</text></revision></page>"""
    body = page.format(t="A &amp; B", i=1, r=11, at="2012-03-04T13:05:06Z", text="#REDIRECT [[C]]\nmore")
    body += page.format(t="C", i=2, r=12, at="bad", text="x &lt;b&gt;")
    (tmp_path / "dump.xml").write_text(f"<mediawiki><siteinfo/>{body}</mediawiki>")
    rows = files.read_wiki_xml(spark, str(tmp_path / "dump.xml")).orderBy("id").collect()
    assert rows[0].asDict() | {"timestamp": str(rows[0].timestamp)} == {
        "id": 1, "title": "A & B", "revision": 11, "user": "u1", "userId": 7,
        "text": "#REDIRECT [[C]]\nmore", "timestamp": "2012-03-04 13:05:06",
    }
    assert (rows[1].text, rows[1].timestamp) == ("x <b>", None)


def test_query_list(spark, tmp_path):
    (tmp_path / "q.csv").write_text('/select?q=a,b\n/select?q="c"\n/select?q=d\n')
    got = [tuple(r) for r in files.read_query_list(spark, str(tmp_path / "q.csv")).orderBy("query_id").collect()]
    assert got == [(0, "/select?q=a,b"), (1, '/select?q="c"'), (2, "/select?q=d")]


def test_host_map(spark, tmp_path):
    (tmp_path / "ips").write_text(
        '{"host": "f1", "ip": "10.0.0.1"}\n{"host": "f2", "ip": "10.0.0.2"}\nnoise\n'
        '{"host": "f1", "ip": "10.0.0.9"}\n'
    )
    got = {r.host: r.ip for r in files.read_json_map(spark, str(tmp_path / "ips")).collect()}
    assert got == {"f1": "10.0.0.9", "f2": "10.0.0.2"}


def test_host_map_of_a_folder_goes_by_file_name(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"host": "f0", "ip": "old"}\n')
    filler = "".join(f'{{"host": "g{i}", "ip": "x"}}\n' for i in range(200))
    (tmp_path / "b.txt").write_text(filler + '{"host": "f0", "ip": "new"}\n')
    got = {r.host: r.ip for r in files.read_json_map(spark, str(tmp_path)).collect()}
    assert got["f0"] == "new" and len(got) == 201


def test_node_logs(spark, tmp_path):
    for node, line in (("n1", "up"), ("n2", "down")):
        (tmp_path / node).mkdir()
        (tmp_path / node / "stderr").write_text(f"{line}\n")
        (tmp_path / node / "stdout").write_text("out\n")
    got = files.read_node_logs(spark, str(tmp_path / "*" / "stderr")).collect()
    assert sorted(map(tuple, got)) == [("n1", "stderr", "up"), ("n2", "stderr", "down")]
    # Folders listed by tasks, not by the driver through a pattern: the same rows.
    assert sorted(files.read_node_logs(spark, str(tmp_path), "stderr").collect()) == sorted(got)


@pytest.mark.parametrize("message", ['plain, "quoted"', "two\nlines", "", None])
def test_result_rows_round_trip(spark, tmp_path, message):
    row = (1, 2, "get", "200", message, "t-1", "text", True, 5, "/q?a=b,c", 2)
    df = spark.createDataFrame([row], files.RESULT_SCHEMA)
    files.write_results_csv(df, str(tmp_path / "out"))
    read = files.read_results_csv(spark, str(tmp_path / "out"), line_breaks="\n" in (message or ""))
    assert [tuple(r) for r in read.collect()] == [row]


def test_result_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "r.csv").write_text("timeStamp,more,bytes,elapsed,URL\n7,x,555,9,/a\n8,y,,1,\n")
    got = files.read_results_csv(spark, str(tmp_path / "r.csv")).orderBy("timeStamp").collect()
    assert [(r.timeStamp, r.elapsed, r.bytes, r.URL, r.Latency) for r in got] == [(7, 9, 555, "/a", None), (8, 1, None, None, None)]
    assert got[0].__fields__ == [c.split()[0] for c in files.RESULT_SCHEMA.split(", ")]


def test_runs(spark, tmp_path, plan):
    base = str(tmp_path / "runs")
    for run, n in (("2024-01-01-00-00-00", 3), ("2024-01-02-00-00-00", 5)):
        runs.write_run(spark.range(n), base, run)
    runs.write_run(spark.range(2), base, "2024-01-02-00-00-00")  # a run written again
    newest = runs.latest_run(runs.read_runs(spark, base))
    assert newest.count() == 2 and newest.first().run_ts == "2024-01-02-00-00-00"
    assert "PartitionFilters: [isnotnull(run_ts" in plan(newest)
    pointed = runs.read_latest(spark, base)
    assert pointed.count() == 2 and pointed.first().run_ts == "2024-01-02-00-00-00"
    assert "run_ts=2024-01-01" not in plan(pointed) and "Subquery" not in plan(pointed)
    runs.write_run(spark.range(9), base, "2023-12-31-00-00-00")  # an older run does not become the latest
    assert runs.read_latest(spark, base).count() == 2 and runs.latest_run(runs.read_runs(spark, base)).count() == 2
    with pytest.raises(ValueError, match="no run"):
        runs.read_latest(spark, str(tmp_path / "none"))


def test_record_table_is_joined_without_moving_it(spark, tmp_path, plan):
    rows = spark.range(100).select(F.concat(F.lit("user"), F.col("id")).alias("key"), "id")
    stored = runs.create_kv_table(rows, "records_test", 4, path=str(tmp_path / "a"))
    stored = runs.create_kv_table(rows.where("id < 50"), "records_test", 4, path=str(tmp_path / "a"))
    assert stored.count() == 50
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(rows.select("key").join(stored, "key"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange") == 1
    spark.sql("DROP TABLE records_test")


@pytest.mark.parametrize("chunk", [None, 1, 2, 7])
def test_titles_are_found_over_the_edges_of_chunks(spark, monkeypatch, chunk):
    """Rules, blank lines and titles in any order, with gaps and repeats in the numbers: the rule as it is stated."""
    import random

    draw = random.Random(3)
    kinds = [RULE, RULE, "", "  ", "a title", "5 iters in 1.0 seconds = 2.5 usec/iter", None]
    rows = [(f, n, draw.choice(kinds)) for f in ("a", "b") for n in range(1, 400) for _ in range(draw.choice([0, 1, 1, 1, 1, 2]))]
    rows += [("a", 1, "first"), ("a", 2, "second"), (None, 1, RULE), (None, 2, "none"), (None, 3, RULE), ("c", None, "x")]
    if chunk is not None:
        monkeypatch.setattr(reports, "WHOLE_ROWS", 10)
        monkeypatch.setattr(reports, "CHUNK_LINES", chunk)
    at = lambda f, n, test: any(g == f and m == n and x is not None and test(x) for g, m, x in rows)
    is_rule, is_blank = (lambda x: x == RULE), (lambda x: not x.strip())
    want = [
        (f, n, x.strip()) for f, n, x in rows
        if f and n and x and not is_rule(x) and not is_blank(x) and at(f, n - 1, is_rule) and at(f, n + 1, is_rule)
        and (n == 2 or at(f, n - 2, is_blank))
    ]
    lines = spark.createDataFrame(rows, "file string, line_no long, line string")
    got = reports.with_titles(lines)
    assert got.count() == len(rows) and len(want) > 5
    assert sorted((r.file, r.line_no, r.title) for r in got.where("title IS NOT NULL").collect()) == sorted(want)


def test_lines_are_numbered_where_they_are(spark, tmp_path, plan):
    """No line is moved for its number, and lines left out after reading do not count."""
    (tmp_path / "one.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "two.txt").write_text("x\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = files.read_lines(spark, str(tmp_path / "*.txt"))
        numbered = files.number_lines(lines)
        above = plan(numbered).split("FileScan")[0]
        assert "BroadcastHashJoin" in above and "Exchange" not in above
        got = {(r.file[-7:], r.line_no): r.line for r in numbered.collect()}
        assert got == {("one.txt", i + 1): f"line {i}" for i in range(5000)} | {("two.txt", 1): "x"}
        some = files.number_lines(lines.where("line NOT LIKE '%7'"))
        kept = [x for x in (f"line {i}" for i in range(5000)) if not x.endswith("7")]
        assert {(r.file[-7:], r.line_no): r.line for r in some.collect()} == {("one.txt", i + 1): x for i, x in enumerate(kept)} | {("two.txt", 1): "x"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
