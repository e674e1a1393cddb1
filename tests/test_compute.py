"""Page rank and the estimate of pi."""

import math
import random

import pytest

from loadlens.operators import estimate, graph


def brute_ranks(edges, vertices, steps, d=0.85):
    out = {}
    for s, t in edges:
        out.setdefault(s, []).append(t)
    n = len(vertices)
    rank = {v: 1 / n for v in vertices}
    for _ in range(steps):
        new = {v: (1 - d) / n for v in vertices}
        for s, targets in out.items():
            for t in targets:
                if t in new and s in rank:
                    new[t] += d * rank[s] / len(targets)
        rank = new
    return rank


def hub_edges(seed=1):
    """A hub holds a third of all links; some links are repeated."""
    pick = random.Random(seed)
    edges = [("hub", f"p{i}") for i in range(40)]
    edges += [(f"p{pick.randrange(40)}", f"p{pick.randrange(40)}") for _ in range(40)]
    return edges + [(f"p{i}", "hub") for i in range(40)]


@pytest.mark.parametrize("block", [1_000_000, 7])
@pytest.mark.parametrize("cut_every", [1, 4])
def test_ranks_equal_brute_force(spark, both_ways, block, cut_every):
    edges = hub_edges()
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.id: r.rank for r in graph.pagerank(df, 5, block=block, cut_every=cut_every).collect()}
    want = brute_ranks(edges, {s for s, _ in edges}, 5)
    assert got.keys() == want.keys()
    assert all(got[v] == pytest.approx(want[v], abs=1e-12) for v in want)
    assert sum(got.values()) == pytest.approx(1.0)


def test_unknown_and_dangling_pages(spark):
    edges = [("a", "b"), ("a", "gone"), ("b", "c")]
    df = spark.createDataFrame(edges, "src string, dst string")
    pages = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    got = {r.id: r.rank for r in graph.pagerank(df, 3, vertices=pages).collect()}
    want = brute_ranks(edges, {"a", "b", "c", "d"}, 3)
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    assert sum(got.values()) < 1


def test_articles_from_file_to_ranks(spark, tmp_path):
    from loadlens.sources.files import read_articles_tsv

    def body(*targets):
        return "".join(f"<link><target>{t}</target></link>" for t in targets)

    rows = [("A", body("B", "C")), ("B", body("C", "Nowhere")), ("C", body("A")), ("D", "no links")]
    file = tmp_path / "dump.tsv"
    file.write_text("".join(f"{i}\t{t}\t2010\t{b}\tplain\n" for i, (t, b) in enumerate(rows)))
    got = graph.rank_articles(read_articles_tsv(spark, str(file)), threshold=0.05, iterations=4)
    edges = [("A", "B"), ("A", "C"), ("B", "C"), ("B", "Nowhere"), ("C", "A")]
    want = brute_ranks(edges, set("ABCD"), 4)
    best = sorted((v for v in want if want[v] >= 0.05), key=lambda v: -want[v])
    assert [r.id for r in got.collect()] == best and "D" not in best


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    assert graph.pagerank(empty, 2).count() == 0


def test_pi(spark):
    got = estimate.monte_carlo_pi(spark, 200_000, slices=10)
    row = got.first()
    assert row.points == 200_000 and row.pi == pytest.approx(math.pi, abs=0.005)
    assert estimate.monte_carlo_pi(spark, 200_000, slices=3).first() == row
    inside = 0
    for i in range(1, 2001):
        x = i * estimate.STEP_X % estimate.PRIME_X / estimate.PRIME_X * 2 - 1
        y = i * estimate.STEP_Y % estimate.PRIME_Y / estimate.PRIME_Y * 2 - 1
        inside += x * x + y * y <= 1
    assert estimate.monte_carlo_pi(spark, 2000).first().inside == inside
    far = spark.range(10**15, 10**15 + 100_000)
    assert estimate.estimate_pi(far, "id").first().pi == pytest.approx(math.pi, abs=0.01)
