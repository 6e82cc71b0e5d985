"""Pivot cells: pruned neighbour graph, stored index, thresholded cosine join, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import cells, vectors


def frame(spark, x, ids=None, parts=5):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "uid long, vec array<double>").repartition(parts)


def clustered(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] * 10 + rng.normal(size=(n, dim))


def brute(x, k, ids=None):
    ids = np.arange(len(x)) if ids is None else np.asarray(ids)
    out = set()
    for i in range(len(x)):
        with np.errstate(invalid="ignore"):
            d = ((x - x[i]) ** 2).sum(axis=1)
        d[~np.isfinite(d)] = np.inf
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out |= {(int(ids[i]), r, int(ids[j])) for r, j in enumerate(order)}
    return out


def rows(g):
    return {(r["q_uid"], r["rank"], r["uid"]) for r in g.collect()}


def test_pruned_graph_is_exact_and_computes_fewer_pairs(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 40)
    monkeypatch.setattr(cells, "QUERY_ROWS", 50)
    x = clustered(600, 6, 12, 1)
    x[100:260] = x[100]  # copies: one cell of many blocks
    df = frame(spark, x)
    placed = cells.NeighbourCells(df, cell_rows=30)
    routes = placed.routes(5)
    assert rows(placed.graph(5, routes=routes)) == brute(x, 5)
    assert placed.computed_pairs(routes) < 0.6 * 600 * 600
    assert int(placed.cells.blocks.max()) > 1
    assert rows(cells.neighbour_graph(df, ks=(2, 5), cell_rows=30)) == brute(x, 5)


@pytest.mark.parametrize("n,k", [(1, 3), (3, 5), (40, 39), (60, 4)])
def test_pruned_graph_of_few_points(spark, n, k):
    x = clustered(n, 3, 2, n)
    assert rows(cells.neighbour_graph(frame(spark, x), ks=(k,), cell_rows=8)) == brute(x, k)


def test_points_that_are_not_finite(spark):
    x = clustered(30, 2, 3, 4)
    x[3, 0], x[7, 1], x[8, 0] = np.nan, np.inf, -np.inf
    assert rows(cells.neighbour_graph(frame(spark, x), ks=(4,), cell_rows=5)) == brute(x, 4)
    few = x[[1, 2, 3, 7, 8, 9]]
    assert rows(cells.neighbour_graph(frame(spark, few), ks=(4,), cell_rows=5)) == brute(few, 4)
    assert cells.neighbour_graph(frame(spark, x).limit(0)).count() == 0


def test_block_plan_where_cells_would_copy_more(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(300, 40))
    monkeypatch.setattr(cells, "COPIES", 8)
    monkeypatch.setattr(cells.NeighbourCells, "graph", None)  # not asked
    assert rows(cells.neighbour_graph(frame(spark, x), ks=(3,), cell_rows=3)) == brute(x, 3)


def test_approximate_graph_reports_its_recall(spark):
    x = clustered(400, 8, 10, 3)
    df = frame(spark, x)
    g, got = cells.approximate_graph(df, 5, target=0.9, cell_rows=20)
    want = brute(x, 5)
    true = len({(a, c) for a, _, c in rows(g)} & {(a, c) for a, _, c in want}) / len(want)
    assert got >= 0.9 and true >= 0.85
    exact, full = cells.approximate_graph(df, 5, target=1.01, cell_rows=100)
    assert full == 1.0 and rows(exact) == want


def test_index_reads_reachable_cells_and_finds_appended_points(spark, tmp_path):
    x = clustered(500, 5, 25, 6)
    df = frame(spark, x)
    path = str(tmp_path / "index")
    cells.build_index(df.filter("uid < 300"), path, cell_rows=10)
    few = df.filter("uid in (4, 77, 410)")
    half = cells.search_index(few, path, 4)
    want = vectors.knn(few, df.filter("uid < 300"), 4)
    assert sorted(map(tuple, half.select("q_uid", "rank", "uid").collect())) == sorted(map(tuple, want.select("q_uid", "rank", "uid").collect()))
    assert 410 not in {r["uid"] for r in half.collect()}
    cells.append_index(df.filter("uid >= 300"), path)
    for self_too in (True, False):
        got, want = cells.search_index(few, path, 4, self_too), vectors.knn(few, df, 4, self_too)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = cells.cell_rows_of(spark, path, [0, 3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    read = [r[0] for r in cells.cell_rows_of(spark, path, [0, 3]).select("cell").distinct().collect()]
    assert sorted(read) == [0, 3]
    assert cells.index_cells(spark, path).count.sum() == 500


def test_index_of_fewer_points_than_asked(spark, tmp_path):
    df = frame(spark, clustered(3, 2, 1, 1))
    cells.build_index(df, str(tmp_path / "i"))
    assert cells.search_index(df, str(tmp_path / "i"), 9).count() == 9
    with pytest.raises(ValueError):
        cells.search_index(df.limit(0), str(tmp_path / "i"), 2)


def test_cosine_pairs_meet_only_where_they_can(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 25)
    x = clustered(300, 4, 12, 8)
    x[10:90] = x[10]
    x[5] = 0
    df = frame(spark, x)
    pairs, met, total = cells._cosine(df, 0.97, cell_rows=15)
    want = vectors.cosine_matrix(df, threshold=0.97)
    key = lambda d: sorted((r["i"], r["j"], round(r["sim"], 9)) for r in d.collect())
    assert key(pairs) == key(want) and met < 0.7 * total
    with pytest.raises(ValueError):
        cells.cosine_pairs(df, 0.0)


def test_bounds_hold_for_every_point():
    rng = np.random.default_rng(5)
    pivots, x, q = rng.normal(size=(9, 3)), rng.normal(size=(200, 3)) * 2, rng.normal(size=(50, 3)) * 2
    to = cells.distances(x, pivots)
    cell = to.argmin(axis=1)
    away = to[np.arange(200), cell]
    count = np.bincount(cell, minlength=9)
    c = cells.Cells(pivots, count, np.array([away[cell == i].max(initial=0) for i in range(9)]),
                    np.array([away[cell == i].min(initial=9) for i in range(9)]))
    tq = cells.distances(q, pivots)
    low, d = c.lower(tq, tq.argmin(axis=1)), cells.distances(q, x)
    assert all((d[:, cell == i] >= low[:, [i]]).all() for i in range(9) if count[i])
    for k in (1, 7, 200):
        assert (np.sort(d, axis=1)[:, k - 1] <= c.upper(tq, k)).all()
    assert np.isinf(c.upper(tq, 201)).all()


def test_cosine_pairs_take_the_block_plan_where_bounds_rule_out_little(spark, monkeypatch):
    """Directions without clusters: every cell may meet every other, and rows are not copied once per cell."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(120)] + [(120, [0.0] * 8)], "uid long, vec array<double>")
    want = {(r.i, r.j): round(r.sim, 9) for r in vectors.cosine_matrix(df, 0.5).collect()}
    taken = []
    monkeypatch.setattr(cells, "COPIES", 1)
    monkeypatch.setattr(cells, "cosine_matrix", lambda *a: taken.append(1) or vectors.cosine_matrix(*a))
    got = cells.cosine_pairs(df, 0.5, cell_rows=4, max_pivots=40)
    assert {(r.i, r.j): round(r.sim, 9) for r in got.collect()} == want and taken


def test_index_writes_a_file_per_cell_not_per_point(spark, tmp_path):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(400)], "uid long, vec array<double>")
    path = str(tmp_path / "index")
    cells.build_index(df, path, cell_rows=100)
    files = list((tmp_path / "index" / "points").glob("cell=*/*.parquet"))
    assert len(files) == len(list((tmp_path / "index" / "points").glob("cell=*"))) <= 4


def test_index_deals_a_large_cell_over_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "FILE_ROWS", 50)
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "uid long, vec array<double>")
    path = str(tmp_path / "index")
    cells.build_index(df, path)
    assert spark.read.parquet(f"{path}/points").count() == 300
    assert len(list((tmp_path / "index" / "points").glob("cell=0/*.parquet"))) <= 6
    got = cells.search_index(df.filter("uid = 7"), path, 3).orderBy("rank").collect()
    assert [(r.uid, r.dist) for r in got] == [(0, 0.0), (1, 0.0), (2, 0.0)]
