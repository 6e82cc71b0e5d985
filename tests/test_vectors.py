"""Vector operators against brute force on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from tessel.functions import vector as V
from tessel.operators import vectors as ops


def vec_df(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "uid long, vec array<double>")


def test_parse_printed_vector(spark):
    df = spark.createDataFrame([("[1.         0.5]",), ("[ 0.25  -3e-2 ]",)], "s string")
    got = [r[0] for r in df.select(V.parse_vector("s")).collect()]
    assert got == [[1.0, 0.5], [0.25, -0.03]]


def test_minmax_constant_column_is_one(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0)], "uid long, x double, y double")
    out = {r.uid: (r.x, r.y) for r in ops.minmax(df, ["x", "y"]).collect()}
    assert out[1][0] == 1.0 and out[2][0] == 1.0
    assert 0 < out[1][1] <= 1 and out[2][1] == 1.0


def test_cosine_zero_vector(spark):
    df = vec_df(spark, [(1, [0, 0]), (2, [1, 0])])
    out = {r.uid: r.cos for r in ops.cosine_to(df, [1.0, 0.0]).collect()}
    assert out == {1: 0.0, 2: 1.0}


def brute_knn(points, q, k, include_self):
    rows = []
    for pid, pv in points:
        if not include_self and pid == q[0]:
            continue
        rows.append((float(np.sum((np.array(pv) - np.array(q[1])) ** 2)), pid))
    return [pid for _, pid in sorted(rows)[:k]]


def test_knn_duplicates_self_and_partitions(spark):
    rng = np.random.default_rng(7)
    pts = [(i, rng.normal(size=4).round(2).tolist()) for i in range(60)]
    pts += [(100, pts[3][1]), (101, pts[3][1])]  # duplicates of point 3
    df = vec_df(spark, pts)
    queries = df.filter(F.col("uid").isin(3, 100, 10))
    for parts in (1, 4, 16):
        for inc in (True, False):
            got = ops.knn(queries, df.repartition(parts), 3, include_self=inc).collect()
            by_q = {}
            for r in sorted(got, key=lambda r: (r.q_uid, r.rank)):
                by_q.setdefault(r.q_uid, []).append(r.uid)
            for qid, qv in pts:
                if qid in (3, 100, 10):
                    assert by_q[qid] == brute_knn(pts, (qid, qv), 3, inc)


def test_knn_graph_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(i, rng.normal(size=3).tolist()) for i in range(90)]
    df = vec_df(spark, pts)
    g = ops.knn_graph(df, ks=(2, 5), block_rows=16).collect()
    by_q = {}
    for r in sorted(g, key=lambda r: (r.q_uid, r.rank)):
        by_q.setdefault(r.q_uid, []).append(r.uid)
    for p in pts:
        assert by_q[p[0]] == brute_knn(pts, p, 5, False)
    assert ops.graph_for_k(ops.knn_graph(df, ks=(2, 5), block_rows=16), 2).count() == 90 * 2


def test_cosine_matrix_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = [(i, rng.normal(size=5).tolist()) for i in range(70)] + [(999, [0.0] * 5)]
    df = vec_df(spark, pts)
    got = {(r.i, r.j): r.sim for r in ops.cosine_matrix(df, threshold=0.3, block_rows=10).collect()}
    want = {}
    for a, va in pts:
        for b, vb in pts:
            if a <= b:
                na, nb = np.linalg.norm(va), np.linalg.norm(vb)
                s = 0.0 if na == 0 or nb == 0 else float(np.dot(va, vb) / (na * nb))
                if round(s, 6) >= 0.3:
                    want[(a, b)] = round(s, 6)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_trim_uses_strict_population_bounds(spark):
    xs = [0.0] * 20 + [100.0]
    df = spark.createDataFrame([(i, x, 0.5) for i, x in enumerate(xs)], "uid long, x double, y double")
    kept = ops.trim_outliers(df, ["x"]).count()
    mu, sd = np.mean(xs), np.std(xs)
    assert kept == sum(1 for x in xs if mu - 3 * sd < x < mu + 3 * sd)


def test_density_grid_last_bin_takes_one(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.05, 0.95)], "uid long, x double, y double")
    cells = {(r.bx, r.by): r.n for r in ops.density_grid(df, bins=10).collect()}
    assert cells == {(9, 9): 1, (0, 9): 1}


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, 0.0, -1.0],)], "l array<double>")
    rows = df.select(V.softmax("l").alias("p"), V.argmax("l").alias("a")).collect()
    for r in rows:
        assert abs(sum(r.p) - 1.0) < 1e-12
    assert [r.a for r in rows] == [1, 0]


def test_project_2d_shape(spark):
    rng = np.random.default_rng(1)
    df = vec_df(spark, [(i, rng.normal(size=6).tolist()) for i in range(40)])
    out = ops.project_2d(df)
    assert out.count() == 40 and set(out.columns) == {"uid", "x", "y"}


def test_knn_switches_to_blocks_above_query_limit(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pts = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    df = vec_df(spark, pts)
    small = {(r.q_uid, r.rank): r.uid for r in ops.knn(df, df, 3, include_self=False).collect()}
    monkeypatch.setattr(ops, "MAX_QUERY_CELLS", 10)
    big = {(r.q_uid, r.rank): r.uid for r in ops.knn(df, df, 3, include_self=False).collect()}
    assert small == big and len(small) == 40 * 3


def test_topk_chunking_is_invisible(spark, monkeypatch):
    rng = np.random.default_rng(21)
    pts = [(i, rng.integers(0, 3, size=2).astype(float).tolist()) for i in range(120)]  # many exact ties
    df = vec_df(spark, pts)
    base = {(r.q_uid, r.rank): (r.uid, r.dist) for r in ops.knn_graph(df, ks=(7,)).collect()}
    monkeypatch.setattr(ops, "DIST_CELLS", 50)
    monkeypatch.setattr(ops, "DIFF_CELLS", 30)
    small = {(r.q_uid, r.rank): (r.uid, r.dist) for r in ops.knn_graph(df, ks=(7,), block_rows=16).collect()}
    assert base == small
    for p in pts[:10]:
        assert [base[(p[0], r)][0] for r in range(7)] == brute_knn(pts, p, 7, False)


def test_knn_string_ids(spark):
    rng = np.random.default_rng(4)
    pts = [(f"id{i:03d}", rng.normal(size=3).tolist()) for i in range(30)]
    df = spark.createDataFrame(pts, "uid string, vec array<double>")
    got = ops.knn_graph(df, ks=(3,), block_rows=8).collect()
    by_q = {}
    for r in sorted(got, key=lambda r: (r.q_uid, r.rank)):
        by_q.setdefault(r.q_uid, []).append(r.uid)
    for p in pts:
        assert by_q[p[0]] == brute_knn(pts, p, 3, False)


def test_knn_graph_distances_symmetric(spark):
    rng = np.random.default_rng(13)
    df = vec_df(spark, [(i, rng.normal(size=4).tolist()) for i in range(50)])
    g = {(r.q_uid, r.uid): r.dist for r in ops.knn_graph(df, ks=(10,), block_rows=12).collect()}
    both = [(a, b) for (a, b) in g if (b, a) in g]
    assert both and all(g[(a, b)] == g[(b, a)] for a, b in both)


def test_project_2d_equals_numpy_pca(spark):
    rng = np.random.default_rng(17)
    X = rng.normal(size=(60, 5)) * np.array([5.0, 3.0, 1.0, 0.5, 0.1])
    df = vec_df(spark, [(i, X[i].tolist()) for i in range(60)])
    got = {r.uid: (r.x, r.y) for r in ops.project_2d(df).collect()}
    cov = np.cov(X, rowvar=False)
    w, v = np.linalg.eigh(cov)
    pc = v[:, np.argsort(w)[::-1][:2]]
    for j in range(2):
        if pc[np.argmax(np.abs(pc[:, j])), j] < 0:
            pc[:, j] = -pc[:, j]
    want = X @ pc  # Spark ML's PCA model projects without centring
    for i in range(60):
        assert abs(got[i][0] - want[i, 0]) < 1e-6 and abs(got[i][1] - want[i, 1]) < 1e-6


def test_filter_dim(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0])], "uid long, vec array<double>")
    assert [r.uid for r in ops.filter_dim(df, 2).collect()] == [1]


def test_parse_vector_matches_numpy_prints(spark):
    rng = np.random.default_rng(8)
    vecs = [rng.normal(size=2) * 10.0 ** rng.integers(-6, 4) for _ in range(200)] + [np.array([1.0, 0.5]),
                                                                                   np.array([0.0, -0.0])]
    printed = [str(v) for v in vecs]  # numpy's own print, as a CSV cell would hold it
    df = spark.createDataFrame([(i, s) for i, s in enumerate(printed)], "i int, s string")
    got = {r.i: r.v for r in df.select("i", V.parse_vector("s").alias("v")).collect()}
    for i, s in enumerate(printed):
        want = [float(x) for x in s.strip("[]").split()]
        assert got[i] == want, s


def test_points_with_nan_come_last_but_are_there(spark):
    nan = float("nan")
    pts = spark.createDataFrame([(1, [0.0, 0.0]), (2, [nan, 1.0]), (3, [1.0, 0.0]), (4, [float("inf"), 0.0])], "uid long, vec array<double>")
    q = pts.filter("uid = 1")
    got = [(r["rank"], r.uid) for r in ops.knn(q, pts, 4).orderBy("rank").collect()]
    assert got == [(0, 1), (1, 3), (2, 2), (3, 4)]
    graph = ops.knn_graph(pts, ks=(3,)).groupBy("q_uid").count().collect()
    assert all(r["count"] == 3 for r in graph) and len(graph) == 4


def test_rows_without_a_vector_stay_or_raise(spark):
    import pytest
    rows = spark.createDataFrame([(1,), (2,)], "uid long")
    vecs = spark.createDataFrame([(1, [1.0])], "uid long, vec array<double>")
    assert sorted((r.uid, r.matched) for r in ops.attach_vectors(rows, vecs).collect()) == [(1, True), (2, False)]
    assert ops.attach_vectors(rows, vecs, missing="drop").count() == 1
    with pytest.raises(ValueError):
        ops.attach_vectors(rows, vecs, missing="error")


def test_topk_exact_by_products_and_differences():
    """The k nearest of the product form are those of the difference form: far from the origin, repeated, with text ids, not finite."""
    rng = np.random.default_rng(11)
    for shift, scale, ids in ((0, 1.0, np.arange(300)), (1e9, 1e-3, np.arange(300)), (0, 1e200, np.arange(300)),
                              (5, 0.1, np.array([f"id{i * i}" for i in range(300)], dtype=object))):
        p = rng.normal(size=(300, 8)).round(1) * scale + shift
        p[7] = np.nan
        top = ops._TopK(ids[:40], 6, False)
        for part in np.array_split(np.arange(300), 4):
            top.add(p[:40], ids[part], p[part])
        with np.errstate(invalid="ignore", over="ignore"):
            d = ops._sq_dists(p[:40], p)
        d[~np.isfinite(d)] = np.inf
        for i in range(40):
            want = sorted((d[i, j], ids[j]) for j in range(300) if j != i)[:6]
            got = top.frame()
            got = got[got["q_uid"] == ids[i]]
            assert list(zip(got["dist"], got["uid"])) == want


def test_graph_pairs_are_spread_over_tasks():
    """A table that fits a few blocks by its bytes is not compared by a few tasks."""
    assert ops._graph_blocks(100_000, 64) == ops.SPREAD_BLOCKS
    assert ops._graph_blocks(500, 64) == 1
    assert ops._graph_blocks(10, 2, 3) == 4
