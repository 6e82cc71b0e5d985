"""The spectral map against a dense eigen-solver."""

import numpy as np

from tessel.operators import spectral, vectors


def dense(graph, k):
    e = [(r["q_uid"], r["uid"]) for r in graph.collect() if r["rank"] < k]
    ids = sorted({i for p in e for i in p})
    at = {u: i for i, u in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for a, b in e:
        w[at[a], at[b]] = w[at[b], at[a]] = 1
    d = w.sum(axis=1)
    values, u = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))
    order = np.argsort(-values)
    return ids, values[order], u[:, order]


def test_map_is_the_second_and_third_eigenvector(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(25, 3)) + c for c in ([0, 0, 0], [4, 0, 0], [0, 3, 0])])
    df = spark.createDataFrame([(f"p{i:02d}", v.tolist()) for i, v in enumerate(x)], "uid string, vec array<double>")
    graph = vectors.knn_graph(df, ks=(12,)).cache()
    for k in (12,):
        ids, values, u = dense(graph, k)
        got = spectral.spectral_map(graph, k, tolerance=1e-7).toPandas().sort_values("uid")
        assert got["uid"].tolist() == ids and got["residual"].iloc[0] <= 1e-7
        for col, value, j in (("x", "value_x", 1), ("y", "value_y", 2)):
            v = u[:, j] * np.sign(u[np.argmax(np.round(abs(u[:, j]), 9)), j])
            assert abs(got[col].to_numpy() - v).max() < 1e-5 and abs(got[value].iloc[0] - values[j]) < 1e-9


def test_map_of_a_graph_in_pieces_and_of_next_to_nothing(spark):
    edges = [(a, 0, a + 1) for a in range(0, 40, 2)] + [(a, 1, (a + 2) % 20) for a in range(20)] + [(a, 1, 20 + (a + 2) % 20) for a in range(20, 40)]
    graph = spark.createDataFrame(edges, "q_uid long, rank int, uid long")
    got = spectral.spectral_map(graph, 2).toPandas()
    assert len(got) == 40 and got["residual"].iloc[0] <= 1e-4 and abs(got["value_x"].iloc[0] - 1) < 1e-6
    for a in (got["x"], got["y"]):
        assert abs((a * a).sum() - 1) < 1e-9
    assert abs((got["x"] * got["y"]).sum()) < 1e-8
    assert spectral.spectral_map(graph.limit(0), 3).count() == 0
    assert spectral.spectral_map(spark.createDataFrame([(1, 0, 2), (2, 0, 1)], "q_uid long, rank int, uid long"), 3).count() == 0


def test_map_over_several_blocks_and_one_checkpoint_a_round(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(30, 3)) + c for c in ([0, 0, 0], [4, 0, 0], [0, 3, 0])])
    df = spark.createDataFrame([(f"p{i:02d}", v.tolist()) for i, v in enumerate(x)], "uid string, vec array<double>")
    graph = vectors.knn_graph(df, ks=(8,)).cache()
    written, keep = [], spectral.checkpoint
    monkeypatch.setattr(spectral, "checkpoint", lambda df: (written.append(df.columns), keep(df))[1])
    cost = []
    for rounds in (1, 3):
        written.clear()
        assert spectral.spectral_map(graph, 8, rounds=rounds, tolerance=0.0).count() == 90
        cost.append(len(written))
    assert cost[1] - cost[0] == 2  # each round writes its vectors once
    ids, values, u = dense(graph, 8)
    for rows in (7, 4096):
        got = spectral.spectral_map(graph, 8, tolerance=1e-7, block_rows=rows).toPandas().sort_values("uid")
        assert got["uid"].tolist() == ids
        for col, value, j in (("x", "value_x", 1), ("y", "value_y", 2)):
            v = u[:, j] * np.sign(u[np.argmax(np.round(abs(u[:, j]), 9)), j])
            assert abs(got[col].to_numpy() - v).max() < 1e-5 and abs(got[value].iloc[0] - values[j]) < 1e-9


def test_steps_leave_nothing_and_shuffle_nothing(spark, tmp_path, monkeypatch):
    """A step writes its vectors only; earlier steps' files go, and at the end the folder."""
    import os
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 3)))], "uid long, vec array<double>")
    graph = vectors.knn_graph(df, ks=(8,)).cache()
    want = spectral.spectral_map(graph, 8, tolerance=1e-7).toPandas().sort_values("uid")
    folder = tmp_path / "map"
    monkeypatch.setattr(spectral, "shared_path", lambda spark, name: str(folder))
    monkeypatch.setattr(spectral, "EDGES_AT_ONCE", 5)
    most, plans, each = [], [], spectral._each
    monkeypatch.setattr(spectral, "_each", lambda *a: (most.append(sum(f.stat().st_size for f in folder.iterdir() if f.name[0] in "xv")), plans.append(each(*a)), plans[-1])[2])
    got = spectral.spectral_map(graph, 8, tolerance=1e-7, block_rows=20).toPandas().sort_values("uid")
    assert len(most) > 20 and max(most) <= 2 * 90 * spectral.BLOCK * 8
    assert not any("Exchange" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert not os.path.exists(folder)
    assert got["uid"].tolist() == want["uid"].tolist() and abs(got[["x", "y"]].to_numpy() - want[["x", "y"]].to_numpy()).max() < 1e-5


def test_rows_carried_by_few_and_by_many_edges():
    rng = np.random.default_rng(7)
    size = np.array([1, 40, 2, 16, 17, 1, 100], np.int32)
    begin = np.cumsum(size) - size
    leave, y = rng.integers(0, 30, size.sum()).astype(np.int32), rng.normal(size=(30, spectral.BLOCK))
    want = np.array([y[leave[b:b + n]].sum(axis=0) for b, n in zip(begin, size)])
    assert abs(spectral._carried(y, leave, begin, size) - want).max() < 1e-12
