"""The mini-batch fit with a log against a plain numpy loop, and its log against SQL."""

import hashlib

import duckdb
import numpy as np
import pytest

from tessel.operators import evaluate, fitting

SCHEMA = "pair_id long, features array<double>, label int"


def data(n, seed, noise=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = np.argmax(x[:, :3] + noise * rng.normal(size=(n, 3)), axis=1)
    return [(int(i), [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, y))]


def loop(train, valid, batch_size, epochs, eval_steps, patience, rate, seed):
    order = sorted(train, key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0]))
    batches = [order[i:i + batch_size] for i in range(0, len(order), batch_size)]
    w, step, log, best = np.zeros((3, 5)), 0, [], (np.inf, None, 0)
    xv, yv = np.array([r[1] for r in valid]), np.array([r[2] for r in valid])
    for e in range(epochs):
        for b in fitting.batch_order(len(batches), seed, e):
            x = np.array([r[1] + [1.0] for r in batches[b]])
            p = np.exp(x @ w.T) / np.exp(x @ w.T).sum(axis=1, keepdims=True)
            p -= np.eye(3)[[r[2] for r in batches[b]]]
            step += 1
            w = w - rate / step ** 0.5 * p.T @ x / len(x)
            if step % eval_steps == 0 or step == epochs * len(batches):
                q = np.exp(np.c_[xv, np.ones(len(xv))] @ w.T)
                loss = -np.log(q[np.arange(len(yv)), yv] / q.sum(axis=1)).mean()
                log.append((step, loss))
                if loss < best[0]:
                    best = (loss, w, step)
                seen = [x for _, x in log]
                if len(seen) > patience and min(seen[-patience:]) >= min(seen[:-patience]):
                    return best, log, True
    return best, log, False


@pytest.mark.parametrize("rate,epochs,eval_steps", [(1.0, 3, 2), (30.0, 6, 1)])
def test_fit_equals_a_plain_loop(spark, rate, epochs, eval_steps):
    train, valid = data(50, 1), data(30, 2)
    frame = spark.createDataFrame(train, SCHEMA).repartition(3)
    got = fitting.fit_with_log(frame, spark.createDataFrame(valid, SCHEMA), batch_size=16, epochs=epochs, eval_steps=eval_steps, rate=rate)
    best, log, stopped = loop(train, valid, 16, epochs, eval_steps, 3, rate, 123)
    assert [s for s, _ in got.rows] == [s for s, _ in log] and np.allclose([x for _, x in got.rows], [x for _, x in log], atol=1e-9)
    assert got.best_step == best[2] and got.stopped is stopped and np.allclose(got.weights, best[1], atol=1e-9)
    # the log's best and stopping steps, by the operators and by SQL
    frame = got.log(spark)
    assert evaluate.best_checkpoint(frame).first()["best_step"] == got.best_step
    stop = evaluate.early_stop(frame, 3).first()
    assert (stop["stop_step"], stop["stopped"]) == (got.stop_step, got.stopped)
    log_table = frame.toPandas()  # noqa: F841 - read by DuckDB
    assert duckdb.sql("select step from log_table order by eval_loss, step limit 1").fetchall() == [(got.best_step,)]
    probs = np.array([r["probs"] for r in got.predict(spark.createDataFrame(valid, SCHEMA)).orderBy("pair_id").collect()])
    z = np.array([r[1] + [1.0] for r in valid]) @ got.weights.T
    assert np.allclose(probs, np.exp(z) / np.exp(z).sum(axis=1, keepdims=True))


def test_fit_without_rows_or_with_too_many_batches(spark, monkeypatch):
    one = spark.createDataFrame(data(9, 1), SCHEMA)
    with pytest.raises(ValueError):
        fitting.fit_with_log(one.limit(0), one)
    with pytest.raises(ValueError):
        fitting.fit_with_log(one, one.limit(0), eval_steps=1, epochs=1)
    monkeypatch.setattr(fitting, "MAX_BATCHES", 2)
    with pytest.raises(ValueError):
        fitting.fit_with_log(one, one, batch_size=3)


def test_rows_are_dealt_by_their_number_and_batches_are_packed(spark, monkeypatch):
    """Joined rows: the optimizer takes them for very many."""
    from tessel.operators import sampling
    train, valid = data(300, 1), data(30, 2)
    ids = spark.createDataFrame([(r[0],) for r in train], "pair_id long")
    frame = sampling.checkpoint(spark.createDataFrame(train, SCHEMA).join(ids, "pair_id"))
    laid, keep = [], sampling.checkpoint
    monkeypatch.setattr(sampling, "checkpoint", lambda df: (laid.append(keep(df)), laid[-1])[1])
    read, sums = [], fitting._sums
    monkeypatch.setattr(fitting, "_sums", lambda df, w, g: (read.append(df.count()), sums(df, w, g))[1])
    got = fitting.fit_with_log(frame, spark.createDataFrame(valid, SCHEMA), batch_size=75, epochs=1, eval_steps=1)
    assert laid[0].rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(read) == 8 and sum(read) < 300  # matrices, not rows
    best, log, stopped = loop(train, valid, 75, 1, 1, 3, 1.0, 123)
    assert np.allclose([x for _, x in got.rows], [x for _, x in log], atol=1e-9) and np.allclose(got.weights, best[1], atol=1e-9)
