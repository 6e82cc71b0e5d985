"""Evaluation metrics against hand computation; early stopping against a loop."""

import random

import pytest

from pyspark.sql import functions as F

from tessel.operators import evaluate as ev


def loop_stop(losses, patience):
    best, since = None, 0
    for i, l in enumerate(losses, 1):
        if best is None or l < best:
            best, since = l, 0
        else:
            since += 1
        if since >= patience:
            return i
    return None


def test_macro_with_class_never_predicted(spark):
    rows = [("m", 0, 0), ("m", 0, 1), ("m", 1, 1), ("m", 2, 1)]  # class 2 never predicted
    df = spark.createDataFrame(rows, "model string, label int, pred int")
    m = ev.nli_metrics(df, ["model"]).first()
    # per class: p = [1, 1/3, 0], r = [1/2, 1, 0], f1 = [2/3, 1/2, 0]
    assert m.precision == pytest.approx((1 + 1 / 3 + 0) / 3)
    assert m.recall == pytest.approx((0.5 + 1 + 0) / 3)
    assert m.f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert m.accuracy == 0.5


def test_early_stop_example(spark):
    log = spark.createDataFrame([(1, s, float(l)) for s, l in enumerate([3, 2, 2, 2, 2])],
                                "run_id long, step long, eval_loss double")
    r = ev.early_stop(log, 3).first()
    assert r.stopped and r.n_evals == 5 and r.stop_step == 4


def test_early_stop_matches_loop_with_small_chunks(spark):
    rnd = random.Random(5)
    rows, expect = [], {}
    for run in range(12):
        losses = [rnd.choice([1.0, 2.0, 3.0, 4.0]) for _ in range(rnd.randint(1, 40))]
        steps = sorted(rnd.sample(range(1000), len(losses)))
        rows += [(run, s, l) for s, l in zip(steps, losses)]
        i = loop_stop(losses, 3)
        expect[run] = (steps[i - 1] if i else steps[-1], i or len(losses), i is not None)
    log = spark.createDataFrame(rows, "run_id long, step long, eval_loss double").repartition(3)
    for chunk in (7, 50, 1 << 16):
        got = {r.run_id: (r.stop_step, r.n_evals, r.stopped) for r in ev.early_stop(log, 3, chunk_steps=chunk).collect()}
        assert got == expect


def test_best_checkpoint_earliest_tie(spark):
    log = spark.createDataFrame([(1, 5, 0.5), (1, 3, 0.5), (1, 9, 0.7)], "run_id long, step long, eval_loss double")
    r = ev.best_checkpoint(log).first()
    assert (r.best_step, r.best_loss) == (3, 0.5)


def test_prediction_table_checks_count(spark):
    preds = spark.createDataFrame([(1, [0.1, 0.2, 0.7], 2), (2, [0.5, 0.3, 0.2], 0)], "pair_id long, probs array<double>, label int")
    ex = spark.createDataFrame([(1, "p1", "h1"), (2, "p2", "h2")], "pair_id long, premise string, hypothesis string")
    t = ev.prediction_table(preds, ex).collect()
    assert [r.pair_id for r in t] == [1, 2] and t[0].pred == 0.7
    with pytest.raises(ValueError):
        ev.prediction_table(preds, ex.limit(1))
    kept = ev.prediction_table(preds, ex.filter("pair_id = 1"), missing="keep").collect()
    assert [(r.pair_id, r.matched, r.premise) for r in kept] == [(1, True, "p1"), (2, False, None)]


def test_loss_counts_rows_of_probability_zero(spark):
    import math
    df = spark.createDataFrame([("m", 0, [0.5, 0.5], [0.0, 0.0]), ("m", 1, [1.0, 0.0], [800.0, 0.0])],
                               "model string, label int, probs array<double>, logits array<double>")
    r = ev.cross_entropy(df, ["model"]).first()
    assert r.clipped == 1 and math.isclose(r.loss, (math.log(2) - math.log(ev.SMALLEST)) / 2)
    assert math.isclose(ev.cross_entropy(df, ["model"], logits_col="logits").first().loss, (math.log(2) + 800) / 2)


def test_pair_classifier_learns_separable_classes(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        lab = i % 3
        u = rng.normal(size=4) + 3 * np.eye(4)[lab]
        v = rng.normal(size=4)
        rows.append(("train" if i < 200 else "validation", i, lab, u.tolist(), v.tolist()))
    df = spark.createDataFrame(rows, "split string, pair_id long, label int, u array<double>, v array<double>")
    feats = ev.pair_features(df, "u", "v")
    model = ev.fit_pair_classifier(feats.filter(F.col("split") == "train"), feats.filter(F.col("split") == "validation"))
    out = ev.with_pred(ev.predict_pairs(model, feats.filter(F.col("split") == "validation")))
    acc = out.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.85
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in out.select("probs").collect())
