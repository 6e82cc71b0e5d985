"""Classifier evaluation: confusion counts, accuracy, macro P/R/F1, class
report, cross-entropy, prediction table, leaderboard, best checkpoint and
early stopping (M1-M11), plus the pair classifier (M12).

Every metric takes ``by`` columns (e.g. ``["model", "split"]``) so all models
and splits are scored in one job instead of a loop. Metric groups are reduced
with partial aggregation, so a model/split holding most rows is not a hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from .vectors import matched_join

N_CLASSES = 3


def with_pred(df: DataFrame, probs_col: str = "probs", out_col: str = "pred") -> DataFrame:
    """Arg-max class (first index wins ties)."""
    return df.withColumn(out_col, V.argmax(F.col(probs_col)))


def confusion(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """M1: ``by..., label, pred, n``."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """M2."""
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def class_stats(conf: DataFrame, by: list[str]) -> DataFrame:
    """Per class present in labels or predictions: ``tp, pp, support`` and
    precision / recall / F1 (0 where undefined)."""
    as_label = conf.select(*by, F.col("label").alias("cls"), F.col("n").alias("support"),
                           F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                           F.lit(0).cast("long").alias("pp"))
    as_pred = conf.select(*by, F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"),
                          F.lit(0).cast("long").alias("tp"), F.col("n").alias("pp"))
    s = as_label.unionByName(as_pred).groupBy(*by, "cls").agg(
        F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("support").alias("support"))
    tp, pp, sup = F.col("tp").cast("double"), F.col("pp").cast("double"), F.col("support").cast("double")
    return s.select(*by, "cls", "tp", "pp", "support",
                    F.when(pp > 0, tp / pp).otherwise(0.0).alias("precision"),
                    F.when(sup > 0, tp / sup).otherwise(0.0).alias("recall"),
                    F.when(pp + sup > 0, 2.0 * tp / (pp + sup)).otherwise(0.0).alias("f1"))


def macro_prf(df: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """M3: unweighted means over classes (a class never predicted scores 0)."""
    return _macro(class_stats(confusion(df, by, label, pred), by), by).drop("accuracy")


def _macro(stats: DataFrame, by: list[str]) -> DataFrame:
    """Macro means and accuracy from per-class counts."""
    return stats.groupBy(*by).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1"),
                                  F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def nli_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """M5/M7: ``by..., accuracy, f1, precision, recall``, unrounded; one pass over the rows."""
    return _macro(class_stats(confusion(df, by), by), by).select(*by, "accuracy", "f1", "precision", "recall")


def evaluate_splits(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M7: the metric row for every held-out split (and model) in one job."""
    return nli_metrics(df, by or ["split"])


def class_report(df: DataFrame, by: list[str]) -> DataFrame:
    """M4: a row per class name plus 'accuracy', 'macro avg', 'weighted avg',
    unrounded. The rows are read once: one aggregate keeps a group's few classes
    as a list, which every line of the report comes from."""
    cs = class_stats(confusion(df, by), by)
    one = F.struct("cls", "tp", "support", "precision", "recall", "f1")
    g = cs.groupBy(*by).agg(F.collect_list(one).alias("c"))  # a group holds one entry per class
    total = F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + x["support"])

    def mean(field: str, weight: bool):
        value = lambda x: x[field] * (x["support"] if weight else F.lit(1.0))
        return F.aggregate("c", F.lit(0.0), lambda acc, x: acc + value(x)) / (total if weight else F.size("c"))

    def line(row, precision, recall, f1, support):
        return F.struct(row.alias("row"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
                        support.cast("long").alias("support"))

    none = F.lit(None).cast("double")
    hits = F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + x["tp"])
    lines = F.concat(
        F.transform("c", lambda x: line(V.label_name(x["cls"]), x["precision"], x["recall"], x["f1"], x["support"])),
        F.array(line(F.lit("macro avg"), mean("precision", False), mean("recall", False), mean("f1", False), total),
                line(F.lit("weighted avg"), mean("precision", True), mean("recall", True), mean("f1", True), total),
                line(F.lit("accuracy"), none, none, hits / total, total)))
    return g.select(*by, F.explode(lines).alias("l")).select(*by, "l.*")


SMALLEST = 2.2250738585072014e-308  # smallest positive normal double


def row_loss(logits: Column, label: Column) -> Column:
    """Cross-entropy of one row from its logits: ``logsumexp - logit[label]``, always finite."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.log(total) - F.element_at(logits, label.cast("int") + 1)


def cross_entropy(df: DataFrame, by: list[str], probs_col: str = "probs", label: str = "label",
                  logits_col: str | None = None) -> DataFrame:
    """M6: mean of -ln p(true class) over all rows, unrounded: ``by..., loss, clipped``.

    With ``logits_col`` the loss comes from the logits and is exact. From
    probabilities alone a true-class probability of 0 counts as the smallest
    positive double, and ``clipped`` says for how many rows."""
    if logits_col:
        loss, zero = row_loss(F.col(logits_col), F.col(label)), F.lit(False)
    else:
        p = F.element_at(F.col(probs_col), F.col(label).cast("int") + 1)
        loss, zero = -F.log(F.greatest(p, F.lit(SMALLEST))), p < SMALLEST
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"), F.count(F.when(zero, 1)).alias("clipped"))


def prediction_table(preds: DataFrame, examples: DataFrame, key: str = "pair_id", cls: int = 2,
                     missing: str = "error") -> DataFrame:
    """Predictions with their examples by key; ``pred`` = score of class
    ``cls`` (contradiction); sorted by it descending (ties by key).

    A prediction without an example raises (``missing="error"``), stays with null
    example columns and ``matched`` false (``"keep"``), or goes (``"drop"``)."""
    j = matched_join(preds, examples, key, missing)
    return j.withColumn("pred", V.class_score(F.col("probs"), cls)).orderBy(F.desc("pred"), F.col(key))


def leaderboard(metrics: DataFrame, metric: str = "f1", group: str = "split", model: str = "model") -> DataFrame:
    """M9: rank of each model per split (1 = best; ties share a rank).
    The window runs over the metric table (models x splits rows)."""
    w = Window.partitionBy(group).orderBy(F.desc(metric))
    return metrics.withColumn("rank", F.rank().over(w).cast("int"))


def best_checkpoint(log: DataFrame, run: str = "run_id", step: str = "step", loss: str = "eval_loss") -> DataFrame:
    """Per run the step with the lowest loss (earliest on ties)."""
    best = F.min(F.struct(F.col(loss).alias("l"), F.col(step).alias("s")))
    return log.groupBy(run).agg(best.alias("_b")).select(
        run, F.col("_b.s").alias("best_step"), F.col("_b.l").alias("best_loss"))


def early_stop(log: DataFrame, patience: int = 3, run: str = "run_id", step: str = "step",
               loss: str = "eval_loss", chunk_steps: int = 1 << 16) -> DataFrame:
    """First evaluation after ``patience`` evaluations in a row without a
    strictly lower loss than every earlier one.

    Evaluation i (1-based, in step order) stops the run iff i > patience and
    ``min(loss[i-patience+1 .. i]) >= min(loss[1 .. i-patience])``.

    Plan (no window over a whole run, so one huge run is not one task):
    1. rows are cut into chunks of ``chunk_steps`` step values; in-chunk order
       and running minimum are windows over one (run, chunk);
    2. a window over the per-chunk table (one row per chunk) gives each chunk's
       row offset and the minimum of all earlier chunks;
    3. each row sends its loss and prefix minimum to itself and the next
       ``patience`` rows, keyed by (run, row index), and a grouped min decides.
    Output ``run, stop_step, n_evals, stopped`` (never stopped: last step, all
    evaluations, false).
    """
    p = patience
    c = log.select(F.col(run).alias("r"), F.col(step).alias("s"), F.col(loss).alias("l"),
                   F.floor(F.col(step) / chunk_steps).alias("ch"))
    wc = Window.partitionBy("r", "ch").orderBy("s")
    c = (c.withColumn("k", F.row_number().over(wc))
         .withColumn("cmin_run", F.min("l").over(wc.rowsBetween(Window.unboundedPreceding, 0))))
    chunks = c.groupBy("r", "ch").agg(F.count(F.lit(1)).alias("cnt"), F.min("l").alias("cmin"))
    wk = Window.partitionBy("r").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("r", "ch", F.coalesce(F.sum("cnt").over(wk), F.lit(0)).alias("off"),
                           F.min("cmin").over(wk).alias("before"))
    rows = c.join(chunks.hint("shuffle_hash"), ["r", "ch"]).select(
        "r", "s", "l", (F.col("off") + F.col("k")).alias("i"),
        F.least(F.coalesce(F.col("before"), F.col("cmin_run")), F.col("cmin_run")).alias("pmin"))
    sent = rows.select("r", "s", "l", "pmin", F.explode(F.sequence(F.lit(0), F.lit(p))).alias("t"),
                       "i").withColumn("j", F.col("i") + F.col("t"))
    per_j = sent.groupBy("r", "j").agg(
        F.max(F.when(F.col("t") == 0, F.col("s"))).alias("s_j"),
        F.min(F.when(F.col("t") < p, F.col("l"))).alias("win_min"),
        F.count(F.when(F.col("t") < p, 1)).alias("win_n"),
        F.max(F.when(F.col("t") == p, F.col("pmin"))).alias("pmin_before"))
    stop = (F.col("s_j").isNotNull() & (F.col("win_n") == p) & F.col("pmin_before").isNotNull()
            & (F.col("win_min") >= F.col("pmin_before")))
    first = F.min(F.when(stop, F.struct(F.col("j").alias("j"), F.col("s_j").alias("s"))))
    agg = per_j.groupBy("r").agg(first.alias("_f"), F.max("s_j").alias("_last"), F.max(
        F.when(F.col("s_j").isNotNull(), F.col("j"))).alias("_n"))
    stopped = F.col("_f").isNotNull()
    return agg.select(F.col("r").alias(run),
                      F.when(stopped, F.col("_f.s")).otherwise(F.col("_last")).alias("stop_step"),
                      F.when(stopped, F.col("_f.j")).otherwise(F.col("_n")).cast("long").alias("n_evals"),
                      stopped.alias("stopped"))


def pair_features(df: DataFrame, u: str, v: str, out: str = "features") -> DataFrame:
    """(u, v, |u - v|, u * v) as one ML vector column."""
    from pyspark.ml.functions import array_to_vector
    feats = F.concat(F.col(u), F.col(v), F.zip_with(u, v, lambda a, b: F.abs(a - b)),
                     F.zip_with(u, v, lambda a, b: a * b))
    return df.withColumn(out, array_to_vector(feats))


TRAIN_PARTITION_BYTES = 128 << 20


def _training_partitions(df: DataFrame, features: str) -> int:
    """Partitions for an iterative fit: by bytes of features alone."""
    import math

    from pyspark.ml.functions import vector_to_array
    st = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_to_array(F.col(features)))).alias("d")).first()
    return max(2, math.ceil((st["n"] or 0) * (st["d"] or 1) * 8 / TRAIN_PARTITION_BYTES))


def fit_pair_classifier(train: DataFrame, valid: DataFrame, reg_params=(0.0, 0.01, 0.1),
                        features: str = "features", label: str = "label", max_iter: int = 50):
    """Multinomial logistic regression; ``regParam`` chosen by validation
    cross-entropy from the logits (the role of 'load best model at end' on eval loss).

    The candidates are independent, so they are fitted concurrently (one
    driver thread each; Spark schedules their jobs side by side)."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    train = train.repartition(_training_partitions(train, features)).cache()
    valid = valid.cache()

    def fit_one(rp):
        m = LogisticRegression(family="multinomial", regParam=rp, maxIter=max_iter,
                               featuresCol=features, labelCol=label).fit(train)
        scored = m.transform(valid).withColumn("_logits", vector_to_array("rawPrediction"))
        return scored.agg(F.avg(row_loss(F.col("_logits"), F.col(label)))).first()[0], rp, m

    try:
        with ThreadPoolExecutor(max_workers=len(reg_params)) as pool:
            results = list(pool.map(fit_one, reg_params))
    finally:
        train.unpersist()
        valid.unpersist()
    return min(results, key=lambda r: (float("inf") if r[0] is None else r[0], r[1]))[2]


def predict_pairs(model, df: DataFrame, features: str = "features") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df).withColumn("probs", vector_to_array("probability"))
    return out.drop("rawPrediction", "probability", "prediction")
