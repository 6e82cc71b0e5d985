"""Evaluation queries (P17-P20, M1-M12, J4, O1) on the ``predictions``,
``pairs`` and ``eval_log`` fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import evaluate as ev
from ..session import load
from . import fixtures as fx
from .registry import register, with_ctes

BY = ["model", "split"]

_PRED = with_ctes(fx.PREDICTIONS_CTE, """scored as (
  select *, cast(list_position(probs, list_max(probs)) - 1 as integer) as pred from predictions)""",
                  """conf as (select model, split, label, pred, count(*) as n from scored group by all)""",
                  """cls_rows as (
  select model, split, label as cls, n as support, case when label = pred then n else 0 end as tp, 0 as pp from conf
  union all select model, split, pred as cls, 0 as support, 0 as tp, n as pp from conf)""",
                  """cs as (select model, split, cls, sum(tp) as tp, sum(pp) as pp, sum(support) as support,
  case when sum(pp) > 0 then sum(tp) / sum(pp) else 0.0 end as precision,
  case when sum(support) > 0 then sum(tp) / sum(support) else 0.0 end as recall,
  case when sum(pp) + sum(support) > 0 then 2.0 * sum(tp) / (sum(pp) + sum(support)) else 0.0 end as f1
  from cls_rows group by model, split, cls)""",
                  """macro as (select model, split, avg(precision) as precision, avg(recall) as recall, avg(f1) as f1
  from cs group by model, split)""",
                  """acc as (select model, split, avg(case when label = pred then 1.0 else 0.0 end) as accuracy
  from scored group by model, split)""",
                  """metrics as (select m.model, m.split, round(a.accuracy, 6) as accuracy, round(m.f1, 6) as f1,
  round(m.precision, 6) as precision, round(m.recall, 6) as recall from macro m join acc a using (model, split))""")


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _scored(spark, sf_dir):
    return ev.with_pred(fx.predictions(spark, sf_dir))


@register("prediction_labels", _PRED + """
select model, split, pair_id, pred,
  ['entailment', 'neutral', 'contradiction'][pred + 1] as pred_name,
  round(probs[3], 6) as score2, round(list_sum(probs), 6) as total from scored""")
def prediction_labels(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("model", "split", "pair_id", "pred", V.label_name(F.col("pred")).alias("pred_name"),
                    F.round(V.class_score(F.col("probs"), 2), 6).alias("score2"),
                    F.round(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register("confusion", _PRED + "select model, split, label, pred, n from conf")
def confusion(spark, sf_dir):
    return ev.confusion(_scored(spark, sf_dir), BY)


@register("nli_metrics", _PRED + "select * from metrics")
def nli_metrics(spark, sf_dir):
    return _rounded(ev.nli_metrics(_scored(spark, sf_dir), BY), "accuracy", "f1", "precision", "recall")


@register("class_report", _PRED + """
select model, split, ['entailment', 'neutral', 'contradiction'][cls + 1] as "row", round(precision, 6) as precision,
  round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from cs
union all select model, split, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  cast(sum(support) as bigint) from cs group by model, split
union all select model, split, 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  cast(sum(support) as bigint) from cs group by model, split
union all select model, split, 'accuracy', null, null, round(sum(tp) / sum(support), 6), cast(sum(support) as bigint)
  from cs group by model, split""")
def class_report(spark, sf_dir):
    return _rounded(ev.class_report(_scored(spark, sf_dir), BY), "precision", "recall", "f1")


@register("cross_entropy", _PRED + """
select model, split, round(avg(-ln(probs[label + 1])), 6) as loss from scored group by model, split""")
def cross_entropy(spark, sf_dir):
    return _rounded(ev.cross_entropy(_scored(spark, sf_dir), BY).drop("clipped"), "loss")


_SATURATED = with_ctes(fx.PREDICTIONS_CTE, """big as (
  select model, split, label, list_transform(logits, lambda x: 4000 * x) as l from logit_rows)""",
                       """shifted as (select model, split, label, l, list_max(l) as top, l[label + 1] as own from big)""")


@register("cross_entropy_saturated", _SATURATED + """
select model, split, round(avg(top + ln(list_sum(list_transform(l, lambda x: exp(x - top)))) - own), 6) as loss,
  count(*) filter (where exp(own - top) / list_sum(list_transform(l, lambda x: exp(x - top))) < 2.2250738585072014e-308) as clipped
from shifted group by model, split""")
def cross_entropy_saturated(spark, sf_dir):
    """Logits times 4000: many rows have probability 0 for their true class and still count."""
    rows = fx.logits(spark, sf_dir).withColumn("logits", F.transform("logits", lambda x: F.lit(4000) * x))
    exact = ev.cross_entropy(rows, BY, logits_col="logits").drop("clipped")
    seen = ev.cross_entropy(rows.withColumn("probs", V.softmax("logits")), BY).drop("loss")
    return _rounded(exact, "loss").join(seen, BY)


@register("leaderboard", _PRED + """
select m.model, m.split, round(a.accuracy, 6) as accuracy, round(m.f1, 6) as f1, round(m.precision, 6) as precision,
  round(m.recall, 6) as recall, cast(rank() over (partition by m.split order by m.f1 desc) as integer) as rank
from macro m join acc a using (model, split)""")
def leaderboard(spark, sf_dir):
    return _rounded(ev.leaderboard(ev.nli_metrics(_scored(spark, sf_dir), BY)), "accuracy", "f1", "precision", "recall")


@register("prediction_table", _PRED + """
select s.model, s.split, s.pair_id, d.text as premise, d.source as hypothesis, round(s.probs[3], 6) as pred, s.label
from scored s left join documents d on d.doc_id = s.pair_id""")
def prediction_table(spark, sf_dir):
    examples = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("premise"), F.col("source").alias("hypothesis"))
    t = ev.prediction_table(_scored(spark, sf_dir), examples, missing="keep")
    return t.select("model", "split", "pair_id", "premise", "hypothesis", F.round("pred", 6).alias("pred"), "label")


@register("prediction_order", _PRED + """
select model, split, pair_id, cast(row_number() over (order by probs[3] desc, pair_id, model) as bigint) as pos from scored""")
def prediction_order(spark, sf_dir):
    """O1: the place of every prediction in the sorted table."""
    from ..operators.sampling import number_rows
    s = _scored(spark, sf_dir).select("model", "split", "pair_id", (-V.class_score(F.col("probs"), 2)).alias("o"))
    return number_rows(s, ["o", "pair_id", "model"]).select("model", "split", "pair_id", (F.col("idx") + 1).alias("pos"))


@register("best_checkpoint", with_ctes(fx.EVAL_LOG_CTE) + """
select run_id, arg_min(step, (eval_loss, step)) as best_step, min(eval_loss) as best_loss from eval_log group by run_id""")
def best_checkpoint(spark, sf_dir):
    return ev.best_checkpoint(fx.eval_log(spark, sf_dir))


@register("early_stop", with_ctes(
    fx.EVAL_LOG_CTE,
    """o as (select run_id, step, eval_loss, row_number() over (partition by run_id order by step) as i,
  min(eval_loss) over (partition by run_id order by step rows between unbounded preceding and 1 preceding) as prev_best
  from eval_log)""",
    """g as (select *, i - max(case when prev_best is null or eval_loss < prev_best then i end)
  over (partition by run_id order by step rows between unbounded preceding and current row) as gap from o)""",
    """st as (select run_id, min(i) filter (where gap >= 3) as stop_i, max(i) as n, max(step) as last_step
  from g group by run_id)""") + """
select st.run_id, coalesce(g.step, st.last_step) as stop_step, cast(coalesce(st.stop_i, st.n) as bigint) as n_evals,
  st.stop_i is not null as stopped
from st left join g on g.run_id = st.run_id and g.i = st.stop_i""")
def early_stop(spark, sf_dir):
    return ev.early_stop(fx.eval_log(spark, sf_dir), patience=3, chunk_steps=500)


@register("early_stop_falling", with_ctes(
    fx.EVAL_LOG_CTE.replace("value as eval_loss", "case when user_id % 2 = 0 then -cast(event_id as double) else value end as eval_loss"),
    """o as (select run_id, step, eval_loss, row_number() over (partition by run_id order by step) as i,
  min(eval_loss) over (partition by run_id order by step rows between unbounded preceding and 1 preceding) as prev_best
  from eval_log)""",
    """g as (select *, i - max(case when prev_best is null or eval_loss < prev_best then i end)
  over (partition by run_id order by step rows between unbounded preceding and current row) as gap from o)""",
    """st as (select run_id, min(i) filter (where gap >= 3) as stop_i, max(i) as n, max(step) as last_step
  from g group by run_id)""") + """
select st.run_id, coalesce(g.step, st.last_step) as stop_step, cast(coalesce(st.stop_i, st.n) as bigint) as n_evals,
  st.stop_i is not null as stopped
from st left join g on g.run_id = st.run_id and g.i = st.stop_i""")
def early_stop_falling(spark, sf_dir):
    """Half of the runs get better at every step and so never stop."""
    log = fx.eval_log(spark, sf_dir)
    loss = F.when(F.col("run_id") % 2 == 0, -F.col("step").cast("double")).otherwise(F.col("eval_loss"))
    return ev.early_stop(log.withColumn("eval_loss", loss), patience=3, chunk_steps=500)


def _pair_features(spark, sf_dir):
    """Both sides hashed in the row, then (u, v, |u - v|, u * v)."""
    from ..functions.text import word_tokens
    from ..operators import encode as enc
    p = fx.pairs(spark, sf_dir)
    hashed = p.select("split", "pair_id", "label", enc.hash_vector(word_tokens(F.col("premise")), 64).alias("u"),
                      enc.hash_vector(word_tokens(F.col("hypothesis")), 64).alias("v"))
    return ev.pair_features(hashed, "u", "v").select("split", "pair_id", "label", "features")


_SIDE = """{s}t as (select pair_id, unnest(regexp_extract_all(lower({c}), '([\\p{{L}}\\p{{N}}]+)', 1)) as t from pairs),
{s}b as (select pair_id, cast('0x' || substr(md5(t), 1, 8) as bigint) % 64 as b,
  sum(case when cast('0x' || substr(md5(t), 9, 1) as bigint) % 2 = 0 then 1.0 else -1.0 end) as x from {s}t group by pair_id, b),
{s}g as (select p.pair_id, r.i, coalesce(q.x, 0.0) as x from pairs p cross join range(64) r(i) left join {s}b q on q.pair_id = p.pair_id and q.b = r.i),
{s} as (select pair_id, list(x order by i) as raw, sqrt(sum(x * x)) as n from {s}g group by pair_id),
{s}v as (select pair_id, list_transform(raw, lambda x: case when n = 0 then x else x / n end) as vec from {s})"""


@register("pair_features", with_ctes(fx.PAIRS_CTE, _SIDE.format(s="u", c="premise"), _SIDE.format(s="h", c="hypothesis")) + """
select p.split, p.pair_id, p.label, list_transform(range(1, 257), lambda i: round(case
    when i <= 64 then uv.vec[i] when i <= 128 then hv.vec[i - 64]
    when i <= 192 then abs(uv.vec[i - 128] - hv.vec[i - 128]) else uv.vec[i - 192] * hv.vec[i - 192] end, 6) + 0.0) as features
from pairs p join uv using (pair_id) join hv using (pair_id)""")
def pair_features(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    f = _pair_features(spark, sf_dir)
    return f.withColumn("features", V.round_vec(vector_to_array("features"), 6))


@register("pair_classifier")
def pair_classifier(spark, sf_dir):
    from ..session import checkpoint
    feats = checkpoint(_pair_features(spark, sf_dir))
    model = ev.fit_pair_classifier(feats.filter(F.col("split") == "train"), feats.filter(F.col("split") == "validation"))
    held = ev.predict_pairs(model, feats.filter(F.col("split").isin("test_lay", "test_expert")))
    return ev.with_pred(held).select("split", "pair_id", "label", "pred", "probs")


@register("pair_classifier_complete", with_ctes(fx.PAIRS_CTE) + """
select split, pair_id, label, 1.0::double as total from pairs where split in ('test_lay', 'test_expert')""")
def pair_classifier_complete(spark, sf_dir):
    """Every held-out pair gets one distribution over the classes."""
    out = pair_classifier(spark, sf_dir)
    return out.select("split", "pair_id", "label", F.round(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register("cap_rows", with_ctes(fx.PAIRS_CTE) + """
select split, pair_id, label from pairs where split = 'train' order by pair_id limit 100""")
def cap_rows(spark, sf_dir):
    from ..operators.sampling import cap_rows as cap
    train = fx.pairs(spark, sf_dir).filter(F.col("split") == "train").select("split", "pair_id", "label")
    return cap(train, 100, ["pair_id"])


@register("cap_rows_large", "select user_id, event_id, value from events order by value, user_id, event_id limit cast((select count(*) from events) * 0.6 as bigint)")
def cap_rows_large(spark, sf_dir):
    """A cap at 60 % of the rows, the cut found by histograms."""
    from ..operators.sampling import cap_rows as cap
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return cap(events, round(events.count() * 0.6), ["value", "user_id", "event_id"], top_n=0)


@register("pair_training")
def pair_training(spark, sf_dir):
    """M12 with a log: mini-batches of a 20th of the training pairs, validation loss every 4 steps; each held-out pair with its
    distribution, beside the log's best and last step."""
    from pyspark.ml.functions import vector_to_array
    from ..operators import fitting
    from ..session import checkpoint
    feats = checkpoint(_pair_features(spark, sf_dir).withColumn("features", vector_to_array("features")))
    train = feats.filter(F.col("split") == "train")
    fitted = fitting.fit_with_log(train, feats.filter(F.col("split") == "validation"), batch_size=max(64, train.count() // 20), epochs=3, eval_steps=4)
    held = ev.with_pred(fitted.predict(feats.filter(F.col("split").isin("test_lay", "test_expert"))))
    return held.select("split", "pair_id", "label", "pred", "probs", F.lit(fitted.best_step).alias("best_step"),
                       F.lit(fitted.stop_step).alias("stop_step"), F.lit(fitted.stopped).alias("stopped"))
