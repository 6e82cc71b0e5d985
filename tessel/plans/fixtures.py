"""Fixture frames derived from the driver tables, each with its SQL twin.

The driver registers only raw tables, so every oracle query inlines the same
fixture as a CTE (``*_CTE`` strings below run in DuckDB and Spark SQL alike).
The Spark side builds the identical frame with the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, spread

# --- posts: raw post rows with missing values, URLs, tabs and file names ---

POSTS_CTE = """posts as (
  select concat('p', cast(doc_id as string)) as id, lang,
    case when doc_id % 5 = 0 then null when doc_id % 11 = 0 then 'NA'
         when doc_id % 17 = 0 then concat('2021 - 07 - 0', cast(doc_id as string), ' / 12 : 30') else text end as headline,
    case when doc_id % 7 = 0 or doc_id % 17 = 0 then null
         when doc_id % 3 = 0 then concat(text, ' https://ex.org/', cast(doc_id as string), chr(10), 'tail word')
         when doc_id % 3 = 1 then concat(text, chr(9), 'http://ex.org/a?b=', cast(doc_id as string), ' end ')
         else text end as related_text,
    case when doc_id % 13 = 0 then null else concat('original_images/', source, '/') end as original_img_dir,
    case when doc_id % 4 = 0 then concat('f', cast(doc_id as string), '.jpg')
         when doc_id % 4 = 1 then concat('f.', cast(doc_id as string), '.png')
         when doc_id % 4 = 2 then concat('f', cast(doc_id as string)) else null end as original_img_filename
  from documents)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    k = F.col("doc_id")
    sid = k.cast("string")
    null = F.lit(None).cast("string")
    headline = (F.when(k % 5 == 0, null).when(k % 11 == 0, F.lit("NA"))
                .when(k % 17 == 0, F.concat(F.lit("2021 - 07 - 0"), sid, F.lit(" / 12 : 30")))  # no letter: no language
                .otherwise(F.col("text")))
    related = (F.when((k % 7 == 0) | (k % 17 == 0), null)
               .when(k % 3 == 0, F.concat("text", F.lit(" https://ex.org/"), sid, F.lit("\n"), F.lit("tail word")))
               .when(k % 3 == 1, F.concat("text", F.lit("\t"), F.lit("http://ex.org/a?b="), sid, F.lit(" end ")))
               .otherwise(F.col("text")))
    img_dir = F.when(k % 13 == 0, null).otherwise(F.concat(F.lit("original_images/"), "source", F.lit("/")))
    fname = (F.when(k % 4 == 0, F.concat(F.lit("f"), sid, F.lit(".jpg")))
             .when(k % 4 == 1, F.concat(F.lit("f."), sid, F.lit(".png")))
             .when(k % 4 == 2, F.concat(F.lit("f"), sid)).otherwise(null))
    return d.select(F.concat(F.lit("p"), sid).alias("id"), "lang", headline.alias("headline"),
                    related.alias("related_text"), img_dir.alias("original_img_dir"),
                    fname.alias("original_img_filename"))


# --- vectors: uid + embedding as array<double> ---

VECTORS_CTE = """vectors as (
  select vec_id as uid, cast(embedding as double[]) as vec from embeddings)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("uid"), F.col("embedding").cast("array<double>").alias("vec"))


# --- map2d: the first two elements as a 2-D point ---

MAP2D_CTE = """map2d as (
  select vec_id as uid, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings)"""


def map2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("uid"),
                    F.col("embedding")[0].cast("double").alias("x"),
                    F.col("embedding")[1].cast("double").alias("y"))


# --- predictions: two models' class probabilities on two held-out splits ---
# logits = 4 x the first three elements; model m2 negates the first logit;
# label = label % 3; even ids are 'test_lay', odd ids 'test_expert'.

PREDICTIONS_CTE = """logit_rows as (
  select m.model, case when vec_id % 2 = 0 then 'test_lay' else 'test_expert' end as split,
    vec_id as pair_id, label % 3 as label,
    [case when m.model = 'm2' then -4.0 else 4.0 end * cast(embedding[1] as double),
     4.0 * cast(embedding[2] as double), 4.0 * cast(embedding[3] as double)] as logits
  from embeddings, (select 'm1' as model union all select 'm2' as model) m),
predictions as (
  select model, split, pair_id, label,
    list_transform(logits, lambda x: exp(x - list_max(logits)) / list_sum(list_transform(logits, lambda z: exp(z - list_max(logits))))) as probs
  from logit_rows)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    first3 = [F.col("embedding")[i].cast("double") for i in range(3)]
    frames = []
    for name, sign in (("m1", 4.0), ("m2", -4.0)):
        frames.append(e.select(
            F.lit(name).alias("model"),
            F.when(F.col("vec_id") % 2 == 0, F.lit("test_lay")).otherwise(F.lit("test_expert")).alias("split"),
            F.col("vec_id").alias("pair_id"), (F.col("label") % 3).alias("label"),
            F.array(F.lit(sign) * first3[0], F.lit(4.0) * first3[1], F.lit(4.0) * first3[2]).alias("logits")))
    return frames[0].unionByName(frames[1])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vector import softmax
    return logits(spark, sf_dir).withColumn("probs", softmax("logits")).drop("logits")


# --- pairs: consecutive turns of a conversation as premise / hypothesis ---
# pair_id = conv_id * 1000 + turn; label = (conv_id + turn) % 3; split by conv_id % 5.

PAIRS_CTE = """pairs as (
  select case a.conv_id % 5 when 0 then 'validation' when 1 then 'test_lay' when 2 then 'test_expert' else 'train' end as split,
    a.conv_id * 1000 + a.turn as pair_id, a.text as premise, b.text as hypothesis,
    cast((a.conv_id + a.turn) % 3 as integer) as label
  from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    a = c.alias("a")
    b = c.select(F.col("conv_id").alias("b_conv"), (F.col("turn") - 1).alias("b_turn"),
                 F.col("text").alias("hypothesis"))
    j = a.join(b, (F.col("a.conv_id") == F.col("b_conv")) & (F.col("a.turn") == F.col("b_turn")))
    m = F.col("conv_id") % 5
    split = (F.when(m == 0, F.lit("validation")).when(m == 1, F.lit("test_lay"))
             .when(m == 2, F.lit("test_expert")).otherwise(F.lit("train")))
    return j.select(split.alias("split"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
                    F.col("text").alias("premise"), "hypothesis",
                    ((F.col("conv_id") + F.col("turn")) % 3).cast("int").alias("label"))


# --- eval_log: validation loss per evaluation step of a training run ---

EVAL_LOG_CTE = """eval_log as (
  select user_id as run_id, event_id as step, value as eval_loss from events)"""


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"),
                     F.col("value").alias("eval_loss"))
