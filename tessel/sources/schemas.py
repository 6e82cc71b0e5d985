"""Declared schemas of the files the operators read and write."""

from pyspark.sql import types as T

POSTS = T.StructType([T.StructField(c, T.StringType()) for c in
                      ["id", "headline", "related_text", "original_img_dir", "original_img_filename"]])
CLEAN = T.StructType([T.StructField(c, T.StringType()) for c in ["uid", "text", "img_dir", "img_fname"]])
MAP_CSV = T.StructType([T.StructField("uid", T.StringType()), T.StructField("text", T.StringType()),
                        T.StructField("vec", T.StringType())])
PAIRS = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("premise", T.StringType()),
                      T.StructField("hypothesis", T.StringType()), T.StructField("label", T.IntegerType())])
PAIRS_WITH_SPLIT = T.StructType(PAIRS.fields + [T.StructField("split", T.StringType())])
SPLITS = ["train", "validation", "test_lay", "test_expert"]
