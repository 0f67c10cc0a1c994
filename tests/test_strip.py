"""The ends of texts, against the regular expression that says what white space is."""

from pyspark.sql import functions as F

from lexiloom.functions import SPACES, strip


def test_strip_removes_what_the_regular_expression_does(spark):
    chars = [chr(i) for i in range(0x3002)] + ["﻿"]
    texts = [(c + "a" + c + "b" + c,) for c in chars] + [("",), (None,), (SPACES,), (SPACES + "x y" + SPACES,)]
    rows = spark.createDataFrame(texts, "t string").select("t", strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+\z", "").alias("r"))
    assert rows.where("not s <=> r").count() == 0
