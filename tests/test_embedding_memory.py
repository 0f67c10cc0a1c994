"""What the embedding seam and its stand-in hand to Python."""

from pyspark.sql import functions as F

from lexiloom.operators import embedding


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_the_stand_in_gets_numbers_not_words(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id long, text string").select("id", embedding.hashed_vector(F.col("text"), 16).alias("v"))
    assert "crc32" in _plan(df)
    assert {r["id"]: r["v"] is not None for r in df.collect()} == {1: True, 2: False, 3: False}


def test_the_model_gets_at_most_a_batch_of_texts(spark):
    rows = spark.createDataFrame([(i, None if i == 7 else "x" * i) for i in range(30)], "id long, text string").coalesce(1)

    def model(texts):
        assert isinstance(texts, list) and len(texts) <= 4
        return [[float(len(t))] for t in texts]

    df = embedding.embed(rows, model, 4)
    assert "MapInArrow" in _plan(df)
    assert {r["id"]: r["vector"] for r in df.collect()} == {i: [0.0 if i == 7 else float(i)] for i in range(30)}
