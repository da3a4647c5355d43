"""Inner products in blocks against folds over arrays, on odd vectors."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.operators import moderation, ranking


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    vectors = [(i, unit([rng.gauss(0, 1) for _ in range(6)])) for i in range(1500)]
    vectors += [(2000 + i, [0.1 * i] * 4) for i in range(9)] + [(3000, [0.0] * 6), (3001, None), (3002, []), (3003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3004, [float("nan")] * 6), (3100, [0.5, None, 0.0, 0.0]), (3200, []), (3300, [1.0] + [0.0] * 5), (7, vectors[8][1]), (None, vectors[8][1])]
    return spark.createDataFrame(vectors, "id long, embedding array<float>").repartition(3)


def fold(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pairs(rows, few):
    a, b = rows.select("id", F.col("embedding").alias("v")), few.select(F.col("id").alias("other"), F.col("embedding").alias("o"))
    return a.join(b, (F.size("v") == F.size("o")) & (F.col("id") != F.col("other"))).withColumn("dot", fold("v", "o"))


def same(got, want):
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r)) for r in want.collect()) and want.count()


def test_scores_are_those_of_folds(rows):
    few = rows.where("id % 100 = 0 or id = 7")
    want = pairs(rows, few).select(F.col("other").alias("query_id"), F.col("id").alias("page_id"), ranking.stretched(F.col("dot")).alias("score"))
    named = few.select(F.col("id").alias("query_id"), "embedding"), rows.select(F.col("id").alias("page_id"), "embedding")
    same(ranking.semantic_scores(*named), want)
    same(ranking.semantic_scores(*named, block=4), want)
    # Ids that repeat leave ranks open, so the best are taken without them.
    once = rows.where("id is not null and id <> 7")
    named = few.where("id <> 7").select(F.col("id").alias("query_id"), "embedding"), once.select(F.col("id").alias("page_id"), "embedding")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id")
    ranked = want.where("query_id <> 7 and page_id <> 7").withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    same(ranking.semantic_top(*named), ranked)


def test_matches_are_those_of_folds(rows):
    few = rows.where("id % 100 = 0 or id = 7")
    norm = lambda c: F.sqrt(fold(c, c))
    cosine = F.round(F.try_divide(F.col("dot"), norm("v") * norm("o")), 6)
    want = pairs(rows, few).select("id", F.col("other").alias("pattern_id"), cosine.alias("cosine")).where("cosine >= 0.3")
    same(moderation.semantic_matches(rows, few, 0.3), want)


def test_no_array_functions_pair_by_pair(rows):
    """Folds over the arrays of every pair took most of the time; no plan has them."""
    few = rows.where("id % 100 = 0")
    for df in (moderation.semantic_matches(rows, few, 0.3), ranking.semantic_scores(few.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "page_id"))):
        assert "zip_with" not in df._jdf.queryExecution().toString()
