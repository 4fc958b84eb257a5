"""Seeded splits of documents. The permutation is drawn on the driver over the sorted ids of the split table, as small as an id a document."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shuffled(docs: DataFrame, seed: int = 2727) -> DataFrame:
    """doc_id, ord, n: the place of each id (sorted as text) in a permutation by the Mersenne Twister."""
    ids = [r[0] for r in docs.select(F.col("doc_id").cast("string")).distinct().collect()]
    ids.sort()
    random.Random(seed).shuffle(ids)
    return docs.sparkSession.createDataFrame([(x, i, len(ids)) for i, x in enumerate(ids)], "doc_id string, ord long, n long")


def hashed(docs: DataFrame, order: Column, span: int = 1 << 32, ranges: int = 4096) -> DataFrame:
    """The same by an expression with whole numbers from 0 to ``span``, for tables whose ids the driver shouldn't hold: ranks inside ranges plus their starts."""
    keyed = docs.select("doc_id").distinct().withColumn("_h", order).withColumn("_r", F.floor(F.col("_h") * ranges / F.lit(span)))
    inner = keyed.withColumn("_k", F.row_number().over(W.partitionBy("_r").orderBy("_h", "doc_id")))
    sizes = keyed.groupBy("_r").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_r", F.coalesce(F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.sum("_n").over(W.partitionBy()).alias("n"))
    return inner.join(sizes, "_r").select("doc_id", (F.col("_s") + F.col("_k") - 1).alias("ord"), "n")


def kfold(order: DataFrame, k: int) -> DataFrame:
    """Adds chunk: sizes round(n / k), the last takes the rest."""
    size = F.bround(F.col("n") / F.lit(k))
    return order.withColumn("chunk", F.when(size == 0, F.lit(k - 1)).otherwise(F.least(F.floor(F.col("ord") / size), F.lit(k - 1))).cast("int"))


def fold_roles(chunks: DataFrame, k: int) -> DataFrame:
    """A row for each fold and document: of the chunks from f on, k - 2 train, one validates, one tests."""
    f = chunks.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    place = F.pmod(F.col("chunk") - F.col("fold"), F.lit(k))
    return f.withColumn("role", F.when(place < k - 2, "train").when(place == k - 2, "validation").otherwise("test"))


def percentage(order: DataFrame, share: float) -> DataFrame:
    return order.withColumn("role", F.when(F.col("ord") < F.floor(F.col("n") * share), "train").otherwise("test"))


def stratified(order: DataFrame, strata: DataFrame, share: float) -> DataFrame:
    """strata (doc_id, stratum): round(len * share) of each to train; strata of one alternate, test first."""
    j = order.join(strata, "doc_id")
    w = W.partitionBy("stratum")
    j = j.withColumns({"m": F.count("*").over(w), "k": F.row_number().over(w.orderBy("ord"))})
    lone = j.filter("m = 1").withColumn("i", F.row_number().over(W.orderBy("stratum"))).select("stratum", "i")
    train = F.when(F.col("m") == 1, F.col("i") % 2 == 0).otherwise(F.col("k") <= F.bround(F.col("m") * share))
    return j.join(lone, "stratum", "left").select("doc_id", "stratum", F.when(train, "train").otherwise("test").alias("role"))


def fold_split(order: DataFrame, folds: int, fold: int) -> DataFrame:
    """floor(n / folds) documents test, the fold's; all others train, the remainder of the division in every fold."""
    size = F.floor(F.col("n") / F.lit(folds))
    return order.withColumn("role", F.when((F.col("ord") >= size * fold) & (F.col("ord") < size * (fold + 1)), "test").otherwise("train"))
