"""Token features as columns, embedding features, vocabularies and information gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .annotate import sentence


def markers(tokens: DataFrame) -> DataFrame:
    return tokens.withColumns({"bos": F.lag("tok_id").over(sentence()).isNull(), "eos": F.lead("tok_id").over(sentence()).isNull()})


def binary(tokens: DataFrame, name: str, test: Column) -> DataFrame:
    return tokens.withColumn(name, F.when(test, F.lit(True)))


def window(tokens: DataFrame, columns: list[str], template: tuple[int, ...] = (-2, -1, 1, 2), include: list[str] | None = None) -> DataFrame:
    """name -> name[k] of the neighbour at k in the sentence, null where there is none; with ``include`` only for the columns listed in it."""
    columns = [c for c in columns if include is None or c in include]
    return tokens.withColumns({f"{c}[{k}]": F.lead(c, k).over(sentence()) if k > 0 else F.lag(c, -k).over(sentence()) for c in columns for k in template})


def conjunction(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.coalesce(a, F.lit("None")), F.coalesce(b, F.lit("None")))


def dictionary(words: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Lower-cased distinct words of more than one letter without stop words."""
    w = words.select(F.lower("word").alias("word")).filter(F.length("word") > 1)
    return (w.filter(~F.col("word").isin(stop)) if stop else w).distinct()


def in_dictionary(tokens: DataFrame, words: DataFrame, name: str) -> DataFrame:
    """Adds whether the lower-cased word is listed; the join is broadcast only if Spark measures the list as small."""
    w = words.select(F.col("word").alias("_w"), F.lit(True).alias(name))
    return tokens.join(w, F.lower("word") == F.col("_w"), "left").drop("_w").withColumn(name, F.coalesce(name, F.lit(False)))


def clusters(tokens: DataFrame, paths: DataFrame, lengths: tuple[int, ...] = ()) -> DataFrame:
    """paths (word, path): adds the word's path in a cluster tree and its prefixes."""
    j = tokens.join(paths.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left").drop("_w")
    return j.withColumns({f"path{n}": F.substring("path", 1, n) for n in lengths})


def scaled(vectors: DataFrame, add: float = 0.0, times: float = 1.0) -> DataFrame:
    return vectors.withColumn("embedding", F.transform("embedding", lambda x: (x.cast("double") + add) * times))


def plain(word: Column) -> Column:
    """A word as lists of embeddings have it: lower case, digits as 0."""
    return F.lower(F.regexp_replace(word, "[0-9]", "0"))


def word_embeddings(tokens: DataFrame, vectors: DataFrame, width: int, add: float = 0.0, times: float = 1.0) -> DataFrame:
    """vectors (word, embedding): adds embedding_i, scaled, of the words that are listed; null for others."""
    j = tokens.join(vectors.select(F.col("word").alias("_w"), "embedding"), plain(F.col("word")) == F.col("_w"), "left")
    return j.withColumns({f"embedding_{i}": (F.get("embedding", F.lit(i)).cast("double") + add) * times for i in range(width)}).drop("_w", "embedding")


def external_labels(tokens: DataFrame, lines: DataFrame, system: str, labels: list[str], weight: float = 1.0) -> DataFrame:
    """lines (ord, label, probability) in the order of all tokens: adds 'system-label' = weight * probability, null for other labels.

    A token's number is its place in its document plus the tokens of all documents before, one small row a document.
    """
    sizes = tokens.groupBy("doc_id").agg(F.count("*").alias("_n"))
    starts = sizes.select("doc_id", F.coalesce(F.sum("_n").over(W.orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    at = F.row_number().over(W.partitionBy("doc_id").orderBy("tok_id")) - 1
    j = tokens.withColumn("_k", at).join(starts, "doc_id").withColumn("_ord", F.col("_s") + F.col("_k")).join(lines.withColumnRenamed("ord", "_ord"), "_ord", "left")
    return j.select(*tokens.columns, *(F.when(F.col("label") == x, weight * F.col("probability")).alias(f"{system}-{x}") for x in labels))


def discrete(vectors: DataFrame, bins: int = 300) -> DataFrame:
    """Bin of every component over the range of all components, from 1; the largest falls in bins + 1."""
    span = vectors.select(F.min(F.array_min("embedding")).cast("double").alias("lo"), F.max(F.array_max("embedding")).cast("double").alias("hi"))
    return vectors.crossJoin(F.broadcast(span)).withColumn("bins", F.transform("embedding", lambda x: F.floor((x.cast("double") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("long") + 1)).drop("lo", "hi")


def binarized(vectors: DataFrame) -> DataFrame:
    """'+' at or above the mean of a dimension's positive values, '-' at or below that of its negative ones, else '0'."""
    long = vectors.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    means = long.groupBy("dim").agg(F.avg(F.when(F.col("x") > 0, F.col("x"))).alias("up"), F.avg(F.when(F.col("x") < 0, F.col("x"))).alias("down"))
    return long.join(means, "dim").select("vec_id", "dim", F.when(F.col("x") >= F.col("up"), "+").when(F.col("x") <= F.col("down"), "-").otherwise("0").alias("sign"))


def vocabulary(names: DataFrame) -> DataFrame:
    """name -> dense index from 0 in the order of the names: ranks inside ranges plus the ranges' starts, no single task."""
    distinct = names.select("name").distinct()
    keyed = distinct.withColumn("_r", F.substring("name", 1, 2))
    inner = keyed.withColumn("_k", F.row_number().over(W.partitionBy("_r").orderBy("name")))
    starts = keyed.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(starts, "_r").select("name", (F.col("_s") + F.col("_k") - 1).cast("long").alias("f_index"))


def _plogp(x: Column, n: Column) -> Column:
    return F.when((x > 0) & (n > 0), -(x / n) * F.log2(x / n)).otherwise(0.0)


def information_gain(presence: DataFrame, classes: DataFrame, compat: bool = False) -> DataFrame:
    """presence (item, name), classes (item, positive boolean) -> name, gain. ``compat`` keeps an old slip in the negative branch."""
    total = classes.agg(F.sum(F.col("positive").cast("int")).cast("double").alias("p"), F.sum((~F.col("positive")).cast("int")).cast("double").alias("n"))
    got = presence.distinct().join(classes, "item").groupBy("name").agg(F.sum(F.col("positive").cast("int")).cast("double").alias("a"), F.sum((~F.col("positive")).cast("int")).cast("double").alias("b"))
    a, b, p, n = (F.col(c) for c in "abpn")
    have, lack = a + b, (p - a) + (n - b)
    h = _plogp(p, p + n) + _plogp(n, p + n)
    h1, h0 = _plogp(a, have) + _plogp(a if compat else b, have), _plogp(p - a, lack) + _plogp(n - b, lack)
    return got.crossJoin(F.broadcast(total)).select("name", (h - have / (p + n) * h1 - lack / (p + n) * h0).alias("gain"))
