"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Sizes are words. The targets share all sizes by the sources' weights and stop at ``MOST`` times a source's size; the excess is
reshared until no target is above. In the order of size over weight the sources that reach their stop are a prefix, so two
running sums find the level at which the rest is filled. Each document of a source has the same expected copies, its source's
target over its size; in the order of size these are summed, one offset from the source's name is added, and a copy is emitted
for each whole number crossed. That order keeps a source's taken words within about its largest document of the target.

The running sum needs no source in one task: equal expected copies make it the rate times the rank, and ranks come from counts
by (source, size, cell), 256 cells by a hash of the document's id and text; only rows of one such cell are numbered together, in the
order of the hash. The order is the same at every number of rows. One row a source meets in a window for the targets.

Defined cases: null text has size 0, and size 0 takes nothing. A null source is a source, the last. Null doc_ids are told apart by
their texts. Repeated rows are separate documents; equal ids and texts are alike, so reruns agree. An empty table gives no rows. Extra
columns of any name pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _prefix(docs: DataFrame) -> str:
    """What the names of work columns begin with, so that none is one of the table's."""
    p = "_"
    while any(c.lower().startswith(p + "mix") for c in docs.columns):
        p += "_"
    return p + "mix"


def _sized(docs: DataFrame, p: str) -> DataFrame:
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")))))
    with_order = docs.withColumns({f"{p}size": words(), f"{p}none": F.col("source").isNull(), f"{p}src": F.coalesce("source", F.lit("")), f"{p}order": order})
    return with_order.withColumn(f"{p}cell", F.substring(f"{p}order", 1, 2))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: none, src, source_size. Adds target and rate. One small row a source."""
    by_name = W.orderBy("none", "src")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumns({"w": weight, "total": F.sum("source_size").over(W.partitionBy())})
    s = s.withColumn("cap", F.col("source_size") * MOST)
    fill = W.orderBy((F.col("source_size") * F.floor(F.lit(6) / F.col("w"))).asc(), "none", "src")
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumns({"gone": F.coalesce(F.sum("cap").over(before), F.lit(0)), "left": F.sum("w").over(after)})
    level = (F.col("total") - F.col("gone")).cast("double") / F.col("left").cast("double")
    s = s.withColumn("full", F.col("cap").cast("double") <= level * F.col("w").cast("double"))
    free = W.partitionBy()
    s = s.withColumns({"fixed": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(free), F.lit(0)), "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(free)})
    rest = (F.col("total") - F.col("fixed")).cast("double") / F.col("open").cast("double") * F.col("w").cast("double")
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest))
    return s.select("none", "src", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def plan(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with size, source_size, target and copies, these names after the prefix that is returned too."""
    p = _prefix(docs)
    rows = _sized(docs, p)
    key = [f"{p}none", f"{p}src", f"{p}size"]
    cells = _sized(docs.select("doc_id", "text", "source"), p).groupBy(*key, f"{p}cell").agg(F.count("*").alias("n"))
    by_size = cells.groupBy(*key).agg(F.sum("n").alias("m"))
    larger = W.partitionBy(*key[:2]).orderBy(F.desc(key[2])).rowsBetween(W.unboundedPreceding, -1)
    by_size = by_size.select("*", F.coalesce(F.sum("m").over(larger), F.lit(0)).alias("before"))
    level = targets(by_size.groupBy(F.col(key[0]).alias("none"), F.col(key[1]).alias("src")).agg(F.sum(F.col("m") * F.col(key[2])).alias("source_size")))
    earlier = W.partitionBy(*key).orderBy(f"{p}cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("within", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(by_size.drop("m"), key).join(level.withColumnsRenamed({"none": key[0], "src": key[1]}), key[:2])
    cells = cells.select(*key, f"{p}cell", (F.col("before") + F.col("within")).alias(f"{p}first"), F.col("source_size").alias(f"{p}source_size"), F.col("target").alias(f"{p}target"), F.col("rate").alias(f"{p}rate"))
    number = F.row_number().over(W.partitionBy(*key, f"{p}cell").orderBy(f"{p}order"))
    ranked = rows.withColumn(f"{p}number", number.cast("long")).join(cells, [*key, f"{p}cell"])
    k = (F.col(f"{p}first") + F.col(f"{p}number")).cast("double")
    name = F.when(F.col(key[0]), F.lit("null")).otherwise(F.concat(F.lit("source "), F.col(key[1])))
    u = F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("double") / 65536.0
    rate = F.col(f"{p}rate")
    crossed = F.floor(rate * k + u) - F.floor(rate * (k - 1.0) + u)
    copies = F.when(F.col(key[2]) > 0, F.least(F.lit(MOST), crossed)).otherwise(F.lit(0)).cast("long")
    return ranked.withColumn(f"{p}copies", copies), p


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    planned, p = plan(docs)
    repeated = planned.filter(F.col(f"{p}copies") > 0).withColumn(f"{p}i", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies").cast("int"))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned, p = plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    size = F.col(f"{p}size")
    return planned.select("doc_id", "source", size.alias("size"), F.col(f"{p}source_size").alias("source_size"), F.col(f"{p}target").alias("target"), (F.col(f"{p}copies") * size).alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS ord, source IS NULL AS none_, coalesce(source, '') AS src,
                  CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT none_, src, sum(size)::BIGINT AS source_size FROM d GROUP BY none_, src),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY none_, src) - 1) % 3 AS w, (sum(source_size) OVER ())::BIGINT AS total, {MOST} * source_size AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY source_size * (6 // w), none_, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone,
             (sum(w) OVER (ORDER BY source_size * (6 // w), none_, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS left_ FROM w),
g AS (SELECT *, cap::DOUBLE <= (total - gone)::DOUBLE / left_::DOUBLE * w::DOUBLE AS full_ FROM f),
h AS (SELECT *, coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)::BIGINT AS fixed, (sum(CASE WHEN NOT full_ THEN w END) OVER ())::BIGINT AS open_ FROM g),
t AS (SELECT none_, src, source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE (total - fixed)::DOUBLE / open_::DOUBLE * w::DOUBLE END AS target FROM h),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate,
             (('0x' || substr(md5(CASE WHEN d.none_ THEN 'null' ELSE 'source ' || d.src END), 1, 4))::INTEGER)::DOUBLE / 65536.0 AS u,
             (row_number() OVER (PARTITION BY d.none_, d.src ORDER BY d.size DESC, d.ord))::DOUBLE AS k
      FROM d JOIN t ON d.none_ = t.none_ AND d.src = t.src)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN size > 0 THEN least({MOST}, CAST(floor(rate * k + u) - floor(rate * (k - 1.0) + u) AS BIGINT)) * size ELSE 0 END::BIGINT AS taken
FROM r
"""
