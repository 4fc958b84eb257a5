"""Writers: one string column per document or instance, written by Spark's text writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pubtator(parts: DataFrame, entities: DataFrame) -> DataFrame:
    """parts (doc_id, title, abstract), entities (doc_id, ent_id, class_id, b, e, text, norm) in document offsets -> value."""
    row = F.concat_ws("\t", "doc_id", F.col("b").cast("string"), F.col("e").cast("string"), "text", "class_id", F.coalesce("norm", F.lit("")))
    rows = entities.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ent_id", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    j = parts.join(rows, "doc_id", "left")
    head = F.concat("doc_id", F.lit("|t|"), "title", F.lit("\n"), "doc_id", F.lit("|a|"), "abstract")
    return j.select(F.concat(head, F.when(F.col("rows").isNotNull(), F.concat(F.lit("\n"), "rows")).otherwise(F.lit("")), F.lit("\n")).alias("value"))


def annotated_json(parts: DataFrame, entities: DataFrame, threshold: float | None = None) -> DataFrame:
    """One JSON document a row: doc_id, value. Entities at or above the threshold are selected, others pre-added."""
    state = F.when(F.lit(threshold is None), "").when(F.col("confidence") >= F.lit(threshold or 0.0), "selected").otherwise("pre-added")
    ent = F.struct(F.col("class_id").alias("classId"), F.col("part_id").alias("part"), F.array(F.struct(F.col("b").alias("start"), "text")).alias("offsets"), F.struct(state.alias("state"), F.col("confidence").alias("prob")).alias("confidence"))
    e = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ent_id", ent.alias("x")))).alias("s")).select("doc_id", F.transform("s", lambda s: s["x"]).alias("entities"))
    p = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part_ord", "part_id"))).alias("s")).select("doc_id", F.transform("s", lambda s: s["part_id"]).alias("parts"))
    body = F.struct(F.struct("parts").alias("annotatable"), F.lit(True).alias("anncomplete"), F.coalesce("entities", F.array()).alias("entities"))
    return p.join(e, "doc_id", "left").select("doc_id", F.to_json(body).alias("value"))


def html(parts: DataFrame) -> DataFrame:
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    p = F.concat(F.lit('<p id="'), "part_id", F.lit('">'), escaped, F.lit("</p>"))
    s = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part_ord", p.alias("p")))).alias("s"))
    return s.select("doc_id", F.concat(F.lit("<!DOCTYPE html><html><body>"), F.array_join(F.transform("s", lambda x: x["p"]), ""), F.lit("</body></html>")).alias("value"))


def instances(features: DataFrame, targets: DataFrame) -> DataFrame:
    """features (edge_id, f_index, value), targets (edge_id, target) -> lines 'target index:value ...' by index."""
    pair = F.concat(F.col("f_index").cast("string"), F.lit(":"), F.col("value").cast("string"))
    s = features.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("f_index", pair.alias("p")))).alias("s"))
    return targets.join(s, "edge_id", "left").select("edge_id", F.concat_ws(" ", F.col("target").cast("string"), F.array_join(F.transform("s", lambda x: x["p"]), " ")).alias("value"))


def console(parts: DataFrame, entities: DataFrame, relations: DataFrame, class1: str, class2: str, color: bool = False) -> DataFrame:
    """parts (doc_id, part_id, part_ord, text), entities (… class_id, b, e, text), relations (doc_id, part_id, text1, text2) -> doc_id, part_ord, value: a part as it is shown.

    With color entities stand coloured in the text, else they are listed below it; both in the order of their offsets.
    """
    key = ["doc_id", "part_id"]
    e = entities.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("b", "e", "class_id", "text"))).alias("ents"))
    r = relations.groupBy(*key).agg(F.array_sort(F.collect_list(F.concat("text1", F.lit(" ---> "), "text2"))).alias("rels"))
    j = parts.join(e, key, "left").join(r, key, "left").withColumns({"ents": F.coalesce("ents", F.array()), "rels": F.coalesce("rels", F.array())})
    if color:
        paint = lambda x: F.when(x["class_id"] == class2, F.lit("\x1b[41m")).otherwise(F.lit("\x1b[42m"))
        sub = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
        start = F.struct(F.lit("").alias("s"), F.lit(0).alias("at"))
        grown = F.aggregate("ents", start, lambda a, x: F.struct(F.concat(a["s"], sub(a["at"], F.greatest(a["at"], x["b"])), paint(x), sub(F.greatest(a["at"], x["b"]), F.greatest(a["at"], x["e"])), F.lit("\x1b[0m")).alias("s"), F.greatest(a["at"], x["e"]).alias("at")))
        body = F.concat(grown["s"], sub(grown["at"], F.length("text")))
    else:
        name = lambda x: F.when(x["class_id"] == class2, "Mutation").otherwise("GGP     ")
        listed = F.transform(F.filter("ents", lambda x: x["class_id"].isin(class1, class2)), lambda x: F.concat_ws(" ", name(x), F.rpad(x["b"].cast("string"), F.length(F.length("text").cast("string")), F.lit(" ")), F.rpad(x["e"].cast("string"), F.length(F.length("text").cast("string")), F.lit(" ")), x["text"]))
        body = F.array_join(F.concat(F.array("text", F.lit("ANNOTATIONS")), listed), "\n")
    value = F.array_join(F.concat(F.array(F.concat(F.lit("PART "), "part_id"), body, F.lit("RELATIONS")), "rels"), "\n")
    return j.select("doc_id", "part_ord", value.alias("value"))


def summary(entities: DataFrame) -> DataFrame:
    """Entities by class and subclass, most first."""
    return entities.groupBy("class_id", "subclass").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class_id", "subclass")


def feature_names(features: DataFrame) -> DataFrame:
    """The different names of long features, sorted, as a serialized pipeline lists them."""
    return features.select("name").distinct().orderBy("name")


def deviation(found: int, total: int, draws: int = 999, share: float = 0.15, seed: int = 17) -> tuple[float, float]:
    """Deviation and error of the share of ``found`` among ``total`` over samples without replacement; each draw is one hypergeometric number."""
    import numpy as np

    size = int(total * share)
    got = np.random.default_rng(seed).hypergeometric(found, total - found, size, draws) / size
    dev = float(((got - found / total) ** 2).sum() / draws**0.5)
    return dev, dev / (draws - 1) ** 0.5


def statistics(rows: DataFrame) -> DataFrame:
    """rows (mode, nl_mention_nr, tot_mention_nr) with the error of their ratio, for the CSV writer; one small row a mode."""
    error = F.udf(lambda a, b: deviation(a, b)[1] if b and int(b * 0.15) else None, "double")
    return rows.withColumn("error", error("nl_mention_nr", "tot_mention_nr"))
