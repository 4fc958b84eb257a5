"""Candidate pairs of entities, relations and their keys; stub extractors are compositions of these."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .annotate import STRETCH, Find, Held, Wanted, over, stretches

_SIDES = ("ent_id", "class_id", "b", "e", "text", "sent_id")


def edges(entities: DataFrame, class1: str, class2: str, distance: int | None = None) -> DataFrame:
    """Pairs of a class-1 and a class-2 entity of a document, by offset, whose sentences lie ``distance`` apart (None: any)."""
    one, two = (entities.filter(F.col("class_id") == c).select("doc_id", *(F.col(x).alias(x + s) for x in _SIDES)) for c, s in ((class1, "_p"), (class2, "_q")))
    gap = F.abs(F.col("sent_id_q") - F.col("sent_id_p"))
    if distance is None:
        j = one.join(two, "doc_id")
    else:  # the distance is part of the key, so sentences meet only those that they may
        away = F.explode(F.array(*(F.col("sent_id_p") + k for k in sorted({distance, -distance})))).alias("sent_id_q")
        j = one.select("*", away).join(two, ["doc_id", "sent_id_q"])
    j = j.filter(F.col("ent_id_p") != F.col("ent_id_q"))
    if class1 == class2:
        j = j.filter(F.col("b_p") < F.col("b_q"))
    swap = F.struct(F.col("b_p"), F.col("ent_id_p")) > F.struct(F.col("b_q"), F.col("ent_id_q"))
    pick = lambda x, s, o: F.when(swap, F.col(f"{x}_{o}")).otherwise(F.col(f"{x}_{s}")).alias(x + ("1" if s == "p" else "2"))
    return j.select("doc_id", *(pick(x, "p", "q") for x in _SIDES), *(pick(x, "q", "p") for x in _SIDES), gap.alias("distance"))


#: Pairs that are made at once.
PAIRS = 1 << 20


def _expanded(lo: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of ranges that begin at lo: numbers of the ranges and of what is in them, in portions of about PAIRS."""
    ends, at = np.cumsum(sizes), 0
    while at < len(lo):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = sizes[at:to]
        yield np.repeat(np.arange(at, to), n), np.repeat(lo[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = to


def _met(h, class1: str, class2: str, distance: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``edges`` among the entities of a batch of texts: numbers of the first ones and of the second ones."""
    whole = lambda x: h.field[x].to_numpy(zero_copy_only=False).astype(np.int64)
    of = lambda c: np.flatnonzero(pc.fill_null(pc.equal(h.field["class_id"], c), False).to_numpy(zero_copy_only=False))
    ent, p, q = whole("ent_id"), of(class1), of(class2)
    place = h.row if distance is None else (h.row << 33) + whole("sent_id") + (1 << 32)
    q = q[np.argsort(place[q], kind="stable")]
    for gap in sorted({distance or 0, -(distance or 0)}):
        lo, hi = (np.searchsorted(place[q], place[p] + gap, side) for side in ("left", "right"))
        for one, two in _expanded(lo, hi - lo):
            one, two = p[one], q[two]
            kept = ent[one] != ent[two]
            if class1 == class2:
                kept &= h.b[one] < h.b[two]
            one, two = one[kept], two[kept]
            swap = (h.b[one] > h.b[two]) | ((h.b[one] == h.b[two]) & (ent[one] > ent[two]))
            yield np.where(swap, two, one), np.where(swap, one, two)


_KIND = dict(ent_id="int", class_id="string", b="int", e="int", text="string", sent_id="int")


def _sides(h, one: np.ndarray, two: np.ndarray, fields: tuple[str, ...]) -> list[pa.Array]:
    """The fields of both entities of pairs, and the distance of their sentences."""
    sent = h.field["sent_id"].to_numpy(zero_copy_only=False)
    return [*(h.field[x].take(pa.array(side)) for side in (one, two) for x in fields), pa.array(np.abs(sent[two] - sent[one]).astype(np.int32))]


def _between(h, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many of the entities of the texts ``at`` lie from lo to hi."""
    place = lambda row, x: (row << 33) + x + (1 << 32)
    order = np.argsort(place(h.row, h.b), kind="stable")
    begins, ends = place(h.row, h.b)[order], place(h.row, h.e)[order]
    first = np.searchsorted(begins, place(at, lo))
    if (np.diff(ends) >= 0).all():  # nothing is nested
        return np.maximum(0, np.searchsorted(ends, place(at, hi), "right") - first)
    out, sizes = np.zeros(len(at), np.int64), np.maximum(0, np.searchsorted(begins, place(at, hi), "right") - first)
    for pair, entity in _expanded(first, sizes):
        np.add.at(out, pair, ends[entity] <= place(at, hi)[pair])
    return out


def edges_in(docs: DataFrame, find: Find, class1: str, class2: str, distance: int | None = None, fields: tuple[str, ...] = _SIDES, between: bool = False) -> DataFrame:
    """``edges`` of the entities that ``find`` finds in texts, and with ``between`` n_between as the operator of that name counts it; no join, no shuffle."""

    def run(held: Held) -> Iterator[pa.RecordBatch]:
        for batch, h in held:
            for one, two in _met(h, class1, class2, distance):
                n = [pa.array(_between(h, h.row[one], h.e[one], h.b[two]))] if between else []
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(h.row[one])), *_sides(h, one, two, fields), *n], names)

    names = ["doc_id", *(x + k for k in "12" for x in fields), "distance", *(["n_between"] if between else [])]
    kinds = ["long", *(_KIND[x] for _ in "12" for x in fields), "int", "long"]
    return over(docs, find, (), run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def pairs_of_sentences(class1: str, class2: str, fields: tuple[str, ...] = _SIDES):
    """For ``annotate.owned_sentences``: the pairs of ``edges`` of one sentence each, with the text and the number of their sentence."""

    def run(h) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        met = list(_met(h, class1, class2, 0))
        one, two = (np.concatenate([x[k] for x in met]) if met else np.zeros(0, np.int64) for k in (0, 1))
        sent = h.field["sent_id"].to_numpy(zero_copy_only=False).astype(np.int64)
        return h.row[one], sent[one], pa.StructArray.from_arrays(_sides(h, one, two, fields), names)

    names = [*(x + k for k in "12" for x in fields), "distance"]
    run.rows = ", ".join(f"{n}: {k}" for n, k in zip(names, [*(_KIND[x] for _ in "12" for x in fields), "int"]))
    return run


def sentences_of_pairs(class1: str, class2: str, distance: int | None = None) -> Wanted:
    """Says which sentences hold an entity of a pair of ``edges``."""

    def run(h):
        sent = h.field["sent_id"].to_numpy(zero_copy_only=False).astype(np.int64)
        sides = [side for pair in _met(h, class1, class2, distance) for side in pair]
        held = np.unique(np.concatenate([np.unique(h.row[x] << 32 | sent[x]) for x in sides])) if sides else np.zeros(0, np.int64)
        return held >> 32, held & 0xFFFFFFFF

    return run


def combined(generators: list[DataFrame]) -> DataFrame:
    out = generators[0]
    for g in generators[1:]:
        out = out.unionByName(g)
    return out


def label_edges(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Adds real_target: 1 where a relation (doc_id, e1, e2) joins the two, in either order, else -1."""
    key = lambda a, b: (F.least(a, b), F.greatest(a, b))
    r = relations.select(F.col("doc_id").alias("_doc"), key("e1", "e2")[0].alias("_a"), key("e1", "e2")[1].alias("_b"), F.lit(1).alias("_hit")).distinct()
    lo, hi = key("ent_id1", "ent_id2")
    j = pairs.join(r, (F.col("doc_id") == F.col("_doc")) & (lo == F.col("_a")) & (hi == F.col("_b")), "left")
    return j.withColumn("real_target", F.coalesce("_hit", F.lit(-1))).drop("_doc", "_a", "_b", "_hit")


def predicted_relations(pairs: DataFrame) -> DataFrame:
    return pairs.filter("pred_target = 1").select("doc_id", F.col("ent_id1").alias("e1"), F.col("ent_id2").alias("e2"))


def purge(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations both of whose entities still exist."""
    ids = entities.select("doc_id", "ent_id").distinct()
    for side in ("e1", "e2"):
        relations = relations.join(ids.withColumnRenamed("ent_id", side), ["doc_id", side], "left_semi")
    return relations


def plausible(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Relations that a candidate pair covers."""
    lo, hi = F.least("ent_id1", "ent_id2").alias("_a"), F.greatest("ent_id1", "ent_id2").alias("_b")
    covered = pairs.select("doc_id", lo, hi).distinct()
    keyed = relations.withColumns({"_a": F.least("e1", "e2"), "_b": F.greatest("e1", "e2")})
    return keyed.join(covered, ["doc_id", "_a", "_b"], "left_semi").drop("_a", "_b")


def relation_key(relation: Column, class1: Column, text1: Column, class2: Column, text2: Column, full: bool = False) -> Column:
    """Key 'relation|x|y', sides by class; with equal classes the second comes first unless ``full`` orders by text too."""
    one, two = F.lower(text1), F.lower(text2)
    first = (class1 < class2) | ((class1 == class2) & (one <= two)) if full else class1 < class2
    return F.when(first, F.concat_ws("|", relation, one, two)).otherwise(F.concat_ws("|", relation, two, one))


def between(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds the number of entities strictly between the two."""
    # what lies between begins in a stretch of text between, so the join's key holds that too
    e = entities.select(F.col("doc_id").alias("_doc"), F.floor(F.col("b") / STRETCH).cast("int").alias("_at"), F.col("b").alias("_b"), F.col("e").alias("_e"))
    keys = ["doc_id", "ent_id1", "ent_id2"]
    gaps = pairs.select(*keys, "e1", "b2").distinct().withColumn("_s", F.explode(stretches(F.col("e1"), F.col("b2") + 1)))
    j = gaps.join(e, (F.col("doc_id") == F.col("_doc")) & (F.col("_s") == F.col("_at")) & (F.col("_b") >= F.col("e1")) & (F.col("_e") <= F.col("b2")), "left")
    counts = j.groupBy(*keys, "e1", "b2").agg(F.count("_b").alias("n_between"))
    return pairs.distinct().join(counts, [*keys, "e1", "b2"]).select(*pairs.columns, "n_between")


def distance_histogram(pairs: DataFrame, key: Column) -> DataFrame:
    """Least distance of each key of a document, counted, with its share."""
    least = pairs.groupBy("doc_id", key.alias("key")).agg(F.min("distance").alias("distance"))
    counts = least.groupBy("distance").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("distance", "n", (F.col("n") / F.col("total")).alias("share"))


def abbreviations(tokens: DataFrame) -> DataFrame:
    """Word pairs in the pattern Y ( X )."""
    from .annotate import sentence

    at = lambda k: F.lead("word", k).over(sentence())
    return tokens.select("doc_id", F.col("word").alias("long"), at(1).alias("o"), at(2).alias("short"), at(3).alias("c")).filter("o = '(' AND c = ')'").select("doc_id", "long", "short")


def sentence_counts(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens before, between and after the two entities in the first one's sentence."""
    t = tokens.select(F.col("doc_id").alias("_doc"), F.col("sent_id").alias("_s"), F.col("b").alias("_b"))
    j = pairs.join(t, (F.col("doc_id") == F.col("_doc")) & (F.col("sent_id1") == F.col("_s")), "left")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return j.groupBy("doc_id", "ent_id1", "ent_id2", "b1", "e1", "b2", "e2").agg(
        count(F.col("_b") < F.col("b1")).alias("before"), count((F.col("_b") >= F.col("e1")) & (F.col("_b") < F.col("b2"))).alias("inside"), count(F.col("_b") >= F.col("e2")).alias("after")
    ).select("doc_id", "ent_id1", "ent_id2", "before", "inside", "after")


def without_offsets(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, text1, class_id, text2 of each relation (class_id of the relation)."""
    text = lambda side, name: entities.select("doc_id", F.col("ent_id").alias(side), F.col("text").alias(name))
    return relations.join(text("e1", "text1"), ["doc_id", "e1"]).join(text("e2", "text2"), ["doc_id", "e2"]).select("doc_id", "text1", "class_id", "text2")


def map_relations(relations: DataFrame, key: Column, distance: Column) -> DataFrame:
    """doc_id, key, distances: those of all relations with the key, in order."""
    return relations.groupBy("doc_id", key.alias("key")).agg(F.array_sort(F.collect_list(distance)).alias("distances"))


def synonyms(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs (doc_id, ent_id, synonym), in both directions, of entities of one class written Y ( X )."""
    from .annotate import percolate, sentence

    at = lambda k: F.lag("word", -k).over(sentence())
    marked = tokens.withColumns({"_prev": F.lag("tok_id", 2).over(sentence()), "_o": at(-1), "_c": at(1), "_sent": F.col("sent_id")})
    span = percolate(tokens, entities).join(entities.select("doc_id", "ent_id", "class_id"), ["doc_id", "ent_id"])
    inside = span.join(marked.select("doc_id", F.col("tok_id").alias("first"), "_prev", "_o"), ["doc_id", "first"]).join(marked.select("doc_id", F.col("tok_id").alias("last"), "_c"), ["doc_id", "last"]).filter("_o = '(' AND _c = ')' AND _prev IS NOT NULL")
    # the token two places before lies in the first entity that holds it
    holder = span.select("doc_id", F.col("ent_id").alias("_other"), F.col("class_id").alias("_class"), F.explode(F.sequence("first", "last")).alias("_prev"))
    pairs = inside.join(holder, ["doc_id", "_prev"]).groupBy("doc_id", "ent_id", "class_id").agg(F.min(F.struct("_other", "_class")).alias("x")).filter("x._class = class_id AND x._other <> ent_id")
    one = pairs.select("doc_id", "ent_id", F.col("x._other").alias("synonym"))
    return one.unionByName(one.select("doc_id", F.col("synonym").alias("ent_id"), F.col("ent_id").alias("synonym"))).distinct()
