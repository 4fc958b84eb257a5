"""Readers of annotated corpora: each gives DataFrames of parts (doc_id, part_id, part_ord, text, is_abstract) or entities."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "doc_id string, part_id string, part_ord int, text string, is_abstract boolean"


def from_string(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("doc_1", "part_1", 0, text, True)], PARTS)


def _whole(spark: SparkSession, path: str, pattern: str, deep: bool = False) -> DataFrame:
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Every .txt file is a document, parted at blank lines; blank parts are left out."""
    return paragraphs(_whole(spark, path, "*.txt").select(F.col("file").alias("doc_id"), "text"))


def paragraphs(docs: DataFrame) -> DataFrame:
    parts = F.filter(F.split("text", "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"\s", " ")) != "")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(parts).alias("part_ord", "text")).select("doc_id", (F.col("part_ord") + 1).cast("string").alias("part_id"), "part_ord", "text", F.lit(True).alias("is_abstract"))


class _Parts(HTMLParser):
    """Elements whose id begins with s; their text is that of a single string inside, else the word None."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[dict] = []
        self.parts: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for p in self.open:
            p["kids"] += p["depth"] == 0
            p["depth"] += 1
        name = dict(attrs).get("id") or ""
        if name.startswith("s"):
            self.open.append({"id": name, "tag": tag, "depth": 0, "kids": 0, "text": []})
            self.parts.append(self.open[-1])

    def handle_endtag(self, tag: str) -> None:
        if self.open and self.open[-1]["tag"] == tag and self.open[-1]["depth"] == 0:
            self.open.pop()
        for p in self.open:
            p["depth"] = max(0, p["depth"] - 1)

    def handle_data(self, data: str) -> None:
        for p in self.open:
            p["text"].append((p["depth"], data))


def _html_parts(source: str) -> list[tuple[str, str, bool]]:
    parser = _Parts()
    parser.feed(source)
    out = []
    for p in parser.parts:
        inner = [t for _, t in p["text"]]
        single = inner and (p["kids"] == 0 or (p["kids"] == 1 and all(d > 0 for d, _ in p["text"])))
        out.append((p["id"], "".join(inner) if single else "None", not (len(p["id"]) > 1 and p["id"][1] in "3456789")))
    return out


def html_parts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, html) -> parts."""

    @F.pandas_udf("array<struct<part_id: string, text: string, is_abstract: boolean>>")
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(lambda s: [dict(zip(("part_id", "text", "is_abstract"), p)) for p in _html_parts(s or "")])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(parse("html")).alias("part_ord", "p")).select("doc_id", "p.part_id", "part_ord", "p.text", "p.is_abstract")


def html_files(spark: SparkSession, path: str, whole_name: bool = False) -> DataFrame:
    base = F.regexp_replace("file", r"(\.plain\.html|\.html|\.xml)$", "")
    docs = _whole(spark, path, "*.{html,xml}", True).select((base if whole_name else F.element_at(F.split(base, "-"), -1)).alias("doc_id"), F.col("text").alias("html"))
    return html_parts(docs)


def pubtator(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_pubtator(spark.read.option("lineSep", "\n\n").text(path))


def parse_pubtator(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (value) of title, abstract and annotation rows -> parts and entities; entities are offset inside their part."""
    lines = blocks.filter(F.trim("value") != "").select(F.split(F.regexp_replace("value", r"^\n+", ""), "\n").alias("l"))
    docs = lines.select(F.regexp_extract(F.col("l")[0], r"^([^|]*)\|t\|", 1).alias("doc_id"), F.regexp_extract(F.col("l")[0], r"(?s)^[^|]*\|t\|(.*)$", 1).alias("title"), F.regexp_extract(F.get("l", F.lit(1)), r"(?s)^[^|]*\|a\|(.*)$", 1).alias("abstract"), F.slice("l", 3, 1 << 30).alias("rows"))
    part = lambda i, c, a: docs.select("doc_id", F.lit(c).alias("part_id"), F.lit(i).alias("part_ord"), F.col(c).alias("text"), F.lit(a).alias("is_abstract"))
    rows = docs.select("doc_id", "title", "abstract", F.posexplode("rows").alias("ent_id", "row")).withColumn("f", F.split("row", "\t")).filter(F.size("f") >= 5)
    start, end, size = F.col("f")[1].cast("int"), F.col("f")[2].cast("int"), F.length("title")
    inside = (start >= 0) & (start < end) & (end <= size)
    shift = F.when(inside, 0).otherwise(size + 1)
    ents = rows.select("doc_id", F.when(inside, "title").otherwise("abstract").alias("part_id"), "ent_id", F.col("f")[4].alias("class_id"), (start - shift).alias("b"), (end - shift).alias("e"), F.when(inside, F.col("title")).otherwise(F.col("abstract")).alias("_t"), F.get("f", F.lit(5)).alias("norm"))
    ents = ents.withColumn("text", F.expr("substring(_t, b + 1, e - b)")).drop("_t")
    return part(0, "title", False).unionByName(part(1, "abstract", True)), ents


def delimited(spark: SparkSession, path: str, with_title: bool = True) -> DataFrame:
    """Rows id, title, abstract (or id, abstract); empty titles and empty or 'null' abstracts give no part."""
    names = ["doc_id", "title", "abstract"] if with_title else ["doc_id", "abstract"]
    rows = spark.read.csv(path, sep="\t", quote="", schema=", ".join(f"{n} string" for n in names))
    parts = [rows.select("doc_id", F.lit(n).alias("part_id"), F.lit(i).alias("part_ord"), F.trim(n).alias("text"), F.lit(n == "abstract").alias("is_abstract")) for i, n in enumerate(names[1:])]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.filter(F.coalesce(F.col("text"), F.lit("")) != "").filter(~((F.col("part_id") == "abstract") & (F.lower("text") == "null")))


def medline(spark: SparkSession, path: str) -> DataFrame:
    """Citations in XML: title, then the first abstract text if any."""
    schema = "PMID struct<_VALUE: string>, Article struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>>"
    rows = spark.read.format("xml").option("rowTag", "MedlineCitation").option("pathGlobFilter", "medline*.xml").option("recursiveFileLookup", True).schema(schema.replace("struct<_VALUE: string>", "string", 1)).load(path)
    base = rows.select(F.col("PMID").alias("doc_id"), F.col("Article.ArticleTitle").alias("t"), F.get(F.col("Article.Abstract.AbstractText"), F.lit(0)).alias("a"))
    one = lambda c, i, name: base.select("doc_id", F.lit(name).alias("part_id"), F.lit(i).alias("part_ord"), F.col(c).alias("text"), F.lit(i == 1).alias("is_abstract"))
    return one("t", 0, "title").unionByName(one("a", 1, "abstract").filter("text IS NOT NULL"))


def brat(spark: SparkSession, path: str) -> DataFrame:
    """doc-part.ann files: entity rows T#, 'class start end', text."""
    lines = spark.read.option("pathGlobFilter", "*.ann").text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.ann$", "").alias("f"), F.split("value", "\t").alias("c")).filter(F.col("c")[0].startswith("T") & (F.size("c") >= 3))
    head = F.split(F.col("c")[1], " ")
    return lines.select(F.split("f", "-")[0].alias("doc_id"), F.element_at(F.split("f", "-"), -1).alias("part_id"), F.regexp_replace(F.col("c")[0], "^T", "").cast("int").alias("ent_id"), head[0].alias("class_id"), head[1].cast("int").alias("b"), head[2].cast("int").alias("e"), F.col("c")[2].alias("text"))


ANNOTATIONS = (
    "annotatable struct<parts: array<string>>, anncomplete boolean, entities array<struct<classId: string, part: string, offsets: array<struct<start: int, text: string>>, confidence: struct<state: string, prob: double>,"
    " normalizations: map<string, struct<source: struct<id: string>, recName: string>>>>, relations array<struct<classId: string, entities: array<string>>>"
)


def annotated_json(spark: SparkSession, path: str, only_complete: bool = True, classes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """*.ann.json files -> annotatable parts (doc_id, part_id) and entities."""
    files = spark.read.schema(ANNOTATIONS).option("multiLine", True).option("pathGlobFilter", "*.ann.json").json(path)
    return annotations_of(files.withColumn("doc_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.ann\.json$", "")), only_complete, classes)


def parse_annotated_json(docs: DataFrame, only_complete: bool = True, classes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, value: one JSON document) -> the same."""
    return annotations_of(docs.select("doc_id", F.from_json("value", ANNOTATIONS).alias("j")).select("doc_id", "j.*"), only_complete, classes)


def annotations_of(rows: DataFrame, only_complete: bool, classes: list[str] | None) -> tuple[DataFrame, DataFrame]:
    rows = rows.filter("anncomplete") if only_complete else rows
    ents = rows.select("doc_id", F.posexplode("entities").alias("ent_id", "x")).select("doc_id", F.col("x.part").alias("part_id"), "ent_id", F.col("x.classId").alias("class_id"), F.col("x.offsets")[0]["start"].alias("b"), F.col("x.offsets")[0]["text"].alias("text"), F.col("x.confidence.prob").alias("confidence"), F.transform_values("x.normalizations", lambda k, v: v["source"]["id"]).alias("norms"))
    ents = ents.withColumn("e", F.col("b") + F.length("text"))
    return rows.select("doc_id", F.explode("annotatable.parts").alias("part_id")), ents.filter(F.col("class_id").isin(classes)) if classes else ents


def annotated_relations(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """rows (doc_id, relations), entities (doc_id, part_id, ent_id, b) -> relations (doc_id, class_id, e1, e2): ends 'part|start,…' are looked up among the entities, and must be one each."""
    ends = rows.select("doc_id", F.posexplode("relations").alias("n", "r")).select("doc_id", "n", F.col("r.classId").alias("class_id"), F.col("r.entities")[0].alias("x1"), F.col("r.entities")[1].alias("x2"))
    place = lambda x: (F.split_part(x, F.lit("|"), F.lit(1)), F.split_part(F.split_part(x, F.lit("|"), F.lit(2)), F.lit(","), F.lit(1)).cast("int"))
    own = entities.groupBy("doc_id", "part_id", "b").agg(F.min("ent_id").alias("ent_id"), F.count("*").alias("_c")).filter("_c = 1").drop("_c")
    for k in (1, 2):
        part, start = place(F.col(f"x{k}"))
        ends = ends.withColumns({"part_id": part, "b": start}).join(own.withColumnRenamed("ent_id", f"e{k}"), ["doc_id", "part_id", "b"]).drop("part_id", "b")
    return ends.select("doc_id", "class_id", "e1", "e2")


def annotators(spark: SparkSession, path: str, only_complete: bool = True) -> DataFrame:
    """path/annotator/*.ann.json -> entities with their annotator, for ``annotate.merge_annotators``."""
    files = spark.read.schema(ANNOTATIONS).option("multiLine", True).option("pathGlobFilter", "*.ann.json").option("recursiveFileLookup", True).json(path)
    rows = files.withColumns({"doc_id": F.regexp_replace(F.col("_metadata.file_name"), r"\.ann\.json$", ""), "annotator": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)})
    rows = rows.filter("anncomplete") if only_complete else rows
    x = rows.select("doc_id", "annotator", F.posexplode("entities").alias("ent_id", "x"))
    return x.select("doc_id", F.col("x.part").alias("part_id"), "annotator", "ent_id", F.col("x.classId").alias("class_id"), F.col("x.offsets")[0]["start"].alias("b"), F.col("x.offsets")[0]["text"].alias("text"))


IGNORED = "** IGNORE LINE **\n"


def paragraphs_with_marks(files: DataFrame) -> DataFrame:
    """files (file doc-part, text): lines to ignore go, paragraphs are parts -> parts with at, the place of a part in the raw text."""
    clean = F.replace("text", F.lit(IGNORED), F.lit(""))
    skipped = F.floor((F.length("text") - F.length(clean)) / len(IGNORED)).cast("int") * len(IGNORED)
    head = files.select(F.split_part("file", F.lit("-"), F.lit(1)).alias("doc_id"), F.expr("substring(file, instr(file, '-') + 1)").alias("prefix"), skipped.alias("at"), F.split(clean, "\n\n").alias("p"))
    # a part's place: what is skipped and the parts before it with their two line ends, blank ones left out
    sizes = F.transform("p", lambda x: F.when(x == "", 0).otherwise(F.length(x) + 2))
    placed = head.select("doc_id", "prefix", F.posexplode(F.transform("p", lambda x, i: F.struct(x.alias("text"), (F.col("at") + F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, b: a + b)).alias("at")))).alias("part_ord", "x")).filter("x.text <> ''")
    return placed.select("doc_id", F.concat("prefix", F.lit("-p"), (F.col("part_ord") + 1).cast("string")).alias("part_id"), "part_ord", "x.text", F.contains("prefix", F.lit("Abstract")).alias("is_abstract"), "prefix", "x.at")


def annotation_lines(spark: SparkSession, path: str, pattern: str = "*.ann") -> DataFrame:
    """Rows T#, 'class start end', text of annotation files: file, ent_id, kind, b, e, text."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.ann$", "").alias("file"), F.split("value", "\t").alias("c"))
    head = F.split(F.col("c")[1], " +")
    lines = lines.filter(F.col("c")[0].startswith("T") & (F.size("c") >= 3))
    return lines.select("file", F.regexp_replace(F.col("c")[0], "^T", "").cast("int").alias("ent_id"), head[0].alias("kind"), head[1].cast("int").alias("b"), head[2].cast("int").alias("e"), F.col("c")[2].alias("text"))


def variome(spark: SparkSession, path: str, classes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """doc-part.txt with doc-part.ann, of several paragraphs each; ``classes`` maps kinds (mutation, gene) to class ids.

    An annotation lies in the last paragraph that begins at or before it, and is offset from there.
    """
    texts = _whole(spark, path, "*.txt").select(F.regexp_replace("file", r"\.txt$", "").alias("file"), "text")
    parts = paragraphs_with_marks(texts)
    lines = annotation_lines(spark, path).filter(F.col("kind").isin(*classes))
    lines = lines.select(F.split_part("file", F.lit("-"), F.lit(1)).alias("doc_id"), F.expr("substring(file, instr(file, '-') + 1)").alias("prefix"), "ent_id", "kind", "b", "e", F.col("text").alias("t"))
    starts = parts.groupBy("doc_id", "prefix").agg(F.array_sort(F.collect_list(F.struct("at", "part_id"))).alias("starts"))
    j = lines.join(starts, ["doc_id", "prefix"])
    own = F.coalesce(F.get(F.filter("starts", lambda x: x["at"] <= F.col("b")), F.size(F.filter("starts", lambda x: x["at"] <= F.col("b"))) - 1), F.get("starts", F.lit(0)))
    kind = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    ents = j.withColumn("own", own).select("doc_id", "own.part_id", "ent_id", kind[F.col("kind")].alias("class_id"), (F.col("b") - F.col("own.at")).alias("b"), (F.col("e") - F.col("own.at")).alias("e"), F.col("t").alias("text"))
    return parts.select("doc_id", "part_id", "part_ord", "text", "is_abstract"), ents


def seth_annotations(spark: SparkSession, path: str, mutation: str, gene: str | None, titles: DataFrame | None = None) -> DataFrame:
    """doc.ann files of kinds SNP, RS (mutations) and Gene -> entities of the abstract; with ``titles`` (doc_id, title) offsets count through both parts."""
    lines = annotation_lines(spark, path).withColumnRenamed("file", "doc_id")
    kind = F.when(F.col("kind").isin("SNP", "RS"), F.lit(mutation)).when((F.col("kind") == "Gene") & F.lit(gene is not None), F.lit(gene))
    ents = lines.withColumn("class_id", kind).filter(F.col("class_id").isNotNull())
    if titles is None:
        return ents.select("doc_id", F.lit("abstract").alias("part_id"), "ent_id", "class_id", "b", "e", "text")
    size = F.length("title")
    inside = (F.col("b") >= 0) & (F.col("b") < F.col("e")) & (F.col("e") <= size)
    shift = F.when(inside, 0).otherwise(size + 1)
    j = ents.join(titles.select("doc_id", "title"), "doc_id")
    return j.select("doc_id", F.when(inside, "title").otherwise("abstract").alias("part_id"), "ent_id", "class_id", (F.col("b") - shift).alias("b"), (F.col("e") - shift).alias("e"), "text")


def protein_residues(spark: SparkSession, path: str, classes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows id, kind, start, end, …, text: a part and an entity for each row of a kind in ``classes`` (Mutation, AminoacidResidue)."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 8)
    kind = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    rows = rows.select(F.col("c")[0].alias("doc_id"), F.concat_ws("|", F.slice("c", 2, 3)).alias("part_id"), kind[F.col("c")[1]].alias("class_id"), F.col("c")[2].cast("int").alias("b"), F.col("c")[7].alias("text")).filter(F.col("class_id").isNotNull())
    parts = rows.groupBy("doc_id", "part_id").agg(F.max("text").alias("text"))
    return parts, rows.select("doc_id", "part_id", "class_id", "b", (F.col("b") + F.length("text")).alias("e"), "text")


def _inline(source: str) -> list[dict]:
    """Articles of inline XML: id, and of title and abstract the text and the variants in it."""
    import xml.etree.ElementTree as ElementTree

    out = []
    try:
        article = ElementTree.fromstring(source)
    except ElementTree.ParseError:
        return out
    for n, part in ((1, "title"), (2, "abstract")):
        text, found = (article[n].text or "") if len(article) > n else "", []
        for child in article[n] if len(article) > n else ():
            if child.tag == "variant":
                found.append((len(text), child.text or ""))
            text += (child.text or "") + (child.tail or "")
        out.append({"doc_id": article[0].text, "part_id": part, "part_ord": n - 1, "text": text, "found": found})
    return out


def osiris(spark: SparkSession, path: str, class_id: str) -> tuple[DataFrame, DataFrame]:
    """Articles (Pmid, Title, Abstract) with variants marked inside their text. The file is read article by article."""
    kind = "array<struct<doc_id: string, part_id: string, part_ord: int, text: string, found: array<struct<b: int, text: string>>>>"

    @F.pandas_udf(kind)
    def parse(blocks: pd.Series) -> pd.Series:
        return blocks.map(_inline)

    blocks = spark.read.option("lineSep", "</Article>").text(path).filter(F.contains("value", F.lit("<Article")))
    whole = F.concat(F.expr("substring(value, instr(value, '<Article'))"), F.lit("</Article>"))
    rows = blocks.select(F.explode(parse(whole)).alias("p")).select("p.*")
    ents = rows.select("doc_id", "part_id", F.posexplode("found").alias("ent_id", "x")).select("doc_id", "part_id", "ent_id", F.lit(class_id).alias("class_id"), F.col("x.b").alias("b"), (F.col("x.b") + F.length("x.text")).alias("e"), F.col("x.text").alias("text"))
    return rows.select("doc_id", "part_id", "part_ord", "text", F.lit(True).alias("is_abstract")), ents


def merge_adjacent(spans: DataFrame) -> DataFrame:
    """spans (doc_id, b, e): those that begin one after the last one's end are one. -> doc_id, b, e"""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("doc_id").orderBy("b", "e")
    fresh = F.coalesce(F.lag("e").over(w) + 1 != F.col("b"), F.lit(True))
    return spans.withColumn("_n", F.sum(fresh.cast("int")).over(w)).groupBy("doc_id", "_n").agg(F.min("b").alias("b"), F.max("e").alias("e")).drop("_n")


def osiris_spans(spark: SparkSession, path: str, class_id: str) -> tuple[DataFrame, DataFrame]:
    """x.txt (id, blank, title, blank, abstract) with x.txt.ann in XML: adjacent spans of all kinds but 'ge' are one entity."""
    texts = _whole(spark, path, "*.txt").withColumn("l", F.split("text", "\n")).filter(F.col("l")[0].rlike("^[0-9]+$") & (F.size("l") >= 5))
    docs = texts.select("file", F.col("l")[0].alias("doc_id"), F.col("l")[2].alias("title"), F.col("l")[4].alias("abstract"), "text")
    anns = _whole(spark, path, "*.ann").select(F.regexp_replace("file", r"\.ann$", "").alias("file"), F.explode(F.regexp_extract_all("text", F.lit("<[^<>]*span=[^<>]*>"), F.lit(0))).alias("a"))
    anns = anns.select("file", F.regexp_extract("a", 'type="([^"]*)"', 1).alias("kind"), F.regexp_extract("a", r'span="(\d+)\.\.(\d+)"', 1).cast("int").alias("b"), F.regexp_extract("a", r'span="(\d+)\.\.(\d+)"', 2).cast("int").alias("e")).filter("kind NOT IN ('', 'ge') AND b IS NOT NULL")
    spans = merge_adjacent(anns.withColumnRenamed("file", "doc_id")).withColumnRenamed("doc_id", "file").join(docs, "file")
    title_at = F.length("doc_id") + 2
    body_at = title_at + F.length("title") + 2
    at = F.when(F.col("b") >= body_at, body_at).otherwise(title_at)
    ents = spans.select("doc_id", F.when(F.col("b") >= body_at, "abstract").otherwise("title").alias("part_id"), F.lit(class_id).alias("class_id"), (F.col("b") - at).alias("b"), (F.col("e") - at).alias("e"), F.expr("substring(text, b + 1, e - b)").alias("text"))
    part = lambda i, c: docs.select("doc_id", F.lit(c).alias("part_id"), F.lit(i).alias("part_ord"), F.col(c).alias("text"), F.lit(True).alias("is_abstract"))
    return part(0, "title").unionByName(part(1, "abstract")), ents


def articles(spark: SparkSession, path: str, one_part: bool = False) -> DataFrame:
    """A table of articles in XML (PubmedArticle) instead of a download: title and abstract, whose sections are led by their labels."""
    schema = "MedlineCitation struct<PMID: struct<_VALUE: string>, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string>>>>>"
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path)
    section = lambda x: F.when(x["_Label"].isNotNull() & (x["_Label"] != "UNLABELLED"), F.concat(x["_Label"], F.lit(": "), x["_VALUE"])).otherwise(x["_VALUE"])
    a = rows.select(F.col("MedlineCitation.PMID._VALUE").alias("doc_id"), F.col("MedlineCitation.Article.ArticleTitle").alias("title"), F.array_join(F.transform("MedlineCitation.Article.Abstract.AbstractText", section), " ").alias("abstract"))
    if one_part:
        return a.select("doc_id", F.lit("abstract").alias("part_id"), F.lit(0).alias("part_ord"), F.concat_ws(" ", "title", "abstract").alias("text"), F.lit(True).alias("is_abstract"))
    part = lambda i, c: a.filter(F.col(c).isNotNull()).select("doc_id", F.lit(c).alias("part_id"), F.lit(i).alias("part_ord"), F.col(c).alias("text"), F.lit(True).alias("is_abstract"))
    return part(0, "title").unionByName(part(1, "abstract"))


def by_ids(parts: DataFrame, ids: DataFrame) -> DataFrame:
    """Parts of the documents listed in ids (doc_id)."""
    return parts.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def denotations(docs: DataFrame, class_id: str) -> tuple[DataFrame, DataFrame]:
    """docs (value: JSON of a tagging service with sourceid, text and denotations) -> parts and entities."""
    schema = "sourceid string, text string, denotations array<struct<span: struct<begin: int, end: int>, obj: string>>"
    rows = docs.select(F.from_json("value", schema).alias("j")).select(F.col("j.sourceid").alias("doc_id"), "j.text", "j.denotations")
    ents = rows.select("doc_id", "text", F.posexplode("denotations").alias("ent_id", "d")).select("doc_id", F.lit("abstract").alias("part_id"), "ent_id", F.lit(class_id).alias("class_id"), F.col("d.span.begin").alias("b"), F.col("d.span.end").alias("e"), F.expr("substring(text, d.span.begin + 1, d.span.end - d.span.begin)").alias("text"), F.col("d.obj").alias("norm"))
    return rows.select("doc_id", F.lit("abstract").alias("part_id"), F.lit(0).alias("part_ord"), "text", F.lit(True).alias("is_abstract")), ents


def genes(entities: DataFrame) -> DataFrame:
    """Gene entities with norm -> different (doc_id, b, e, text, gene_id): the number in the norm."""
    number = F.regexp_extract("norm", r"^[a-z]*:?(\d+)", 1)
    return entities.select("doc_id", "b", "e", "text", number.alias("gene_id")).filter("gene_id <> ''").distinct()


def mapped_ids(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """ids (gene_id), mapping (gene_id, uniprot_id) -> gene_id, uniprot_ids in order; the join stands for a look-up service."""
    return ids.select("gene_id").distinct().join(mapping, "gene_id").groupBy("gene_id").agg(F.array_sort(F.collect_set("uniprot_id")).alias("uniprot_ids"))


def tag_genes(genes: DataFrame, mapping: DataFrame, class_id: str, confidence: float = 0.5) -> DataFrame:
    """Gene entities with their norms by number and by mapped id."""
    norms = F.map_filter(F.create_map(F.lit("gene"), "gene_id", F.lit("uniprot"), F.array_join("uniprot_ids", ",")), lambda k, v: v.isNotNull())
    j = genes.join(mapped_ids(genes, mapping), "gene_id", "left")
    return j.select("doc_id", F.lit(class_id).alias("class_id"), "b", "e", "text", norms.alias("norms"), F.lit(confidence).alias("confidence"))


def cached(spark: SparkSession, path: str, make, max_seconds: int = 604_800) -> DataFrame:
    """The table at ``path`` if it was written at most ``max_seconds`` ago, else what ``make`` gives, written there."""
    import time

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (fs.exists(at) and time.time() - fs.getFileStatus(at).getModificationTime() / 1000 <= max_seconds):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
