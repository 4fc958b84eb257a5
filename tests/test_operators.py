"""Fixtures of single operators."""

from textloom.functions.words import cut_sentences, cut_words, stem, tokens
from textloom.operators import annotate, evaluate, graph, relations
from textloom.sources import readers, writers

ENT = "doc_id long, ent_id int, class_id string, b int, e int, text string, sent_id int"
TEXT = "Sentence 1: e_1_yolo may be related to e_2_tool plus hey, e_2_coco. Sentence 2: e_1_nin. Sentence 3: e_2_musk. Sentence 4: nothing"


def entities(spark):
    rows = [(0, 0, "e_1", 12, 20, "e_1_yolo", 0), (0, 1, "e_2", 39, 47, "e_2_tool", 0), (0, 2, "e_2", 58, 66, "e_2_coco", 0), (0, 3, "e_1", 80, 87, "e_1_nin", 1), (0, 4, "e_2", 101, 109, "e_2_musk", 2)]
    return spark.createDataFrame(rows, ENT)


def test_words():
    assert [w for w in cut_words("c.2708_2711delTTAG") if w] == ["c", ".", "2708", "_", "2711", "del", "TTAG"]
    assert [w for w in cut_words("offset") if w] == ["of", "fset"]
    assert len(cut_sentences(TEXT)) == 4
    assert [stem(w) for w in ("Make", "making", "made", "Try", "tried", "tries")] == ["make", "make", "made", "tri", "tri", "tri"]


def test_offsets(spark):
    d = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string")
    got = tokens(d).collect()
    assert got and all(r.doc_id == 1 and TEXT[r.b : r.e] == r.word for r in got)


def test_edges_and_stubs(spark):
    e = entities(spark)
    counts = [relations.edges(e, "e_1", "e_2", d).count() for d in (0, 1, 2, 99)]
    assert counts == [2, 3, 1, 0]
    gold = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (0, 3, 4)], "doc_id long, e1 int, e2 int")
    from pyspark.sql import functions as F

    names = lambda df, a, b, o: df.select("doc_id", F.concat_ws("|", F.least(a, b), F.greatest(a, b)).alias(o))
    g = names(gold, "e1", "e2", "g")
    same, near, any_ = (relations.edges(e, "e_1", "e_2", d) for d in (0, 1, None))
    want = {"same": (1, 1, 2), "near": (3, 2, 0), "any": (3, 3, 0)}
    for name, pairs in (("same", same), ("near", relations.combined([same, near])), ("any", any_)):
        r = evaluate.equal_counts(g, names(pairs, "ent_id1", "ent_id2", "p")).first()
        assert (r.tp, r.fp, r.fn) == want[name]


def test_decode(spark):
    words, labels = "some text c . A 100 G p . V 100 Q some text".split(), "O O B I I I E A I I I E O O".split()
    text, at, rows = "some text c.A100G p.V100Q some text", 0, []
    for i, (w, label) in enumerate(zip(words, labels)):
        at = text.index(w, at)
        rows.append((1, 0, i, w, at, at + len(w), label))
        at += len(w)
    t = spark.createDataFrame(rows, "doc_id long, sent_id int, tok_id int, word string, b int, e int, label string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sorted((r.entity, r.b) for r in annotate.decode(t, docs).collect()) == [("c.A100G", 10), ("p.V100Q", 18)]


def test_measures(spark):
    c = spark.createDataFrame([(3, 4, 5, 3, 3)], "tp int, fp int, fn int, fp_ov int, fn_ov int")
    got = {s: evaluate.measures(c, s).first() for s in ("exact", "overlapping", "half_overlapping")}
    assert [(round(r.precision, 6), round(r.recall, 6)) for r in got.values()] == [(round(3 / 7, 6), round(3 / 8, 6)), (0.9, round(9 / 11, 6)), (0.6, round(6 / 11, 6))]


def test_paths(spark):
    deps = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 0, 2), (1, 0, 2, 3)], "doc_id long, sent_id int, head int, child int")
    pairs = spark.createDataFrame([(1, 0, 1, 3), (1, 0, 3, 1), (1, 0, 2, 2), (1, 0, 1, 9)], "doc_id long, sent_id int, u int, v int")
    got = {(r.u, r.v): r.path for r in graph.shortest_paths(deps, pairs).collect()}
    assert got == {(1, 3): [1, 0, 2, 3], (3, 1): [3, 2, 0, 1], (2, 2): [2], (1, 9): []}


def test_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One.\n\n \n\nTwo.")
    parts = readers.text_files(spark, str(tmp_path)).orderBy("part_ord").collect()
    assert [(p.doc_id, p.part_id, p.text) for p in parts] == [("a.txt", "1", "One."), ("a.txt", "2", "Two.")]
    p = spark.createDataFrame([("7", "A gene.", "It is BRCA1 here.")], "doc_id string, title string, abstract string")
    e = spark.createDataFrame([("7", 0, "gene", 2, 6, "gene", "n1"), ("7", 1, "gene", 14, 19, "BRCA1", "n2")], "doc_id string, ent_id int, class_id string, b int, e int, text string, norm string")
    writers.pubtator(p, e).write.text(str(tmp_path / "pt"))
    got, ents = readers.pubtator(spark, str(tmp_path / "pt"))
    assert sorted((r.part_id, r.text) for r in got.collect()) == [("abstract", "It is BRCA1 here."), ("title", "A gene.")]
    assert sorted((r.part_id, r.b, r.text) for r in ents.collect()) == [("abstract", 6, "BRCA1"), ("title", 2, "gene")]
    html = spark.createDataFrame([("d", '<p id="s1">a</p><p id="s3h">b <i>c</i></p><p id="x">d</p>')], "doc_id string, html string")
    assert [(r.part_id, r.text, r.is_abstract) for r in readers.html_parts(html).orderBy("part_ord").collect()] == [("s1", "a", True), ("s3h", "None", False)]


def test_graphs_of_all_sentences(spark, tmp_path):
    from textloom.plans import catalog

    d = spark.createDataFrame([(1, "One two three four. Five six seven eight nine. Ten."), (2, TEXT), (3, None)], "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = {}
    for r in tokens(d).collect():
        sizes[r.doc_id, r.sent_id] = sizes.get((r.doc_id, r.sent_id), 0) + 1
    assert len(sizes) > 4

    def up(k):
        return [k, *up((k - 1) // 2)] if k else [0]

    depth = {(*key, k): len(up(k)) - 1 for key, n in sizes.items() for k in range(n)}
    hops = {key: len(set(up(1)) ^ set(up(n - 1))) for key, n in sizes.items() if n > 2}
    got = catalog.QUERIES["graph_depth_sentences"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.sent_id, r.tok_id): r.depth for r in got} == depth and len(got) == len(depth)
    got = catalog.QUERIES["graph_shortest_path_sentences"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.sent_id): r.hops for r in got} == hops and len(got) == len(hops)
