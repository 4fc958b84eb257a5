"""Mutation labels, merging of annotators, readers of further corpora, pair features, a field and a machine."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import words as fw
from textloom.operators import annotate, edge_features, evaluate, features, learn, relations
from textloom.sources import readers, writers

ENT = "doc_id long, ent_id int, class_id string, b int, e int, text string"


def test_mutation_labels(spark):
    text = "some text ... (c.2708_2711delTTAG, p.V903GfsX905) ... text"
    t = fw.tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    ents = spark.createDataFrame([(1, 0, "m", 15, 33, "c.2708_2711delTTAG"), (1, 1, "m", 35, 48, "p.V903GfsX905")], ENT)
    got = [r.label for r in annotate.tmvar_labels(t, ents, "m").orderBy("tok_id").collect()]
    assert got[got.index("A") :][:7] == ["A", "I", "P", "P", "P", "T", "W"]
    assert [x for x in got if x != "O"][7:] == ["A", "I", "W", "P", "I", "M", "P"]


def test_merging_annotators(spark):
    rows = [("1", "p", "a", 0, "c", 0, "gene one"), ("1", "p", "a", 1, "c", 20, "x"), ("1", "p", "b", 0, "c", 0, "gene"), ("1", "p", "b", 1, "c", 40, "yy")]
    e = spark.createDataFrame(rows, "doc_id string, part_id string, annotator string, ent_id int, class_id string, b int, text string")
    found = lambda *a, **k: sorted((r.b, r.text) for r in annotate.merge_annotators(e, *a, **k).collect())
    assert found("union", "shortest") == [(0, "gene"), (20, "x"), (40, "yy")]
    assert found("intersection", "longest") == [(0, "gene one")]
    assert found("union", "priority", order=["b", "a"]) == [(0, "gene"), (20, "x"), (40, "yy")]


def test_prose():
    assert fw.words_of_prose("They don't say it's Dr. Smith's, isn't it?") == ["They", "do", "n't", "say", "it", "'s", "Dr", ".", "Smith", "'s", ",", "is", "n't", "it", "?"]
    assert fw.sentences_of_prose('Dr. Smith left. He said "No." Then e.g. this. End') == ["Dr. Smith left.", 'He said "No."', "Then e.g. this.", "End"]


def test_any_tokenizer(spark):
    text = "One two. Two one!"
    got = fw.tokens_by(spark.createDataFrame([(1, text)], "doc_id long, text string"), fw.sentences_of_prose, fw.words_of_prose).orderBy("tok_id").collect()
    assert [text[r.b : r.e] for r in got] == [r.word for r in got] == ["One", "two", ".", "Two", "one", "!"] and [r.sent_id for r in got] == [0, 0, 0, 1, 1, 1]


def test_readers(spark, tmp_path):
    at = lambda name, text: ((tmp_path / name).parent.mkdir(exist_ok=True, parents=True), (tmp_path / name).write_text(text))
    at("v/PMC1-01-Abstract.txt", "** IGNORE LINE **\nThe gene A.\n\nA mutation V1M here.\n\n")
    at("v/PMC1-01-Abstract.ann", "T1\tgene 22 28\tgene A\nT2\tmutation 42 45\tV1M\nT3\tdisease 0 1\tx\n")
    parts, ents = readers.variome(spark, str(tmp_path / "v"), {"gene": "g", "mutation": "m"})
    text = {r.part_id: r.text for r in parts.collect()}
    assert text == {"01-Abstract-p1": "The gene A.", "01-Abstract-p2": "A mutation V1M here."}
    assert sorted((r.class_id, r.part_id, text[r.part_id][r.b : r.e]) for r in ents.collect()) == [("g", "01-Abstract-p1", "gene A"), ("m", "01-Abstract-p2", "V1M")]
    at("s/7.ann", "T1\tSNP 3 6\tabc\nT2\tGene 12 14\txy\nR1\tx\n")
    titles = spark.createDataFrame([("7", "0123456789")], "doc_id string, title string")
    assert sorted((r.part_id, r.class_id, r.b) for r in readers.seth_annotations(spark, str(tmp_path / "s"), "m", "g", titles).collect()) == [("abstract", "g", 1), ("title", "m", 3)]
    at("r/x.tsv", "9\tMutation\t10\t15\tAsp\t4\tAla\tD483A\n9\tOther\t1\t2\ta\tb\tc\tq\n")
    assert [tuple(r) for r in readers.protein_residues(spark, str(tmp_path / "r"), {"Mutation": "m"})[1].collect()] == [("9", "Mutation|10|15", "m", 10, 15, "D483A")]
    at("o/x.xml", "<Corpus><Article><Pmid>5</Pmid><Title>On <variant>A1B</variant> in <gene>g</gene>.</Title><Abstract/></Article><Article><Pmid>6</Pmid><Title>T</Title><Abstract>x<variant>C</variant></Abstract></Article></Corpus>")
    parts, ents = readers.osiris(spark, str(tmp_path / "o/x.xml"), "m")
    assert sorted((r.doc_id, r.part_id, r.text) for r in parts.collect()) == [("5", "abstract", ""), ("5", "title", "On A1B in g."), ("6", "abstract", "xC"), ("6", "title", "T")]
    assert sorted((r.doc_id, r.b, r.text) for r in ents.collect()) == [("5", 3, "A1B"), ("6", 1, "C")]
    at("w/a.txt", "11\n\nA title x\n\nBody A 12 T end")
    at("w/a.txt.ann", '<R><Annotation><Annotation type="v" span="20..21"/><Annotation type="v" span="22..24"/><Annotation type="ge" span="4..5"/></Annotation></R>')
    assert [(r.part_id, r.b, r.text) for r in readers.osiris_spans(spark, str(tmp_path / "w"), "m")[1].collect()] == [("abstract", 5, "A 12")]
    js = '{"sourceid": "3", "text": "The V1M.", "denotations": [{"span": {"begin": 4, "end": 7}, "obj": "tmVar:x"}]}'
    assert [(r.doc_id, r.text) for r in readers.denotations(spark.createDataFrame([(js,)], "value string"), "m")[1].collect()] == [("3", "V1M")]
    g = readers.genes(spark.createDataFrame([("1", 0, 2, "ab", "tax:123"), ("1", 0, 2, "ab", "123")], "doc_id string, b int, e int, text string, norm string"))
    m = spark.createDataFrame([("123", "P2"), ("123", "P1")], "gene_id string, uniprot_id string")
    assert [r.norms for r in readers.tag_genes(g, m, "g").collect()] == [{"gene": "123", "uniprot": "P1,P2"}]
    a, b = (readers.cached(spark, str(tmp_path / "c"), lambda n=n: spark.range(n)).count() for n in (3, 5))
    assert a == b == 3


def test_console_and_statistics(spark):
    p = spark.createDataFrame([("1", "s1", 0, "The gene V1M.")], "doc_id string, part_id string, part_ord int, text string")
    e = spark.createDataFrame([("1", "s1", "g", 4, 8, "gene"), ("1", "s1", "m", 9, 12, "V1M")], "doc_id string, part_id string, class_id string, b int, e int, text string")
    r = spark.createDataFrame([("1", "s1", "gene", "V1M")], "doc_id string, part_id string, text1 string, text2 string")
    plain, color = (writers.console(p, e, r, "g", "m", c).first().value for c in (False, True))
    assert plain.split("\n") == ["PART s1", "The gene V1M.", "ANNOTATIONS", "GGP      4  8  gene", "Mutation 9  12 V1M", "RELATIONS", "gene ---> V1M"]
    assert "The \x1b[42mgene\x1b[0m \x1b[41mV1M\x1b[0m." in color
    assert 0 < writers.deviation(30, 100)[1] < 1 and evaluate.header(se=True).endswith("e|P\te|R\te|F\te|F_SE")


def test_window_list(spark):
    t = spark.createDataFrame([(1, 0, i, "a", "b") for i in range(3)], "doc_id long, sent_id int, tok_id int, a string, b string")
    assert [c for c in features.window(t, ["a", "b"], (-2, 1), ["a"]).columns if "[" in c] == ["a[-2]", "a[1]"]


def test_paths_of_two_sentences(spark):
    col = "doc_id long, sent_id int, tok_id int, word string, lemma string, tag string, dep string, head int, depth int, is_punct boolean, is_root boolean, b int, e int"
    toks = [(1, 0, 0, "Alpha", "alpha", "NNP", "nsubj", 1, 1, False, False, 0, 5), (1, 0, 1, "binds", "bind", "VBZ", "ROOT", None, 0, False, True, 6, 11), (1, 1, 2, "not", "not", "RB", "neg", 3, 1, False, False, 13, 16), (1, 1, 3, "seen", "see", "VBN", "ROOT", None, 0, False, True, 17, 21), (1, 1, 4, "42", "42", "CD", "dobj", 3, 1, False, False, 22, 24)]
    ents = spark.createDataFrame([(1, 0, "P", 0, 5, "Alpha", 0), (1, 1, "Q", 22, 24, "42", 1)], ENT + ", sent_id int")
    f = edge_features.with_path(edge_features.links(edge_features.frame(relations.edges(ents, "P", "Q", 1), spark.createDataFrame(toks, col), ents)))
    r = f.first()
    assert (r.path, r.kinds, r.ways) == ([0, 1, 3, 4], ["nsubj", "rootDepForward", "dobj"], ["B", "F", "F"]) and (r.first1, r.last2) == (0, 4)
    names = {x.name for x in edge_features.dependency_path_features(f, (1, 2)).collect()}
    n = "DependencyFeatureGenerator::pd_PD_"
    assert {n + "bow_N_gram_PD_2_<[SOURCE ~~ bind>_[0]", n + "full_N_gram_PD_1_<[SOURCE nsubj-B>_[0]", n + "directed_edges_N_gram_PD_2_<rootDepForward-F ~~ dobj-F>_[0]", n + "bow_N_gram_PD_1_<see>_[0]"} <= names
    got = {(x.name, x.value) for x in edge_features.sentence_features(f, ents).collect()}
    assert {("SentenceFeatureGenerator::sentence_is_negated_sentence_is_negated_[0]", 1.0), ("SentenceFeatureGenerator::main_verbs_main_verbs_see_[0]", 1.0), ("SentenceFeatureGenerator::bow_bow_P_[0]", 1.0)} <= got
    assert edge_features.path_features(f).count() > 20 and edge_features.head_chains(f).count() > 20 and edge_features.window_features(f).count() > 4


def test_field_by_brute_force():
    rng = np.random.default_rng(1)
    unary, trans = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    score = lambda s: sum(unary[i, y] for i, y in enumerate(s)) + sum(trans[a, b] for a, b in zip(s, s[1:]))
    every = {s: score(s) for s in itertools.product(range(3), repeat=4)}
    total, one, _ = learn.forward_backward(unary, trans)
    assert tuple(learn.viterbi(unary, trans)) == max(every, key=every.get) and abs(total - np.log(sum(np.exp(list(every.values()))))) < 1e-9
    assert abs(one[2, 1] - sum(np.exp(v - total) for s, v in every.items() if s[2] == 1)) < 1e-9


def test_field_and_machine(spark):
    rows = [(d, 0, i, f"w{(d * 7 + i) % 11}", "B" if (d * 7 + i) % 11 < 3 else "O") for d in range(60) for i in range(8)]
    t = spark.createDataFrame(rows, "doc_id long, sent_id int, tok_id int, word string, label string")
    model = learn.train_crf(learn.sentences(t.filter("doc_id < 40"), ["word"], "label"), 3)
    held = t.filter("doc_id >= 40")
    got = learn.tag_crf(learn.sentences(held, ["word"]), model).withColumnRenamed("label", "told").join(held, ["doc_id", "sent_id", "tok_id"])
    assert got.filter("told = label AND confidence > 0.5").count() == 160
    pairs = [(1, i, 0, "x" if i % 3 == 0 else "y", 1.0 + i % 2) for i in range(30)]
    f = spark.createDataFrame(pairs, "doc_id long, ent_id1 int, ent_id2 int, name string, value double")
    v = features.vocabulary(f)
    rows = learn.vectors(f, v, 2).withColumn("real_target", F.when(F.col("ent_id1") % 3 == 0, 1).otherwise(-1))
    assert learn.Svm().train(rows).annotate(rows).filter("pred_target <> real_target").count() == 0
    assert {r["real_target"]: r["count"] for r in learn.undersampled(rows).groupBy("real_target").count().collect()} == {1: 10, -1: 10}


def test_paths_are_those_of_one_search_each(spark):
    """Random graphs with loops, double links and parts that don't meet; several pairs a sentence, some of tokens without links."""
    import random

    from textloom.operators import graph

    rng = random.Random(9)
    rows, want = [], {}
    for d in range(60):
        n = rng.randint(1, 9)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 12))]
        pairs = [(rng.randrange(n + 1), rng.randrange(n + 1)) for _ in range(rng.randint(0, 5))]
        rows.append((d, d % 3, links if links or d % 2 else None, pairs))
        near = graph._near(*([x[i] for x in links] for i in (0, 1)))
        for u, v in pairs:
            dist, back = graph.bfs(near, [u])
            path = [v] if v in dist else []
            while path and path[-1] != u:
                path.append(back[path[-1]])
            want.setdefault((d, u, v), []).append(path[::-1])
    sentences = spark.createDataFrame(rows, "doc_id long, sent_id int, links array<struct<head:int,child:int>>, pairs array<struct<u:int,v:int>>")
    for size in (1 << 22, 7):
        graph.NODES, kept = size, graph.NODES
        got = {}
        for batch in graph._path_batches(sentences.toArrow().to_batches()):
            for r in batch.to_pylist():
                got.setdefault((r["doc_id"], r["u"], r["v"]), []).append(r["path"])
        graph.NODES = kept
        assert got == want
    assert sum(map(len, want.values())) == graph.shortest_paths_in(sentences).count()


def test_a_long_chain_from_end_to_end():
    import numpy as np

    from textloom.operators import graph

    n = 1000
    ends, to = np.append(np.arange(n - 1), np.arange(1, n)), np.append(np.arange(1, n), np.arange(n - 1))
    first = np.append(0, np.cumsum(np.bincount(ends, minlength=n)))
    path, length = graph._search(first, to[np.lexsort((to, ends))], np.array([0]), np.array([n - 1]), np.array([0]), np.array([n]))
    assert path.tolist() == list(range(n)) and length.tolist() == [n]
