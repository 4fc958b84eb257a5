"""Repeated and null ids, extreme values, brute force of templates, bins, places and the pipeline, clashing names."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest

pytest.importorskip("textloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from textloom.llm import html_text, jaccard_join, mixing, packing, secrets, token_files, topk_search, toxicity, vector_dedup  # noqa: E402
from textloom.llm.common import mark, materialize, release, scratch_path  # noqa: E402

from .test_edges import docs, reference_ids  # noqa: E402


def test_vectors_of_null_and_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [0.0, -1.0, 0.5]
    near = lambda v: [x + 0.001 for x in v]
    rows = [(None, a, 1), (None, b, 1), (5, near(a), 1), (6, near(b), 1), (6, c, 1), (7, [1e-200, 0.0, 0.0], 2), (8, [2e-200, 0.0, 0.0], 2), (9, [1e200, 0.0, 0.0], 2), (None, [5.0, 5.0, 5.0], 3)]
    got = vector_dedup.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (0, 1, 5, False), (0, 1, 6, False), (5, 1, 5, True), (6, 0, 6, True), (6, 1, 6, True), (7, 2, 7, True), (8, 2, 7, False), (9, 2, 7, False)]


def test_vector_tree_of_intervals(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(240, 3))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    monkeypatch.setattr(vector_dedup, "TOP", 2)
    monkeypatch.setattr(vector_dedup, "FAN", 3)
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vector_dedup, "INTERVAL_BYTES", 1)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_copies(rows).collect()}
    assert got == {i: int((unit @ unit[i] >= 0.98).sum()) - 1 for i in range(len(m))}


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, 0.0]), (2, [-1e17, 0.0]), (3, [1e300, 1.0]), (4, [0.5, 0.0])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 4).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2**63 - 1), (3, 2**63 - 1), (4, 2**63 - 1), (2, -(2**63))]


def test_bins_are_those_of_plain_first_fit():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 700):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], np.empty(n, int)
        for i in np.argsort(-sizes, kind="stable"):
            at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [100] * (at == len(room))
            room[at] -= sizes[i]
            want[i] = at
        assert bins.tolist() == want.tolist() and all(o >= 0 for o in offsets)


def test_reading_a_file_in_parts(tmp_path):
    rng = np.random.default_rng(6)
    sizes = [1, 300_000, 5, 900_000, *rng.integers(1, 4000, 300).tolist()]
    ids = [rng.integers(0, 3000, n).astype(np.uint32) for n in sizes]
    coder = token_files.Coder(token_files.frequencies(np.bincount(np.concatenate(ids), minlength=token_files.VOCABULARY_SIZE)))
    w = token_files.Writer(f"{tmp_path}/x.rans", coder, 17)
    for i, x in enumerate(ids):
        w.add(None if i == 2 else i, x)
    w.close()
    whole = list(token_files.documents_of(f"{tmp_path}/x.rans", coder))
    assert [(n, c) for _, _, n, c in whole] == [(len(x), zlib.crc32(x.astype("<u4").tobytes())) for x in ids] and whole[0][1] == 17
    for parts in (2, 5, 400):
        assert [r for p in range(parts) for r in token_files.documents_of(f"{tmp_path}/x.rans", coder, p, parts)] == whole


def brute_template(sources):
    pages = {tuple(html_text.Page(s).tokens) for s in sources}
    if len(pages) < html_text.LEAST_PAGES:
        return set()
    pages = [list(p) for p in pages]
    counts = [Counter(p) for p in pages]
    classes = defaultdict(set)
    for t in set().union(*counts):
        vector = tuple(c[t] for c in counts)
        if sum(map(bool, vector)) >= max(2, html_text.SUPPORT * len(pages)):
            classes[vector].add(t)
    ordered = {}
    for vector, toks in classes.items():
        orders = {html_text.order_of([t for t in p if t in toks]) for p, n in zip(pages, vector) if n}
        if len(orders) == 1 and None not in orders:
            ordered[vector] = orders.pop()
    states = defaultdict(set)
    for p in pages:
        for c, d, state in html_text.nesting(p, {v: o for v, o in ordered.items() if set(o) & set(p)}):
            states[c, d].add(state)
    rank = lambda v: (sum(map(bool, v)), len(ordered[v]))
    bad = {c if rank(c) < rank(d) else d for (c, d), s in states.items() if (len(s) > 1 or html_text.CROSSED in s) and rank(c) != rank(d)}
    return {t for v, o in ordered.items() if v not in bad for t in o}


def test_templates_by_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(10**9)}"
    sources = []
    for i in range(14):
        items = "".join(f"<li><b class=k>{word()}</b><i class=v>{word()}</i></li>" for _ in range(int(rng.integers(1, 5))))
        note = "<p class=x>Please read our rules</p>" if i % 5 else ""
        sources.append(f"<html><body><nav>Home</nav><article><h1>{word()}</h1><p>Sign up for our letter</p><p>{word()} {word()}</p><ul>{items}</ul>{note}</article><div>All rights reserved</div></body></html>")
    df = spark.createDataFrame([(i, f"http://h.example/{i}", s) for i, s in enumerate(sources)] + [(99, "http://h.example/99", sources[0])], "page_id long, url string, html string")
    rows = df.select(F.lit(1).cast("long").alias("host"), "html")
    fixed = set(html_text.templates(rows).first().fixed)
    assert fixed == brute_template(sources) and fixed
    text = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for i, s in enumerate(sources):
        assert not re.search("Sign up|Please read|All rights|Home", text[i]) and all(w in text[i] for w in re.findall(r"w\d+", s))
    assert text[99] == text[0]


def test_deep_and_broken_pages():
    deep = html_text.Page("<div>" * 30_000 + "<p>in" + "</b>" * 5000)
    assert deep.text(set()) == "in" and html_text.Page("<a <a <a " * 2000).text(set()).count("<a") == 6000
    assert html_text.order_of([1, 2, 1, 2]) == (1, 2) and html_text.order_of([1, 2, 2, 1]) is None and html_text.order_of([1, 1]) == (1,)
    assert set(html_text.nesting([1, 5, 2], {10: (1, 2), 11: (5,)})) == {(11, 10, 0)}
    assert (12, 10, html_text.CROSSED) in set(html_text.nesting([1, 3, 2, 4], {10: (1, 2), 12: (3, 4)}))


def test_every_occurrence_has_its_place(spark):
    key = "0b4c9d1e7f3a5b6c8d2e4f60718293a4b5c6d7e8"
    texts = [f'commit {key} and then token = "{key}" end', "password: hun!ter#2x and pwd=example", "-----BEGIN RSA PRIVATE KEY-----\nabc", "AKIA" + "QZABLMNXNVCKTWRB", None, "", "é" * 30 + " ".join(f"https://www.abc.com/xyz/{i}" for i in range(3000)), "x \x1f " + key]
    d = docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumnRenamed("key", "_work")
    got = secrets.scan(d).collect()
    assert all(texts[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate for r in got)
    assert [r.is_secret for r in sorted(got, key=lambda r: r.start) if r.doc_id == 0] == [False, True]
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert "hun!ter#2x" in {r.candidate for r in by[1]} and by[2][0].is_secret and by[3][0].is_secret and len(by[6]) == 3000
    out = {r.doc_id: r for r in secrets.redact(d).collect()}
    assert key not in out[0].text and out[0]._work == "k" and out[4].text is None and out[6].text == texts[6] and "[SECRET]" in out[2].text


def test_rates_on_formats_held_out():
    precision, recall = secrets.held_out_rates()
    assert precision > 0.75 and recall > 0.8


def test_mix_of_null_ids_and_clashing_names(spark):
    rows = [(None, f"a {'b ' * (i % 3)}", "s") for i in range(30)] + [(1, "same text", "t"), (1, "same text", "t")]
    d = docs(spark, rows).withColumnsRenamed({"key": "_mixsize", "label": "_mixcopies"})
    a, b = (sorted(map(repr, mixing.mix(x).collect())) for x in (d, d.repartition(7)))
    assert a == b and mixing.mix(d).columns == d.columns


def test_training_does_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(80)}" for _ in range(20)) + (" zorgle blarg" if i % 4 == 0 else "") for i in range(200)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1000 + i, texts[0], "s") for i in range(20)] + [(5000, "calm " * 40_000, "s")]
    lab = spark.createDataFrame([(i, 1, int("zorgle" in t)) for i, t, _ in rows], "doc_id long, quality int, toxic int")
    d = docs(spark, rows).withColumnRenamed("key", "_toxicity")
    one, two = ({r.doc_id: r.score for r in toxicity.score(x, lab).collect()} for x in (d, d.orderBy(F.desc("doc_id")).repartition(3)))
    assert one == two and one[5000] < 0.5 < one[4]
    assert {r.doc_id for r in toxicity.reject(d, lab).collect()} == {i for i, s in one.items() if s < 0.5}


def test_scratch_is_released(spark):
    since = mark()
    a = materialize(spark.range(3), "a")
    b = materialize(a, "b")
    release(spark, since, b)
    assert b.count() == 3 and len(a.inputFiles()) and mark() == since + 1
    with pytest.raises(Exception):
        spark.read.parquet(a.inputFiles()[0]).count()
    scratch_path(spark, "unused")


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(320):
        words = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(8, 60)))]
        if i % 4 == 0:
            words[3:4] = [("zorgle", "idiot", "blarg")[i % 3]]
        rows.append((i, " ".join(words), ("a", "b", None)[i % 3 if i % 3 != 2 or i % 6 == 2 else 0]))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(400 + i, rows[i][1], "b") for i in range(1, 8)] + [(500, 'my token = "0b4c9d1e7f3a5b6c8d2e4f60718293a4b5c6d7e8" is set', "a"), (501, None, "b"), (None, "an odd row without an id", "a"), (502, "", None)]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    toxic = {(r.doc_id) for r in toxicity.score(read("documents"), read("labels")).collect() if r.predicted}
    assert toxic <= {i for i, _, _ in rows if i is not None and i % 4 == 0} and len(toxic) > 60
    kept, seen = [], set()
    for i, t, s in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):  # copies here are equal texts
        if i in toxic or (t and t in seen):
            continue
        seen.add(t)
        kept.append((i, (t or "").replace("0b4c9d1e7f3a5b6c8d2e4f60718293a4b5c6d7e8", "[SECRET]"), s, t))
    size = lambda t: len(t.split())
    by = defaultdict(list)
    for r in kept:
        by[r[2]].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    totals, weight = {s: sum(size(r[1]) for r in by[s]) for s in names}, {s: 1 + k % 3 for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(totals.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 3 * totals[s]]
        for s in full or open_.copy():
            target[s] = 3.0 * totals[s] if full else share[s]
            left -= target[s]
            open_.discard(s)
    want = Counter()
    for s in names:
        u = int(md5(("null" if s is None else f"source {s}").encode()).hexdigest()[:4], 16) / 65536
        rate = target[s] / totals[s] if totals[s] else 0.0
        order = lambda r: md5(f"{'null' if r[0] is None else r[0]}|{md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
        for k, r in enumerate(sorted(by[s], key=lambda r: (-size(r[1]), order(r))), 1):
            copies = min(3, math.floor(rate * k + u) - math.floor(rate * (k - 1) + u)) if size(r[1]) else 0
            ids = reference_ids(r[1])
            want[r[0], len(ids), zlib.crc32(ids.tobytes())] += copies
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in got) == +want  # all texts are shorter than a sequence
    rooms = defaultdict(int)
    for r in got:
        rooms[r.sequence_id] += r.length
    assert max(rooms.values()) <= packing.CAPACITY and len(jaccard_join.__doc__) > 0
