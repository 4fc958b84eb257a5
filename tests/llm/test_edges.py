"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import zlib

import numpy as np
import pytest

pytest.importorskip("textloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from textloom.llm import html_text, jaccard_join, mixing, packing, secrets, sharding, token_files, topk_search, toxicity, vector_dedup  # noqa: E402

DOCS = "doc_id long, text string, source string, n_chars long, score double, n long, key string, label string, shard string"
WORDS = "the quick brown fox jumps over the lazy dog and runs far away from every hunter in this dark forest tonight again"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), 0.5, 1, "k", "x", "y") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return docs(spark, [(1, WORDS, "a"), (2, WORDS, "a"), (3, WORDS.upper() + "\n", None), (4, None, "b"), (5, "", "b"), (6, " \t\n", "b"), (7, "two words", "c"), (8, "two  words", "c"), (9, long, "c"), (None, "no id here at all", "a"), (7, "two words", "c"), (10, "café \U0001f600 naïve İstanbul <|endoftext|> don't \x1c x", None)])


def reference_ids(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_packing(spark, odd):
    got = packing.pack(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sum(r.length for r in got) == sum(len(reference_ids(t)) for _, t in rows)
    ids = {d: reference_ids(t) for d, t in rows}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= packing.CAPACITY
    assert packing.pack(odd.limit(0)).count() == 0


def test_token_files(spark, odd, tmp_path):
    token_files.write_token_files(odd, f"file://{tmp_path}/a")
    got = token_files.read_token_files(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or 0, len(i), zlib.crc32(i.tobytes())) for d, i in ((d, reference_ids(t)) for d, t in rows))
    token_files.write_token_files(odd.limit(0), f"file://{tmp_path}/b")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0


def test_coder():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 700_000), 49_000).astype(np.uint32)
    coder = token_files.Coder(token_files.frequencies(np.bincount(ids, minlength=token_files.VOCABULARY_SIZE)))
    for n in (0, 1, 63, 64, 5000, 600_000):
        data = coder.encode(ids[:n])
        assert (coder.decode(data) == ids[:n]).all()
    part = coder.decode(data, 1, 2)
    at = token_files.CHECKPOINT * token_files.LANES
    assert (part == ids[at : at + len(part)]).all() and len(part)
    with pytest.raises(ValueError):
        coder.decode(data[:100] + bytes([data[100] ^ 1]) + data[101:])


def test_jaccard(spark, odd):
    got = {r.doc_id: r for r in jaccard_join.similar(odd).collect()}
    assert len(got) == 11
    assert [got[i].n_similar for i in (1, 2, 3, 4, 5, 6, 9)] == [2, 2, 2, 0, 0, 0, 0]
    assert [got[i].component_id for i in (1, 2, 3, 4, None)] == [1, 1, 1, 4, None]
    assert got[7].n_similar == 1 and got[8].component_id == 7 and got[5].n_shingles == 0 and got[7].n_shingles == 1
    assert sorted((r.doc_id or 0) for r in jaccard_join.deduplicate(odd).collect()) == [0, 1, 4, 5, 6, 7, 9, 10]
    assert jaccard_join.similar(odd.limit(0)).count() == 0


def test_jaccard_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(60)]
        for copy in range(8):
            words = list(base)
            for at in rng.integers(0, 60, copy // 2):
                words[at] = f"e{rng.integers(1000)}"
            rows.append((len(rows), " ".join(words), "s"))
    sets = {}
    for i, t, _ in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    links = {i: sum(j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    assert {r.doc_id: r.n_similar for r in jaccard_join.similar(docs(spark, rows)).collect()} == links


def test_jaccard_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"d{k}w{i}" for i in range(30))
    near = lambda k: text(k) + " end"
    rows = [*((None, text(k), "s") for k in range(40)), (None, near(0), "s"), (None, near(1), "s"), (5, near(1) + " more", "s"), (7, text(50), "s"), (7, text(51), "s"), (8, near(51), "s"), (None, None, "s"), (None, "", "s"), (9, None, "s"), (9, " ", "s")]
    d = docs(spark, rows)
    got = jaccard_join.similar(d).filter("n_shingles > 0").collect()
    assert sorted(r.n_similar for r in got if r.doc_id is None) == [0] * 38 + [1, 1, 2, 2]
    assert [(r.n_similar, r.component_id) for r in got if r.doc_id == 5] == [(2, 5)] and sorted(r.component_id or 0 for r in got if r.doc_id is None) == [0] * 40 + [5, 5]
    assert sorted((r.n_similar, r.component_id) for r in got if r.doc_id in (7, 8)) == [(0, 7), (1, 7), (1, 7)]
    kept = [(r.doc_id, r.text) for r in jaccard_join.deduplicate(d).collect()]
    group = {near(0): text(0), near(1): text(1), near(1) + " more": text(1), near(51): text(51)}
    assert sorted(group.get(t, t) for _, t in kept if t and t.strip()) == sorted(text(k) for k in (*range(40), 50, 51))
    assert sorted(((i or 0), t or "") for i, t in kept if not (t and t.strip())) == [(0, ""), (0, ""), (9, ""), (9, " ")]


def test_mixing(spark, odd):
    def planned(d):
        rows, p = mixing.plan(d)
        return rows.select("doc_id", "source", *(F.col(p + c).alias(c) for c in ("size", "source_size", "target", "copies"))).collect()

    got = planned(odd)
    assert len(got) == 12 and all(0 <= r.copies <= 3 for r in got)
    assert all(r.target <= 3 * r.source_size + 1e-6 for r in got)
    assert sorted(got, key=repr) == sorted(planned(odd.repartition(5)), key=repr)
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0


def test_sharding(spark, odd):
    table = sharding.lookup()
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    got = sharding.assign(odd)
    assert got.count() == 12 and got.filter(F.col("shard").isNull()).count() == 0 and sharding.assign(odd.limit(0)).count() == 0
    moved = sum(a != b for a, b in zip(table, sharding.lookup(sharding.SHARDS[:-1])))
    assert moved < len(table) / 3


def test_secrets(spark):
    key = "AKIA" + "QZ7PLM3XNV2KTWRB"
    d = docs(spark, [(1, f"the key is {key} and again {key} here", "a"), (2, "write to anna.k.12@mail8.example.com or 4193803191787627", "a"), (3, None, "a"), (4, "", None), (5, 'token = "0b4c9d1e7f3a5b6c8d2e4f60718293a4b5c6d7e8"', "b")])
    got = {(r.doc_id, r.candidate): r.is_secret for r in secrets.scan(d).collect()}
    assert got[(1, key)] and got[(5, "0b4c9d1e7f3a5b6c8d2e4f60718293a4b5c6d7e8")] and not any(v for (i, _), v in got.items() if i == 2)
    out = {r.doc_id: r for r in secrets.redact(d).collect()}
    assert out[1].text == "the key is [SECRET] and again [SECRET] here" and out[1].n_chars == len(out[1].text)
    assert out[2].text.startswith("write to anna") and out[3].text is None and out[4].text == ""
    assert secrets.scan(d.limit(0)).count() == 0


def test_redaction_judges_every_occurrence(spark):
    key = "0b4c9d1e7f3a5b6c8d2e4f60718293a4b5c6d7e8"
    calm, loud = f"see commit {key} of may", f'then much further below there stands token = "{key}" was set'
    filler = " ".join(f"https://www.abc.com/xyz/{i}" for i in range(1000, 1200))
    d = docs(spark, [(1, f"{calm} {filler} {loud}", "a"), (2, f"{loud} {filler} {calm}", "a"), (3, calm, "a"), (4, f"x{key} {loud}", "a")])
    out = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    gone = lambda t: t.replace(key, "[SECRET]")
    assert out[3] == calm and out[1] == gone(f"{calm} {filler} {loud}") and out[2] == gone(f"{loud} {filler} {calm}")
    assert key not in out[4]


def test_toxicity(spark):
    rows, labels = [], []
    rng = np.random.default_rng(9)
    for i in range(400):
        words = [f"word{rng.integers(500)}" for _ in range(30)]
        if i % 4 == 0:
            words[int(rng.integers(30))] = ("zorgle", "idiot", "blarg")[i % 3]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    d = docs(spark, [*rows, (None, "zorgle", "s"), (1000, None, "s"), (1001, "", None)])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (2000, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(400))
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    assert got[1000].predicted == got[1001].predicted == 0
    assert toxicity.score(d.limit(0), lab).count() == 0 and toxicity.score(d, lab.limit(0)).count() == 403


def test_shouting_counts_the_whole_text():
    vote = lambda t: toxicity.Lexicon().read(t.encode())[0][toxicity.VOTERS.index("shouting")]
    calm, loud = "quiet lower words " * 150, "GO AWAY NOW!!!!! " * 400
    assert vote(calm + loud) == toxicity.TOXIC and vote(loud[:2100] + calm * 3) == toxicity.NONE
    assert vote("УБИРАЙСЯ!!!!! " * 3) == toxicity.TOXIC and vote("убирайся!!!!! " * 3) == vote("") == toxicity.NONE
    assert vote("HUSH HUSH!!!!!") == toxicity.TOXIC


VEC = "vec_id long, embedding array<float>, label int, score double"


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("float32").tolist(), i % 3) for i in range(300)]
    rows += [(300 + i, (np.array(rows[i][1]) * 2 + rng.normal(size=8) * 0.02).tolist(), i % 3) for i in range(60)]
    rows += [(400, rows[0][1], 0), (401, None, 0), (402, [0.0] * 8, 0), (403, [float("nan")] * 8, 1), (404, [None] * 8, 1), (405, rows[1][1], None), (400, rows[0][1], 0), (None, rows[5][1], 2)]
    return rows, spark.createDataFrame([(*r, 0.1) for r in rows], VEC)


def fine(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_top_k(spark):
    rows, df = vectors(spark)
    ok = [(i, np.floor(256 * np.array(v, "float32").astype(float)).astype(int)) for i, v, _ in rows if i is not None and fine(v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted(((-int(v @ c), i) for i, c in ok if i != q))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()) == sorted(want)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_vector_dedup(spark):
    rows, df = vectors(spark)
    unit = [np.array(v, "float32").astype(float) / np.linalg.norm(np.array(v, "float32").astype(float)) if fine(v) and any(v) and lab is not None else None for _, v, lab in rows]
    links = [sum(a is not None and b is not None and i != j and rows[i][2] == rows[j][2] and a @ b >= 0.98 for j, b in enumerate(unit)) for i, a in enumerate(unit)]
    got = vector_dedup.near_copies(df).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.vec_id), r.n_links) for r in got) == sorted((key(rows[i][0]), n) for i, n in enumerate(links))
    assert vector_dedup.near_copies(df.limit(0)).count() == 0


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li>Home</ul></nav><div class='cookie-notice'>We use</div><article><h1>Title &amp; more</h1><p>First <b>bold\n text.<br><p>Second&nbsp;one.</p><script>var a='<p>x</p>'</script></article><section id=comments><p>nice</p></section><footer>f</footer></body></html>"
    plain = "<body><p>Site menu words</p><p>Own text {}</p><p>All rights reserved</p></body>"
    rows = [(1, "http://a.example/x", page), (2, None, None), (3, "bad", ""), *((10 + i, f"https://b.example/{i}", plain.format(f"{i} here")) for i in range(6)), (1, "http://a.example/x", page)]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n long")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert html_text.extract(df).count() == len(rows)
    assert got[1].text == "Title & more\n\nFirst bold text.\n\nSecond one." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[12].text == "Own text 2 here"
    assert html_text.extract(df.limit(0)).count() == 0
