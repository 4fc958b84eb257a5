"""Word functions: the piecewise tokenizer, sentence boundaries, stems, number and noun tests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT, BREAK = "\x1f", "\x1e"
#: Applied in order; pieces between the cuts are the text again.
RULES = (
    ("([0-9])([A-Za-z])", r"\1\x1f\2"),
    ("([a-z])([A-Z])", r"\1\x1f\2"),
    ("([A-Za-z])([0-9])", r"\1\x1f\2"),
    ("([a-z])(fs)", r"\1\x1f\2"),
    ("([^\x00-\x7f])", r"\x1f\1\x1f"),
    ("([^A-Za-z0-9_\x1f\x80-\U0010ffff]|[\\-_])", r"\x1f\1\x1f"),
)
_RULES = [(re.compile(p), r.replace(r"\x1f", CUT)) for p, r in RULES]
_SENTENCE = re.compile(r"([.!?][ \n]+)")


def cut_sentences(text: str) -> list[str]:
    """Sentences with the white space that ends them."""
    return [s for s in _SENTENCE.sub(rf"\1{BREAK}", text).split(BREAK) if s]


def cut_words(text: str) -> list[str]:
    for pattern, to in _RULES:
        text = pattern.sub(to, text)
    return text.split(CUT)


#: What a byte of a text is: blank, digit, capital, small letter, any other sign, the rest of a sign of several bytes.
BLANK, DIGIT, CAPITAL, SMALL, SIGN, REST = range(6)
KIND = np.full(256, SIGN, np.uint8)
KIND[[*range(9, 14), *range(28, 33)]] = BLANK
KIND[48:58], KIND[65:91], KIND[97:123], KIND[128:192] = DIGIT, CAPITAL, SMALL, REST
_BLANKS = sorted(int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Bytes of text that are cut at once, but for a longer text.
SLICE = 1 << 20


class Words(NamedTuple):
    """The words of several texts, in order: the texts' bytes, each word's text, sentence and number in it, its bytes and its code points in it."""

    data: np.ndarray
    row: np.ndarray
    sent: np.ndarray
    tok: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    b: np.ndarray
    e: np.ndarray

    def texts(self, some: np.ndarray | None = None) -> pa.Array:
        """The words, or those of a boolean mask."""
        lo, hi = (self.lo, self.hi) if some is None else (self.lo[some], self.hi[some])
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[lo] += 1
        inside[hi] -= 1
        offsets = np.zeros(len(lo) + 1, np.int32)
        np.cumsum(hi - lo, out=offsets[1:])
        return pa.Array.from_buffers(pa.string(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[np.cumsum(inside[:-1], dtype=np.int8) > 0])])


def cut(texts: pa.Array) -> Words:
    """The words that ``cut_words`` gives in the sentences of ``cut_sentences``, found in passes over the bytes of all texts together."""
    texts = texts.cast(pa.string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    none = np.zeros(0, np.int64)
    if not len(data):
        return Words(data, none, none, none, none, none, none, none)
    kind, head = KIND[data], np.zeros(len(data) + 1, bool)
    head[off] = True
    head = head[:-1]
    wide = data >= 0x80
    points = None
    if wide.any():
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind != REST, out=points[1:])
        for lead, n in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
            at = np.flatnonzero(data == lead)
            code = np.zeros(len(at), np.int64)
            for i in range(n):
                code = code << 8 | data[at + i]
            for i in range(n):
                kind[at[np.isin(code, _BLANKS)] + i] = BLANK
    before = np.roll(kind, 1)
    start = (kind > BLANK) & (kind < REST) & (head | (kind == SIGN) | ((kind != before) & ~((kind == SMALL) & (before == CAPITAL))))
    fs = np.flatnonzero((kind[:-2] == SMALL) & (data[1:-1] == 102) & (data[2:] == 115) & ~start[1:-1] & ~start[2:])
    if len(fs) > 1 and (np.diff(fs) == 2).any():  # matches don't overlap: of a row of them every other counts
        kept, last = [], -9
        for x in fs.tolist():
            if x > last + 2:
                kept.append(x)
                last = x
        fs = np.array(kept)
    start[fs + 1] = True
    lo = np.flatnonzero(start)
    inside = np.append(kind > BLANK, False)
    hi = np.flatnonzero(inside[:-1] & (np.append(start[1:], False) | ~inside[1:])) + 1
    gap = (data == 32) | (data == 10) | (data == 31) | (data == 30)
    opens = np.flatnonzero(gap & (head | ~np.roll(gap, 1)))
    ends = np.flatnonzero(gap & np.append(head[1:] | ~gap[1:], True)) + 1
    last = data[opens - 1]
    breaks = ends[~head[opens] & ((last == 46) | (last == 33) | (last == 63))]
    starts = np.searchsorted(lo, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(starts))
    first = off[row]
    sent = np.cumsum(np.bincount(np.searchsorted(lo, breaks), minlength=len(lo) + 1))[: len(lo)] - np.searchsorted(breaks, off, "right")[row]
    tok = np.arange(len(lo)) - starts[row]
    b, e = (lo - first, hi - first) if points is None else (points[lo] - points[first], points[hi] - points[first])
    return Words(data, row, sent, tok, lo, hi, b, e)


def slices(batches: Iterable[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have about SLICE bytes."""
    for batch in batches:
        if not len(batch):
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield batch.slice(at, to - at)
            at = to


def small(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = cut(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.row)), small(w.sent), small(w.tok), w.texts(), small(w.b), small(w.e)], TOKENS)


TOKENS = ["doc_id", "sent_id", "tok_id", "word", "b", "e"]
_TOKEN_ROWS = "doc_id long, sent_id int, tok_id int, word string, b int, e int"


def spread(docs: DataFrame) -> DataFrame:
    """Rows over all cores where a few files would keep them in a few tasks; many files stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def _as_they_are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches


def once(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that several branches of a plan read, made once: nothing can be pushed below the pass over them, so their shuffle is the same in all
    branches and Spark keeps one. For small rows that are dear to make."""
    return rows.repartition(key).mapInArrow(_as_they_are, rows.schema)


def tokens(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, sent_id, tok_id, word, b, e (offsets in code points); no shuffle, but for a few files of many rows."""
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_token_batches, _TOKEN_ROWS)


def _name_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = cut(batch.column(1))
        kind = KIND[w.data]
        other = np.append(0, np.cumsum((kind != CAPITAL) & (kind != SMALL)))
        some = other[w.lo] == other[w.hi]
        names = pc.ascii_lower(w.texts(some)).dictionary_encode()
        n = max(1, len(names.dictionary))
        once = np.unique(w.row[some] * n + names.indices.to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(once // n)), names.dictionary.take(pa.array(once % n))], ["doc_id", "name"])


def distinct_words(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, name: the words of letters from A to Z, lower-case, once for each row of documents."""
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_name_batches, "doc_id long, name string")


def _sentence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = cut(batch.column(1))
        first = np.flatnonzero(np.append(True, (w.row[1:] != w.row[:-1]) | (w.sent[1:] != w.sent[:-1])))[: len(w.row)]
        last = np.append(first[1:], len(w.row)) - 1 if len(first) else first
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.row[first])), small(w.sent[first]), small(w.b[first]), small(w.e[last]), small(w.tok[first]), pa.array(last - first + 1)], ["doc_id", "sent_id", "sb", "se", "first", "n_words"])


def sentences(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, sent_id, sb, se (where its words begin and end), first (tok_id), n_words; no row of a token, no shuffle of them."""
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_sentence_batches, "doc_id long, sent_id int, sb int, se int, first int, n_words long")


def _string_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = cut(batch.column(1))
        first = np.flatnonzero(np.append(True, (w.row[1:] != w.row[:-1]) | (w.sent[1:] != w.sent[:-1])))[: len(w.row)]
        said = pc.binary_join(pa.ListArray.from_arrays(small(np.append(first, len(w.row))), w.texts()), " ")
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.row[first])), small(w.sent[first]), said], ["doc_id", "sent_id", "sentence"])


def sentence_strings(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, sent_id, sentence: its words joined by blanks; no row of a token, no shuffle of them."""
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_string_batches, "doc_id long, sent_id int, sentence string")


def tokens_by(docs: DataFrame, sentences: Callable[[str], Iterable[str]], words: Callable[[str], Iterable[str]]) -> DataFrame:
    """The same by any splitter and tokenizer: each word is looked for from the end of the one before; blank words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in TOKENS]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = tok = 0
                for sent, s in enumerate(sentences(text or "")):
                    for w in words(s):
                        if w and not w.isspace() and (found := (text or "").find(w, at)) >= 0:
                            for c, v in zip(cols, (doc, sent, tok, w, found, found + len(w))):
                                c.append(v)
                            at, tok = found + len(w), tok + 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], TOKENS)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, _TOKEN_ROWS)


_ABBREVIATED = frozenset("dr mr mrs ms prof st vs etc al fig figs eq eqs ref refs vol pp ed eds inc ltd co corp jr sr approx ca cf e.g i.e u.s jan feb mar apr jun jul aug sep sept oct nov dec".split())
_STOP = re.compile(r"[.!?]+[\"')\]]*(?=\s+[\"'(\[]?[A-Z0-9])")


def sentences_of_prose(text: str) -> list[str]:
    """Sentences without the space around them: a stop before a capital or a digit ends one, but not after an abbreviation or an initial."""
    out, begin = [], 0
    for m in _STOP.finditer(text):
        before = re.search(r"(\S+)$", text[max(begin, m.start() - 20) : m.start()])
        word = before[1].lower().lstrip("([\"'") if before else ""
        if m[0].startswith(".") and len(m[0].rstrip("\"')]")) == 1 and (word in _ABBREVIATED or len(word) == 1 and word.isalpha() or word in ("no", "nos") and text[m.end() :].lstrip()[:1].isdigit()):
            continue
        out.append(text[begin : m.end()].strip())
        begin = m.end()
    out.append(text[begin:].strip())
    return [s for s in out if s]


_TREE = re.compile(
    r"\.{3}|--|[A-Za-z]+(?=n't\b)|n't\b|'(?:s|m|d|ll|re|ve)\b|[A-Z](?:\.[A-Z])+\.?|\d+(?:[.,]\d+)*|[^\W\d_](?:[\w-]|\.(?=\w))*?(?=n't\b|'(?:s|m|d|ll|re|ve)\b)|[^\W_](?:[\w/-]|[.'](?=\w))*|\S",
    re.I,
)


def words_of_prose(sentence: str) -> list[str]:
    """Words in the manner of treebanks: contractions and punctuation apart, inner hyphens and points kept. Quotes stay as written."""
    return _TREE.findall(sentence)


def words_only(text: Column) -> Column:
    """The same words as an array, by expressions alone."""
    for pattern, to in RULES:
        java = pattern.replace("\x00", r"\x00").replace("\x7f", r"\x7f").replace(CUT, r"\x1f").replace("\x80", r"\x{80}").replace("\U0010ffff", r"\x{10ffff}")
        text = F.regexp_replace(text, java, to.replace(r"\1", "$1").replace(r"\2", "$2").replace(r"\x1f", CUT))
    return F.filter(F.split(text, CUT), lambda w: F.trim(F.regexp_replace(w, r"\s", " ")) != "")


# --- stems ---------------------------------------------------------------------------------------------------------------

_VOWELS = "aeiou"


def _measure(word: str) -> tuple[str, int, bool]:
    kinds = ""
    for i, c in enumerate(word):
        kinds += "v" if c in _VOWELS or (c == "y" and i and kinds[-1] == "c") else "c"
    return kinds, len(re.findall("vc", re.sub(r"(.)\1+", r"\1", kinds))), "v" in kinds


def _cvc(word: str) -> bool:
    kinds = _measure(word)[0]
    return kinds[-3:] == "cvc" and word[-1] not in "wxy"


_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "ement ment ance ence able ible ant ent ism ate iti ous ive ize al er ic ou".split()


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Suffix stripping in five steps; a final y after a consonant becomes i in words of more than two letters."""
    w = word.lower()
    if len(w) <= 2 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3])[1] > 0:
            w = w[:-1]
    elif w.endswith("ed") and _measure(w[:-2])[2]:
        w, again = w[:-2], True
    elif w.endswith("ing") and _measure(w[:-3])[2]:
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _measure(w)[1] == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and len(w) > 2 and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for s in sorted(table, key=len, reverse=True):
            if w.endswith(s):
                if _measure(w[: -len(s)])[1] > 0:
                    w = w[: -len(s)] + table[s]
                break
    for s in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(s):
            if _measure(w[: -len(s)])[1] > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        m = _measure(w[:-1])[1]
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w)[1] > 1:
        w = w[:-1]
    return w


def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def with_stems(tokens: DataFrame) -> DataFrame:
    """Adds the stem of each word, computed once for each different word."""
    stems = tokens.select("word").distinct().withColumn("stem", stem_of("word"))
    return tokens.join(stems, "word", "left").select(*tokens.columns, "stem")


def stem_of(word: Column | str) -> Column:
    """Stems in Arrow batches; call it on distinct words."""
    return F.pandas_udf(_stems, "string")(word)


# --- tests of words ------------------------------------------------------------------------------------------------------


def is_number(word: Column) -> Column:
    """What reads as a floating point number, with single underscores between digits."""
    return word.rlike(r"^\s*[+-]?(([0-9](_?[0-9])*)(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?\s*$") | F.lower(F.trim(word)).rlike(r"^[+-]?(inf|infinity|nan)$")


def masked(word: Column, class_id: Column, number: str = "NUM") -> Column:
    return F.coalesce(class_id, F.when(is_number(word), F.lit(number)).otherwise(word))


def is_noun(tag: Column) -> Column:
    return tag.startswith("NN")


def is_verb(tag: Column) -> Column:
    return tag.startswith("V")
