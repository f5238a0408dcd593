"""Benchmark decontamination: which words of which documents lie in a passage of a benchmark item.

The distinct windows of the benchmark are a hash set that goes to every executor. Its size is checked first: windows
and bytes are counted, and a benchmark beyond ``most_windows`` is taken in blocks, each broadcast on its own and each
adding its hits to what the blocks before it found (written between blocks), so no broadcast grows with the benchmark.
Documents are scanned where they are read, without a shuffle: hashes of all word windows are looked up in the sorted
set and every hit is verified word by word.

Defined cases: null texts have no words; items without words have no windows; an item without an id counts as the item
with the empty id; repeated item ids are one item; repeated documents are judged row by row; further columns of
documents, whatever their names, are kept by ``drop_contaminated`` and ``cut_spans``; empty tables give no hits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import textvec as tv
from netloom.llm.arrowio import add_columns, column, unused
from netloom.llm.session import checkpointed

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SALT = 0xDEC0
FIELDS = ("n_words", "n_hit", "items", "hits")
_TYPES = ("long", "long", "array<string>", "array<struct<from_word:int,to_word:int>>")


def _normalised(texts) -> tuple[np.ndarray, ...]:
    data, offsets = tv.as_bytes(texts)
    data = tv.LOWER[data]
    starts, ends, at = tv.words(data, offsets, tv.NOT_ALNUM)
    return data, starts, ends, at, tv.word_hashes(data, starts, ends)


class _Windows:
    """Distinct windows of benchmark items: sorted hashes by width, and each window's words and items."""

    def __init__(self, rows: list, ngram: int):
        self.items: dict[tuple[int, int], dict[bytes, set[str]]] = {}
        texts = pa.array([r.text for r in rows], pa.large_string())
        data, starts, ends, at, hashes = _normalised(texts)
        hasher = tv.WindowHasher(hashes, _SALT)
        raw = data.tobytes()
        for i, r in enumerate(rows):
            n = int(at[i + 1] - at[i])
            width = min(ngram, n)
            if not n:
                continue
            firsts = np.arange(at[i], at[i + 1] - width + 1)
            for first, h in zip(firsts.tolist(), hasher.of(firsts, width).tolist(), strict=True):
                words = b" ".join(raw[starts[first + k] : ends[first + k]] for k in range(width))
                self.items.setdefault((width, h), {}).setdefault(words, set()).add("" if r.item_id is None else str(r.item_id))
        self.sorted = {w: np.sort(np.array([h for v, h in self.items if v == w], np.uint64)) for w in {w for w, _ in self.items}}

    def find(self, texts) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """Words before each document, which words are hit, and each document's items."""
        data, starts, ends, at, hashes = _normalised(texts)
        hit, items = np.zeros(len(starts), bool), [set() for _ in range(len(at) - 1)]
        if not self.sorted or not len(starts):
            return at, hit, items
        hasher, raw = tv.WindowHasher(hashes, _SALT), None
        for width, known in self.sorted.items():
            first, doc = tv.windows(at, width)
            found = hasher.of(first, width)
            place = np.minimum(np.searchsorted(known, found), len(known) - 1)
            maybe = np.flatnonzero(known[place] == found)
            for i in maybe.tolist():
                raw = data.tobytes() if raw is None else raw
                f = int(first[i])
                words = b" ".join(raw[starts[f + k] : ends[f + k]] for k in range(width))
                if of := self.items[width, int(found[i])].get(words):
                    hit[f : f + width] = True
                    items[doc[i]] |= of
        return at, hit, items


def _spans(at: np.ndarray, hit: np.ndarray) -> pa.Array:
    head, tail = hit.copy(), hit.copy()
    inner = np.isin(np.arange(1, max(len(hit), 1)), at)
    head[1:] &= ~hit[:-1] | inner
    tail[:-1] &= ~hit[1:] | inner
    begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    of = np.searchsorted(begin, at)
    base = np.repeat(at[:-1], np.diff(of))
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - base, pa.int32()), pa.array(end - base, pa.int32())], ["from_word", "to_word"]))


def _add_hits(docs: DataFrame, found: _Windows, names: tuple[str, ...], *, before: bool) -> DataFrame:
    windows = docs.sparkSession.sparkContext.broadcast(found)

    def fn(piece: pa.RecordBatch) -> list:
        at, hit, items = windows.value.find(column(piece, "text"))
        if before:
            for i, (spans, old) in enumerate(zip(column(piece, names[3]).to_pylist(), column(piece, names[2]).to_pylist(), strict=True)):
                items[i] |= set(old)
                for s in spans:
                    hit[at[i] + s["from_word"] : at[i] + s["to_word"]] = True
        sums = np.concatenate([[0], np.cumsum(hit)])
        return [pa.array(np.diff(at), pa.int64()), pa.array(np.diff(sums[at]), pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), _spans(at, hit)]

    return add_columns(docs, ", ".join(f"`{n}` {t}" for n, t in zip(names, _TYPES, strict=True)), fn)


def scan(docs: DataFrame, benchmark: DataFrame, *, ngram: int = 10, most_windows: int = 1_000_000, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """docs with n_words, n_hit, items (ids of items with windows in it, sorted as strings) and hits (word ranges).

    The four go by ``names``; a column of such a name is replaced.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0  # a window starts at a byte of its own
    blocks = -(-windows // most_windows) if windows else 1
    if blocks == 1:
        return _add_hits(docs, _Windows(items.collect(), ngram), names, before=False)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        docs = _add_hits(docs, _Windows(part, ngram), names, before=block > 0)
        if block + 1 < blocks:
            docs = checkpointed(docs)
    return docs


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, ngram: int = 10) -> DataFrame:
    """Documents without a hit, with the columns they had."""
    names = tuple(unused(docs.columns, *FIELDS))
    return scan(docs, benchmark, ngram=ngram, names=names).filter(F.col(names[1]) == 0).select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, *, ngram: int = 10) -> DataFrame:
    """All documents, with hit passages cut from their texts and everything else as it was."""
    names = tuple(unused(docs.columns, *FIELDS))

    def fn(piece: pa.RecordBatch) -> list:
        out = []
        for text, spans in zip(column(piece, "text").to_pylist(), column(piece, names[3]).to_pylist(), strict=True):
            if spans:
                raw = text.encode()
                at = [m.span() for m in _WORD.finditer(bytes(tv.LOWER[np.frombuffer(raw, np.uint8)]))]
                for s in reversed(spans):
                    raw = raw[: at[s["from_word"]][0]] + raw[at[s["to_word"] - 1][1] :]
                text = raw.decode()
            out.append(text)
        return [pa.array(out, pa.string())]

    return add_columns(scan(docs, benchmark, ngram=ngram, names=names), "text string", fn).select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ngram=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
widths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, widths WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN ids USING (doc_id)"""
