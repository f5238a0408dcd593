"""Substring dedup with prefix-partitioned suffix trees over words.

A repeat is a sequence of at least ``min_words`` words that several documents have. A suffix can begin a maximal repeat
only where what stands before it differs between its occurrences; only such suffixes become leaves. Five steps, each a
Spark shuffle of compact blocks, none of which gathers more than one block group in a task:

1. texts are dealt into batches of about ``batch_bytes`` by a hash of id and text;
2. each batch sends the distinct fingerprints of its runs of ``min_words`` words, with the word before each run (or that
   it differs within the batch), to buckets, and gets back two bits for each: it occurs elsewhere too, and what stands
   before it differs. Repeated runs that follow each other form a stretch; suffixes to keep start a stretch or differ in
   what stands before them;
3. prefixes that start more suffixes than a group may hold are lengthened by one word until they don't
   (variable-length prefixes, so that a group fits in memory); what a batch counts is pre-aggregated;
4. kept suffixes, equal ones of a batch once, go to their prefix's group as symbol sequences. There they are sorted, and
   common prefix lengths of neighbours give the subtree: an internal node is a range of leaves with its depth. Each leaf
   learns the deepest node above it that holds a document of smaller id;
5. batches get these depths back, cut the words from a suffix's start to its node's depth, and join what is left.

For step 4 a suffix goes only as far as the next kept suffix of its stretch needs it (what the rest repeats, that one
finds), so all sequences together are about as long as the repeated text; ``maximal_repeats`` sends whole stretches, and
returns every internal node with differing words before it: a maximal repeat, its true length and its occurrences.

A hot passage costs one leaf for each batch and way of going on, not one for each occurrence. Symbols are 48-bit word
hashes; fingerprints and the words before them grow with the logarithm of the input, so that a filter's false answers
stay as rare at any size.

Defined cases: null text has no words; a row without an id takes no part (nothing is smaller than null) and keeps all
its words; repeated ids count as one document; texts shorter than ``min_words`` have no suffix of that depth and stay
whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import textvec as tv
from netloom.llm.arrowio import slices

_SYMBOL, _TREE, _FILTER, _BEFORE = 0x51A7, 0x7EE5, 0xF117, 0xBEF0
_WIDE = 6
_FLIP = np.uint64(1 << 63)

OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<from_word:int,to_word:int>>"
_BLOCKS = "grp int, batch int, n int, block binary"


class _Batch:
    """One batch's documents in a fixed order, with their runs of ``depth`` words."""

    def __init__(self, table: pa.Table, depth: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = table.column("doc_id").combine_chunks()
        self.known = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.rows = table.column("doc_id")
        self.data, offsets = tv.as_bytes(table.column("text"))
        self.starts, self.ends, self.offsets = tv.words(self.data, offsets)
        self.hashes = tv.word_hashes(self.data, self.starts, self.ends)
        self.hasher = tv.WindowHasher(self.hashes)
        at, doc = tv.windows(self.offsets, depth)
        if not self.known.all():
            take = self.known[doc]
            at, doc = at[take], doc[take]
        self.at, self.doc, self.depth = at, doc, depth

    def fingerprints(self, bits: int) -> np.ndarray:
        """Distinct fingerprints in order; keeps the runs' order and for each run the place of its fingerprint."""
        prints = tv.mix(self.hasher.of(self.at, self.depth), _FILTER) >> np.uint64(64 - bits)
        self.order = np.argsort(prints, kind="stable")
        ordered = prints[self.order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.head = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        return ordered[self.head]

    def before(self, bits: int) -> np.ndarray:
        """The word before each distinct fingerprint's runs; all ones where it differs, or a text begins."""
        most = np.uint64(2**bits - 1)
        code = np.full(len(self.at), most)
        inner = self.at > self.offsets[self.doc]
        code[inner] = np.minimum(tv.mix(self.hashes[self.at[inner] - 1], _BEFORE) >> np.uint64(64 - bits), most - np.uint64(1))
        if not len(code):
            return code
        code = code[self.order]
        return np.where(np.minimum.reduceat(code, self.head) == np.maximum.reduceat(code, self.head), code[self.head], most)

    def leaves(self, again: np.ndarray, differs: np.ndarray, whole: bool) -> None:
        """Kept suffixes: places in the text (begin), words to send (size), document (of), by distinct sequence (leaf)."""
        n = len(self.at)
        self.begin = self.size = self.of = self.leaf = self.first = np.zeros(0, np.int64)
        if not n:
            return
        tail = np.append(self.head[1:], n) - 1
        docs = self.ids[self.doc[self.order]]
        again = again | (docs[self.head] != docs[tail])
        repeated, keep = np.zeros(n, bool), np.zeros(n, bool)
        repeated[self.order], keep[self.order] = again[self.run], differs[self.run]
        follows = np.zeros(n, bool)
        follows[1:] = repeated[:-1] & (self.doc[1:] == self.doc[:-1])
        at = np.flatnonzero(repeated & (keep | ~follows))
        if not len(at):
            return
        stretch = np.cumsum(repeated & ~follows)[at]
        last = repeated.copy()
        last[:-1] &= ~(repeated[1:] & follows[1:])
        ends = np.flatnonzero(last)[stretch - 1]
        if not whole:
            inside = np.append(stretch[1:] == stretch[:-1], False)
            ends[inside] = np.append(at[1:], 0)[inside] - 1
        self.begin, self.of, self.size = self.at[at], self.doc[at], ends - at + self.depth
        sequences = tv.mix(self.hasher.of(self.begin, self.size) ^ tv.mix(self.size.astype(np.uint64)))
        _, self.first, self.leaf = np.unique(sequences, return_index=True, return_inverse=True)


def _heavy_prefixes(docs: DataFrame, depth: int, groups: int) -> tuple[int, int, list[np.ndarray]]:
    """Numbers of suffixes and bytes, and by length the prefixes that more than one suffix in 4 x groups start with.

    A slice of the input reports a prefix with a share of its own suffixes half as large; a prefix that is heavy overall
    is so in some slice. What comes to the driver is bounded by 4 x groups prefixes for each length.
    """

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        b = _Batch(pa.Table.from_batches([piece]), depth)
        rows = [(0, 0, len(b.at)), (-1, 0, len(b.data))]
        left, least = b.at, max(2, len(b.at) / (8 * groups))
        for k in range(1, depth):
            found, n = np.unique(b.hasher.of(left, k), return_counts=True)
            found, n = found[n >= least], n[n >= least]
            if not len(found):
                break
            rows += zip([k] * len(n), found.view(np.int64).tolist(), n.tolist(), strict=True)
            left = left[np.isin(b.hasher.of(left, k), found)]
        return pa.record_batch({"width": pa.array([r[0] for r in rows], pa.int32()), "prefix": pa.array([r[1] for r in rows], pa.int64()), "n": pa.array([r[2] for r in rows], pa.int64())})

    def scan(batches):
        for batch in batches:
            yield from map(count, slices(batch, "text"))

    counted = docs.mapInArrow(scan, "width int, prefix long, n long").groupBy("width", "prefix").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.col("width") > 0, F.desc("n"), "width", "prefix").limit(4 * groups * depth + 2).collect()
    total, size = (sum(r.n for r in rows if r.width == w) for w in (0, -1))
    least = max(2, total / (4 * groups))
    return total, size, [np.sort(np.array([r.prefix for r in rows if r.width == k and r.n >= least], np.int64).view(np.uint64)) for k in range(depth)]


def _pack(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    """Rows of numbers that end with bytes, as a table."""
    kinds = [pa.int32()] * (len(names) - 1) + [pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def _common(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many symbols each sequence shares with the one before it; 0 for the first."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.int64)
    live = np.arange(1, len(sizes))
    most = np.minimum(sizes[1:], sizes[:-1])
    k = 0
    while len(live):
        live = live[most[live - 1] > k]
        live = live[symbols[offsets[live] + k] == symbols[offsets[live - 1] + k]]
        out[live] += 1
        k += 1
    return out


def _deepest_with_smaller(common: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each leaf in order, the depth of the deepest node above it that holds a smaller document; 0 without one."""
    best = [0] * len(docs)
    lcp, docs = common.tolist(), docs.tolist()
    for places, step in ((range(len(docs)), 0), (range(len(docs) - 1, -1, -1), 1)):
        stack: list[tuple[int, int]] = []  # documents that grow, each with the depth it shares with the one before it
        for i in places:
            depth = lcp[i + step] if i + step < len(lcp) else 0
            while stack and stack[-1][0] >= docs[i]:
                depth = min(depth, stack.pop()[1])
            if stack and depth > best[i]:
                best[i] = depth
            stack.append((docs[i], depth))
    return np.array(best, np.int64)


def _nodes(common: np.ndarray):
    """Internal nodes as (depth, first leaf, leaf beyond the last)."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common.tolist()[1:], 0], 1):
        low = i - 1
        while stack and stack[-1][0] > depth:
            top, low = stack.pop()
            yield top, low, i
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, low))


class _Leaves:
    """A group's leaves, sorted by their sequences. Per leaf: batch row, index in the batch, smallest and largest
    document, words before (code), occurrences, place in the smallest document, symbols."""

    FIELDS = (("index", 4), ("doc", 8), ("most", 8), ("code", 8), ("n", 5), ("word", 4), ("size", 4))

    def __init__(self, table: pa.Table):
        sizes = table.column("n").to_pylist()
        columns, symbols = {k: [] for k, _ in self.FIELDS}, []
        for x, n in zip(table.column("block"), sizes, strict=True):
            raw, at = memoryview(x.as_buffer()), 0
            for name, width in self.FIELDS:
                columns[name].append(tv.get_planes(raw[at : at + n * width], n, width))
                at += n * width
            symbols.append(np.frombuffer(raw[at:], np.uint8))
        self.sizes = sizes
        self.columns = {k: np.concatenate(v) for k, v in columns.items()}
        raw = np.concatenate(symbols).tobytes()
        size = self.columns["size"].astype(np.int64)
        ends = np.cumsum(size)
        keys = [raw[_WIDE * (e - s) : _WIDE * e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        ordered = np.frombuffer(b"".join([keys[i] for i in self.order]), np.uint8).reshape(-1, _WIDE)
        wide = np.zeros((len(ordered), 8), np.uint8)
        wide[:, 8 - _WIDE :] = ordered
        self.common = _common(wide.view(">u8").reshape(-1), np.concatenate([[0], np.cumsum(size[self.order])]))

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name][self.order]

    @staticmethod
    def write(b: _Batch, leaf: np.ndarray, code: np.ndarray, most: np.ndarray, n: np.ndarray, symbols: np.ndarray) -> bytes:
        """The block of some of a batch's leaves."""
        at = b.first[leaf]
        begin, size = b.begin[at], b.size[at]
        values = {"index": leaf, "doc": b.ids[b.of[at]].view(np.uint64) ^ _FLIP, "most": most[leaf].view(np.uint64) ^ _FLIP, "code": code[leaf], "n": n[leaf], "word": begin - b.offsets[b.of[at]], "size": size}
        ends = np.cumsum(size)
        words = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
        return b"".join([*(tv.put_planes(values[k].astype(np.uint64), w) for k, w in _Leaves.FIELDS), symbols[words].tobytes()])


class _Forest:
    """What the steps share: sizes, heavy prefixes and functions over batches, buckets and groups (no DataFrames: it goes to executors)."""

    def __init__(self, docs: DataFrame, min_words: int, batch_bytes: int, whole: bool):
        self.depth, self.whole = min_words, whole
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total, size, self.heavy = _heavy_prefixes(docs, min_words, parts)
        self.batches = max(parts, -(-size // batch_bytes))
        self.groups = max(parts, -(-16 * total // batch_bytes))
        # A fingerprint passes falsely once in 1,000 suffixes; of suffixes with differing words before, one in 1,000 x the input is missed.
        need = math.ceil(math.log2(max(total, 2))) + 10
        self.bits, self.code_bits = min(60, max(24, need)), min(56, max(32, need))
        self.width, self.code_width = (self.bits + 7) // 8, (self.code_bits + 7) // 8

    def ask(self, table: pa.Table) -> pa.Table:
        """A batch's distinct fingerprints, sorted, as differences, and the words before them; a block for each bucket."""
        b = _Batch(table, self.depth)
        prints = b.fingerprints(self.bits)
        code = b.before(self.code_bits)
        edges = np.searchsorted(prints, np.array([(i << self.bits) // self.groups for i in range(self.groups + 1)], np.uint64))
        batch = table.column("batch")[0].as_py()
        rows = [(i, batch, int(hi - lo), tv.put_planes(np.diff(prints[lo:hi], prepend=np.uint64(0)), self.width) + tv.put_planes(code[lo:hi], self.code_width)) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
        return _pack(rows, ("grp", "batch", "n", "block"))

    def answer(self, table: pa.Table) -> pa.Table:
        """Two bits for each of a bucket's fingerprints: it came from several batches; the words before it differ."""
        sizes, prints, codes = table.column("n").to_pylist(), [], []
        for x, n in zip(table.column("block"), sizes, strict=True):
            raw = memoryview(x.as_buffer())
            prints.append(np.cumsum(tv.get_planes(raw[: n * self.width], n, self.width)))
            codes.append(tv.get_planes(raw[n * self.width :], n, self.code_width))
        prints, codes = np.concatenate(prints), np.concatenate(codes)
        order = np.argsort(prints, kind="stable")
        ordered, codes = prints[order], codes[order]
        head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        low, high = np.minimum.reduceat(codes, head), np.maximum.reduceat(codes, head)
        times = np.diff(np.append(head, len(ordered)))
        again, differs = np.zeros(len(prints), bool), np.zeros(len(prints), bool)
        again[order] = np.repeat(times > 1, times)
        differs[order] = np.repeat((low != high) | (high == np.uint64(2**self.code_bits - 1)), times)
        ends = np.cumsum(sizes).tolist()
        made = [np.packbits(again[e - n : e]).tobytes() + np.packbits(differs[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
        return pa.table({"grp": table.column("grp"), "batch": table.column("batch"), "n": table.column("n"), "block": pa.array(made, pa.binary())})

    def kept(self, table: pa.Table, replies: pa.Table) -> _Batch:
        b = _Batch(table, self.depth)
        b.fingerprints(self.bits)
        again, differs = [np.zeros(0, bool)], [np.zeros(0, bool)]
        replies = replies.sort_by("grp")
        for x, n in zip(replies.column("block"), replies.column("n").to_pylist(), strict=True):
            raw = np.frombuffer(x.as_buffer(), np.uint8)
            half = (n + 7) // 8
            again.append(np.unpackbits(raw[:half], count=n).astype(bool))
            differs.append(np.unpackbits(raw[half:], count=n).astype(bool))
        b.leaves(np.concatenate(again), np.concatenate(differs), self.whole)
        return b

    def suffixes(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        """A batch's leaves, by prefix group."""
        if not table.num_rows:
            return _pack([], ("grp", "batch", "n", "block"))
        b = self.kept(table, replies)
        if not len(b.first):
            return _pack([], ("grp", "batch", "n", "block"))
        at = b.begin[b.first]
        group = np.zeros(len(at), np.uint64)
        left = np.arange(len(at))
        for k in range(1, self.depth + 1):
            prefix = b.hasher.of(at[left], k)
            group[left] = prefix
            if k == self.depth or not len(self.heavy[k]):
                break
            left = left[np.isin(prefix, self.heavy[k])]
            if not len(left):
                break
        group = (tv.mix(group, _TREE) % np.uint64(self.groups)).astype(np.int64)
        # What the leaves of equal sequence have in common: words before, largest document, occurrences.
        most_code = np.uint64(2**self.code_bits - 1)
        code = np.full(len(b.begin), most_code)
        inner = b.begin > b.offsets[b.of]
        code[inner] = np.minimum(tv.mix(b.hashes[b.begin[inner] - 1], _BEFORE) >> np.uint64(64 - self.code_bits), most_code - np.uint64(1))
        by = np.argsort(b.leaf, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], np.diff(b.leaf[by]) > 0]))
        low, high = np.minimum.reduceat(code[by], head), np.maximum.reduceat(code[by], head)
        most, n = np.maximum.reduceat(b.ids[b.of[by]], head), np.diff(np.append(head, len(by)))
        raw = np.ascontiguousarray(tv.mix(b.hashes, _SYMBOL), ">u8").view(np.uint8).reshape(-1, 8)[:, :_WIDE]
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(self.groups + 1))
        batch = table.column("batch")[0].as_py()
        rows = [(g, batch, int(hi - lo), _Leaves.write(b, order[lo:hi], np.where(low == high, low, most_code), most, n, raw)) for g, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
        return _pack(rows, ("grp", "batch", "n", "block"))

    def subtree(self, table: pa.Table) -> pa.Table:
        """The depth to which each leaf repeats a smaller document; replies bear the group's number beyond the buckets'."""
        leaves = _Leaves(table)
        depth = np.empty(len(leaves.order), np.int64)
        depth[leaves.order] = _deepest_with_smaller(leaves.common, leaves["doc"])
        index, rows, at = leaves.columns["index"], [], 0
        for grp, batch, n in zip(*(table.column(c).to_pylist() for c in ("grp", "batch", "n")), strict=True):
            rows.append((self.groups + grp, batch, n, tv.put_planes(index[at : at + n], 4) + tv.put_planes(depth[at : at + n].astype(np.uint64), 4)))
            at += n
        return _pack(rows, ("grp", "batch", "n", "block"))

    def repeats(self, table: pa.Table) -> pa.Table:
        """Maximal repeats of a group: internal nodes of several documents whose words before differ."""
        leaves = _Leaves(table)
        n = leaves["n"].astype(np.int64)
        # A leaf of several occurrences is a node of its own: it stands twice.
        times = np.where(n > 1, 2, 1)
        at = np.repeat(np.arange(len(n)), times)
        second = np.concatenate([[False], at[1:] == at[:-1]])
        size = leaves["size"].astype(np.int64)
        common = np.where(second, size[at], leaves.common[at])
        weight = np.where(second, n[at] - 1, 1)
        doc, most, code, word = (leaves[k][at] for k in ("doc", "most", "code", "word"))
        rows = []
        for depth, low, high in _nodes(common):
            codes = code[low:high]
            differs = codes.min() != codes.max() or int(codes.max()) == 2**self.code_bits - 1
            if depth >= self.depth and differs and doc[low:high].min() != most[low:high].max():
                i = low + int(np.lexsort((word[low:high], doc[low:high]))[0])
                rows.append((int(depth), int(weight[low:high].sum()), int((doc[i] ^ _FLIP).view(np.int64)), int(word[i])))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["n_words", "occurrences", "doc_id", "from_word"])

    def cut(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        number = np.asarray(replies.column("grp").combine_chunks())
        b = self.kept(table, replies.filter(pa.array(number < self.groups)))
        removed = np.zeros(len(b.starts), bool)
        if len(b.first):
            depth = np.zeros(len(b.first), np.int64)
            found = replies.filter(pa.array(number >= self.groups))
            for x, n in zip(found.column("block"), found.column("n").to_pylist(), strict=True):
                raw = memoryview(x.as_buffer())
                depth[tv.get_planes(raw[: 4 * n], n, 4).astype(np.int64)] = tv.get_planes(raw[4 * n :], n, 4)
            # Leaves stand for the smallest of their documents; the others repeat that one whole.
            docs = b.ids[b.of]
            own = np.where(docs > docs[b.first][b.leaf], b.size, depth[b.leaf])
            hit = own >= self.depth
            removed = tv.cover(b.begin[hit], own[hit], len(b.starts))
        text = tv.join_words(b.data, b.starts, b.ends, b.offsets, ~removed)
        sums = np.concatenate([[0], np.cumsum(removed)])
        inner = np.isin(np.arange(1, max(len(removed), 1)), b.offsets)
        edge, tail = removed.copy(), removed.copy()
        edge[1:] &= ~removed[:-1] | inner
        tail[:-1] &= ~removed[1:] | inner
        begin, end = np.flatnonzero(edge), np.flatnonzero(tail) + 1
        at = np.searchsorted(begin, b.offsets)
        base = np.repeat(b.offsets[:-1], np.diff(at))
        spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - base, pa.int32()), pa.array(end - base, pa.int32())], ["from_word", "to_word"]))
        return pa.table({"doc_id": b.rows.combine_chunks(), "n_words": pa.array(np.diff(b.offsets), pa.int64()), "n_removed": pa.array(np.diff(sums[b.offsets]), pa.int64()), "kept_text": text, "removed": spans})


def _planted(docs: DataFrame, min_words: int, batch_bytes: int, whole: bool) -> tuple[_Forest, DataFrame, DataFrame, DataFrame]:
    """The forest, texts by batch, answers to batches, and leaves by group."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    forest = _Forest(docs, min_words, batch_bytes, whole)
    batched = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(forest.batches)).cast("int"))
    answered = batched.groupBy("batch").applyInArrow(lambda rows: forest.ask(rows), _BLOCKS).groupBy("grp").applyInArrow(lambda rows: forest.answer(rows), _BLOCKS)
    leaves = batched.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(lambda rows, replies: forest.suffixes(rows, replies), _BLOCKS)
    return forest, batched, answered, leaves


def substring_dedup(docs: DataFrame, *, min_words: int = 13, batch_bytes: int = 8 << 20) -> DataFrame:
    """Remove every word covered by a run of ``min_words`` words that also starts in a document with a smaller id.

    Returns one row for each input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space) and the
    removed spans as word ranges. Repeats are judged on the input texts.
    """
    forest, batched, answered, leaves = _planted(docs, min_words, batch_bytes, False)
    found = leaves.groupBy("grp").applyInArrow(lambda rows: forest.subtree(rows), _BLOCKS)
    return batched.groupBy("batch").cogroup(answered.unionByName(found).groupBy("batch")).applyInArrow(lambda rows, replies: forest.cut(rows, replies), OUT)


def maximal_repeats(docs: DataFrame, *, min_words: int = 13, batch_bytes: int = 8 << 20) -> DataFrame:
    """n_words, occurrences, and doc_id and from_word of the first, for every sequence that several documents have and
    that no longer one contains at all its occurrences."""
    forest, _, _, leaves = _planted(docs, min_words, batch_bytes, True)
    return leaves.groupBy("grp").applyInArrow(lambda rows: forest.repeats(rows), "n_words int, occurrences long, doc_id long, from_word int")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
