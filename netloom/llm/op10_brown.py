"""LM scoring with Brown class-based bigrams.

P(word | word before) = P(class | class before) * P(word | class). Spark counts everything over all training texts:

* one pass over the texts makes a block of word numbers for each slice of about ``batch_bytes`` (a batch), and sends its
  distinct words with their counts to buckets of the hash range. A word costs a batch one entry however often it occurs,
  so frequent words do not gather anywhere, and the vocabulary is never in one place;
* every word that occurs at least ``least`` times in training gets a Brown class by exchange clustering. The most
  frequent words (four for each class) seed the classes: their bigram matrix, of bounded size, is clustered exactly, one
  move after another. Then, in ``rounds`` rounds, batches count for each word which classes stand before and after it,
  buckets add these counts up and move each of their words to the class that raises the likelihood of the class bigrams
  most, all against the same class totals, as distributed exchange does. Buckets answer batches with the words' classes,
  and the next round counts with these;
* a last pass over the blocks counts class bigrams, and one more scores.

The number of classes grows with the root of the clustered vocabulary, from 16 to 128. Words seen less often and unseen
ones form classes by spelling shape; transitions are interpolated with class frequencies; emissions of shapes are
discounted by how many words of the shape were seen once and twice, and what is taken off is the probability of a word
never seen of that shape. As in the base model, unseen words of a class are one type, so probabilities of all types add
up to 1. Batches and buckets are sized by bytes, so what a task holds doesn't grow with the input.

Words are told apart by 64-bit hashes: at 10**8 distinct words the chance that any two meet is 0.0003.

Defined cases: null is the empty text, whose one token is the end; rows without an id are scored, not held out, and not
learned from; repeated rows are scored each; without training tokens counts are 0, base and score use the single unseen
type (probability 1); further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import textvec as tv
from netloom.llm.arrowio import column, slices
from netloom.llm.labelled import remainder
from netloom.llm.session import stored

_END = np.uint64(0xE0D0E0D0E0D0E0D1)
_SHAPES, _END_SHAPE = 16, 15
_STOPS = np.isin(np.arange(256), list(b".,;:!?"))
_PLAIN = np.isin(np.arange(256), [*range(0x61, 0x7B), *range(0x80, 0x100), *b".,;:!?'-"])

OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of every token, each document's closed by the end token, and tokens before each document."""
    data, offsets = tv.as_bytes(texts)
    data = tv.LOWER[data]
    starts, ends, at = tv.words(data, offsets)
    hashes = tv.word_hashes(data, starts, ends)
    size = ends - starts
    odd = np.concatenate([[0], np.cumsum(~_PLAIN[data], dtype=np.int64)])
    wide = np.concatenate([[0], np.cumsum(data >= 0x80, dtype=np.int64)])
    shape = (size > 4).astype(np.int64) + (size > 9) + 3 * _STOPS[data[ends - 1]] + 6 * (wide[ends] > wide[starts])
    shape[odd[ends] > odd[starts]] = 12
    return np.insert(hashes, at[1:], _END), np.insert(shape, at[1:], _END_SHAPE), at + np.arange(len(at))


def exchange(counts: np.ndarray, movable: int, classes: int, *, rounds: int = 20) -> np.ndarray:
    """A class for each of the first movable units of a bigram matrix; the other units keep classes of their own.

    Units move one after another, each against all moves before it, until a round moves none.
    """
    units = len(counts)
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(units - movable)])
    total = classes + units - movable
    member = np.zeros((units, total))
    member[np.arange(units), of] = 1
    grid = member.T @ counts @ member
    f = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(rounds):
        moved = 0
        for w in range(movable):
            right, left, loop = counts[w] @ member, counts[:, w] @ member, counts[w, w]
            old = of[w]
            right[old] -= loop
            left[old] -= loop
            grid[old] -= right
            grid[:, old] -= left
            grid[old, old] -= loop
            g = grid[:classes]
            gain = (f(g + right) - f(g)).sum(axis=1) + (f(grid[:, :classes] + left[:, None]) - f(grid[:, :classes])).sum(axis=0)
            k = np.arange(classes)
            d = grid[k, k]
            gain += f(d + right[k] + left[k] + loop) - f(d + right[k]) - f(d + left[k]) + f(d)
            rows, cols = g.sum(axis=1), grid[:, :classes].sum(axis=0)
            gain -= f(rows + right.sum() + loop) - f(rows) + f(cols + left.sum() + loop) - f(cols)
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            grid[new] += right
            grid[:, new] += left
            grid[new, new] += loop
            if new != old:
                member[w, old], member[w, new], of[w] = 0, 1, new
                moved += 1
        if not moved:
            break
    return of


def moves(words: np.ndarray, columns: np.ndarray, n: np.ndarray, grid: np.ndarray, classes: int, now: np.ndarray, chunk: int = 4_096) -> np.ndarray:
    """The class for each word that raises the likelihood of the class bigrams most, all else staying as it is.

    Cells (word, column, n), ordered by word, count the classes before (columns from len(grid) on) and after a word. grid
    counts class bigrams; now has the words' present classes, from which their own counts are taken first (-1 or a shape:
    the word is in none of the classes). Words without cells keep their class.
    """
    k = len(grid)
    after, ahead = grid[:classes].T.astype(np.float32), grid[:, :classes].astype(np.float32)  # by neighbour and class
    table = np.concatenate([after, ahead])
    f = lambda g, r: np.where(g > 0, g * np.log1p(r / np.maximum(g, 1)), 0) + r * np.log(np.maximum(g + r, 1))
    rows, cols = grid[:classes].sum(axis=1), grid[:, :classes].sum(axis=0)
    out = now.copy()
    at = 0
    while at < len(words):
        to = min(at + chunk, len(words))
        to = int(np.searchsorted(words, words[to - 1], "right"))
        w, head = np.unique(words[at:to], return_index=True)
        c, r = columns[at:to], n[at:to].astype(np.float32)
        mine = np.repeat(now[w], np.diff(np.append(head, to - at)))
        cells = table[c]
        inside = np.flatnonzero((mine >= 0) & (mine < classes))
        cells[inside, mine[inside]] = np.maximum(cells[inside, mine[inside]] - r[inside], 0)
        gain = np.add.reduceat(f(cells, r[:, None]), head, axis=0)
        for side, totals in ((c < k, rows), (c >= k, cols)):
            own = np.add.reduceat(np.where(side, r, 0), head).astype(np.float64)
            total = np.repeat(totals[None, :].astype(np.float64), len(w), axis=0)
            here = np.flatnonzero((now[w] >= 0) & (now[w] < classes))
            total[here, now[w[here]]] = np.maximum(total[here, now[w[here]]] - own[here], 0)
            gain -= f(total, own[:, None])
        best = gain.argmax(axis=1)
        here = np.flatnonzero((now[w] >= 0) & (now[w] < classes))
        stay = here[gain[here, best[here]] <= gain[here, now[w[here]]] + 1e-3]
        best[stay] = now[w[stay]]
        out[w] = best
        at = to
    return out


class Model:
    """Class transitions and emissions. grid counts class bigrams; sums has for each class tokens, words, and of its
    shape words seen once and twice."""

    def __init__(self, grid: np.ndarray, sums: np.ndarray, classes: int, *, prior: float = 5.0):
        share = (grid.sum(axis=0) + 0.5) / (grid.sum() + 0.5 * len(grid))
        self.step = np.log10((grid + prior * share) / (grid.sum(axis=1, keepdims=True) + prior))
        self.end = classes + _END_SHAPE
        n, v, n1, n2 = sums
        off = np.where(np.arange(len(grid)) < classes, 0, np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.1, 0.95))
        off[self.end] = 0
        self.off, self.in_class = off, np.maximum(n, 1)
        # Mass of the unseen type of a shape: all that was taken off; all of it where the shape was never seen.
        self.unseen = np.where(np.arange(len(grid)) < classes, 1.0, np.where(n > 0, np.maximum(off * v, 1e-9) / np.maximum(n, 1), 1.0))

    def __call__(self, place: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of every token, given its class and training count."""
        before = np.empty_like(place)
        before[1:] = place[:-1]
        before[at[:-1]] = self.end
        seen = np.maximum(count - self.off[place], 1e-9) / self.in_class[place]
        return self.step[before, place] + np.log10(np.where(count > 0, seen, self.unseen[place]))


def _cells(x: np.ndarray, n: np.ndarray) -> bytes:
    """Increasing numbers and their counts."""
    return tv.put_planes(np.diff(x.astype(np.uint64), prepend=np.uint64(0)), 6) + tv.put_planes(n.astype(np.uint64), 6)


def _uncells(raw, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(tv.get_planes(raw[: 6 * n], n, 6)).astype(np.int64), tv.get_planes(raw[6 * n :], n, 6).astype(np.int64)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[f for f, _ in fields])


_MADE = "batch long, bucket int, n int, block binary, ids array<long>, held array<boolean>, learn array<boolean>, at array<int>"
_STATE = "bucket int, n int, words binary, batches array<long>, sizes array<int>, numbers binary"
_BLOCKS = "batch long, bucket int, n int, block binary"


def _make(docs: DataFrame, buckets: int, batch_bytes: int) -> DataFrame:
    """For each batch its texts as numbers of its distinct words (bucket null), and these words for each bucket."""
    edges = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)

    def run(batches):
        nth = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, "text", batch_bytes):
                hashes, shape, at = tokens(column(piece, "text"))
                keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                learn = np.asarray(column(piece, "learn").cast(pa.int8())).astype(bool)
                n = np.bincount(inverse, weights=np.repeat(learn, np.diff(at)), minlength=len(keys)).astype(np.uint64)
                cut = np.searchsorted(keys, edges).tolist() + [len(keys)]
                rows = [(nth, None, len(inverse), tv.put_planes(inverse, 4))]
                for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if hi > lo:
                        rows.append((nth, i, hi - lo, tv.put_planes(np.diff(keys[lo:hi], prepend=np.uint64(0)), 8) + tv.put_planes(n[lo:hi], 6) + shape[first[lo:hi]].astype(np.uint8).tobytes()))
                made = _table(rows, _BLOCKS)
                none = [None] * (len(rows) - 1)
                lists = [pa.array([column(piece, c).to_pylist(), *none], pa.list_(k)) for c, k in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("learn", pa.bool_()))]
                made = pa.table([*made.columns, *lists, pa.array([at.tolist(), *none], pa.list_(pa.int32()))], names=[f.split()[0] for f in _MADE.split(", ")])
                yield from made.to_batches()
                nth += 1

    return stored(docs.mapInArrow(run, _MADE))


def _merge(table: pa.Table) -> pa.Table:
    """A bucket: its distinct words, and for each batch the numbers of the words that it asked about."""
    table = table.sort_by("batch")
    sizes, keys, counts, shapes = table.column("n").to_pylist(), [], [], []
    for x, n in zip(table.column("block"), sizes, strict=True):
        raw = memoryview(x.as_buffer())
        keys.append(np.cumsum(tv.get_planes(raw[: 8 * n], n, 8)))
        counts.append(tv.get_planes(raw[8 * n : 14 * n], n, 6))
        shapes.append(np.frombuffer(raw[14 * n :], np.uint8))
    keys, counts, shapes = map(np.concatenate, (keys, counts, shapes))
    words, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    totals = np.zeros(len(words), np.uint64)
    np.add.at(totals, inverse, counts)
    block = tv.put_planes(np.diff(words, prepend=np.uint64(0)), 8) + tv.put_planes(totals, 6) + shapes[first].tobytes()
    lists = pa.array([table.column("batch").to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32()))
    return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), pa.array([len(words)], pa.int32()), pa.array([block], pa.binary()), *lists, pa.array([tv.put_planes(inverse, 4)], pa.binary())], names=[f.split()[0] for f in _STATE.split(", ")])


class _Bucket:
    """A row of the state."""

    def __init__(self, row: dict):
        n, raw = row["n"], row["words"]
        self.bucket, self.batches, self.sizes = row["bucket"], row["batches"], row["sizes"]
        self.words = np.cumsum(tv.get_planes(raw[: 8 * n], n, 8))
        self.totals = tv.get_planes(raw[8 * n : 14 * n], n, 6).astype(np.int64)
        self.shapes = np.frombuffer(raw[14 * n :], np.uint8).astype(np.int64)
        self.numbers = tv.get_planes(row["numbers"], sum(self.sizes), 4).astype(np.int64)

    def movable(self, least: int) -> np.ndarray:
        return (self.totals >= least) & (self.shapes != _END_SHAPE)

    def answers(self, place: np.ndarray) -> pa.RecordBatch:
        """For each batch, the counts and places of the words that it asked about."""
        rows, at = [], 0
        for batch, n in zip(self.batches, self.sizes, strict=True):
            own = self.numbers[at : at + n]
            rows.append((batch, self.bucket, n, tv.put_planes(self.totals[own].astype(np.uint64), 6) + tv.put_planes(place[own].astype(np.uint64), 2)))
            at += n
        return _table(rows, _BLOCKS).combine_chunks().to_batches()[0]


def _rows(batches):
    """Rows one by one: each may hold megabytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _buckets(batches):
    return map(_Bucket, _rows(batches))


class _Text:
    """A batch's texts: its words' counts and places, and for every token its word's number."""

    def __init__(self, table: pa.Table, replies: pa.Table):
        row = table.to_pylist()[0]
        self.row, self.inverse, self.at = row, tv.get_planes(row["block"], row["n"], 4).astype(np.int64), np.array(row["at"], np.int64)
        replies = replies.sort_by("bucket")
        self.buckets, self.sizes = replies.column("bucket").to_pylist(), replies.column("n").to_pylist()
        counts, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for x, n in zip(replies.column("block"), self.sizes, strict=True):
            raw = memoryview(x.as_buffer())
            counts.append(tv.get_planes(raw[: 6 * n], n, 6))
            places.append(tv.get_planes(raw[6 * n :], n, 2))
        self.count, self.place = (np.concatenate(x).astype(np.int64) for x in (counts, places))


def _contexts(text: _Text, units: int, end: int, least: int, words: bool) -> list[tuple]:
    """Blocks: bigrams of units (bucket null), and if asked for, by bucket, which units stand before and after each word."""
    learned = np.repeat(np.array(text.row["learn"], bool), np.diff(text.at))
    number = text.inverse[learned]
    unit = text.place[number]
    last = np.zeros(len(text.inverse), bool)
    last[text.at[1:] - 1] = True
    last = last[learned]
    before = np.empty_like(unit)
    before[1:] = unit[:-1]
    before[:1] = end
    before[1:][last[:-1]] = end
    pair, n = np.unique(before * units + unit, return_counts=True)
    rows = [(text.row["batch"], None, len(pair), _cells(pair, n))]
    if words:
        after = np.append(unit[1:], end)
        take = (text.count[number] >= least) & ~last
        number, before, after = number[take], before[take], after[take]
        cell, n = np.unique(np.concatenate([number * 2 * units + after, number * 2 * units + units + before]), return_counts=True)
        start = np.cumsum([0, *text.sizes])
        edges = np.searchsorted(cell, start * 2 * units)
        for bucket, base, lo, hi in zip(text.buckets, start[:-1].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi > lo:
                rows.append((text.row["batch"], bucket, hi - lo, _cells(cell[lo:hi] - base * 2 * units, n[lo:hi])))
    return rows


def _matrix(contexts: DataFrame, units: int) -> np.ndarray:
    """The sum of all batches' bigrams of units: added up in tasks, and of these sums the driver gets one for each cell."""

    def add(batches):
        grid = np.zeros(units * units, np.int64)
        for row in _rows(batches):
            pair, n = _uncells(row["block"], row["n"])
            grid[pair] += n
        at = np.flatnonzero(grid)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(grid[at])], names=["pair", "n"])

    summed = contexts.filter("bucket is null").select("n", "block").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros(units * units)
    grid[np.asarray(summed["pair"])] = np.asarray(summed["n"])
    return grid.reshape(units, units)


class _Clustered:
    """The training vocabulary by bucket with every word's class, and what the model needs."""

    def __init__(self, docs: DataFrame, *, least: int, rounds: int, batch_bytes: int, classes: int | None):
        spark = docs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        made = _make(docs, max(parts, -(-size // batch_bytes)), batch_bytes)
        self.texts = made.filter("bucket is null").drop("bucket")
        self.state = stored(made.filter("bucket is not null").select("batch", "bucket", "n", "block").groupBy("bucket").applyInArrow(_merge, _STATE))
        most = 4 * 128

        def summary(batches):
            for b in _buckets(batches):
                t, s = b.totals, b.shapes
                sums = [np.bincount(s, weights=w, minlength=_SHAPES).astype(np.int64) for w in (t, t > 0, t == 1, t == 2, b.movable(least))]
                top = np.lexsort((b.words, -t))[: most + 1]
                top = top[b.movable(least)[top]]
                rows = [(0, k, *(int(x[k]) for x in sums)) for k in range(_SHAPES)] + [(1, int(b.words[i].view(np.int64)), int(t[i]), 0, 0, 0, 0) for i in top]
                yield _table(rows, "kind long, key long, n long, v long, n1 long, n2 long, m long").combine_chunks().to_batches()[0]

        found = stored(self.state.mapInArrow(summary, "kind long, key long, n long, v long, n1 long, n2 long, m long"))
        sums = {r.key: r for r in found.filter("kind = 0").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "v", "n1", "n2", "m"))).collect()}
        get = lambda c: np.array([getattr(sums[k], c) if k in sums else 0 for k in range(_SHAPES)], np.int64)
        self.tokens, self.types, self.once, self.twice = int(get("n").sum()), int(get("v").sum()), get("n1"), get("n2")
        movable = int(get("m").sum())
        self.classes = classes or 2 ** min(max(round(math.log2(max(movable, 1)) / 2) - 2, 4), 7)
        top = found.filter("kind = 1").orderBy(F.desc("n"), "key").limit(4 * self.classes).collect()
        keys = np.array([r.key for r in top], np.int64).view(np.uint64)
        order = np.argsort(keys)
        known = np.append(keys[order], np.uint64(2**64 - 1))
        seed = lambda words: np.where(known[at := np.searchsorted(known, words)] == words, np.append(order, -1)[at], -1)

        def first(batches):
            """Seeds are units of their own, all other words are shapes."""
            for b in _buckets(batches):
                of = seed(b.words)
                yield b.answers(np.where(of >= 0, of, len(top) + b.shapes))

        self.answered = stored(self.state.mapInArrow(first, _BLOCKS))
        units = len(top) + _SHAPES
        to_class, places = None, None
        for turn in range(rounds):
            contexts = stored(self._count(units, least, True))
            grid = _matrix(contexts, units)
            if to_class is None:
                to_class = exchange(grid, len(top), self.classes)
                member = np.zeros((units, self.classes + _SHAPES))
                member[np.arange(units), to_class] = 1
                grid = member.T @ grid @ member
            places = self._move(contexts, places, grid, units, to_class, seed, least, turn)
            units, to_class = self.classes + _SHAPES, np.arange(self.classes + _SHAPES)
        self.places = places

    def _count(self, units: int, least: int, words: bool) -> DataFrame:
        end = units - _SHAPES + _END_SHAPE

        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            return _table(_contexts(_Text(table, replies), units, end, least, words) if table.num_rows else [], _BLOCKS)

        return self.texts.groupBy("batch").cogroup(self.answered.groupBy("batch")).applyInArrow(run, _BLOCKS)

    def _move(self, contexts: DataFrame, places: DataFrame | None, grid: np.ndarray, units: int, to_class: np.ndarray, seed, least: int, turn: int) -> DataFrame:
        """One round: words' new places by bucket, and the answers to batches that say so.

        The first round moves all words, each later one half of them, by hash, so that words which stand together don't
        all leave a class at once.
        """
        classes, k = self.classes, len(grid)
        state = self.state if places is None else self.state.join(places.select("bucket", "place"), "bucket")

        def run(table: pa.Table, cells: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _table([], "bucket int, n int, place binary")
            row = table.to_pylist()[0]
            b = _Bucket(row)
            movable, own = b.movable(least), seed(b.words)
            if "place" in row:
                now = tv.get_planes(row["place"], len(b.words), 2).astype(np.int64)
            else:
                now = np.where(own >= 0, to_class[own], -1)
            base = dict(zip(b.batches, np.cumsum([0, *b.sizes]).tolist(), strict=False))
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for batch, n, raw in zip(*(cells.column(c).to_pylist() for c in ("batch", "n", "block")), strict=True):
                cell, count = _uncells(raw, n)
                number, at = b.numbers[base[batch] + cell // (2 * units)], cell % (2 * units)
                keys.append(number * 2 * k + at // units * k + to_class[at % units])
                counts.append(count)
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            if turn:
                take = ((b.words[keys // (2 * k)] >> np.uint64(7)) & np.uint64(1)).astype(int) == turn % 2
                keys, counts = keys[take], counts[take]
            keys, inverse = np.unique(keys, return_inverse=True)
            total = np.bincount(inverse, counts, len(keys))
            place = moves(keys // (2 * k), keys % (2 * k), total, grid, classes, now)
            # A word without contexts is its bucket's, by hash: in training every word has some, so this is never used.
            place = np.where(movable, np.where(place >= 0, place, (b.words % np.uint64(classes)).astype(np.int64)), classes + b.shapes)
            return _table([(b.bucket, len(b.words), tv.put_planes(place, 2))], "bucket int, n int, place binary")

        moved = stored(state.groupBy("bucket").cogroup(contexts.filter("bucket is not null").groupBy("bucket")).applyInArrow(run, "bucket int, n int, place binary"))

        def answer(batches):
            for row in _rows(batches):
                b = _Bucket(row)
                yield b.answers(tv.get_planes(row["place"], len(b.words), 2).astype(np.int64))

        self.answered = stored(self.state.join(moved.select("bucket", "place"), "bucket").mapInArrow(answer, _BLOCKS))
        return moved

    def words(self) -> DataFrame:
        """word (its hash), n and class of every training word; classes from ``classes`` on are spelling shapes."""

        def run(batches):
            for row in _rows(batches):
                b, n = _Bucket(row), row["n"]
                seen = b.totals > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[seen]) for x in (b.words.view(np.int64), b.totals, tv.get_planes(row["place"], n, 2).astype(np.int64))], names=["word", "n", "class"])

        return self.state.join(self.places.select("bucket", "place"), "bucket").mapInArrow(run, "word long, n long, class long")

    def model(self) -> Model:
        k = self.classes + _SHAPES
        grid = _matrix(self._count(k, 0, False), k)
        by = {r["class"]: r for r in self.words().groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
        n, v = (np.array([by[i][c] if i in by else 0 for i in range(k)], float) for c in ("n", "v"))
        shape = lambda x: np.concatenate([np.zeros(self.classes), x])
        return Model(grid, np.stack([n, v, shape(self.once), shape(self.twice)]), self.classes)


def word_classes(docs: DataFrame, *, least: int = 2, rounds: int = 2, batch_bytes: int = 4 << 20, classes: int | None = None) -> DataFrame:
    """word (64-bit hash), n and class of every word of all texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out"), F.lit(True).alias("learn"))
    return _Clustered(docs, least=least, rounds=rounds, batch_bytes=batch_bytes, classes=classes).words()


def score(docs: DataFrame, *, held_out, learn, least: int = 2, rounds: int = 2, batch_bytes: int = 4 << 20, classes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(learn, F.lit(False)).alias("learn"))
    known = _Clustered(docs, least=least, rounds=rounds, batch_bytes=batch_bytes, classes=classes)
    model = spark.sparkContext.broadcast(known.model())
    base = np.log10(known.tokens + known.types + 1)

    def weigh(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        text = _Text(table, replies)
        count, at = text.count[text.inverse], text.at
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        add = lambda x: np.bincount(doc, x, len(at) - 1)
        values = (text.row["ids"], text.row["held"], np.diff(at), add(count > 0).astype(np.int64), add(np.log10(count + 1.0) - base), add(model.value(text.place[text.inverse], count, at)))
        return pa.table([pa.array(x, k) for x, k in zip(values, kinds, strict=True)], names=names)

    scored = known.texts.groupBy("batch").cogroup(known.answered.groupBy("batch")).applyInArrow(weigh, OUT)
    return scored.withColumn("train_tokens", F.lit(known.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = remainder(F.col("doc_id"), 7)
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out=rest == 2, learn=rest != 2)
