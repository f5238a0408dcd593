"""Toxicity: class-conditional Kneser-Ney bigram models, compared by length-normalised log-likelihoods.

Each class, toxic and ordinary, has a model P(word | word before) of three levels, with absolute discounts:

* a pair of words counts as often as there are different words that it follows in the class's documents, so copies and
  near copies of a document add nothing; 1 is taken off each count and goes to what both classes share: the pairs'
  counts of both, discounted in the same way, weighed by how much likelier the pair's word is in the class;
* below, a word counts as often as there are different words that it follows in the class; its stem (first four
  characters) as often as there are different words that complete it, which catches inflections never seen. The
  discount, below 1, is estimated for each class from how many keys have one context and two;
* below both lies what the classes share: in how many of them a key occurs, as Kneser-Ney counts contexts once more. So
  a word seen once in a class keeps evidence, and a rare expression that one class alone has is weak evidence.

Probabilities of all words of the model add up to 1 after any word. A text's raw score is the difference of the classes'
log-likelihoods divided by length, taken over ``window`` tokens in a row where it is largest (over all of a shorter
text), so a passage counts the same in a long text as in a short one. A logistic curve makes it a score.

A bounded sample of labelled rows (up to ``per_class`` of each label, weighted by the rows behind them) is counted by
Spark: three quarters make the models, the rest places the curve. The sample's words and its pairs of two contexts or
more reach the driver and the broadcast, as Arrow columns. Scoring is one pass without a shuffle.

Defined cases: null counts as the empty text, whose difference is 0; without labels of both classes every score is 0; rows
without an id are scored and never held out; repeated ids are scored row by row; further columns are kept by
``drop_toxic``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import textvec as tv
from netloom.llm.arrowio import add_columns, column, slices, unused
from netloom.llm.labelled import Scale, remainder, sample_labels
from netloom.llm.session import checkpointed

_PAIR = 0x70C5
STEM = 4


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of their stems, and words before each document."""
    data, offsets = tv.as_bytes(texts)
    data = tv.LOWER[data]
    starts, ends, at = tv.words(data, offsets, tv.NOT_ALNUM)
    heads = (data & 0xC0) != 0x80
    # Where characters begin, and beyond the last one the end of the data.
    begins = np.append(np.flatnonzero(heads), np.full(STEM, len(data)))
    before = np.cumsum(heads) - heads
    cut = begins[before[starts] + STEM]
    return tv.word_hashes(data, starts, ends), tv.word_hashes(data, starts, np.minimum(ends, cut)), at


def _before(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The word before each token; 0 where a text begins."""
    before = np.zeros(len(hashes), np.uint64)
    before[1:] = hashes[:-1]
    before[at[:-1][np.diff(at) > 0]] = 0
    return before


def discounts(once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Absolute discounts n1 / (n1 + 2 n2), kept between 0.1 and 0.9 where a table is too small to tell."""
    return np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)


class _Level:
    """Probabilities of both classes by key: discounted counts, and the mass taken off shared by how many classes have a key.

    Both classes share the same mass, the larger of the two, so that having fewer documents is no evidence by itself.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        n = counts.sum(axis=0)
        off = np.minimum(counts, discounts((counts == 1).sum(axis=0), (counts == 2).sum(axis=0)))
        back = off.sum(axis=0) / n
        self.mass = back.max()
        order = np.argsort(keys)
        # A last entry that no search passes keeps lookups in range.
        self.keys, counts, off = np.append(keys[order], np.uint64(2**64 - 1)), counts[order], off[order]
        self.kept = (1 - self.mass) * (counts - off) / n / (1 - back)
        self.classes = (counts > 0).sum(axis=1)[:, None]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.keys, hashes)
        return place, self.keys[place] == hashes


class _Pairs:
    """P(word | word before) of both classes, over a backoff in which the classes share the pairs' counts.

    A pair counts as often as there are different words before it, and 1 is taken off: what one passage has said, however
    often it was copied, stays with the words. What is taken off after a word goes to the pairs of both classes together
    (discounted alike, over the words of both), each weighed by how much likelier its word is in the class; so a pair
    that one class alone has seen a few times is no more than weak evidence, and its word keeps its own.
    """

    def __init__(self, before: np.ndarray, words: np.ndarray, counts: np.ndarray, lean: np.ndarray, firsts: np.ndarray, sums: np.ndarray, types: np.ndarray):
        """Pairs of two contexts or more and their (pairs, 3) counts in each class and both; lean: the ratio of the
        word's probability in each class and in both. firsts: the words before them, in order, with the sums and numbers
        of all pairs' counts after them."""
        of = np.searchsorted(firsts, before)
        add = lambda x: np.stack([np.bincount(of, x[:, c], len(firsts)) for c in range(x.shape[1])], axis=1)
        mass = types / np.maximum(sums, 1)
        mass[:, :2] = mass[:, :2].max(axis=1, keepdims=True)  # having fewer documents is no evidence by itself
        kept = np.maximum(counts - 1, 0)
        total = add(kept)
        mass = np.where(total > 0, mass, 1.0)  # a class that kept no pair of a word gives all to what is shared
        share = (1 - mass)[of] * kept / np.maximum(total, 1)[of]
        # Weighing by class changes the sum over all words from 1 to this.
        norm = mass[:, 2:] + add(share[:, 2:] * lean)
        key = tv.mix(before, _PAIR) ^ words
        order = np.argsort(key)
        self.keys, self.share = np.append(key[order], np.uint64(2**64 - 1)), np.concatenate([share[order], np.zeros((1, 3))])
        self.firsts = np.append(firsts, np.uint64(2**64 - 1))
        self.mass, self.norm = np.concatenate([mass, np.ones((1, 3))]), np.concatenate([norm, np.ones((1, 2))])

    def __call__(self, before: np.ndarray, words: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Each token's probability in both classes; p: its word's in the classes and in both."""
        key = tv.mix(before, _PAIR) ^ words
        place = np.searchsorted(self.keys, key)
        share = np.where((self.keys[place] == key)[:, None], self.share[place], 0.0)
        place = np.searchsorted(self.firsts, before)
        found = (self.firsts[place] == before)[:, None]
        mass, norm = np.where(found, self.mass[place], 1.0), np.where(found, self.norm[place], 1.0)
        both = share[:, 2:] + mass[:, 2:] * p[:, 2:]
        return share[:, :2] + mass[:, :2] * both * (p[:, :2] / p[:, 2:]) / norm


class Models:
    """Both classes' models: pairs of words over words over stems."""

    def __init__(self, words: np.ndarray, own: np.ndarray, follows: np.ndarray, pairs: tuple, firsts: tuple, window: int):
        """Words, their stems and (words, 2) numbers of what they follow; both classes have some. For pairs (before, word,
        counts) and firsts see _Pairs."""
        completed, within = np.unique(own, return_inverse=True)
        types = np.stack([np.bincount(within, follows[:, c] > 0, len(completed)) for c in (0, 1)], axis=1)
        order = np.argsort(words)
        words, own, follows, within = words[order], own[order], follows[order], within[order]
        word, stem = _Level(words, follows), _Level(completed, types)
        p_stem = stem.kept + stem.mass * stem.classes / stem.classes.sum()
        place, _ = stem.find(own)
        inside = np.bincount(place, word.classes[:, 0], len(completed))[:, None]
        self.words, self.stems, self.window = word, stem, window
        both = lambda p: np.concatenate([p, p.mean(axis=1, keepdims=True)], axis=1)
        # The last rows: a word not in the model is its stem's, in the share of half a word; a new stem backs off alike in both classes.
        self.p_word = both(np.concatenate([word.kept + word.mass * (p_stem / inside)[place] * word.classes, np.ones((1, 2))]))
        least = word.mass * p_stem / np.maximum(inside, 1) / 2
        self.p_stem = both(np.concatenate([least, np.full((1, 2), least.min())]))
        at, _ = word.find(pairs[1])
        self.pairs = _Pairs(*pairs, self.p_word[at, :2] / self.p_word[at, 2:], *firsts)

    def likelihoods(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """For each token its logarithm of probability after the word before it, in both classes; tokens before each text."""
        hashes, stems, at = _tokens(texts)
        place, found = self.stems.find(stems)
        p = np.where(found[:, None], self.p_stem[place], self.p_stem[-1])
        place, found = self.words.find(hashes)
        p = np.where(found[:, None], self.p_word[place], p)
        return np.log(self.pairs(_before(hashes, at), hashes, p)), at

    def __call__(self, texts) -> np.ndarray:
        """The largest mean difference of the classes' log-likelihoods over ``window`` tokens in a row; 0 without any."""
        logs, at = self.likelihoods(texts)
        ratio = logs[:, 1] - logs[:, 0]
        sizes = np.diff(at)
        last = np.repeat(at[1:], sizes)
        first = np.arange(len(ratio))
        begin = first[(first + self.window <= last) | (first == np.repeat(at[:-1], sizes))]
        end = np.minimum(begin + self.window, last[begin])
        sums = np.concatenate([[0.0], np.cumsum(ratio)])
        out = np.zeros(len(sizes))
        some = sizes > 0
        if some.any():
            out[some] = np.maximum.reduceat((sums[end] - sums[begin]) / (end - begin), np.searchsorted(begin, at[:-1][some]))
        return out


class Model:
    def __init__(self, models: Models | None, scale: Scale | None):
        self.models, self.scale = models, scale

    def __call__(self, texts) -> np.ndarray:
        return np.zeros(len(texts)) if self.models is None else self.scale(self.models(texts))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", trainable=None, per_class: int = 8_000, window: int = 3, at: float = 0.5) -> Model:
    sample = sample_labels(labels, label, trainable=F.lit(True) if trainable is None else trainable, per_class=per_class, even=False)
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", "fold", "weight")

    def contexts(batches):
        """Each word with the two words before it, and in which classes; once for each slice."""
        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, stems, at = _tokens(column(piece, "text"))
                before = _before(hashes, at)
                second = _before(before, at)
                toxic = np.repeat(np.asarray(column(piece, "label")), np.diff(at)) == 1
                _, first, inverse = np.unique(tv.mix(tv.mix(second, _PAIR) ^ before, _PAIR) ^ hashes, return_index=True, return_inverse=True)
                flags = [np.bincount(inverse, weights=x, minlength=len(first)) > 0 for x in (~toxic, toxic)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[first].view(np.int64)) for x in (hashes, stems, before, second)), *(pa.array(x.astype(np.int32)) for x in flags)], names=["key", "stem", "before", "second", "n0", "n1"])

    triples = rows.filter("fold < 3").select("text", "label").mapInArrow(contexts, "key long, stem long, before long, second long, n0 int, n1 int")
    triples = triples.groupBy("key", "stem", "before", "second").agg(F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    counted = checkpointed(triples.groupBy("key", "stem", "before").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    both = F.col("n0") + F.col("n1")

    def table(df: DataFrame, keys: tuple, columns: tuple) -> tuple:
        got = df.toArrow()  # once: rows may come in another order each time
        return (*(got[c].to_numpy().view(np.uint64) for c in keys), *(np.stack([got[c].to_numpy().astype(float) for c in cs], axis=1) for cs in columns))

    key, stem, follows = table(counted.groupBy("key", "stem").agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1")), ("key", "stem"), (("n0", "n1"),))
    if not len(key) or not follows.sum(axis=0).all():
        return Model(None, None)
    pairs = table(counted.filter(both > 1).withColumn("n2", both), ("before", "key"), (("n0", "n1", "n2"),))
    sums = counted.groupBy("before").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(both).alias("n2"), F.count_if(F.col("n0") > 0).alias("t0"), F.count_if(F.col("n1") > 0).alias("t1"), F.count(F.lit(1)).alias("t2"), F.max(both).alias("most"))
    firsts, n, types = table(sums.filter("most > 1"), ("before",), (("n0", "n1", "n2"), ("t0", "t1", "t2")))
    order = np.argsort(firsts)
    ratio = Models(key, stem, follows, pairs, (firsts[order], n[order], types[order]), window)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    held = add_columns(rows.filter("fold = 3").select("text", "label", "weight"), "raw double", lambda piece: [pa.array(shared.value(column(piece, "text")), pa.float64())], keep=["label", "weight"]).collect()
    return Model(ratio, Scale(np.array([r.raw for r in held]), np.array([r.label for r in held]), at=at, weight=np.array([r.weight for r in held])))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, "score double", lambda piece: [pa.array(shared.value(column(piece, "text")), pa.float64())], small=True)


def drop_toxic(docs: DataFrame, model: Model, *, at: float = 0.5) -> DataFrame:
    """Documents that score below ``at``, with the columns they had."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = unused(docs.columns, "toxicity")
    scored = add_columns(docs, f"`{name}` double", lambda piece: [pa.array(shared.value(column(piece, "text")), pa.float64())], small=True)
    return scored.filter(F.col(name) < at).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), trainable=~held_out)
    return score_toxicity(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
