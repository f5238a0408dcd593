"""Edit-aware token counts: a segment tree of token sums per document, updated where edits touch it.

A text is cut into leaves of a few hundred characters at places where a pre-token is sure to begin (a single space
between two letters or digits), so a text's tokens are the sum of its leaves'. A document's tree holds, for every node,
the characters and tokens below it. An edit walks down the tree to the leaves it touches, takes the two characters
before it and the one after it as context, re-encodes these leaves' new text alone, and updates the sums on the way up;
the cuts outside keep their neighbours and so stay certain. Leaves that edits let grow are cut again when trees are
built next.

``build`` makes the trees of a table (one pass, no shuffle; a tree is two short arrays, the leaves' characters and
tokens). ``apply_edits`` joins texts, trees and edits on the document, and returns new texts, trees and counts.
Edits give places in the text before any of them: document, at (characters from 0), delete (characters), insert (text).
They take effect from the last place to the first, a deletion ending where a later edit begins; edits beyond the end
take place at the end.

Defined cases: null texts count as empty, with 0 tokens; null insertions are empty, null or negative places and lengths
are 0; edits of unknown documents and documents without edits change nothing; rows that repeat an id are each edited;
rows without an id have no edits; further columns are ignored. A document's edits are applied by one task, since each
needs the text that the others leave; they are bounded by what one text can take.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.arrowio import column, slices
from netloom.llm.op5_training_order import Vocabulary

_CUT = re.compile("(?<=[0-9A-Za-zÀ-ɏ]) (?=[0-9A-Za-zÀ-ɏ])")
LEAF = 256


def leaves(text: str, size: int = LEAF) -> list[str]:
    out, at = [], 0
    while found := _CUT.search(text, at + size):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class Tree:
    """Sums of characters and tokens over leaves, in heap order."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = len(chars)
        self.width = 1 << max(self.n - 1, 0).bit_length()
        self.sums = [[0] * self.width + list(x) + [0] * (self.width - self.n) for x in (chars, tokens)]
        for s in self.sums:
            for i in range(self.width - 1, 0, -1):
                s[i] = s[2 * i] + s[2 * i + 1]

    @property
    def chars(self) -> int:
        return self.sums[0][1]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one if beyond), and the leaf's first character."""
        chars, i, start = self.sums[0], 1, 0
        place = min(place, max(self.chars - 1, 0))
        while i < self.width:
            i *= 2
            if place - start >= chars[i]:
                start += chars[i]
                i += 1
        return i - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        for s, value in zip(self.sums, (chars, tokens), strict=True):
            i = leaf + self.width
            change = value - s[i]
            while i and change:
                s[i] += change
                i //= 2

    def leaf_sums(self) -> tuple[list[int], list[int]]:
        return tuple(s[self.width : self.width + self.n] for s in self.sums)


def edit(text: str, tree: Tree, at: int, delete: int, insert: str, count) -> tuple[str, int]:
    """Apply one edit to a text and its tree; returns the text and how many characters were encoded again."""
    at = min(at, len(text))
    end = min(at + delete, len(text))
    if at == end and not insert:
        return text, 0
    first, start = tree.leaf_at(max(at - 2, 0))
    last, last_start = tree.leaf_at(end)
    stop = last_start + tree.sums[0][last + tree.width]
    region = text[start:at] + insert + text[end:stop]
    for leaf in range(first + 1, last + 1):
        tree.put(leaf, 0, 0)
    tree.put(first, len(region), sum(count(x) for x in leaves(region)))
    return text[:at] + insert + text[end:], len(region)


def build(docs: DataFrame, *, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, text_key and the leaves' chars and tokens, once for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary())

    def run(batches):
        encoding = shared.value.encoding
        for batch in batches:
            for piece in slices(batch, "text"):
                parts = [leaves(t) for t in column(piece, "text").to_pylist()]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())
                flat = [leaf for p in parts for leaf in p]
                chars, tokens = [len(x) for x in flat], [len(encoding.encode_to_numpy(x, disallowed_special=())) for x in flat]
                yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), column(piece, "text_key"), *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (chars, tokens))], names=["doc_id", "text_key", "chars", "tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_key long, chars array<int>, tokens array<int>")


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, *, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, text, chars and tokens after the edits, n_tokens before and after, n_edits and n_reencoded (characters)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary())
    whole = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0))
    one = F.struct(whole("at").alias("at"), whole("delete").alias("delete"), F.coalesce("insert", F.lit("")).alias("insert"))
    lists = edits.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(one)).alias("edits"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    # Trees and edits, which are short, meet first; texts are shuffled once.
    known = trees.dropDuplicates(["doc_id", "text_key"]).join(lists, "doc_id", "left").withColumnsRenamed({"doc_id": "tree_id", "text_key": "tree_key"})
    joined = texts.join(known, F.col("doc_id").eqNullSafe(F.col("tree_id")) & (F.col("text_key") == F.col("tree_key")))
    out = "doc_id long, text string, chars array<int>, tokens array<int>, n_tokens long, n_edits long, n_tokens_after long, n_reencoded long"

    def run(batches):
        encoding = shared.value.encoding
        count = lambda x: len(encoding.encode_to_numpy(x, disallowed_special=()))
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = []
                for doc, text, chars, tokens, todo in zip(*(column(piece, c).to_pylist() for c in ("doc_id", "text", "chars", "tokens", "edits")), strict=True):
                    tree, again, limit = Tree(chars, tokens), 0, len(text)
                    before = tree.tokens
                    for e in reversed(todo or []):
                        at = min(e["at"], limit)
                        text, n = edit(text, tree, at, min(e["delete"], limit - at), e["insert"], count)
                        again, limit = again + n, at
                    rows.append((doc, text, *tree.leaf_sums(), before, len(todo or []), tree.tokens, again))
                kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in out.split(", ")])

    return joined.select("doc_id", "text", "chars", "tokens", "edits").mapInArrow(run, out)


def sample_edits(docs: DataFrame, *, per_document: int = 3) -> DataFrame:
    """Edits for every document, drawn by hashes of its id: places, deletions up to 23 characters, insertions of its own text."""
    size = F.length("text")
    hashed = lambda salt, by: F.pmod(F.xxhash64("doc_id", "n", F.lit(salt)), by.cast("long")).cast("int")
    drawn = docs.filter(size > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(per_document))).alias("n"))
    return drawn.select("doc_id", hashed("at", size + 1).alias("at"), hashed("delete", F.lit(24)).alias("delete"), F.substr("text", hashed("from", size) + 1, hashed("size", F.lit(24))).alias("insert"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = apply_edits(docs, build(docs), sample_edits(docs))
    return found.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded")
