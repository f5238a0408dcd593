"""Training-order materialisation: token sequences in a keyed global order, as fixed-stride shards.

Texts become token ids of a byte-level vocabulary (its path is a parameter), each document closed by one end token and
cut into sequences of ``length`` ids, the last padded with the end token. Every sequence has an index below the number N
of sequences (its place in the table as read: partition offsets plus a running count), and a keyed Feistel permutation
of 0 to N - 1, walked along its cycles, gives it a slot of its own. Slots are dealt to as many equal ranges as there
are shards and sorted in them, so shard s holds slots s * stride to (s + 1) * stride - 1 and any slot's place in its
file is known without an index: reads are sequential and resume anywhere.

Tokens are made once: they are written to the shared folder, and only a count for each input partition goes to the
driver (bounded by the number of partitions). One shuffle brings sequences to their slots.

Defined cases: null and empty texts give one sequence that holds the end token alone; repeated rows are sequences of
their own; a row without an id keeps null; an empty table gives no sequences; further columns are ignored. The order
depends on the key, N and the order of the input, which is that of its files and splits.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.arrowio import column, slices
from netloom.llm.permute import feistel
from netloom.llm.session import stored

_encodings: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """A vocabulary file's contents, small enough to go to every executor, and its encoder there."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        with open(path or default_vocabulary(), "rb") as f:
            self.raw = f.read()
        self.pattern = public_tokenizers.PATTERN
        self.end = self.raw.count(b"\n")

    @property
    def encoding(self):
        key = hash(self.raw)
        if key not in _encodings:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.splitlines())}
            _encodings[key] = tiktoken.Encoding("corpus", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _encodings[key]


def sequences(docs: DataFrame, *, length: int = 512, vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row for each sequence: part and place (its place in the table as read), doc_id, piece, n_tokens, tokens.

    Tokens are little-endian 16-bit ids; n_tokens counts the end token but not the padding.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary())
    schema = "part int, place long, doc_id long, piece int, n_tokens int, tokens binary"

    def run(batches):
        encoding, end = shared.value.encoding, shared.value.end
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = column(rows, "text").to_pylist()
                tokens = [encoding.encode_to_numpy(t or "", disallowed_special=()) for t in texts]
                sizes = np.array([len(t) + 1 for t in tokens])
                pieces = -(-sizes // length)
                flat = np.full(int(pieces.sum()) * length, end, "<u2")
                first = np.cumsum(pieces) - pieces
                for t, at in zip(tokens, (first * length).tolist(), strict=True):
                    flat[at : at + len(t)] = t
                n = len(flat) // length
                piece = np.arange(n) - np.repeat(first, pieces)
                blocks = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), n, [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), column(rows, "doc_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(texts)), pieces))), pa.array(piece.astype(np.int32)), pa.array(np.minimum(np.repeat(sizes, pieces) - piece * length, length).astype(np.int32)), blocks],
                    names=["part", "place", "doc_id", "piece", "n_tokens", "tokens"],
                )
                place += n

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def materialise(docs: DataFrame, *, length: int = 512, key: int = 5, shards: int | None = None, shard_sequences: int = 1 << 15, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Sequences with slot, shard and record (place in the shard), in one partition for each shard, sorted by slot.

    There are as many shards as sequences ask for at ``shard_sequences`` each (32 MB at the usual length), whatever the
    session's settings.
    """
    spark = docs.sparkSession
    cut = stored(sequences(docs, length=length, vocabulary=vocabulary))
    counts = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    n = np.array([r.n for r in counts], np.int64)
    total = int(n.sum())
    shards = shards or max(1, -(-total // shard_sequences))
    stride = max(1, -(-total // shards))
    # From Arrow it becomes a local relation of known size: broadcast below Spark's threshold, without a shuffle of tokens.
    offsets = spark.createDataFrame(pa.table({"part": pa.array([r.part for r in counts], pa.int32()), "base": pa.array(np.cumsum(n) - n, pa.int64())}))
    slot = feistel(F.col("base") + F.col("place"), F.lit(total).cast("long"), F.lit(key).cast("long"))
    placed = cut.join(offsets, "part").withColumn("slot", slot)
    placed = placed.withColumn("shard", F.expr(f"cast(slot div {stride} as int)")).withColumn("record", F.expr(f"cast(slot % {stride} as int)"))
    ordered = placed.select("slot", "shard", "record", "doc_id", "piece", "n_tokens", "tokens")
    return ordered.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")


def write_shards(ordered: DataFrame, path: str) -> None:
    """One file for each shard, of records of 2 * length + 1 bytes: a sequence's ids and a line end.

    The record of slot s starts at byte (s % stride) * (2 * length + 1) of the file part-<s // stride>. Spark's writer
    commits a file as a whole, so a lost executor leaves no partial shard.
    """
    ordered.select(F.col("tokens").cast("string").alias("value")).write.text(path)


def read_records(raw: bytes, length: int, first: int = 0) -> np.ndarray:
    """A shard file's sequences from a record on."""
    stride = 2 * length + 1
    return np.frombuffer(raw, np.uint8).reshape(-1, stride)[first:, :-1].copy().view("<u2")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
