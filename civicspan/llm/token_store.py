"""Token ids in binary blocks with Elias-Fano boundaries.

The store is a table of blocks in ascending document order. A block holds the concatenated ids of
its documents (16 bits each if the vocabulary allows, else 32), the boundaries between them and the
document ids, both as Elias-Fano sequences: the low bits of each value packed, the high bits in unary, in about
``2 + log2(universe / n)`` bits a value. Positions of every 64th one in the unary part make
``select`` a short scan, so one document's place is found without decoding the others'.

Defined cases: a null text counts as an empty one and has only its end id; documents without an id
come first; documents with the same id follow one another, in the order of their texts' hashes;
an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspan.llm.bpe import PieceEncoder, byte_characters, read_vocabulary
from civicspan.llm.common import small_batches
from civicspan.session import fresh_path

SAMPLED = 64
BLOCK_IDS = 1 << 20
BLOCK_SCHEMA = (
    "shard int, block int, n_docs long, n_ids long, width int, nulls long, first long, ids binary, bounds binary, doc_ids binary"
)


class EliasFano:
    """A sequence of non-decreasing numbers from 0."""

    HEAD = struct.Struct("<QBQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLED].astype("<u8"))

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, low, high = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        parts = np.frombuffer(data, np.uint8)
        samples = np.frombuffer(data, "<u8", offset=at + low + high)
        return cls(n, low_bits, parts[at : at + low], parts[at + low : at + low + high], samples)

    def select(self, i: int) -> int:
        """The place of the ``i``-th one in the unary part: from the nearest sample on, byte by byte."""
        place = int(self.samples[i // SAMPLED])
        left = i % SAMPLED
        byte = place >> 3
        bits = int(self.high[byte]) >> (place & 7) << (place & 7)
        while bits.bit_count() <= left:
            left -= bits.bit_count()
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return 8 * byte + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        low, at = 0, i * self.low_bits
        if self.low_bits:
            taken = self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes()
            low = (int.from_bytes(taken, "little") >> (at & 7)) & ((1 << self.low_bits) - 1)
        return ((self.select(i) - i) << self.low_bits) | low

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        result = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            result |= bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return result


@lru_cache(maxsize=2)
def library_encoder(content: str) -> PieceEncoder:
    """Texts to ids by the tokenizers library's own merges; each new piece is handed to it once."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    model = tokenizer.model
    characters = {byte: c for c, byte in byte_characters().items()}
    special = {token.content: i for i, token in tokenizer.get_added_tokens_decoder().items()}

    def piece(text: str) -> bytes:
        spelled = "".join(map(characters.__getitem__, text.encode()))
        return np.array([token.id for token in model.tokenize(spelled)], "<u4").tobytes()

    return PieceEncoder(special, piece)


def _block(shard: int, block: int, keys: list[int | None], ids: list[bytes], width: int) -> dict:
    joined = np.frombuffer(b"".join(ids), "<u4")
    sizes = [len(i) // 4 for i in ids]
    known = [k for k in keys if k is not None]
    first = known[0] if known else 0
    return {
        "shard": shard,
        "block": block,
        "n_docs": len(keys),
        "n_ids": len(joined),
        "width": width,
        "nulls": len(keys) - len(known),
        "first": first,
        "ids": joined.astype(f"<u{width}").tobytes(),
        "bounds": EliasFano.of(np.cumsum([0, *sizes])).to_bytes(),
        "doc_ids": EliasFano.of(np.array([k - first for k in known], dtype=np.uint64)).to_bytes(),
    }


def id_width(content: str, end_id: int) -> int:
    """The bytes that hold every id of a vocabulary, and the end: 2 or 4."""
    held = json.loads(content)
    ids = [*held["model"]["vocab"].values(), *(token["id"] for token in held.get("added_tokens", [])), end_id]
    return 2 if max(ids) < 1 << 16 else 4


def write_store(
    docs: DataFrame, vocabulary: str, end_id: int = 2, width: int | None = None, key: str = "doc_id", text: str = "text"
) -> str:
    """Encodes the documents, each followed by ``end_id``, and writes the blocks; returns the store's path.

    Ids are ``width`` bytes wide, by default as wide as the vocabulary needs; fewer raise ValueError. Texts are dealt to ranges of document ids before they are encoded, as they are smaller than
    their ids; a block is full at 2**20 ids, and a longer document has one for itself.
    """
    spark = docs.sparkSession
    vocabulary_json = read_vocabulary(vocabulary)
    needed = id_width(vocabulary_json, end_id)
    width = width or needed
    if width < needed:
        raise ValueError(f"ids of this vocabulary need {needed} bytes")
    content = spark.sparkContext.broadcast(vocabulary_json)
    path = fresh_path(spark, "token-store")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(content.value).encode
        shard, block, size = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        for batch in small_batches(batches):
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = encode(own or "") + end
                if keys and size + len(made) // 4 > BLOCK_IDS:
                    yield pa.RecordBatch.from_pylist([_block(shard, block, keys, ids, width)], schema=arrow)
                    keys, ids, size, block = [], [], 0, block + 1
                keys.append(doc)
                ids.append(made)
                size += len(made) // 4
        if keys:
            yield pa.RecordBatch.from_pylist([_block(shard, block, keys, ids, width)], schema=arrow)

    arrow = pa.schema(
        [(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in BLOCK_SCHEMA.split(", "))]
    )
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, block, block_start``: the ids before each block. One row a shard is collected."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).select("shard", "block", "n_ids")
    totals, before = [], 0
    for row in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        totals.append((row["shard"], before))
        before += row["n"]
    shards = spark.createDataFrame(totals, "shard int, shard_start long")
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumn("inside", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    return inside.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("inside")).alias("block_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``shard, block, doc_id, place, n_tokens, ids``: each document of each block, ids as little-endian 32-bit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            row = batch.to_pylist()[0]
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            boundaries = EliasFano.from_bytes(row["bounds"])
            bounds = np.array([boundaries[i] for i in range(boundaries.n)], np.int64)  # each by its select
            keys = [None] * row["nulls"]
            keys += [row["first"] + int(k) for k in EliasFano.from_bytes(row["doc_ids"]).values()]
            n = row["n_docs"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * n, pa.int32()),
                    pa.array([row["block"]] * n, pa.int32()),
                    pa.array(keys, pa.int64()),
                    pa.array(bounds[:-1], pa.int64()),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                ],
                names=["shard", "block", "doc_id", "place", "n_tokens", "ids"],
            )

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    return blocks.mapInArrow(run, "shard int, block int, doc_id long, place long, n_tokens long, ids binary")


def document(spark: SparkSession, path: str, shard: int, block: int, i: int) -> np.ndarray:
    """The ids of one document, whose place ``select`` finds."""
    row = spark.read.schema(BLOCK_SCHEMA).parquet(path).where((F.col("shard") == shard) & (F.col("block") == block)).first()
    bounds = EliasFano.from_bytes(bytes(row["bounds"]))
    ids = np.frombuffer(row["ids"], f"<u{row['width']}")
    return ids[bounds[i] : bounds[i + 1]].astype(np.uint32)
