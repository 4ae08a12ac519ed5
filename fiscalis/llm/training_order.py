"""Token sequences in training order: fixed-stride binary shards under a keyed permutation.

The documents, in the order of their ids, form one stream of token ids with an end mark behind each. The stream is cut
into sequences of a fixed length, and a keyed Feistel permutation assigns every sequence a global slot. A shard holds a
range of slots; a sequence lies at slot * stride of its shard, so training reads shards from front to back and resumes
from a slot by one division.

The tokens are made once and written to the shared folder, then dealt by ranges of ids and counted; each document then
knows its place in the stream, and its tokens go to the shards that they belong to, one task per shard, and are written
once more before the shards are, so that a shard can be made again from its own file. The plan is the same at any size. Equal sequences get different slots and hot sources are spread by the permutation, so shards have one
size.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscalis.llm.common import materialize, new_path, pick, qualified, release, table, text_of
from fiscalis.llm.tokenizers import byte_ids, default_path, end_mark

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Tokens of a sequence, sequences of a shard, and the key of the permutation.
LENGTH = 512
PER_SHARD = 4096
KEY = 42
#: Documents whose heads teach the packing of pieces, and bytes of a head.
SAMPLES = 1000
SAMPLE_BYTES = 4096
ROUNDS = 6

_PIECES = "slot long, at int, id long, tokens binary"
_SEQUENCES = "slot long, shard long, byte_offset long, n_tokens int, doc_ids array<long>, sha256 binary, path string"


def _round_keys(key: int) -> np.ndarray:
    digest = hashlib.sha256(str(key).encode()).digest() + hashlib.sha256(b"more" + str(key).encode()).digest()
    return np.frombuffer(digest, "<u8")[:ROUNDS]


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1: a Feistel network over the next even power of two, walked along its cycle until the value is below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(key)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(29)
            left, right = right, left ^ (mixed & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, width = end_mark(path)

        def packed(text: str) -> bytes:
            ids = array("I", byte_ids(text, path))  # much faster than an array of numpy from a list
            ids.append(end)
            return np.frombuffer(ids, f"u{ids.itemsize}").astype(f"<u{width}").tobytes()

        for b in batches:
            found = [packed(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sub"), pa.array(found, pa.binary())], ["id", "sub", "tokens"])

    return run


@contextmanager
def _file_by_file(spark: SparkSession) -> Iterator[None]:
    """While it holds, each file of a table that is read is one task, whole and in its order."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {k: spark.conf.get(k) for k in names}
    for k in names:
        spark.conf.set(k, str(1 << 36))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def placed(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame, int]:
    """The tokens of all documents in the order of ids (null ids last), a file for each range of ids, as (part, id, n, tokens); the tokens before each part, as (part, base); and all tokens.

    The tokens are dealt by ranges of ids once. Only the sums of the ranges, one row each, are told to all; a task that
    reads a range counts on from there.
    """
    width = end_mark(path)[1]
    made = materialize(docs.mapInArrow(_tokens(path), "id long, sub long, tokens binary").withColumn("row", F.monotonically_increasing_id()), "order-tokens", level=1)
    order = F.col("id").asc_nulls_last(), F.col("sub"), F.col("row")  # row: so that equal rows can be dealt to several tasks
    dealt = made.repartitionByRange(*order).sortWithinPartitions(*order)
    run = materialize(dealt.select(F.spark_partition_id().alias("part"), "id", (F.octet_length("tokens") / width).cast("long").alias("n"), "tokens"), "order-places", level=1)
    release(made)
    parts = run.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return run, parts.select("part", "base"), total


def _dictionary(tokens: DataFrame) -> bytes:
    """What short pieces are packed by, from the heads of some documents; empty where there are few. It changes no result."""
    found = tokens.select(F.substring("tokens", 1, SAMPLE_BYTES).alias("x")).limit(SAMPLES).toArrow().column("x").to_pylist()
    samples = [x[i : i + 1024] for x in found for i in range(0, len(x), 1024)]
    return zstandard.train_dictionary(1 << 16, samples).as_bytes() if len(samples) > 500 else b""


def _pieces(total: int, length: int, key: int, width: int, packing: bytes):
    n = -(-total // length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(packing) if packing else None).compress
        part, before = None, 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = b.slice(at, 1000)
                ids, tokens = rows.column("id").to_pylist(), rows.column("tokens").to_pylist()
                size, parts, base = (rows.column(k).to_numpy() for k in ("n", "part", "base"))
                start = np.cumsum(size) - size
                for x in np.nonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))[0].tolist():
                    start[x:] += (before if parts[x] == part else int(base[x])) - start[x]
                    part = parts[x]
                before = int(start[-1] + size[-1])
                first, last = start // length, (start + size - 1) // length
                count = last - first + 1
                row = np.repeat(np.arange(len(ids)), count)
                sequence = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
                low = np.maximum(sequence * length - start[row], 0)
                high = np.minimum((sequence + 1) * length - start[row], size[row])
                cut = [pack(tokens[r][x:y]) for r, x, y in zip(row.tolist(), (low * width).tolist(), (high * width).tolist())]
                where = np.maximum(start[row] - sequence * length, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(permute(sequence, n, key)), pa.array(where), pa.array([ids[r] for r in row.tolist()], pa.int64()), pa.array(cut, pa.binary())], ["slot", "at", "id", "tokens"])

    return run


def _write(folder: str, length: int, per_shard: int, end_id: int, width: int, packing: bytes):
    """Writes each shard whole, under a name of the attempt's own that becomes the shard's name at the end, so that repeated and parallel attempts do no harm."""
    stride = length * width
    end = np.array(end_id, f"<u{width}").tobytes()

    def shard_rows(store, base: str, shard: int, held: dict[int, tuple[list, bytearray]]) -> pa.RecordBatch:
        name = f"shard-{shard:08d}.bin"
        own = f"{base}/_{uuid.uuid4().hex}"
        rows = []
        with store.open_output_stream(own) as out:
            for slot in sorted(held):
                ids, data = held[slot]
                filled = len(data) // width
                data += end * (length - filled)
                out.write(bytes(data))
                rows.append((slot, shard, (slot - shard * per_shard) * stride, filled, ids, hashlib.sha256(data).digest(), f"{folder}/{name}"))
        store.move(own, f"{base}/{name}")
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.string()))], [x.split()[0] for x in _SEQUENCES.split(", ")]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(packing) if packing else None).decompress
        now, held = None, {}
        for b in batches:
            for slot, at, doc, tokens in zip(*(b.column(k).to_pylist() for k in range(4))):
                shard = slot // per_shard
                if shard != now:
                    if held:
                        yield shard_rows(store, base, now, held)
                    now, held = shard, {}
                    store.create_dir(base, recursive=True)
                ids, data = held.setdefault(slot, ([], bytearray()))
                if len(data) != at * width:
                    raise ValueError(f"slot {slot} has {len(data) // width} tokens before those at {at}")
                data += unpack(tokens)
                ids.append(doc)
        if held:
            yield shard_rows(store, base, now, held)

    return run


def write_shards(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, path: str | None = None
) -> DataFrame:
    """Writes the shards into folder (which every executor reaches; a path without scheme is on Spark's default file system) and returns one row per sequence: slot, shard, byte_offset, n_tokens without padding, doc_ids in order, sha256 of its bytes, path.

    Null texts count as empty: an end mark alone. Rows that share an id are ordered by a hash of their text; rows equal in
    both are each written. Null ids come last. The last sequence is filled with end marks. An empty table writes nothing.
    """
    spark = docs.sparkSession
    folder, path = qualified(spark, folder), path or default_path(VOCABULARY)
    end, width = end_mark(path)
    d = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), text_of("text").alias("text")).withColumn("sub", F.xxhash64("text"))
    tokens, bases, total = placed(d, path)
    packing = _dictionary(tokens)
    pieces = tokens.join(F.broadcast(bases), "part").mapInArrow(_pieces(total, length, key, width, packing), _PIECES)
    shards = max(1, -(-total // (length * per_shard)))
    dealt = pieces.repartitionById(min(shards, 100_000), F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot", "at")
    with _file_by_file(spark):
        dealt = materialize(dealt, "order-pieces", level=1)
        release(tokens)
        found = materialize(dealt.mapInArrow(_write(folder, length, per_shard, end, width, packing), _SEQUENCES), "order-sequences")
    release(dealt)
    return found.withColumn("sha256", F.lower(F.hex("sha256")))


def read_shard(path: str, first: int = 0, length: int = LENGTH, width: int = 2) -> Iterator[np.ndarray]:
    """The sequences of a shard in order, from the first-th on; width is the bytes of an id."""
    store, base = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    with store.open_input_file(base) as f:
        f.seek(first * length * width)
        while data := f.read(length * width):
            yield np.frombuffer(data, f"<u{width}")


def op9_training_order(spark, sf_dir: str) -> DataFrame:
    """All documents as token sequences in shards, a row for each sequence."""
    found = write_shards(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    return found.select("slot", "shard", "byte_offset", "n_tokens", "sha256", F.array_join(F.col("doc_ids").cast("array<string>"), ",", "null").alias("doc_ids"))
