"""Compression of vectors to short codes: a codebook per part of the vector, learned in whole numbers.

Vectors become columnar blocks of whole numbers (a row for each component, a column for each vector), written once to the
shared folder. Each round of learning is one treeAggregate of an RDD over these blocks: the distances of a block's parts
to all entries are summed dimension by dimension, np.add.at adds components and counts to int64 tensors of the size of
the codebooks, and the tensors of all blocks are merged through a reduction tree. Only tensors (kilobytes, of one size
for any input) and codebooks reach the driver. All arithmetic is in whole numbers, so the order of merging doesn't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis.llm.common import broadcast_if, materialize, pick, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows of sums of labels that are broadcast at most.
BROADCAST_LABELS = 100_000


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def scaled(values: np.ndarray, dims: int) -> np.ndarray:
    """floor(SCALE * x), at most so large that squared distances of vectors fit into int64 (32,768 before scaling for 64 dimensions)."""
    most = min(isqrt((1 << 62) // max(dims, 1)) // 2, (1 << 31) - 1)
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int32)


def _blocks(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("vector")
            size = np.diff(vectors.offsets.to_numpy())
            out = np.zeros((dims, b.num_rows), np.int32)
            row = np.repeat(np.arange(b.num_rows), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            out[at, row] = scaled(vectors.flatten().to_numpy(zero_copy_only=False), dims)
            listed = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*listed, pa.array([out.tobytes()], pa.binary())], ["ids", "labels", "block"])

    return run


def blocks(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """The kept vectors as columnar blocks (ids, labels, block) in the shared folder, and their dimensions. vectors: id, vector, label."""
    kept = vectors.where(finite(F.col("vector")))
    longest = kept.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    dims = -(-longest // parts) * parts
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    made = kept.select("id", "vector", "label").mapInArrow(_blocks(dims), f"ids array<{kind['id']}>, labels array<{kind['label']}>, block binary")
    return materialize(made, "vector-blocks", level=1), dims


def first_entries(vectors: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, dims / parts): the parts of the vectors with the smallest ids (null ids last, equal ids by their components); fewer entries where there are fewer vectors."""
    found = vectors.where(finite(F.col("vector"))).select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    rows = np.zeros((len(found), dims), np.int64)
    for i, r in enumerate(found):
        rows[i, : len(r.vector)] = scaled(np.array(r.vector, np.float64), dims)
    return rows.reshape(len(found), parts, dims // parts).transpose(1, 0, 2)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the columns of part (dimensions, vectors) the nearest entry of book (entries, dimensions), the first of equals, and its squared distance."""
    far = np.zeros((len(book), part.shape[1]), np.int64)
    for x, entry in zip(part.astype(np.int64), book.T):
        gap = x - entry[:, None]
        far += gap * gap
    code = far.argmin(axis=0)
    return code, far[code, np.arange(len(code))]


def _columns(block: bytes, parts: int, dims: int) -> np.ndarray:
    data = np.frombuffer(block, np.int32)
    return data.reshape(parts, dims // parts, len(data) // dims if dims else 0)


def learned(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after some rounds: every part goes to its nearest entry, each entry becomes the floor of the mean of its parts; entries without a part stay."""
    parts, entries, width = books.shape
    data = rows.select("block").rdd.map(lambda r: r[0])

    def zero() -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((parts, width, entries), np.int64), np.zeros((parts, entries), np.int64)

    for _ in range(rounds if width and entries else 0):
        now = books

        def add(state: tuple[np.ndarray, np.ndarray], block: bytes, now: np.ndarray = now) -> tuple[np.ndarray, np.ndarray]:
            sums, counts = state
            for p, part in enumerate(_columns(block, parts, parts * width)):
                code, _ = nearest(part, now[p])
                np.add.at(counts[p], code, 1)
                for x, total in zip(part, sums[p]):
                    np.add.at(total, code, x)
            return sums, counts

        sums, counts = data.treeAggregate(zero(), add, lambda a, b: (a[0] + b[0], a[1] + b[1]))
        mean = sums // np.maximum(counts, 1)[:, None, :]
        books = np.where(counts[:, :, None] > 0, mean.transpose(0, 2, 1), now)
    return books


def _coded(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels = b.column("ids")[i].values, b.column("labels")[i].values
                codes, errors = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                if width:
                    for p, part in enumerate(_columns(b.column("block")[i].as_py(), parts, parts * width)):
                        codes[:, p], far = nearest(part, books[p])
                        errors += far
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[2 * parts * k : 2 * parts * (k + 1)] for k in range(len(ids))], pa.string()), pa.array(errors)], ["id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, as whole numbers."""
    return np.concatenate([book[x] for book, x in zip(books, bytes.fromhex(code))])


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """One row (id, label, code, error, label_error) per kept row, and the codebooks (parts, entries, dims / parts).

    Rows without a vector, or with a null or non-finite component, are left out. Vectors shorter than the longest one (or
    than a multiple of `parts`) are filled with zeros; empty ones are zeros. Repeated rows and ids stay rows of their own.
    Null ids are kept, behind all others. Equal distances go to the lower entry. At most 256 entries. label_error is the
    sum of errors of all rows with that label, null labels together. An empty table gives no rows and no entries.
    """
    d = pick(vectors, id=id_col, vector=vector_col, label=label_col)
    found, dims = blocks(d, parts)
    books = learned(found, first_entries(d, dims, parts, entries), rounds)
    kind = {f.name: f.dataType.simpleString() for f in d.schema}
    coded = materialize(found.mapInArrow(_coded(books), f"id {kind['id']}, label {kind['label']}, code string, error long"), "vector-codes")
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "vector-labels")
    return coded.join(broadcast_if(sums, sums.count(), BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """All rows of embeddings as codes, with the errors of each row and of its label."""
    found, books = compress(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
