"""Quality scores by voting of nearest labelled neighbours among latent-semantic vectors.

Terms are hashed 3-byte strings and a few counted events (a word said again, a shouted word, a symbol, ...). Weights by
inverse document frequency and the leading right singular vectors of the labelled rows give each text a latent vector.
The vectors of a bounded sample of labelled rows are broadcast; each document's exact cosines with all of them are
products of blocks, and the nearest ones vote for their labels, weighted by a power (SHARPNESS) of their similarity.
Cosines are double-precision products, rounded, and of equals the earlier sample row is nearer, so a score doesn't depend
on which documents share its block.

Only the labelled sample is bounded (MOST_LABELLED): the broadcast then has the same size for any input. Every document
is scored, whole, in one pass without a shuffle of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.llm.common import pick, table, text_of

#: Labelled rows that are fitted and broadcast at most, hashed terms, latent dimensions, voting neighbours, texts in a block.
MOST_LABELLED = 6000
TERMS = 1024
LATENT = 64
NEIGHBOURS = 25
BLOCK = 512
THRESHOLD = 0.3
#: The power of a cosine that is a neighbour's weight, and decimals of cosines and scores.
SHARPNESS = 8
DECIMALS = 9
#: Times that each counted event is weighted beside a hashed term.
EVENT_WEIGHT = 3.0


def terms(text: bytes) -> np.ndarray:
    """Counts of the hashed terms and, behind them, of the events."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    out = np.zeros(TERMS + 8, np.float32)
    if len(data) >= 3:
        mixed = (data[:-2] | data[1:-1] << 8 | data[2:] << 16) * np.uint32(0x9E3779B1)
        out[:TERMS] = np.bincount(mixed >> np.uint32(32 - TERMS.bit_length() + 1), minlength=TERMS)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    shouted = sum(map(bytes.isupper, words))
    out[TERMS:] = (
        sum(map(eq, words, words[1:])), len(words) - len(set(words)), shouted, symbols, text.count(b"!"), len(lines) - len(set(lines)),
        sum(map(bytes.isdigit, words)), text.count(b"|"),
    )
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf, of unit length; counted events are taken by their share of the words' terms."""
    x = np.log1p(counts) * idf
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.maximum(size, 1e-12)).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = _weighted(counts, self.idf).astype(np.float64) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """0 to 1 per row; the base rate where a text has no term, or no neighbour is similar at all."""
        empty = ~counts.any(axis=1)
        cosine = np.round(self.latent(counts) @ self.vectors.T.astype(np.float64), DECIMALS)
        k = min(NEIGHBOURS, cosine.shape[1])
        if not k:
            return np.full(len(counts), self.base)
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        nearer, same = cosine > last, cosine == last
        same &= np.cumsum(same, axis=1) <= k - nearer.sum(axis=1, keepdims=True)
        near = np.flatnonzero(nearer | same).reshape(len(counts), k) % cosine.shape[1]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300)
        return np.round(np.where(empty | (total == 0), self.base, np.clip(vote, 0, 1)), DECIMALS)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    """counts: a row of terms() for each labelled text. No rows give a model that scores 0.5."""
    width = counts.shape[1] if counts.ndim == 2 else TERMS + 8
    if not len(labels):
        return Model(np.zeros(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(float), 0.5)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    idf[TERMS:] *= EVENT_WEIGHT
    x = _weighted(counts, idf)
    _, axes = np.linalg.eigh(x.T.astype(np.float64) @ x)
    model = Model(idf, axes[:, ::-1][:, :LATENT].astype(np.float32), np.zeros((0, 0)), labels.astype(np.float64), float(labels.mean()))
    model.vectors = model.latent(counts).astype(np.float32)
    return model


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [terms(t.as_buffer().to_pybytes()).tobytes() for t in b.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(counts, pa.binary())], ["label", "counts"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Fits on at most `most` labelled rows, those whose id has the smallest hash; rows without an id or a label are left out.

    Of several labels of one id the smallest counts, of several texts of one id the one with the smallest hash.
    """
    given = pick(labels, id=id_col, label=label_col).where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    sample = given.orderBy(F.xxhash64("id"), "id").limit(most).select(F.col("id").alias("_id"), F.col("label").cast("double").alias("label"))
    d = pick(docs, id=id_col, text=text_col).select("id", text_of("text").alias("text"))
    rows = d.join(F.broadcast(sample), F.col("id") == F.col("_id")).groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = rows.select("label", "text").mapInArrow(_terms, "label double, counts binary").toArrow()  # `most` rows
    if not found.num_rows:
        return fit(np.zeros((0, TERMS + 8), np.float32), np.zeros(0))
    counts = np.frombuffer(b"".join(found.column("counts").to_pylist()), np.float32).reshape(found.num_rows, -1)
    label = found.column("label").to_numpy()
    by = np.lexsort((*counts[:, :4].T, label))  # as tasks end in any order
    return fit(counts[by], label[by])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score) per row of docs, however these are dealt. Null texts count as empty and get the base rate of the labelled rows; repeated rows and ids, null ones too, stay rows of their own; very long texts are counted whole; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                counts = np.stack([terms(t.as_buffer().to_pybytes()) for t in part.column("text").cast(pa.large_binary())])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(held.value.scores(counts))], ["id", "score"])

    kept = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), text_of("text").alias("text"))
    return kept.mapInArrow(run, "id long, score double")


def held_out(column: str):
    """Whether a row is kept from fitting: crc32 of the id as text leaves 0 when divided by 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def op3_quality_knn(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id")))
    found = score(docs, model)
    return found.select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
