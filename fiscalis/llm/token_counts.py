"""Token counts of sections: whole documents are encoded once, and token spans are joined to sections by their characters.

A byte-level token stands for known bytes, so the sizes of the ids give every token's span without a second pass. The
join of token spans to section spans is a merge of two sorted lists within one document: no pair is formed that doesn't
overlap, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.llm.common import pick, table, text_of
from fiscalis.llm.tokenizers import byte_bpe, byte_ids, default_path
from fiscalis.sources.tables import spread

VOCABULARY = "byte_bpe_50k.tiktoken"
SCHEMA = "id long, n_tokens long, sections array<struct<section: int, start: int, end: int, n_tokens: double, n_crossing: int>>"
_SECTION = pa.struct([("section", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.float64()), ("n_crossing", pa.int32())])
RULES = ("first", "largest", "share")


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters (start, end) of each token. A token that holds only some bytes of a character has the whole character."""
    _, sizes = byte_bpe(path)
    until = np.cumsum(sizes[np.array(byte_ids(text, path), np.int64)])
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    begin = np.concatenate([[0], until[:-1]]) if len(until) else until
    return (char[begin], char[until - 1] + 1) if len(until) else (until, until)


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text as sections; a line ends with its line feed."""
    cut = np.nonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)[0] + 1
    edge = np.unique(np.concatenate([[0], cut, [len(text)]]))
    return edge[:-1], edge[1:]


def allocate(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and tokens that cross out of it or into it. Sections are sorted and don't overlap; they may leave gaps.

    first: a token counts for the section that holds its first character. largest: for the one that holds most of its
    characters, the earlier of equals. share: for each section by its part of the token's characters. Characters in no
    section count nowhere.
    """
    m = len(low)
    total, crossing = np.zeros(m), np.zeros(m, np.int64)
    if not m or not len(starts):
        return total, crossing
    a = np.searchsorted(high, starts, side="right")  # the first section that ends behind the token's start
    b = np.searchsorted(low, ends, side="left")  # the first one that begins at or behind its end
    count = np.maximum(b - a, 0)
    token = np.repeat(np.arange(len(starts)), count)
    section = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
    overlap = np.minimum(high[section], ends[token]) - np.maximum(low[section], starts[token])
    size = (ends - starts)[token]
    np.add.at(crossing, section[overlap < size], 1)
    if rule == "share":
        np.add.at(total, section, overlap / size)
    elif rule == "first":
        np.add.at(total, section[low[section] <= starts[token]], 1)
    else:
        best = np.lexsort((section, -overlap, token))
        head = np.concatenate([[True], token[best][1:] != token[best][:-1]]) if len(best) else np.zeros(0, bool)
        np.add.at(total, section[best][head], 1)
    return total, crossing


def _batches(path: str, rule: str, own: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, values, offsets = [], [], [0]
            given = b.column("sections").to_pylist() if own else None
            for i, text in enumerate(b.column("text").to_pylist()):
                text = text or ""
                if own:
                    pairs = sorted((s["start"], s["end"]) for s in given[i] or () if s and s["start"] is not None and s["end"] is not None and s["start"] < s["end"])
                    low, high = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
                    if (low[1:] < high[:-1]).any():
                        raise ValueError("sections of a document overlap")
                else:
                    low, high = lines(text)
                starts, ends = token_spans(text, path)
                total, crossing = allocate(starts, ends, low, high, rule)
                counts.append(len(starts))
                values.append((np.arange(len(low)), low, high, total, crossing))
                offsets.append(offsets[-1] + len(low))
            columns = [pa.array(np.concatenate([v[k] for v in values] or [np.zeros(0)]).astype(f.type.to_pandas_dtype())) for k, f in enumerate(_SECTION)]
            sections = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SECTION)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64()), sections], ["id", "n_tokens", "sections"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first", path: str | None = None) -> DataFrame:
    """One row (id, n_tokens, sections) per row of docs; sections are its lines, or those of sections_col (array of structs with start and end, in characters).

    Null texts count as empty: no tokens and, of lines, none. Null sections count as none, empty ones are left out;
    overlapping ones are an error. Repeated rows and ids stay rows of their own; null ids stay null.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    names = {"id": id_col, "text": text_col} | ({"sections": sections_col} if sections_col else {})
    kept = pick(docs, **names).withColumn("text", text_of("text")).withColumn("id", F.col("id").cast("long"))
    return kept.mapInArrow(_batches(path or default_path(VOCABULARY), rule, bool(sections_col)), SCHEMA)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """The tokens of every line of all documents."""
    found = count_tokens(spread(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), F.col("n_tokens").alias("doc_tokens"), F.inline_outer("sections")).select(
        "doc_id", "doc_tokens", "section", F.col("start").alias("char_start"), F.col("end").alias("char_end"), F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing"
    )
