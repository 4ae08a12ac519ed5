"""Quality rules: word and line measures, and repetition found in a suffix array of each whole text.

One pass over the text in Arrow batches, without a shuffle: a text's measures need no other text, so neither hot sources
nor groups of copies matter, and a lost task costs only its own rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.llm.common import parts, table
from fiscalis.llm.suffixes import repeats
from fiscalis.sources.tables import spread

#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
FEWEST_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3
#: Text that is measured into one Arrow batch.
PART_BYTES = 4 << 20
#: Limits of the repetition verdict: a repeat counts from so many code points on; a text is rejected if repeats cover more than this part of it, or if one repeat has more code points than the longest one allowed.
SHORTEST_REPEAT = 40
MOST_COVERED = 0.4
LONGEST_REPEAT = 200

SCHEMA = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars_seen long, covered_chars long, longest_repeat long, spans array<struct<start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()  # bytes.split() takes exactly the six ASCII blanks
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = 0
    windows = Counter(zip(*(words[i:] for i in range(WINDOW))))
    if len(windows) < len(words) - WINDOW + 1:
        until = 0  # words before this place are counted
        for i, w in enumerate(zip(*(words[i:] for i in range(WINDOW)))):
            if windows[w] > 1:
                repeated += i + WINDOW - max(until, i)
                until = i + WINDOW
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def _batches(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in parts(batch, PART_BYTES)):
            rows, starts, ends, offsets = [], [], [], [0]
            for text in b.column("text").to_pylist():
                text = text or ""
                spans, longest = repeats(np.frombuffer(text.encode("utf-32-le"), np.uint32), shortest)
                rows.append((*base(text), len(text), int((spans[:, 1] - spans[:, 0]).sum()), longest))
                starts.append(spans[:, 0])
                ends.append(spans[:, 1])
                offsets.append(offsets[-1] + len(spans))
            measures = np.array(rows, np.int64).reshape(-1, 8).T
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([*x, np.zeros(0)]).astype(np.int32)) for x in (starts, ends)], fields=list(_SPANS.value_type))
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
            names = ["id", *(x.split()[0] for x in SCHEMA.split(", ")[1:9]), "spans"]
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, measures), spans, *b.columns[2:]], [*names, *b.schema.names[2:]])

    return run


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST_REPEAT, whole_rows: bool = False) -> DataFrame:
    """One row per row of docs with its counts, the code points covered by repeats, the longest repeat and the covered spans; with whole_rows also a struct `row` of all columns of docs.

    Null texts count as empty: all measures 0, no spans. Repeated rows and ids stay rows of their own; null ids stay null.
    """
    row = [F.struct("*").alias("row")] if whole_rows else []
    kept = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"), *row)
    more = f", row {kept.schema['row'].dataType.simpleString()}" if whole_rows else ""
    return kept.mapInArrow(_batches(shortest), SCHEMA + more)


def verdicts(found: DataFrame, most_covered: float = MOST_COVERED, longest_repeat: int = LONGEST_REPEAT) -> DataFrame:
    """Adds covered_fraction, base_failed and kept; the verdict is defined for empty texts too (too few words)."""
    n = F.greatest(F.col("n_chars_seen"), F.lit(1))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    too_long = F.col("longest_repeat") > longest_repeat
    return (
        found.withColumn("covered_fraction", F.col("covered_chars") / n)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("covered_fraction") <= most_covered) & ~too_long)
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The measures of all documents and whether each is kept."""
    found = verdicts(measures(spread(table(spark, sf_dir, "documents"))))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "covered_chars", "longest_repeat", F.size("spans").cast("long").alias("n_spans"),
    )
