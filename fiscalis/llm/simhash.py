"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are made in Arrow batches (one pass over the text, no shuffle of text). Everything after that works on
distinct 64-bit fingerprints, so exact copies cost one row.

Blocks: 64 bits are cut into m blocks; two fingerprints with at most d differing bits agree on at least m - d blocks, so
they meet under one of the C(m, m - d) keys made of m - d blocks. The keys are joined and the distance verified.
A key that holds very many fingerprints is not joined with itself: its members are linked through midpoints instead.
Two fingerprints differ in at most 2 bits exactly if some value is within 1 bit of both; each such member emits its 65
values within 1 bit, and members that meet in a value are linked to the smallest of them. That is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.llm.common import materialize, pick, table, text_of
from fiscalis.llm.components import connected_components
from fiscalis.sources.tables import spread

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: A key with more fingerprints than this is linked through midpoints.
LARGEST_BLOCK = 256


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text; a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 8192):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in b.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sub"), pa.array(np.array(values, np.uint64).view(np.int64))], ["id", "sub", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, sub, fp) per row of docs; sub is a hash of the text, fp the fingerprint's bits as a signed long. Null and empty texts have 0."""
    kept = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), text_of("text").alias("text"))
    return kept.withColumn("sub", F.xxhash64("text")).mapInArrow(_batches, "id long, sub long, fp long")


def block_keys(m: int, d: int = DISTANCE) -> list[list[tuple[int, int]]]:
    """For each key the (shift, width) of its blocks."""
    cut = [64 * i // m for i in range(m + 1)]
    blocks = [(cut[i], cut[i + 1] - cut[i]) for i in range(m)]
    return [list(c) for c in combinations(blocks, m - d)]


def blocks_for(n: int) -> int:
    """The number of blocks whose keys are so wide that n unrelated fingerprints make fewer than n chance pairs."""
    for m in range(4, 12):
        bits = min(sum(w for _, w in key) for key in block_keys(m))
        if n * len(block_keys(m)) < 2 ** (bits + 1):
            return m
    return 12


def links(distinct: DataFrame, m: int, largest_block: int = LARGEST_BLOCK) -> DataFrame:
    """Edges (a, b) among the distinct fingerprints of column fp, whose components are those of all pairs within 2 bits."""
    keys = block_keys(m)
    each = []
    for i, key in enumerate(keys):
        mask = sum(((1 << w) - 1) << s for s, w in key)
        each.append(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("v")))
    member = distinct.select("fp", F.inline(F.array(*each)))
    size = member.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(member.join(size, ["k", "v"]), "simhash-blocks")  # few: most keys have one member

    small = shared.where(F.col("n") <= largest_block)
    x, y = small.select("k", "v", F.col("fp").alias("a")), small.select("k", "v", F.col("fp").alias("b"))
    pairs = x.join(y, ["k", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")

    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]
    hot = shared.where(F.col("n") > largest_block).select("fp").distinct()
    middle = hot.select("fp", F.explode(F.array(*near)).alias("mid"))
    first = middle.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b")
    through = middle.join(first, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(through)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest_block: int = LARGEST_BLOCK) -> DataFrame:
    """One row (id, sub, fp, component, root) per row of docs; component is the smallest id that is reachable over links of at most 2 bits, root the smallest fingerprint, which no other component has.

    Lower-cases A-Z, takes words between ASCII white space and shingles of 3 words, repeats included (fewer words: the
    whole sequence). Texts without a word, null ones included, share the fingerprint 0 and so link to each other.
    Repeated rows and repeated ids stay rows of their own. A row whose id is null keeps its place, but can't name a
    component; a component of null ids only has a null name. An empty table gives an empty result.
    """
    every = materialize(fingerprints(docs, id_col, text_col), "simhash")
    distinct = every.groupBy("fp").agg(F.min("id").alias("least"))
    m = blocks_for(distinct.count())
    roots = connected_components(links(distinct.select("fp"), m, largest_block)).select(F.col("node").alias("fp"), "root")
    group = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = group.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = group.join(named, "root").select(F.col("fp").alias("f"), "component", "root")
    return every.join(of_fp, F.col("fp") == F.col("f")).select("id", "sub", "fp", "component", "root")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates: the one with the smallest id (null ids last), of several rows with that id the one whose text has the smallest hash, once.

    The kept keys grow with the input, so both sides are shuffled by id and text hash at any size.
    """
    each = near_duplicates(docs, id_col, text_col).groupBy("root", "id", "sub").agg(F.count("*").alias("n"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "sub", "n")).alias("k"))
    kept = materialize(first.select(F.col("k.id").alias("__kept_id"), F.col("k.sub").alias("__kept_sub"), F.col("k.n").alias("__kept_n")), "simhash-kept")
    most = kept.agg(F.max("__kept_n")).first()[0]
    own_id, own_sub = docs[f"`{id_col}`"].cast("long"), F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit("")))
    out = docs.join(kept.hint("merge"), own_id.eqNullSafe(F.col("__kept_id")) & (own_sub == F.col("__kept_sub")))
    if (most or 0) > 1:  # rows equal in id and text: only these are shuffled
        out = out.where("__kept_n = 1").unionByName(out.where("__kept_n > 1").dropDuplicates(["__kept_id", "__kept_sub"]))
    return out.drop("__kept_id", "__kept_sub", "__kept_n")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of every document."""
    found = near_duplicates(spread(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
