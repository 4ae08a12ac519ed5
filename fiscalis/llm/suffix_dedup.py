"""Removal of repeated byte strings: shards of strips of text, each sorted by induced sorting.

A window is any string of LENGTH bytes inside one document. Two equal windows must meet in a shard, so each window is
routed by the smallest hash among the grams in it (its anchor): equal windows have equal anchors. Consecutive windows
with one anchor form a strip, about one strip per 40 bytes of text. Hashes only route; bytes decide.

1. One pass lists the strips of each document by anchor and place. A strip whose anchor no other strip has holds no
   repeated window and goes no further. Strips are counted per anchor in each task first, so a hot anchor reaches the
   shuffle once per task.
2. The strips left are cut from the documents. Strips of equal bytes are combined in the task: only the first goes on,
   the others are repeated as a whole.
3. An anchor with more than LARGEST strips would make too large a shard. Its strips are split into short ones of at most
   CHUNK windows, at places that lie evenly about the anchor, and routed by the core that these windows share; the short
   strips of a core with too many are split once more into single windows, routed by their own bytes.
4. Strips are dealt by route and sorted by bytes; equal ones enter the shard once, as their first occurrence, and the
   others are repeated. A route with one kind of strip needs no more; all others are gathered into shards. Each shard
   gets its suffix array by induced sorting and its permuted common prefixes; suffixes that share LENGTH bytes with a
   neighbour are equal windows, and all but the first in document order are repeated.
5. Repeated windows are united per document.

Which routes are hot is told to the tasks as a bit map of ROUTES bits, of one size for any input: a route that shares its
bit with a hot one is split too, which changes no result. Everything between the steps is written to the shared folder,
so a lost executor repeats no earlier step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.llm.common import materialize, pick, release, table
from fiscalis.llm.induced import END, permuted_lcp, suffix_array

LENGTH = 100
GRAM = 24
CHUNK = 8
#: Strips that a task counts at once, bytes that it combines at once, bytes of a shard and of a task's shards, strips of a route that still go into one shard, bits that tell which routes have more.
COUNTED = 500_000
COMBINED_BYTES = 48 << 20
SHARD_BYTES = 1 << 20
TASK_BYTES = 16 << 20
LARGEST = 8_000
ROUTES = 1 << 20

#: Hash of the anchor, document, first window, further windows, distance to the anchor; whether the task has more strips of this anchor, and how many in all, told once.
_STRIPS = "h long, id long, sub long, a int, more byte, p byte, known boolean, n int"
#: Route, document, first and last window, whether the route came from a hot one, and the bytes; none for strips that are known as repeated.
_CUT = "h long, id long, sub long, a int, b int, hot boolean, strip binary"
_RUNS = "id long, sub long, a int, b int"
Runs = tuple[np.ndarray, ...]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(id, sub, oid, text), where id and sub order the documents, and whether ids are distinct. sub is 0 for distinct ids; rows that share an id (or have none: they come last) are told apart by a hash of their text."""
    d = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("oid"), F.coalesce("text", F.lit("")).alias("text"))
    n, ids = d.agg(F.count("*"), F.count_distinct("oid")).first()
    sub = F.lit(0).cast("long") if n == ids else F.xxhash64("text")
    return d.select(F.coalesce("oid", F.lit((1 << 63) - 1)).alias("id"), sub.alias("sub"), "oid", "text"), n == ids


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash of the anchor's gram, first window, last window, place of the anchor) of each strip of one text of at least `length` bytes."""
    n, words = len(data), gram // 8
    w = np.zeros(n + 8, np.uint64)
    w[:n] = data
    for k in (1, 2, 4):
        w[:-k] |= w[k:] << np.uint64(8 * k)
    grams = n - gram + 1
    h = np.zeros(grams, np.uint64)
    for i in range(words):
        h ^= w[8 * i : 8 * i + grams]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.nonzero(np.concatenate([[True], place[1:] != place[:-1]]))[0]
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    return h[place[first]].view(np.int64), first, last, place[first]


def _united(doc: np.ndarray, sub: np.ndarray, a: np.ndarray, b: np.ndarray) -> Runs:
    """Runs of windows of one document that follow on each other, as one."""
    by = np.lexsort((a, sub, doc))
    doc, sub, a, b = doc[by], sub[by], a[by], b[by]
    if not len(doc):
        return doc, sub, a, b
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (a[1:] > b[:-1] + 1)])
    at = np.nonzero(new)[0]
    return doc[at], sub[at], a[at], np.maximum.reduceat(b, at)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _counted(parts: list[Runs]) -> Iterator[pa.RecordBatch]:
    rows = [np.concatenate([p[i] for p in parts]) for i in range(6)]
    by = np.argsort(rows[0], kind="stable")
    route = rows[0][by]
    head = np.nonzero(np.concatenate([[True], route[1:] != route[:-1]]))[0]
    size = np.diff(np.append(head, len(by)))
    n, known = np.zeros(len(by), np.int32), np.zeros(len(by), bool)
    n[by[head]] = size
    known[by] = np.repeat(size > 1, size)  # rows stay in the order of the text, which packs well
    for i in range(0, len(by), 100_000):
        yield _batch([c[i : i + 100_000] for c in (*rows, known, n)], _STRIPS)


def _strips(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, subs = batch.column("id").to_numpy(), batch.column("sub").to_numpy()
            for i, cell in enumerate(batch.column("text").cast(pa.large_binary())):
                text = cell.as_buffer()
                if len(text) < length:
                    continue
                h, a, b, p = anchors(np.frombuffer(text, np.uint8), length, gram)
                parts.append((h, np.full(len(h), ids[i]), np.full(len(h), subs[i]), a, b - a, p - a))
                held += len(h)
                if held >= COUNTED:
                    yield from _counted(parts)
                    parts, held = [], 0
        if parts:
            yield from _counted(parts)

    return run


def _bits(route: np.ndarray) -> np.ndarray:
    return route & np.int64(ROUTES - 1)


def _hot_map(hot: DataFrame) -> np.ndarray:
    """The bit map of the routes h of hot; what is collected has ROUTES values at most."""
    found = hot.select(F.col("h").bitwiseAND(F.lit(ROUTES - 1)).alias("bit")).distinct().toArrow()
    out = np.zeros(ROUTES, bool)
    out[found.column("bit").to_numpy()] = True
    return np.packbits(out)


def _is_hot(packed: np.ndarray, route: np.ndarray) -> np.ndarray:
    bit = _bits(route)
    return packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1 == 1


def _combined(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (route, id, sub, first window, last window, hot, bytes): of equal bytes the first in document order as it is, the others as runs of windows that are known as repeated."""
    first: dict[bytes, tuple] = {}
    again = []
    for row in rows:
        had = first.get(row[6])
        if had is None:
            first[row[6]] = row
        elif row[1:4] < had[1:4]:
            first[row[6]] = row
            again.append(had)
        else:
            again.append(row)
    for at in range(0, len(kept := list(first.values())), 20_000):
        yield _batch(list(zip(*kept[at : at + 20_000])), _CUT)
    if again:
        doc, sub, a, b = _united(*(np.array(x, np.int64) for x in zip(*(r[1:5] for r in again))))
        spread = (doc * np.int64(0x5851F42D4C957F2D)) ^ a
        for at in range(0, len(doc), 100_000):
            to = slice(at, at + 100_000)
            m = len(doc[to])
            yield _batch([spread[to], doc[to], sub[to], a[to], b[to], np.zeros(m, bool), [None] * m], _CUT)


def _gathered(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6])
        if size >= COMBINED_BYTES:
            yield from _combined(held)
            held, size = [], 0
    if held:
        yield from _combined(held)


def _cut(length: int, chunk: int, packed: np.ndarray):
    """The strips in `parts` with their bytes; those of hot anchors split into short ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            lists = batch.column("parts")
            offsets, strips = lists.offsets.to_numpy(), lists.values
            h, a, more, p = (strips.field(k).to_numpy() for k in ("h", "a", "more", "p"))
            hot = _is_hot(packed, h)
            ids, subs = batch.column("id").to_pylist(), batch.column("sub").to_pylist()
            for i, cell in enumerate(batch.column("text").cast(pa.large_binary())):
                text = cell.as_buffer().to_pybytes()
                to = slice(offsets[i], offsets[i + 1])
                for route, x, m, at, split in zip(h[to].tolist(), a[to].tolist(), more[to].tolist(), p[to].tolist(), hot[to].tolist()):
                    if not split:
                        yield route, ids[i], subs[i], x, x + m, False, text[x : x + m + length]
                        continue
                    at += x
                    for j in range((at - x - m) // chunk, (at - x) // chunk + 1):
                        low = at - j * chunk - chunk + 1  # the windows from low to low + chunk - 1 are at these places about the anchor
                        core = digest(text[low + chunk - 1 : low + length], j) - (1 << 63)
                        y, z = max(low, x), min(low + chunk - 1, x + m)
                        yield core, ids[i], subs[i], y, z, True, text[y : z + length]

    return lambda batches: _gathered(rows(batches))


def _windows(length: int):
    """Each window of the strips as a strip of its own, routed by its bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for _, doc, sub, a, b, _, strip in zip(*(batch.column(i).to_pylist() for i in range(7))):
                for x in range(b - a + 1):
                    window = strip[x : x + length]
                    yield xxhash.xxh3_64_intdigest(window, 1) - (1 << 63), doc, sub, a + x, a + x, True, window

    return lambda batches: _gathered(rows(batches))


def _shard(ids: np.ndarray, subs: np.ndarray, starts: np.ndarray, strips: list[bytes], length: int) -> Runs:
    """The repeated windows of one shard of different strips, as runs."""
    end = bytes([END])
    text = np.frombuffer(end.join(strips) + end, np.uint8)
    sizes = np.array([len(x) for x in strips], np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    of = np.repeat(np.arange(len(strips)), sizes + 1)
    inside = np.arange(len(text)) - offset[of]
    whole = inside <= sizes[of] - length
    order = suffix_array(text)
    shared = permuted_lcp(text, order)[order] >= length
    cluster = np.cumsum(~shared)
    at = whole[order]
    order, cluster = order[at], cluster[at]
    doc, sub, start = ids[of[order]], subs[of[order]], starts[of[order]] + inside[order]
    by = np.lexsort((start, sub, doc, cluster))
    doc, sub, start, cluster = doc[by], sub[by], start[by], cluster[by]
    again = np.zeros(len(by), bool)
    again[1:] = cluster[1:] == cluster[:-1]
    return _united(doc[again], sub[again], start[again], start[again])


def _shards(length: int, shard_bytes: int):
    """From strips sorted by route and bytes: whole routes are gathered up to the size of a shard. A route with strips of one kind only has no neighbours to compare: a window has one place about its anchor, so no strip holds it twice."""

    def result(first: list[tuple], again: list[tuple]) -> Iterator[pa.RecordBatch]:
        runs = [_shard(*(np.array(x, np.int64) for x in zip(*(r[1:4] for r in first))), [r[6] for r in first], length)] if first else []
        if again:
            runs.append(tuple(np.array(x, np.int64) for x in zip(*(r[1:5] for r in again))))
        out = _united(*map(np.concatenate, zip(*runs)))
        if len(out[0]):
            yield _batch(list(out), _RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, again, size, kinds = [], [], 0, 0
        last = route = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                strip = row[6]
                if strip is None or (row[0] == route and strip == last):
                    again.append(row)
                    continue
                if row[0] != route:
                    if kinds == 1:
                        size -= len(first.pop()[6])
                    if size >= shard_bytes or len(again) >= COUNTED:
                        yield from result(first, again)
                        first, again, size = [], [], 0
                    kinds = 0
                route, last, kinds = row[0], strip, kinds + 1
                first.append(row)
                size += len(strip)
            if len(again) >= COUNTED:  # the repeated strips of one route may be very many
                yield from result([], again)
                again = []
        if kinds == 1:
            first.pop()
        if first or again:
            yield from result(first, again)

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, largest: int = LARGEST, shard_bytes: int = SHARD_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Runs (id, sub, a, b) of windows, by their first bytes, whose bytes start earlier too. docs is keyed(), its (id, sub) distinct."""
    d = docs.select("id", "sub", "text")
    strips = materialize(d.mapInArrow(_strips(length, gram), _STRIPS), "suffix-strips")
    counts = materialize(strips.where("n > 0").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "suffix-anchors")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = _hot_map(counts.where(F.col("n") > largest))

    place = F.struct("h", "a", "more", "p").alias("part")
    shared = strips.where("known").select("id", "sub", place)
    # of an anchor, each task has at most one strip here
    shared = shared.unionByName(strips.where("not known").join(counts.select("h"), "h", "left_semi").select("id", "sub", place))
    shared = materialize(shared, "suffix-shared")
    release(strips)
    release(counts)
    of_doc = shared.groupBy("id", "sub").agg(F.collect_list("part").alias("parts"))
    cut = d.join(of_doc, ["id", "sub"]).select("id", "sub", "text", "parts").mapInArrow(_cut(length, chunk, hot), _CUT)
    whole = cut = materialize(cut, "suffix-cut")
    release(shared)
    if hot.any():
        split = cut.where("hot and strip is not null")
        cores = split.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > largest)
        often = _hot_map(cores)
        if often.any():
            bit = F.broadcast(cores.select(F.col("h").bitwiseAND(F.lit(ROUTES - 1)).alias("bit")).distinct())  # ROUTES rows at most
            own = F.col("h").bitwiseAND(F.lit(ROUTES - 1))
            single = split.join(bit, own == F.col("bit"), "left_semi").mapInArrow(_windows(length), _CUT)
            rest = split.join(bit, own == F.col("bit"), "left_anti")
            cut = cut.where("not hot or strip is null").unionByName(rest).unionByName(single)
    tasks = max(1, n * (length + 40) // TASK_BYTES)
    dealt = cut.repartition(tasks, "h").sortWithinPartitions("h", "strip", "id", "sub", "a")
    runs = materialize(dealt.mapInArrow(_shards(length, shard_bytes), _RUNS), "suffix-runs")
    release(whole)
    return runs


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for i, cell in enumerate(batch.column("text").cast(pa.large_binary())):
                text, found = cell.as_buffer().to_pybytes(), batch.column("runs")[i].as_py()
                here: list[list[int]] = []
                for r in sorted((r["a"], r["b"] + length) for r in found or ()):
                    if here and r[0] <= here[-1][1]:
                        here[-1][1] = max(here[-1][1], r[1])
                    else:
                        here.append(list(r))
                at = [0, *(x for s in here for x in s), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(at[::2], at[1::2])))
                spans.append([{"start": x, "end": y} for x, y in here])
            yield pa.RecordBatch.from_arrays(
                [batch.column("oid"), pa.array([len(c.as_buffer()) for c in batch.column("text").cast(pa.large_binary())], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["id", "n_bytes", "kept", "spans"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **sizes: int) -> DataFrame:
    """One row (id, n_bytes, kept, spans) per row of docs: the bytes left, and the removed runs in the original bytes.

    A byte goes if some window of `length` bytes that covers it also starts earlier: in a document with a smaller id, or
    earlier in the same one (overlaps count). Windows are judged on the input and never cross documents. Null texts are
    empty. Rows that share an id are ordered by a hash of their text; rows equal in both count as one document, and each
    reports it. Null ids come after all others. An empty table gives an empty result.
    """
    d, distinct = keyed(docs, id_col, text_col)
    runs = repeated_windows(d if distinct else d.dropDuplicates(["id", "sub"]), length, **sizes)
    of_doc = runs.groupBy("id", "sub").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    return d.join(of_doc, ["id", "sub"], "left").select("oid", "text", "runs").mapInArrow(
        _kept(length), "id long, n_bytes long, kept binary, spans array<struct<start: int, end: int>>"
    )


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeat earlier ones."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
