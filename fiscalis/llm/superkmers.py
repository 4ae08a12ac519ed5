"""Removal of repeated word sequences: super-k-mers, dealt to buckets by their minimisers.

A window is LENGTH consecutive words of one document. Its minimiser is the run of GRAM words in it whose hash is smallest.
Consecutive windows with one minimiser (at one place) form a super-k-mer, which travels as one packed string, its words
joined by blanks, to the minimiser's bucket: about one string for 14 windows. Equal windows have equal minimisers, at
equal places, so they meet in a bucket; hashes only deal, words decide.

1. One pass lists the super-k-mers of each document by minimiser and place. One whose minimiser no other has holds no
   repeated window, and its words go nowhere. They are counted per minimiser in each task first, so a frequent one
   reaches the shuffle once per task.
2. The others are packed. Equal strings are combined in the task: one goes on, marked as met before, the rest are repeated
   as a whole.
3. A minimiser with more than LARGEST strings would make too large a bucket. Its strings are cut into single windows, dealt
   by a hash of all their words, and combined in the task again.
4. Each bucket is sorted by minimiser, place of the window about it, and words, so equal windows lie side by side and are
   counted; those that are there twice, or were marked, are repeated. Strings that are equal as a whole, or alone in their
   bucket, needn't be cut for that.
5. Repeated windows are united per document, and the words that they cover are removed.

Which minimisers are frequent is told to the tasks as a bit map of one size for any input. Everything between the steps is
written to the shared folder, so a lost executor repeats no earlier step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.llm.common import materialize, release, table
from fiscalis.llm.suffix_dedup import _STRIPS, COUNTED, ROUTES, _batch, _bits, _counted, _hot_map, _is_hot, _united, keyed

LENGTH = 35
GRAM = 8
#: Bytes of text that are looked at, or packed, at once, strings of a minimiser that still go into one bucket, windows that are sorted at once, and bytes of a task's buckets.
TEXT_BYTES = 1 << 20
COMBINED_BYTES = 16 << 20
LARGEST = 2_000
SORTED = 200_000
TASK_BYTES = 16 << 20

#: Hash of the minimiser, document, first and last window, place of the minimiser behind the first window, whether an equal string was met before, whether the route came from a frequent minimiser, and the packed words; none for strings that are known as repeated.
_PACKED = "h long, id long, sub long, a int, b int, p int, again boolean, hot boolean, words binary"
_RUNS = "id long, sub long, a int, b int"
ODD, UNDO = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
Row = tuple[int, int, int, int, int, int, bool, bool, bytes]


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... as unsigned 64-bit numbers."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a text whose words are parted by single blanks. A word's hash is a polynomial in its bytes, from running sums over the whole text."""
    data = np.frombuffer(text, np.uint8)
    blank = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], blank + 1]), np.append(blank, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(ODD, len(data)), out=sums[1:])
    return _mixed((sums[end] - sums[start]) * _powers(UNDO, len(data) + 1)[start]), start, end


def super_kmers(words: np.ndarray, begins: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash of the minimiser, first window, last window, place of the minimiser, document) of the super-k-mers of several documents: words are the hashes of all their words, begins the documents' first words and the number of all; places count from there."""
    none = np.zeros(0, np.int64)
    if len(words) < length:
        return none, none, none, none, none
    grams = len(words) - gram + 1
    h = np.zeros(grams, np.uint64)
    for k in range(gram):
        h = h * np.uint64(ODD) + words[k : k + grams]
    h = _mixed(h)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[: len(place)]
    inside = np.arange(len(place)) + length <= begins[1:][doc]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(place) - 1)
    use = inside[first]
    first, last = first[use], last[use]
    return h[place[first]].view(np.int64), first, last, place[first], doc[first]


def _grouped(b: pa.RecordBatch) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """The rows of a batch in groups of about TEXT_BYTES, as their numbers and words."""
    rows, words, size = [], [], 0
    for i, cell in enumerate(b.column("text").cast(pa.large_binary())):
        text = cell.as_buffer()
        rows.append(i)
        words.append(text.to_pybytes().split())
        size += len(text)
        if size >= TEXT_BYTES:
            yield rows, words
            rows, words, size = [], [], 0
    if rows:
        yield rows, words


def _listed(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            ids, subs = b.column("id").to_numpy(), b.column("sub").to_numpy()
            for rows, words in _grouped(b):
                use = [k for k, w in enumerate(words) if len(w) >= length]
                if not use:
                    continue
                begins = np.cumsum([0, *(len(words[k]) for k in use)])
                h, a, z, p, doc = super_kmers(word_hashes(b" ".join(b" ".join(words[k]) for k in use))[0], begins, length, gram)
                row = np.array([rows[k] for k in use])[doc]
                parts.append((h, ids[row], subs[row], a - begins[doc], z - a, p - a))
                held += len(h)
                if held >= COUNTED:
                    yield from _counted(parts)
                    parts, held = [], 0
        if parts:
            yield from _counted(parts)

    return run


def _combined(rows: list[Row]) -> Iterator[pa.RecordBatch]:
    """Of rows with equal words (and the minimiser at one place) the first, marked if there are more; the others as runs of windows that are known as repeated."""
    first: dict[tuple[bytes, int], Row] = {}
    again = []
    for row in rows:
        key = row[8], row[5]
        had = first.setdefault(key, row)
        if had is not row:
            again.append(row)
            if not had[6]:
                first[key] = (*had[:6], True, *had[7:])
    kept = list(first.values())
    for at in range(0, len(kept), 20_000):
        yield _batch(list(zip(*kept[at : at + 20_000])), _PACKED)
    if again:
        doc, sub, a, b = _united(*(np.array(x, np.int64) for x in zip(*(r[1:5] for r in again))))
        spread = (doc * np.int64(0x5851F42D4C957F2D)) ^ a
        for at in range(0, len(doc), 100_000):
            to = slice(at, at + 100_000)
            m = len(doc[to])
            yield _batch([spread[to], doc[to], sub[to], a[to], b[to], np.zeros(m, np.int32), np.ones(m, bool), np.zeros(m, bool), [None] * m], _PACKED)


def _gathered(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[8]) + 100
        if size >= COMBINED_BYTES:
            yield from _combined(held)
            held, size = [], 0
    if held:
        yield from _combined(held)


def _packed(length: int, packed: np.ndarray):
    """The super-k-mers in `parts` with their words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for b in batches:
            lists = b.column("parts")
            offsets, strips = lists.offsets.to_numpy(), lists.values
            h, a, more, p = (strips.field(k).to_numpy() for k in ("h", "a", "more", "p"))
            hot = _is_hot(packed, h)
            ids, subs = b.column("id").to_pylist(), b.column("sub").to_pylist()
            for i, cell in enumerate(b.column("text").cast(pa.large_binary())):
                text = b" ".join(cell.as_buffer().to_pybytes().split())
                blank = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                start, end = np.concatenate([[0], blank + 1]), np.append(blank, len(text))
                to = slice(offsets[i], offsets[i + 1])
                x, m = a[to].astype(np.int64), more[to].astype(np.int64)
                for route, first, n, at, often, low, high in zip(h[to].tolist(), x.tolist(), m.tolist(), p[to].tolist(), hot[to].tolist(), start[x].tolist(), end[x + m + length - 1].tolist()):
                    yield route, ids[i], subs[i], first, first + n, at, False, often, text[low:high]

    return lambda batches: _gathered(rows(batches))


def windows_of(words: bytes, n: int, length: int) -> list[bytes]:
    """The n windows of a packed string."""
    if n == 1:
        return [words]
    blank = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    start, end = np.concatenate([[0], blank[: n - 1] + 1]).tolist(), np.append(blank, len(words))[length - 1 :].tolist()
    return [words[x:y] for x, y in zip(start, end)]


def _windows(length: int):
    """Each window of the packed strings as a row of its own, dealt by its words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for b in batches:
            for _, doc, sub, a, z, _, again, _, words in zip(*(b.column(i).to_pylist() for i in range(9))):
                for k, window in enumerate(windows_of(words, z - a + 1, length)):
                    yield xxhash.xxh3_64_intdigest(window, 1) - (1 << 63), doc, sub, a + k, a + k, 0, again, True, window

    return lambda batches: _gathered(rows(batches))


def _repeated(kinds: list[tuple[list[Row], bool]], length: int) -> list[tuple[int, int, int, int]]:
    """The runs of repeated windows in one bucket; kinds: the rows with equal strings (all of them, at one place of the minimiser) and whether these are repeated as a whole."""
    out = [r[1:5] for rows, whole in kinds if whole for r in rows]
    if len(kinds) == 1:
        return out
    # each window of each kind by its place about the minimiser and its words; sorted, equal ones lie side by side
    every = sorted((rows[0][5] - k, window, i, k) for i, (rows, _) in enumerate(kinds) for k, window in enumerate(windows_of(rows[0][8], rows[0][4] - rows[0][3] + 1, length)))
    for x, (place, window, i, k) in enumerate(every):
        rows, whole = kinds[i]
        if whole:
            continue
        if (x and every[x - 1][:2] == (place, window)) or (x + 1 < len(every) and every[x + 1][:2] == (place, window)):
            out += [(r[1], r[2], r[3] + k, r[3] + k) for r in rows]
    return out


def _counted_windows(length: int):
    """From packed strings sorted by minimiser, place and words: the repeated windows. Of a bucket only different strings are held, at most LARGEST unless a bit map let more through, and of many equal ones the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        kinds: list[tuple[list[Row], bool]] = []
        route = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out:
                found = _united(*(np.array(x, np.int64) for x in zip(*out)))
                out = []
                yield _batch(list(found), _RUNS)

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(9))):
                if row[8] is None:
                    out.append(row[1:5])
                elif row[0] != route:
                    if kinds:
                        out += _repeated(kinds, length)
                    route, kinds = row[0], [([row], row[6])]
                else:
                    rows, _ = kinds[-1]
                    if rows[0][8] == row[8] and rows[0][5] == row[5]:
                        out.append(row[1:5])  # repeated as a whole; the first one tells so at the end of its bucket
                        kinds[-1] = rows, True
                    elif row[7] and rows[0][4] == rows[0][3] and row[3] == row[4]:  # single windows with one hash: no other has these words
                        out += _repeated(kinds, length)
                        kinds = [([row], row[6])]
                    else:
                        kinds.append(([row], row[6]))
                if len(out) >= SORTED:
                    yield from flush()
        if kinds:
            out += _repeated(kinds, length)
        yield from flush()

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """Runs (id, sub, a, b) of windows, by their first words, whose words start somewhere else too. docs is keyed(), its (id, sub) distinct."""
    d = docs.select("id", "sub", "text")
    strips = materialize(d.mapInArrow(_listed(length, gram), _STRIPS), "kmer-places")
    counts = materialize(strips.where("n > 0").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "kmer-counts")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = _hot_map(counts.where(F.col("n") > largest))

    place = F.struct("h", "a", "more", "p").alias("part")
    shared = strips.where("known").select("id", "sub", place)
    shared = shared.unionByName(strips.where("not known").join(counts.select("h"), "h", "left_semi").select("id", "sub", place))
    shared = materialize(shared, "kmer-shared")
    release(strips)
    release(counts)
    of_doc = shared.groupBy("id", "sub").agg(F.collect_list("part").alias("parts"))  # at most one part per word of a document
    packed = d.join(of_doc, ["id", "sub"]).select("id", "sub", "text", "parts").mapInArrow(_packed(length, hot), _PACKED)
    whole = packed = materialize(packed, "kmer-packed")
    release(shared)
    if hot.any():
        single = packed.where("hot and words is not null").mapInArrow(_windows(length), _PACKED)
        packed = packed.where("not hot or words is null").unionByName(single)
    tasks = max(1, n * 300 // TASK_BYTES)
    dealt = packed.repartition(tasks, "h").sortWithinPartitions("h", "p", "words", "id", "sub", "a")
    runs = materialize(dealt.mapInArrow(_counted_windows(length), _RUNS), "kmer-runs")
    release(whole)
    return runs


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans, sizes = [], [], []
            for i, cell in enumerate(b.column("text").cast(pa.large_binary())):
                words, found = cell.as_buffer().to_pybytes().split(), b.column("runs")[i].as_py()
                here: list[list[int]] = []
                for r in sorted((r["a"], r["b"] + length) for r in found or ()):
                    if here and r[0] <= here[-1][1]:
                        here[-1][1] = max(here[-1][1], r[1])
                    else:
                        here.append(list(r))
                at = [0, *(x for s in here for x in s), len(words)]
                kept.append(b" ".join(w for x, y in zip(at[::2], at[1::2]) for w in words[x:y]))
                spans.append([{"start": x, "end": y} for x, y in here])
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("oid"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["id", "n_words", "kept", "spans"]
            )

    return run


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """One row (id, n_words, kept, spans) per row of docs: the words left, joined by one blank, and the removed spans of words.

    Words are runs of anything but ASCII white space, unchanged. A word goes if some window of `length` words that covers
    it also starts anywhere else, in the same document (overlaps count) or in another one; all places lose it. Windows are
    judged on the input and never cross documents. Null and empty texts have no words, those with fewer than `length` words
    lose none. Rows that share an id are documents of their own; rows equal in id and text are copies of each other, so
    each loses all windows. Null ids are kept. Very long texts are looked at one by one. An empty table gives an empty result.
    """
    d, distinct = keyed(docs, id_col, text_col)
    if distinct:
        runs = repeated_windows(d, length, gram, largest)
    else:  # rows that are equal in id and text stand once, and repeat themselves as a whole
        n = materialize(d.groupBy("id", "sub").agg(F.count("*").alias("n")).where("n > 1"), "kmer-copies")
        once = d.dropDuplicates(["id", "sub"])
        size = F.size(F.split(F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")), " "))
        whole = once.join(n, ["id", "sub"]).where(size >= length).select("id", "sub", F.lit(0).alias("a"), (size - length).alias("b"))
        runs = repeated_windows(once, length, gram, largest).unionByName(whole)
    of_doc = runs.groupBy("id", "sub").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    return d.join(of_doc, ["id", "sub"], "left").select("oid", "text", "runs").mapInArrow(
        _kept(length), "id long, n_words long, kept string, spans array<struct<start: int, end: int>>"
    )


def op13_superkmer_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the words in repeated windows of 35 words."""
    found = remove_repeated_words(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_words", n_removed.cast("long").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
