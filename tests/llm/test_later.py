"""Vector codes, the Merkle manifest and super-k-mers against plain loops, and on messy tables."""

import hashlib
import random
import re
import zlib
from math import floor, inf, isfinite, nan

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_messy import CLASH, ROWS, SCHEMA

from fiscalis.llm import merkle, quality_knn, superkmers, tokenizers, token_counts, training_order, vector_codes
from fiscalis.llm.queries import queries


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def plain_codes(rows):
    """rows: (id, vector, label). The codes, errors, sums of labels and codebooks, by loops."""
    kept = [(i, [floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    dims = -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8
    kept = [(i, v + [0] * (dims - len(v)), label) for i, v, label in kept]
    w = dims // 8
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[v[p * w : p * w + w] for _, v, _ in first] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min(range(len(book)), key=lambda k: (far(part, book[k]), k))
    for _ in range(6):
        for p in range(8):
            got = {}
            for _, v, _ in kept:
                part = v[p * w : p * w + w]
                got.setdefault(near(part, books[p]), []).append(part)
            books[p] = [[sum(c) // len(got[k]) for c in zip(*got[k])] if k in got else e for k, e in enumerate(books[p])]
    out, of_label = [], {}
    for i, v, label in kept:
        code = [near(v[p * w : p * w + w], books[p]) for p in range(8)]
        error = sum(far(v[p * w : p * w + w], books[p][c]) for p, c in enumerate(code))
        of_label[label] = of_label.get(label, 0) + error
        out.append((i, label, bytes(code).hex(), error))
    return sorted(((*r, of_label[r[1]]) for r in out), key=str), sha(",".join(str(x) for b in books for e in b for x in e))


def test_op11(spark, data):
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want, books = plain_codes(rows)
    got = queries()["op11_vector_codes"](spark, data)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = got.collect()
    assert {r.codebooks_sha256 for r in got} == {books}
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted((i, c, e, t) for i, _, c, e, t in want)


def test_codes_of_messy_vectors(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-2, 2) for _ in range(19)], i % 3 or None) for i in range(60)]
    rows += [(None, [0.5] * 19, 1), (7, rows[7][1], 7), (7, rows[7][1], 7), (3, [1.0] * 19, 2), (100, None, 1), (101, [1.0, nan], 1), (102, [inf, 0.0], 1), (103, [None, 1.0], 1), (104, [], None), (105, [-0.3], 9), (-1, [0.1] * 19, 0)]
    schema = "vec_id long, embedding array<double>, label long"
    d = spark.createDataFrame(rows, schema)
    want, digest = plain_codes(rows)
    for k, x in enumerate((d.repartition(5), d.coalesce(1).select("*", *(F.lit(1).alias(c) for c in CLASH if c != "label"), F.lit(2).alias("vector"), F.lit(3).alias("ids")))):
        found, books = vector_codes.compress(x)
        assert vector_codes.digest(books) == digest
        assert sorted(((r.id, r.label, r.code, r.error, r.label_error) for r in found.collect()), key=str) == want
    one = next(r for r in found.collect() if r.id == 105)
    v = np.zeros(24, np.int64)
    v[0] = floor(-0.3 * 4096)
    assert ((vector_codes.decoded(one.code, books) - v) ** 2).sum() == one.error
    assert vector_codes.compress(d.limit(0))[0].count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, [], None), (2, None, 1)], schema))[0].collect() == [(1, None, "00" * 8, 0, 0)]
    few = spark.createDataFrame([(1, [1e30, -1e30], 1), (2, [0.0, 0.0], 1)], schema)  # so large that they are cut, not an error
    assert sorted(r.code for r in vector_codes.compress(few)[0].collect()) == ["0000000000000000", "0101000000000000"]


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text). By levels of lists."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(field, r)))

    def climb(nodes):
        """The levels of a list of hashes, from below."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([sha("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
        return levels

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    levels = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        levels[g] = climb([leaf(r) for r in groups[g]])
    top = climb([levels[g][-1][0] for g in order])
    out = []
    for t, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node, proof = leaf((*r[:3], r[3] + 1, r[4])) if tampered else leaf(r), ""
            for at, way in ((i, levels[g]), (t, top)):
                for level in way[:-1]:
                    pair = level[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += "".join(x for k, x in enumerate(pair) if k != at % 2)
                    pair[at % 2] = node
                    node, at = sha("".join(pair)), at // 2
            out.append((r[0], leaf(r), levels[g][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def test_op12(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = queries()["op12_merkle_manifest"](spark, data)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == plain_manifest([tuple(r) for r in docs.collect()])
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 255, 256, 257, 1030])
def test_manifest_of_messy_rows(spark, tmp_path, n):
    """Groups of all sizes about a page's, null ids and groups, repeated ids and rows, more groups than a page holds."""
    r = random.Random(n)
    rows = [(k, r.choice(["a", None]), "en", r.choice([None, k]), "x" * (k % 3)) for k in range(n)]
    if n == 257:
        rows += [(k, None, f"l{k}", 1, "é") for k in range(300)] + [(None, None, None, None, None)] * 3 + [(5, "a", "en", 5, "y"), (5, "a", "en", 5, "y"), (None, "b", "en", 1, None), (9, "s", None, 0, ""), (9, "s", "", 0, "ü\0")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    d = spark.createDataFrame(rows, schema).repartition(3).select("*", *(F.lit(1).alias(c) for c in ("pos", "hash", "depth", "path", "group", "id")))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op12_merkle_manifest"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def plain_windows(rows, length):
    """rows: (id, text). Words removed, by a dictionary of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    places: dict = {}
    for k, w in enumerate(words):
        for i in range(len(w) - length + 1):
            places.setdefault(tuple(w[i : i + length]), []).append((k, i))
    gone = [set() for _ in rows]
    for at in places.values():
        if len(at) > 1:
            for k, i in at:
                gone[k].update(range(i, i + length))
    return sorted(((i, len(w), len(g), sha(" ".join(x for k, x in enumerate(w) if k not in g))) for (i, _), w, g in zip(rows, words, gone)), key=str)


def digests(found):
    return sorted(((r.id, r.n_words, sum(s.end - s.start for s in r.spans), sha(r.kept)) for r in found.collect()), key=str)


def test_op13(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries()["op13_superkmer_dedup"](spark, data)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = plain_windows(rows, superkmers.LENGTH)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(n > 0 for _, _, n, _ in want) > 10


@pytest.mark.parametrize("largest", [3, 8000])
def test_random_texts_of_few_words(spark, largest):
    """Many repeats at all distances; with a small bound, buckets are cut into windows."""
    r = random.Random(largest)
    parts = [" ".join(r.choice("abcde") * r.randint(1, 2) for _ in range(r.randint(3, 30))) for _ in range(40)]
    rows = [(k, r.choice([" ", "\n", " \t "]).join(r.choice(parts) for _ in range(r.randint(0, 8)))) for k in range(150)]
    rows += [(200, "q " * 500), (201, "q " * 9), (202, "q " * 10), (203, "é \U0001f600 " * 40), (204, "one two three four five six seven eight nine ten eleven"), (205, "x\x00y z\x0bw")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digests(superkmers.remove_repeated_words(d, length=10, gram=3, largest=largest)) == plain_windows(rows, 10)


def test_words_of_messy_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = [(r[0], r[1]) for r in ROWS]
    for d in (docs, docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))):
        for length in (5, superkmers.LENGTH):
            assert digests(superkmers.remove_repeated_words(d, length=length, gram=2)) == plain_windows(rows, length)
    assert superkmers.remove_repeated_words(docs.limit(0)).count() == 0


def test_scores_dont_depend_on_blocks(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    model = quality_knn.train(docs, labels)
    twice = docs.unionByName(docs)
    want = {(r.id, r.score) for r in quality_knn.score(docs.coalesce(1), model).collect()}
    for d in (twice.repartition(7), twice.orderBy(F.rand(3)).repartition(3)):
        assert {(r.id, r.score) for r in quality_knn.score(d, model).collect()} == want
    one = quality_knn.fit(np.ones((40, quality_knn.TERMS + 8), np.float32), np.arange(40) % 2)  # all cosines are equal: the first rows vote
    assert one.scores(np.ones((3, quality_knn.TERMS + 8), np.float32)).tolist() == [12 / 25] * 3


def test_op1_of_all_documents(spark, data):
    path = tokenizers.default_path(token_counts.VOCABULARY)
    encoding, _ = tokenizers.byte_bpe(path)
    want = {r.doc_id: len(encoding.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries()["op1_token_counts"](spark, data).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {k: n for k, n in want.items() if n}


def test_op9_query(spark, data):
    """The rows of the registered query against the stream, laid out by hand."""
    path = tokenizers.default_path(training_order.VOCABULARY)
    encoding, _ = tokenizers.byte_bpe(path)
    stream, owner = [], []
    for r in sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*encoding.encode_ordinary(r.text or ""), 50256]
        stream += ids
        owner += [r.doc_id] * len(ids)
    length = training_order.LENGTH
    n = -(-len(stream) // length)
    want = set()
    for k, slot in enumerate(training_order.permute(np.arange(n), n).tolist()):
        part = stream[k * length : (k + 1) * length]
        whole = part + [50256] * (length - len(part))
        ids = ",".join(map(str, dict.fromkeys(owner[k * length : (k + 1) * length])))
        shard = slot // training_order.PER_SHARD
        want.add((slot, shard, (slot - shard * training_order.PER_SHARD) * length * 2, len(part), hashlib.sha256(np.array(whole, "<u2").tobytes()).hexdigest(), ids))
    assert {tuple(r) for r in queries()["op9_training_order"](spark, data).collect()} == want
