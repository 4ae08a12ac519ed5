"""That the stages keep all they should: unrelated documents with null or repeated ids, items without an id, the spans of pieces."""

import xxhash
from pyspark.sql import functions as F
from test_brute_force import plain_components, plain_fingerprint
from test_messy import ROWS, SCHEMA

import corpus_pipeline
from fiscalis.llm import decontaminate, pieces, simhash


def test_one_row_of_each_group(spark):
    rows = [*ROWS, (None, "quite another text that has no id", "en", "s", 1), (None, "a third text with words of its own", "en", "s", 2), (1, "yet another text with an id seen before", "en", "s", 3)]
    groups: dict = {}
    for k, root in plain_components({k: plain_fingerprint(r[1] or "") for k, r in enumerate(rows)}).items():
        groups.setdefault(root, []).append(rows[k])
    signed = lambda t: int.from_bytes(xxhash.xxh64(t.encode(), 42).digest(), "big", signed=True)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1] or "")))[:2] for g in groups.values()]
    docs = spark.createDataFrame(rows, SCHEMA)
    for d in (docs, docs.withColumn("root", F.lit(1)).withColumn("component", F.lit(2))):
        out = simhash.representatives(d)
        assert out.columns == d.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "we have alpha beta gamma delta epsilon zeta here"), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contained(docs, items).collect()] == [(1, None, 1.0, 2, 2)]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [2]


def test_clean_rows_stay_beside_leaked_ones_of_their_id(spark):
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(None, "lead " + item), (None, "a clean text of its own"), (3, item + " tail"), (3, "another clean text"), (3, item + " tail"), (4, "clean"), (4, "clean"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sub", F.lit(1)).withColumn("item", F.lit(2))
    out = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, nothing).count() == len(rows) and decontaminate.contained(docs, nothing).count() == 0


def test_spans_leave_the_pipeline(spark, data):
    texts = [(1, "  two  blanks é\U0001f600あx"), (2, ""), (3, None), (4, "word " * 100000), (5, "the end")]
    out = corpus_pipeline.encode(spark, spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), data)
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in texts:
        raw = (t or "").encode()
        ids, starts, ends = pieces.encode(raw, pieces.default_path(pieces.MODEL))
        r = rows[i]
        assert (list(r.ids), list(r.starts), list(r.ends), r.n_tokens) == (ids, starts.tolist(), ends.tolist(), len(ids))
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw
