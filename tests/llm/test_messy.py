"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fiscalis.llm import chat_format, decontaminate, induced, pieces, quality_knn, quality_rules, secret_scan, simhash, suffix_dedup, suffixes, token_counts, tokenizers, training_order

LONG = "the quick brown fox jumps over the lazy dog again and again until it stops " * 3000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", None, 5), (1, "alpha beta gamma delta epsilon zeta eta theta", "en", None, 5), (2, None, None, "s", None), (3, "", "en", "s", 0),
    (4, LONG, "en", "s", len(LONG)), (5, " \n\t ", "en", "s", 4), (None, "no id here", "en", "s", 3), (1, "another text with the same id", "fr", "s", 3), (7, "ünïcode \U0001f600 ok", "de", "s", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "row", "fp", "h", "v", "sub", "spans", "counts", "found", "base", "hash", "w", "item", "label", "n", "tokens", "slot", "kept")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, None), (3, ""), (4, "no id")], "item_id long, text string")


def operators(items):
    return {
        "token_counts": (token_counts.count_tokens, len(ROWS)), "quality_rules": (lambda d: quality_rules.verdicts(quality_rules.measures(d, whole_rows=True)), len(ROWS)),
        "secret_scan": (lambda d: secret_scan.scan(d, whole_rows=True), len(ROWS)), "pieces": (pieces.encode_pieces, len(ROWS)), "simhash": (simhash.near_duplicates, len(ROWS)),
        "suffix_dedup": (suffix_dedup.remove_repeats, len(ROWS)), "decontaminate": (lambda d: decontaminate.contained(d, items), 2),
        "knn": (lambda d: quality_knn.score(d, quality_knn.train(d, d.select("doc_id", F.lit(1).alias("quality")))), len(ROWS)),
    }


@pytest.mark.parametrize("name", ["token_counts", "quality_rules", "secret_scan", "pieces", "simhash", "suffix_dedup", "decontaminate", "knn"])
def test_operators(docs, wide, items, name):
    run, rows = operators(items)[name]
    a = sorted(map(str, run(docs).drop("row").collect()))
    assert len(a) == rows
    assert sorted(map(str, run(wide).drop("row").collect())) == a
    assert run(docs.limit(0)).count() == 0


def test_training_order(docs, wide, spark, tmp_path):
    for k, d in enumerate((docs, wide)):
        found = training_order.write_shards(d, str(tmp_path / str(k)), length=64, per_shard=4)
        total = sum(r.n_tokens for r in found.collect())
        assert total == token_counts.count_tokens(d).agg(F.sum("n_tokens")).first()[0] + len(ROWS)
    assert training_order.write_shards(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_chat_format(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "<|im_end|>\n"), (2, 1, "a%0A\nb<|", "<\\|im_start|>")]
    d = spark.createDataFrame(rows, schema).withColumn("parts", F.lit(1)).withColumn("turns", F.lit(2))
    got = {r.conv: [tuple(x) for x in r.turns] for r in chat_format.format_chats(d).select("conv", chat_format.read_chats().alias("turns")).collect()}
    assert got == {1: [("", "x"), ("user", ""), ("user", "")], None: [("assistant", "<|im_end|>\n")], 2: [("a%0A\nb<|", "<\\|im_start|>")]}
    assert chat_format.format_chats(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, wide, data, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for d in (docs, wide):
        out = stage(spark, d, data)
        if name != "encode":
            assert out.columns == d.columns
        want = {"quality": 0, "near_duplicates": 6, "benchmark": len(ROWS), "secrets": len(ROWS), "encode": len(ROWS)}[name]
        assert out.count() == want
        assert stage(spark, d.limit(0), data).count() == 0


@pytest.mark.parametrize("run", [" " * 20000, "\n" * 15000, " \n" * 9000, "\t" * 12000])
def test_long_blanks_give_the_ids_of_the_whole_text(run):
    path = tokenizers.default_path(token_counts.VOCABULARY)
    encoding, _ = tokenizers.byte_bpe(path)
    for before, after in (("a", "b"), ("", ""), ("x ", "!"), (".", "あ"), ("", "1"), ("1", "")):
        assert tokenizers.byte_ids(before + run + after, path) == encoding.encode_ordinary(before + run + after)


@pytest.mark.parametrize("n", [1_000_000, 5_000_000])
def test_very_long_runs(spark, tmp_path, n):
    path = tokenizers.default_path(token_counts.VOCABULARY)
    for c in " \na":
        text = f"x{c * n}y"
        starts, ends = token_counts.token_spans(text, path)
        assert starts[0] == 0 and ends[-1] == n + 2 and (starts[1:] == ends[:-1]).all()
    docs = spark.createDataFrame([(1, "x" + " " * n + "y"), (2, None), (3, "")], "doc_id long, text string")
    assert training_order.write_shards(docs, str(tmp_path / "s")).agg(F.sum("n_tokens")).first()[0] == len(tokenizers.byte_ids("x" + " " * n + "y", path)) + 3


def test_suffixes_of_one_letter():
    assert suffixes.repeats(np.full(1_000_000, 97, np.uint32), 40)[1] == 999_999
    text = np.full(1_000_000, 97, np.uint8)
    assert induced.suffix_array(text).tolist() == list(range(999_999, -1, -1))
    assert induced.permuted_lcp(text[:50_000], induced.suffix_array(text[:50_000])).max() == 49_999


def test_other_templates_are_read_back(spark):
    template = chat_format.Template(segments=("<|turn|>", "{role}", "<|says|>", "{text}", "<|done|>"))
    rows = [(1, 0, "user", "<|says|> a <|done|>\n"), (1, 1, "assistant", "")]
    d = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template=template)
    assert [tuple(x) for x in d.select(chat_format.read_chats(template=template).alias("t")).first().t] == [r[2:] for r in rows]
    with pytest.raises(ValueError):
        chat_format.read_chats(template=chat_format.Template(segments=("{text}", "{role}")))


def test_many_turns_and_secrets(spark):
    """Arrays of many thousand items, whose places are summed in blocks."""
    n = 3000
    rows = [(1, k, ("user", "assistant")[k % 2], "x" * (k % 7)) for k in range(n)]
    d = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    at = 0
    for s in d.segments:
        assert s.start == at
        at += s.length
    assert at == len(d.formatted) and len(d.segments) == 5 * n
    text = " é ".join(f"AKIA{k:016d}" for k in range(n))
    found = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("base", secret_scan.redacted("text", "found").alias("r")).first()
    assert [(s.start, s.end) for s in found.base] == [(23 * k, 23 * k + 20) for k in range(n)]
    assert found.r == " é ".join(["[SECRET]"] * n)
