"""The stored mart: all tables of a commit or none, touched buckets only, several runs and writers."""

import json

import pytest
from pyspark.sql import functions as F

from fiscalis.operators import loading, mart, store


class Stop(Exception):
    pass


def rows(spark, root, name):
    return sorted(map(tuple, store.read(spark, root, name).collect()))


def changes(spark, n):
    a = spark.createDataFrame([(k, n) for k in range(5)], "k long, v long")
    return {name: store.Change(a.withColumn("v", F.col("v") + i), ["k"], "last") for i, name in enumerate(("one", "two", "three"))}


@pytest.mark.parametrize("step", range(5))
def test_a_lost_writer_leaves_no_gap(spark, tmp_path, monkeypatch, step):
    """The second commit stops after 0 to 3 tables, or right before the rename: readers have the first one whole."""
    root = str(tmp_path / "mart")
    store.commit(spark, root, changes(spark, 1))
    want = {name: rows(spark, root, name) for name in ("one", "two", "three")}
    done, write, publish = [], store.written, store.publish

    def stops(*args):
        if len(done) == step:
            raise Stop
        done.append(write(*args))
        return done[-1]

    def fails(*args):
        raise Stop

    with monkeypatch.context() as m:
        m.setattr(store, "written", stops)
        m.setattr(store, "publish", fails if step >= 3 else publish)
        with pytest.raises(Stop):
            store.commit(spark, root, changes(spark, 2))
    assert {name: rows(spark, root, name) for name in want} == want and store.version(spark, root) == 1
    assert store.commit(spark, root, changes(spark, 2)) == 2
    assert {name: rows(spark, root, name) for name in want} == {name: [(k, v + 1) for k, v in old] for name, old in want.items()}
    assert store.read(spark, root, "one", 1).agg(F.max("v")).first()[0] == 1  # the version before is still there
    gone = store.sweep(spark, root, keep=1)
    assert gone == 3 + min(step, 3) and {name: rows(spark, root, name) for name in want} == {name: [(k, v + 1) for k, v in old] for name, old in want.items()}


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    root = str(tmp_path / "mart")
    base = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    store.commit(spark, root, {"t": store.Change(base, ["k"])})
    before = store.manifest(spark, root)["t"]["paths"]
    assert len(before) == store.BUCKETS
    new = spark.createDataFrame([(3, "a"), (3, "b"), (2000, "c")], "k long, v string")
    touched = {str(r[0]) for r in new.select(store.bucket(["k"], store.BUCKETS)).collect()}
    for how, want in (("first", {3: "old", 2000: "c"}), ("last", {3: "b", 2000: "c"})):
        was = store.manifest(spark, root)["t"]["paths"]
        store.commit(spark, root, {"t": store.Change(new, ["k"], how, ("v",))})
        now = store.manifest(spark, root)["t"]["paths"]
        assert {b for b in now if now[b] != was.get(b)} == touched
        found = store.of_keys(spark, root, "t", new)
        assert {r.k: r.v for r in found.collect()} == want
        assert {f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles()} == touched
        d = store.read(spark, root, "t")
        assert d.count() == 1001 and d.where("v = 'old'").count() == 1000 - (how == "last")


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer whose version number was taken starts anew from what the other one left."""
    root = str(tmp_path / "mart")
    one = lambda k: {"t": store.Change(spark.createDataFrame([(k, k)], "k long, v long"), ["k"], "last")}
    store.commit(spark, root, one(0))
    publish, first = store.publish, []

    def late(*args):
        if not first:
            first.append(1)
            monkeypatch.setattr(store, "publish", publish)
            store.commit(spark, root, one(1))
        return publish(*args)

    monkeypatch.setattr(store, "publish", late)
    assert store.commit(spark, root, one(2)) == 3
    assert rows(spark, root, "t") == [(0, 0), (1, 1), (2, 2)]


def test_mart_is_loaded_by_commits(spark, tmp_path):
    doc = lambda county, at, name: {"pipeline": "p", "generated_at": at, "counties": [{"county": county, "projects": [{"project_id": f"{county}-1", "county": county, "project_name": name}]}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(doc("A", "2024-05-02T10:00:00", "x")))
    (tmp_path / "in" / "b.json").write_text(json.dumps(doc("B", "2024-05-01T10:00:00", "y")))
    (tmp_path / "f.json").write_text(json.dumps({"metadata": {"fiscal_year": "2023"}, "financial_data": {"budget_summary": {"data": [{"county": "A", "total_budget_kshs": "1,500"}]}}}))
    root = str(tmp_path / "mart")
    assert loading.load_stored(spark, root, str(tmp_path / "in"), str(tmp_path / "f.json")) == 2
    assert loading.load_stored(spark, root, str(tmp_path / "in")) == 3
    runs = [(r.run_id, str(r.generated_at)[:10]) for r in mart.list_runs(store.read(spark, root, "audit_runs")).collect()]
    assert runs == [(1, "2024-05-01"), (2, "2024-05-02"), (3, "2024-05-01"), (4, "2024-05-02")]
    assert [r[1:2] for r in rows(spark, root, "projects")] == [("A",), ("B",)] and len(rows(spark, root, "county_finances")) == 1 and len(rows(spark, root, "counties")) == 2


def test_replaced_tables_are_put_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    loading.write_whole(spark.range(3), path)
    loading.write_whole(spark.range(4), path)
    assert spark.read.parquet(path).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["t"]
