import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(shared)).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def same(spark, query, sql, data):
    """Whether a query's rows equal those of DuckDB's SQL, columns by name, order left out."""
    import duckdb

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    ours = query(spark, data)
    names = sorted(ours.columns)
    cursor = con.execute(sql)
    theirs = [x[0] for x in cursor.description]
    assert sorted(theirs) == names
    plain = lambda x: round(float(x), 6) if type(x).__name__ in ("float", "Decimal") else x
    key = lambda row: [(x is None, str(x)) for x in row]
    a = sorted(([plain(r[n]) for n in names] for r in ours.collect()), key=key)
    b = sorted(([plain(r[theirs.index(n)]) for n in names] for r in cursor.fetchall()), key=key)
    assert a == b
