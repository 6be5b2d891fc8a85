"""The queries against their SQL on the smallest data."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

import __spark_entry__
from beaconframe import registry

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return repr(x)


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sql, name):
    df = registry.queries()[name](spark, str(DATA))
    found = sql.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted([plain(r[i]) for i in order] for r in found.fetchall())
    assert sorted([plain(x) for x in r] for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dedupe_first_keeps_the_first_of_the_files(spark, tmp_path):
    """Rows of equal keys in several files, the later ones larger, so that Spark reads them first; with one thread the SQL keeps the first it reads."""
    table = tmp_path / "lineitem.parquet"
    table.mkdir()
    db = duckdb.connect()
    db.execute("SET threads = 1")
    for i in range(4):
        db.execute(f"COPY (SELECT CAST(r % 7 AS BIGINT) AS l_orderkey, CAST(1 + r % 2 AS INTEGER) AS l_linenumber, CAST({i} * 100000 + r AS BIGINT) AS l_partkey FROM range({14 * 40**i}) t(r)) TO '{table}/part-{i}.parquet'")
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{table}/*.parquet'")
    want = db.execute(registry.oracle_sql()["dedupe_first"]).fetchall()
    assert sorted(map(tuple, registry.queries()["dedupe_first"](spark, str(tmp_path)).collect())) == sorted(want)
    assert all(r[2] < 14 for r in want)


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def shuffled_by(spark, query):
    before, usual = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        registry.queries()[query](spark, str(DATA)).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    return shuffled(spark) - before


def test_the_grid_of_scores_is_not_shuffled(spark):
    """500 captions and images: a grid of 250,000 rows, of which 21 neighbours of each item and modality are shuffled."""
    assert shuffled_by(spark, "rr_scores_zero_filled") < 100_000


def test_scores_of_subsets_are_not_shuffled(spark):
    """500 items in seven subsets: 21 neighbours of each item, modality and subset are shuffled, not the pairs they score."""
    assert shuffled_by(spark, "random_ablation_runs") < 400_000


def test_scores_of_repeated_subsets_are_not_shuffled(spark):
    assert shuffled_by(spark, "random_ablation_mean_std") < 400_000


def test_neighbours_of_subsets_are_not_shuffled(spark):
    """500 items have 20 neighbours of each modality in each of seven subsets, 140,000 rows; only the subsets, the vectors and the counts are shuffled."""
    assert shuffled_by(spark, "random_ablation_mean_std") < 60_000
