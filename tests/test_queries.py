"""Every registered query of the core against its SQL on the same tables."""

import math

import duckdb
import pytest

from tidemark import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    return repr(bytes(x) if isinstance(x, bytearray) else x)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, data, duck, name):
    got = queries.QUERIES[name](spark, data)
    cur = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(tuple(map(_plain, r)) for r in cur.fetchall())
    assert sorted(tuple(map(_plain, r)) for r in got.select(*columns).collect()) == want


def test_no_query_is_empty_by_accident(spark, data):
    for name, f in queries.QUERIES.items():
        if name != "q27_compaction_plan":
            assert f(spark, data).count() > 0, name


def test_rows_only_queries(spark, data):
    stats = queries.q28_bloom_stats(spark, data).collect()
    assert stats and all(0 < r.fp_rate < 0.03 and r.num_hashes == 7 for r in stats)
    plan = queries.q27_compaction_plan(spark, data).collect()
    assert len(plan) == 1 and plan[0].width >= 4 and plan[0].drop_tombstones == (plan[0].start == 0)


def test_multi_get_with_ranges_is_the_same(spark, data):
    log = queries.log_e(spark, data)
    probes = log.selectExpr("seq AS probe_id", "user_key", "seq - 3 AS snapshot")
    from tidemark.operators.visibility import multi_get

    one, many = multi_get(log, probes), multi_get(log, probes, seq_ranges=7)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_plans_prune_and_push_down(spark, data, tmp_path):
    """A key and a snapshot reach the scan; a count does not read values; top-1 is cut before the shuffle."""
    from tidemark.operators import visibility

    path = str(tmp_path / "log")
    queries.log_e(spark, data).write.parquet(path)
    log = spark.read.parquet(path)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    got = plan(visibility.get(log, b"42", 100))
    assert "LessThanOrEqual(seq,100)" in got and "EqualTo(user_key" in got and "TakeOrderedAndProject" in got
    counted = plan(visibility.count_live(log))
    assert "value" not in counted.split("ReadSchema")[1] and "Window" not in counted
    assert plan(visibility.scan(log)).count("WindowGroupLimit") >= 2
    assert "CartesianProduct" not in plan(visibility.multi_get(log, log.selectExpr("seq AS probe_id", "user_key", "seq AS snapshot")))
