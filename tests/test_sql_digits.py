"""The SQL of gravity decides and rounds on the same doubles as the query."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skylark import queries as own
from skylark.plans import engines


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of all values from 0 to 200 in steps, whose gravity lies on many ties and thresholds."""
    out = str(tmp_path_factory.mktemp("digits"))
    e = spark.range(40_000).withColumnRenamed("id", "event_id")
    e = e.select("event_id", F.timestamp_micros(F.lit(1706400000000000) + F.col("event_id") * 900_000_000).cast("timestamp_ntz").alias("ts"), (F.col("event_id") % 5).alias("user_id"), F.lit("view").alias("event_type"))
    e = e.withColumns({"value": (F.col("event_id") * 37 % 201).cast("double"), "props": F.concat(F.lit('{"k": '), (F.col("event_id") * 53 % 101).cast("string"), F.lit("}"))})
    e.coalesce(1).write.parquet(f"{out}/events.parquet")
    return out


@pytest.mark.parametrize("name", ["g01_gravity_decisions", "g05_actor_feedback", "g07_escalations"])
def test_query_and_sql_agree_on_ties(spark, folder, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    want = db.execute(own.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in db.description]
    got = [tuple(r) for r in own.queries()[name](spark, folder).select(*columns).collect()]
    assert sorted(got) == sorted(want)


def test_gravity_has_the_same_last_digit(spark, folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    want = dict(db.execute(f"WITH {engines.SIGNALS} SELECT signal_id, {engines.GRAVITY} FROM signals").fetchall())
    got = {r.signal_id: r.g for r in engines.signals(spark, folder).select("signal_id", engines.gravity().alias("g")).collect()}
    assert got == want
