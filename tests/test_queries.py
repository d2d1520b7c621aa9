"""Every query against its SQL twin on the smallest tables, and streams against batch."""

import math

import duckdb
import pytest

import __spark_entry__
from trackloom import registry
from trackloom.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr(tuple(norm(r[k]) for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    rel = duck.sql(registry.ORACLES[name])
    assert got == table(rel.columns, rel.fetchall())


def test_ordinals_of_a_large_bank_equal_sql(spark, tmp_path):
    """Numbers of five digits, which the SQL's lpad cuts to four; the operator's own names stay whole."""
    from trackloom.operators import bank

    spark.range(10_900).selectExpr("id AS vec_id", "array(CAST(id AS FLOAT)) AS embedding", "CAST(id % 10 AS INT) AS label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df, rel = registry.QUERIES["w16_ordinals"](spark, str(tmp_path)), con.sql(registry.ORACLES["w16_ordinals"])
    rows = rel.fetchall()
    assert len(rows) > 10_000 and table(df.columns, df.collect()) == table(rel.columns, rows)
    named = bank.ordinals(spark.range(10_900).selectExpr("id % 10 AS g", "id"), ["g", "id"])
    assert named.select("ordinal").distinct().count() == 10_900 and named.where("ordinal = 'SB10899'").count() == 1


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_stream_equals_batch(spark):
    from pyspark.sql import functions as F

    from trackloom.operators import machines
    from trackloom.streaming.events import observed, recovery

    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = machines.run(observed(events), ["clip_id"], machines.recover, "at")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, recovery(spark, SF).collect()))


def chunks_of_events(spark, tmp_path):
    """The events in four files by time, each a micro-batch."""
    import os

    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    edges = [r[0] for r in events.select(F.percentile(F.unix_micros("ts"), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")).select(F.explode("q")).collect()]
    folder = tmp_path / "live"
    folder.mkdir()
    for k, (a, b) in enumerate(zip([0, *edges], [*edges, 1e30])):
        out = tmp_path / f"part{k}"
        events.where((F.unix_micros("ts") >= a) & (F.unix_micros("ts") < b)).coalesce(1).write.parquet(f"file://{out}")
        (file,) = out.glob("*.parquet")
        file.rename(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    return events, folder


def live(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def test_state_is_carried_over_micro_batches(spark, tmp_path):
    from trackloom.operators import machines
    from trackloom.streaming.events import finished, observed, recovered

    events, folder = chunks_of_events(spark, tmp_path)
    batch = machines.run(observed(events), ["clip_id"], machines.recover, "at")
    got = finished(spark, recovered(live(spark, folder, events.schema)), "append")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, got.collect()))


def test_late_rows_are_dropped_and_idle_tracks_end(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from trackloom.operators import machines
    from trackloom.streaming.events import finished, observed, recovered

    events, folder = chunks_of_events(spark, tmp_path)
    late = events.orderBy("ts").limit(5)  # come again after everything, long before the watermark
    late.coalesce(1).write.parquet(f"file://{tmp_path}/late")
    (file,) = (tmp_path / "late").glob("*.parquet")
    file.rename(folder / "9.parquet")
    os.utime(folder / "9.parquet", (1_000_009, 1_000_009))
    got = finished(spark, recovered(live(spark, folder, events.schema)), "append")
    batch = machines.run(observed(events), ["clip_id"], machines.recover, "at")
    assert got.count() == events.count() == batch.count()


def test_idle_tracks_are_given_up(spark, tmp_path):
    """A third of the clips is silent in the second and third batch: with a short idle time they begin anew in the last, with a long one they go on."""
    import os

    from pyspark.sql import functions as F

    from trackloom.streaming.events import finished, recovered

    events, folder = chunks_of_events(spark, tmp_path)
    for k in (1, 2):
        spark.read.parquet(f"file://{folder}/{k}.parquet").where("user_id % 3 <> 0").coalesce(1).write.parquet(f"file://{tmp_path}/some{k}")
        (file,) = (tmp_path / f"some{k}").glob("*.parquet")
        file.rename(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_000_000 + k, 1_000_000 + k))

    def twice(idle_ms):
        rows = finished(spark, recovered(live(spark, folder, events.schema), idle_ms=idle_ms), "append").where("reason = 'first_visible_candidate'")
        return {r["clip_id"] for r in rows.groupBy("clip_id").agg(F.count("*").alias("n")).where("n > 1").collect()}

    short = twice(1)
    assert short and all(c % 3 == 0 for c in short) and twice(10**12) == set()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
