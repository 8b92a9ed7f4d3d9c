"""Streams of snapshots and events against the same work on tables."""

from pyspark.sql import functions as F

from corroborate.operators import quality as Q
from corroborate.streaming import events as V
from corroborate.streaming import snapshots as S

SHAPE = "report_id string, id string, version long, at timestamp, deleted boolean, damage_name string, section string, part string, location string, " + ", ".join(f"{c} {k}" for c, k in Q.LISTS.items())


def snapshot(id_, version, minute, overrides=(), deleted=False, history=0, place="1m"):
    over = [(f, "a", v, at) for f, v, at in overrides]
    return ("r", id_, version, f"2024-01-01 00:{minute:02}:00", deleted, "균열", "s", "사면", place, over or None, [(f"h{k}", "review_completed") for k in range(history)] or None, None, [("location", "1m", ("2m", None, f"d{version}"))] if version > 2 else None)


ROWS = [
    snapshot("NEW-1", 1, 1), snapshot("NEW-1", 2, 2, [("location", "b", "t1")]), snapshot("NEW-1", 3, 3, [("location", "b", "t1"), ("part", "c", "t2")], history=1), snapshot("NEW-1", 4, 4, deleted=True),
    snapshot("R2", 1, 1), snapshot("R2", 2, 5, [("status", "excluded", "t1")]), snapshot("R2", 3, 6, [("status", "excluded", "t9")]), snapshot("R3", 1, 2, [("section", "x", "t")]),
]
END = snapshot("END", 1, 59)


def expected(spark):
    """Events of each snapshot against the one before, from tables."""
    rows = spark.createDataFrame([(*r[:3], *r[3:]) for r in ROWS], SHAPE.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))
    live = rows.where("not deleted")
    out = []
    for version in (1, 2, 3, 4):
        before = live.where(F.col("version") == version - 1)
        now = rows.where(F.col("version") == version)
        seen = before.join(now.select("report_id", "id"), ["report_id", "id"], "left_semi")
        got = Q.record_events(seen, now.where("not deleted"), F.lit("now"))
        out += [(r["record_id"], version, r["type"], r["field"], r["to"]) for r in got.collect()]
    return sorted(out, key=str)


def run(spark, tmp_path, steps, name):
    """Feed the steps one run after the other, each starting anew from the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, kept = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
    schema = spark.createDataFrame([], SHAPE).schema
    for k, rows in enumerate(steps):
        table = spark.createDataFrame(rows, SHAPE.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))
        table.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        V.append_events(S.record_events(stream, "10 minutes"), out, kept).awaitTermination()
    return sorted(((r["record_id"], r["version"], r["type"], r["field"], r["to"]) for r in spark.read.parquet(out).collect()), key=str)


def test_a_stream_of_snapshots_gives_the_events_of_tables(spark, tmp_path):
    late_and_twice = [[ROWS[2], ROWS[0], ROWS[0]], [ROWS[1], ROWS[4], ROWS[2]], [ROWS[3], ROWS[6], ROWS[7]], [ROWS[5]], [END], [snapshot("END", 2, 59)], [ROWS[1]]]
    want = expected(spark)
    assert {e[2] for e in want} == {"damage_added", "field_edited", "bulk_reviewed", "cross_validation_resolved", "damage_deleted", "status_excluded"}
    assert run(spark, tmp_path, late_and_twice, "late") == want


def test_sliding_and_session_windows(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:20:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:10:00"), ("a", None)], "c string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    slid = V.windowed_counts(rows, "ts", "c", "1 hour", slide="30 minutes")
    assert sorted((str(r["start"])[11:16], r["c"], r["n"]) for r in slid.collect()) == [("00:00", "a", 2), ("00:00", "b", 1), ("00:30", "a", 1), ("01:00", "a", 1), ("23:30", "a", 2), ("23:30", "b", 1)]
    met = V.session_counts(rows, "ts", "c", "30 minutes")
    assert sorted((str(r["start"])[11:16], str(r["end"])[11:16], r["c"], r["n"]) for r in met.collect()) == [("00:00", "00:50", "a", 2), ("00:10", "00:40", "b", 1), ("01:00", "01:30", "a", 1)]


def test_events_that_come_again_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, "f", "2024-01-01 00:00:00"), (1, "f", "2024-01-01 00:00:00"), (1, "g", "2024-01-01 00:01:00")], "id int, field string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    for k in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        V.append_events(S.once(stream, "ts", ["id", "field", "ts"], "1 hour"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r["id"], r["field"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "f"), (1, "g")]
