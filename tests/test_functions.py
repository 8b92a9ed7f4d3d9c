"""Text functions and record operators on small cases."""

from pyspark.sql import functions as F

from corroborate.functions import text as T
from corroborate.operators import linkage as L
from corroborate.operators import review as R


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_location_forms_agree(spark):
    for text in ("165 m", "165.0m", "STA.165m", "STA 165", "K165", "165m"):
        assert one(spark, T.normalize_location(F.col("a")), a=text) == "165m"
    assert one(spark, T.normalize_location(F.col("a")), a="  ") is None


def test_list_keeps_ranges_and_shares_the_unit(spark):
    assert one(spark, T.split_list(F.col("a")), a="165, 187, 188m") == ["165m", "187m", "188m"]
    assert one(spark, T.split_list(F.col("a")), a="65m, 176~206m") == ["65m", "176~206m"]


def test_range_counts_both_ends_and_units(spark):
    inside = T.within_range(F.col("p"), F.col("r"))
    assert [one(spark, inside, p=p, r="100~200m") for p in ("100m", "200m", "201m", "150km")] == [True, True, False, False]


def test_labels(spark):
    assert one(spark, T.source_label(F.array(F.lit(1), F.lit(3)))) == "p.1, p.3"
    assert one(spark, T.percent_text(F.lit(0.125))) == "12.5%"
    assert one(spark, T.file_type(F.lit("A.B.XLSX"))) == "xlsx"


def test_prf_of_nothing_is_zero(spark):
    got = L.precision_recall_f1(spark.createDataFrame([(0, 0, 0), (90, 5, 10)], "tp long, fp long, fn long")).orderBy("tp").collect()
    assert got[0][3:] == (0.0, 0.0, 0.0)
    assert abs(got[1]["precision"] - 90 / 95) < 1e-12 and got[1]["recall"] == 0.9


def test_one_to_one_counts_repeats(spark):
    rows = lambda n: spark.createDataFrame([("k",)] * n, "k string")
    assert tuple(L.one_to_one(rows(2), rows(1), ["k"]).first()) == ("k", 1, 1, 0)


def test_short_trend_is_empty(spark):
    events = spark.createDataFrame([("a", k) for k in range(7)], "c string, at long")
    assert R.recent_trend(events, "c", "at", "at", window=5).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v string")
    assert L.merge_duplicates(none.withColumn("b", F.lit(1)), ["k"], ["v"], ["b"], ["b"]).count() == 0
    assert R.snapshot_diff(none, none, "k", ["v"]).count() == 0
    assert L.overlap_pairs(none, "k", "v").count() == 0
