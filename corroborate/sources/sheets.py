"""Report data sets written one folder per sheet, and the store of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The one sheet of a workbook that would otherwise have none.
NOTICE = "notice"


def write_sheets(sheets: dict[str, DataFrame], path: str, form: str = "csv") -> list[str]:
    """Write each sheet below ``path`` in parallel tasks; returns their folders.  Without sheets one is written that says so."""
    written = []
    if not sheets:
        spark = SparkSession.getActiveSession()
        sheets = {NOTICE: spark.createDataFrame([("nothing was chosen",)], "text string")}
    for name, rows in sheets.items():
        folder = f"{path.rstrip('/')}/{name}"
        writer = rows.write.mode("overwrite")
        (writer.option("header", True).csv(folder) if form == "csv" else writer.format(form).save(folder))
        written.append(folder)
    return written


def save_reports(rows: DataFrame, path: str, key: str = "report_id") -> None:
    """Replace only the reports that ``rows`` holds; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def load_reports(spark: SparkSession, path: str, defaults: dict, legacy) -> DataFrame:
    """Stored reports, those of an older layout migrated."""
    from corroborate.operators import state

    return state.migrate(spark.read.option("mergeSchema", True).parquet(path), defaults, legacy)


def delete_reports(spark: SparkSession, path: str, ids: list, key: str = "report_id") -> None:
    """Take the named reports out of the store: their partitions go, the others are not read."""
    jvm = spark.sparkContext._jvm
    for i in ids:
        at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{key}={i}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_reports(spark: SparkSession, path: str, key: str = "report_id") -> None:
    """Leave a store of no rows, of the same columns.

    The empty store is written first and the old one moved aside before it takes its place, so that a run that breaks off
    leaves the old store, beside or below its name with ``.old``; what is left of one is put back or cleared next time."""
    spark_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store, empty, old = (spark_path(path.rstrip("/") + x) for x in ("", ".empty", ".old"))
    files = store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(old) and not files.exists(store):
        files.rename(old, store)
    spark.read.parquet(path).limit(0).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(empty.toString())
    files.delete(old, True)
    files.rename(store, old)
    files.rename(empty, store)
    files.delete(old, True)
