"""Reading tables and writing results."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession

MOST_REPORT_ROWS = 1_000_000


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A Parquet table of a folder; columns and filters of later steps reach the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header row.  Without a schema the types come from a pass over the file."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, form: str = "parquet") -> None:
    """Distributed: one file or more for each task, which may fail and run again."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).format(form).save(path)


def save_tab(tables: dict[str, DataFrame] | DataFrame, path: str = "temp.csv", first_line: str = "\n") -> None:
    """One text file on the driver with a section for each table: its name and its rows as CSV, nulls as nothing.

    A single table has no name line.  For printed reports: a table above ``MOST_REPORT_ROWS`` rows is an error, and
    belongs into ``write_table``.
    """
    out = io.StringIO()
    out.write(first_line)
    many = isinstance(tables, dict)
    for name, df in (tables if many else {"": tables}).items():
        if many:
            out.write(f"\n{name}\n")
        writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
        writer.writerow(["", *df.columns])
        rows = df.limit(MOST_REPORT_ROWS + 1).collect()
        if len(rows) > MOST_REPORT_ROWS:
            raise ValueError(f"{name or 'the table'} has more than {MOST_REPORT_ROWS} rows")
        for k, row in enumerate(rows, 1):
            writer.writerow([k, *["" if v is None else v for v in row]])
    with open(path, "w", encoding="utf-8") as f:
        f.write(out.getvalue())
