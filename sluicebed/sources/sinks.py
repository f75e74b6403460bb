"""Sinks: append-only results, summaries, CSV and JSON reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def check_output(path: str) -> str:
    """Results may not land in a folder of job logs."""
    if "logs" in path.replace("\\", "/").split("/")[:-1] or path.endswith((".out", ".err")):
        raise ValueError(f"{path}: results may not be written below logs/")
    return path


def append_results(results: DataFrame, path: str) -> None:
    """Append rows as JSONL; a task's file appears only when it is whole."""
    results.write.mode("append").option("ignoreNullFields", "false").json(check_output(path))


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    """Atomic JSONL output that isn't overwritten unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").json(check_output(path))


def write_if_absent(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").json(path)


def write_csv(df: DataFrame, path: str, missing: str = "") -> None:
    """A small report as one CSV file with a header; missing rates become `missing`."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", missing).option("emptyValue", missing).csv(check_output(path))


def write_summary(metrics: DataFrame, path: str) -> None:
    """Metrics as nested JSON: one row per mode with a list of metrics by dimension."""
    nested = metrics.groupBy("mode").agg(F.collect_list(F.struct(*[c for c in metrics.columns if c != "mode"])).alias("metrics"))
    nested.coalesce(1).write.mode("overwrite").json(check_output(path))


def guard_run(df: DataFrame, settings: dict) -> None:
    """Refuse to go on in a folder written under other settings: the first run stores them beside it, later ones compare."""
    spark = df.sparkSession
    path = f"{settings['output']}-settings"
    want = json.dumps(settings, sort_keys=True)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        have = spark.read.text(path).first()[0]
        if have != want:
            raise ValueError("settings differ from those of the run to resume")
    else:
        spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(path)
