"""JSONL scans with declared schemas."""

from __future__ import annotations

import contextlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebed.functions.schemas import ANALYSIS, RAW_PULL, RESULT, SUPPORTED_CWES


BATCH = 50_000  # rows of a local database in memory at a time


def _parsed(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("_path"))
    one = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.filter(F.trim("value") != "").select(one.alias("j"), "_path").select("j.*", "_path")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """One row per line that isn't blank. Only "\\n" ends a line, so U+2028 inside strings survives; a line that is no
    object keeps its text in _corrupt_record if the schema has that column."""
    return _parsed(spark, path, schema).drop("_path")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def split_path(root: str, cwe: str, malicious: bool, version: str, benign_version: str) -> str:
    """<root>/<cwe>/<version>/generated_prs.jsonl, or <root>/<cwe>/benign/<version>/generated_prs.jsonl."""
    parts = [root, cwe, version] if malicious else [root, cwe, "benign", benign_version]
    return os.path.join(*parts, "generated_prs.jsonl")


def read_split(spark: SparkSession, root: str, cwe: str, malicious: bool, version: str = "v2", benign_version: str = "v1") -> DataFrame | None:
    """A local split with its label and folder, or None if it is missing (a remote hub is out of reach here)."""
    path = split_path(root, cwe, malicious, version, benign_version)
    if not _exists(spark, path):
        return None
    return read_jsonl(spark, path, RAW_PULL).withColumns({"malicious": F.lit(malicious), "cwe_dir": F.lit(cwe)})


def read_enriched(spark: SparkSession, root: str, cwes: list[str] | None = None, include_benign: bool = True) -> DataFrame:
    """<root>/cwe*/{malicious,benign}.jsonl with label and folder from the path; folders not asked for aren't listed."""
    dirs = "{" + ",".join(cwes) + "}" if cwes else "cwe*"
    names = "{malicious,benign}" if include_benign else "malicious"
    raw = _parsed(spark, os.path.join(root, dirs, f"{names}.jsonl"), RAW_PULL)
    where = F.col("_path")
    return raw.withColumns(
        {"cwe_dir": F.regexp_extract(where, r"([^/]+)/[^/]+$", 1), "malicious": F.regexp_extract(where, r"([^/]+)\.jsonl$", 1) == "malicious"}
    ).drop("_path")


def read_metadata(spark: SparkSession, root: str, cwes: tuple[str, ...] = SUPPORTED_CWES, include_benign: bool = True) -> DataFrame:
    """The metadata splits of the chosen weaknesses that are there, one union."""
    parts = [read_split(spark, root, c, m) for c in cwes for m in ((True, False) if include_benign else (True,))]
    found = [p for p in parts if p is not None]
    if not found:
        raise FileNotFoundError(f"no metadata under {root}")
    whole = found[0]
    for p in found[1:]:
        whole = whole.unionByName(p)
    return whole


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, RESULT)


def repaired_results(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoint without a torn last line.

    Raises ValueError if any other line is torn or a key (id, malicious, mode) occurs twice.
    """
    rows = read_results(spark, path)
    raw = spark.read.option("lineSep", "\n").text(path)
    torn = rows.filter("_corrupt_record is not null").select("_corrupt_record").limit(2).collect()
    if torn:
        files = {r[0] for r in raw.select(F.input_file_name()).distinct().collect()}
        tails = set()
        for f in files:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(f)
            size = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).getLen()
            stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
            try:
                stream.seek(max(0, size - 1))
                ended = stream.read() == 10
            finally:
                stream.close()
            if not ended:
                tails.add(f)
        if len(torn) > 1 or not tails:
            raise ValueError("a line before the last one is broken")
    rows = rows.filter("_corrupt_record is null").drop("_corrupt_record")
    twice = rows.groupBy("id", "malicious", "mode").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated key {tuple(twice[0])[:3]}")
    return rows


def load_benchmark(
    spark: SparkSession,
    enriched_root: str | None = None,
    metadata_root: str | None = None,
    path: str | None = None,
    cwes: list[str] | None = None,
    include_benign: bool = True,
    hard_only: bool = False,
    need_code: bool = False,
) -> DataFrame:
    """Canonical, complete records from an explicit file, else the enriched folders, else the metadata splits.

    With need_code the enriched folders must give rows; an explicit file takes no further filters.
    """
    from sluicebed.operators import prs

    if path is not None:
        raw = read_jsonl(spark, path, RAW_PULL).withColumn("cwe_dir", F.lit(None).cast("string"))
        return prs.require_unique(prs.canonical(raw.filter("_corrupt_record is null")))

    def chosen(raw: DataFrame) -> DataFrame:
        out = prs.canonical(raw)
        out = prs.hard_split(out) if hard_only else out
        return prs.with_code(out) if need_code else out

    if enriched_root and _exists(spark, os.path.join(enriched_root, "cwe*")):
        rows = chosen(read_enriched(spark, enriched_root, cwes, include_benign))
        if not rows.isEmpty():
            return prs.require_complete(rows)
    if need_code or not metadata_root:
        raise FileNotFoundError(f"no enriched records under {enriched_root}")
    return prs.require_complete(chosen(read_metadata(spark, metadata_root, tuple(cwes or SUPPORTED_CWES), include_benign)))


def load_results(spark: SparkSession, path: str, allow_partial: bool = False) -> DataFrame:
    """Scored results without repeated keys; unless partial ones are allowed, every mode has scored the same records."""
    from sluicebed.operators.metrics import modes_aligned

    rows = repaired_results(spark, path)
    if not allow_partial:
        odd = modes_aligned(rows).limit(1).collect()
        if odd:
            raise ValueError(f"not every mode has scored {odd[0][0]}")
    return rows


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, ANALYSIS)


def read_sqlite(path: str, query: str, spark: SparkSession, schema: str) -> DataFrame:
    """Rows of a local SQLite file through the standard library, BATCH at a time; a cluster uses read_jdbc."""
    import sqlite3

    from sluicebed.plans.shared import place

    out = place(spark, "sqlite")
    with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        found = db.execute(query)
        rows = found.fetchmany(BATCH)
        while True:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(out)
            rows = found.fetchmany(BATCH)
            if not rows:
                return spark.read.schema(schema).parquet(out)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational table read in parallel over ranges of a numeric column."""
    options = {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()
