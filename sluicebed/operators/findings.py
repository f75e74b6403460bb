"""Findings of several analyses together: union, deduplication, ablation and the advisory verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sluicebed.functions.schemas import ADVISORY_KINDS
from sluicebed.operators import multilang, pysem, rules
from sluicebed.operators.difflines import numbered
from sluicebed.operators.prs import overlay
from sluicebed.operators.stripping import masked_lines


def exploded(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, seq, kind, path, line, detail) of analysis rows with a findings array."""
    return rows.select(key, F.posexplode("findings").alias("seq", "f")).select(key, "seq", "f.kind", "f.path", "f.line", "f.detail")


def distinct_whole(found: DataFrame, key: str) -> DataFrame:
    """Findings that agree in every column count once, at their first place."""
    return found.groupBy(key, "kind", "path", "line", "detail").agg(F.min("seq").alias("seq"))


def distinct_detail(found: DataFrame, key: str) -> DataFrame:
    """Findings that agree in kind, path and detail count once; the first one's line stays."""
    return found.groupBy(key, "kind", "path", "detail").agg(F.min(F.struct("seq", "line")).alias("f")).select(key, "kind", "path", "detail", "f.seq", "f.line")


def advisory(found: DataFrame, key: str) -> DataFrame:
    """(key, n_findings, n_advisory, advisory)."""
    hit = F.col("kind").isin(*ADVISORY_KINDS)
    return found.groupBy(key).agg(F.count("*").alias("n_findings"), F.count_if(hit).alias("n_advisory"), F.max(hit).alias("advisory"))


def without(found: DataFrame, disabled: tuple[str, ...]) -> DataFrame:
    """Ablation: findings of disabled kinds are left out."""
    return found.filter(~F.col("kind").isin(*disabled)) if disabled else found


def top_advisory(found: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The first k advisory findings of each key in arrival order."""
    order = W.Window.partitionBy(key).orderBy("seq", "path", "kind", "detail")
    return found.filter(F.col("kind").isin(*ADVISORY_KINDS)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def analyze(pulls: DataFrame, disabled: tuple[str, ...] = (), changed_only: bool = False, masked: bool = True) -> DataFrame:
    """(example_no, layer, seq, kind, path, line, detail): Python, multilingual and diff findings and warnings of each row.

    The label of a record is never read. Disabled names are finding kinds, or "diff" for the whole scan of the diff.
    """
    off = frozenset(disabled)
    cols = ["example_no", "layer", "seq", "kind", "path", "line", "detail"]
    python = pysem.analyze_pulls(pulls, off, changed_only).withColumn("layer", F.lit("python"))
    other = multilang.scan_files(overlay(pulls, changed_only), off).withColumn("layer", F.lit("multilang"))
    whole = python.select(*cols).unionByName(other.select(*cols))
    if "diff" not in off:
        lines = numbered(pulls).withColumn("line", F.coalesce("new_line", "old_line"))
        lines = masked_lines(lines) if masked else lines.filter("op in ('+', '-')")
        whole = whole.unionByName(rules.findings_of(lines.select("example_no", "path", "pos", "op", "line", "text")).withColumn("layer", F.lit("diff")).select(*cols))
    return whole.filter(~F.col("kind").isin(*off) | (F.col("layer") == "diff")) if off else whole


def reports(found: DataFrame) -> DataFrame:
    """(example_no, advisory, findings, warnings): findings gathered by row; a row's findings are bounded by its sources."""
    is_note = F.col("kind") == "warning"
    item = F.struct("layer", "seq", "kind", "path", "line", "detail")
    return found.groupBy("example_no").agg(
        F.max(~is_note & F.col("kind").isin(*ADVISORY_KINDS)).alias("advisory"),
        F.array_sort(F.collect_list(F.when(~is_note, item))).alias("findings"),
        F.array_sort(F.collect_set(F.when(is_note, F.col("detail")))).alias("warnings"),
    )
