"""python -m sluicebed evaluate | analyze | enrich | score | report: the jobs as spark-submit runs them."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluicebed.functions.names import cwe_codes
from sluicebed.operators import evaluate, findings, metrics, prs
from sluicebed.plans.shared import ship, written
from sluicebed.sources import sinks
from sluicebed.sources.gitrepo import enrich, look_up
from sluicebed.sources.jsonl import load_benchmark, load_results, read_analysis, read_sqlite, repaired_results


def _records(spark: SparkSession, a: argparse.Namespace):
    return prs.numbered(load_benchmark(spark, a.enriched_root, a.metadata_root, a.benchmark, a.cwe, not a.skip_benign, a.hard_split, a.need_code))


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = prs.require_complete(_records(spark, a), ("pr_title", "pr_body", "diff"))
    if a.dry_run:
        rows.groupBy("malicious").count().orderBy("malicious").show()
        return
    settings = evaluate.Settings(tuple(a.modes.split(",")), tuple(x for x in a.disable.split(",") if x), a.budget, a.limit, a.seed, a.model, a.output)
    evaluate.run(rows, repaired_results(spark, a.output) if a.resume else None, settings)
    sinks.write_summary(metrics.by_dimension(repaired_results(spark, a.output)), f"{a.output}-summary")


def run_analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _records(spark, a)
    rows = written(rows.limit(a.limit)) if a.limit else rows  # the first records, as they are read
    found = findings.reports(findings.analyze(rows, tuple(x for x in a.disable.split(",") if x), a.changed_files_only))
    out = rows.select("example_no", "id", cwe_codes(F.col("cwe_id")).alias("cwe"), "malicious").join(prs.changed_extensions(rows), "example_no").join(found, "example_no", "left")
    sinks.write_once(out.withColumn("advisory", F.coalesce("advisory", F.lit(False))).drop("example_no"), a.output, a.force)


def run_enrich(spark: SparkSession, a: argparse.Namespace) -> None:
    """Records of a metadata split with what the forge's database and git hold of their pull requests, as JSON lines."""
    rows = load_benchmark(spark, None, a.metadata_root, None, a.cwe, not a.skip_benign, a.hard_split)
    rows = written(prs.numbered(rows.limit(a.limit) if a.limit else rows))
    tables = [
        read_sqlite(a.database, "SELECT id, head_branch, base_branch, merge_base, base_repo_id, issue_id, \"index\" FROM pull_request", spark, "id long, head_branch string, base_branch string, merge_base string, base_repo_id long, issue_id long, `index` long"),
        read_sqlite(a.database, "SELECT id, owner_name, name FROM repository", spark, "id long, owner_name string, name string"),
        read_sqlite(a.database, "SELECT id, name, content FROM issue", spark, "id long, name string, content string"),
    ]
    repo = F.split("repo", "/")
    wanted = rows.select(F.col("example_no").alias("row_key"), repo[0].alias("owner"), F.try_element_at(repo, F.lit(2)).alias("name"), F.col("pr_number").cast("long").alias("number"))
    found = look_up(wanted, *tables)
    held = enrich(found, a.repositories, a.include_repository_source).join(found.select("row_key", "title", "body"), "row_key")
    out = rows.select(*[c for c in rows.columns if c not in set(held.columns)], F.col("example_no").alias("row_key")).join(held, "row_key")
    out = out.withColumns({"pr_title": F.coalesce("title", "pr_title"), "pr_body": F.coalesce("body", "pr_body")})
    sinks.write_once(out.drop("row_key", "example_no", "title", "body"), a.output, a.force)


def run_score(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = read_analysis(spark, a.input)
    if rows.isEmpty():
        print("no rows")
        return
    metrics.rate_table(rows).orderBy("place", "name").drop("place").show(100, False)
    metrics.kind_counts(rows).orderBy("cwe", "rank").show(500, False)
    metrics.extension_counts(rows).orderBy("cwe", F.desc("n")).show(500, False)


def run_report(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = load_results(spark, a.input, a.allow_partial)
    sinks.write_csv(metrics.by_source_and_variant(rows).orderBy("mode", "source", "variant"), f"{a.output}/metrics")
    sinks.write_csv(metrics.ranked_attack_types(rows).orderBy("rank").drop("rank"), f"{a.output}/attack-types")
    rows.agg(F.count("*").alias("rows"), F.sort_array(F.collect_set("mode")).alias("modes"), F.lit(not a.allow_partial).alias("complete")).coalesce(1).write.mode("overwrite").json(f"{a.output}/status")


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sluicebed")
    jobs = top.add_subparsers(dest="job", required=True)
    for name in ("evaluate", "analyze"):
        p = jobs.add_parser(name)
        for flag in ("--enriched-root", "--metadata-root", "--benchmark"):
            p.add_argument(flag)
        p.add_argument("--cwe", action="append")
        p.add_argument("--disable", default="")
        p.add_argument("--limit", type=int)
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--output", required=True)
        for flag in ("--hard-split", "--need-code", "--skip-benign", "--force", "--resume", "--dry-run", "--changed-files-only"):
            p.add_argument(flag, action="store_true")
        if name == "evaluate":
            p.add_argument("--modes", default="baseline,multi_agent,hybrid")
            p.add_argument("--budget", type=int, default=32_768)
            p.add_argument("--model", default="fake", help="fake, or module:attribute of a callable (system, user) -> answer")
    p = jobs.add_parser("enrich")
    for flag in ("--metadata-root", "--database", "--repositories", "--output"):
        p.add_argument(flag, required=True)
    p.add_argument("--cwe", action="append", required=True)
    p.add_argument("--limit", type=int)
    for flag in ("--hard-split", "--skip-benign", "--include-repository-source", "--force"):
        p.add_argument(flag, action="store_true")
    for name in ("score", "report"):
        p = jobs.add_parser(name)
        p.add_argument("input")
        p.add_argument("--output", default="report")
        p.add_argument("--allow-partial", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName(f"sluicebed-{a.job}").getOrCreate()
    ship(spark)
    {"evaluate": run_evaluate, "analyze": run_analyze, "enrich": run_enrich, "score": run_score, "report": run_report}[a.job](spark, a)


if __name__ == "__main__":
    main()
