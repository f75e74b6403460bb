"""Queries of the core operators over the tables of a folder: name -> callable(spark, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebed.functions.names import cwe_codes
from sluicebed.functions.schemas import RAW_PULL
from sluicebed.operators import agents, difflines, evaluate, findings, metrics, multilang, prs, pysem, review, rules, stripping
from sluicebed.plans.oracle import SQL
from sluicebed.plans.shared import place
from sluicebed.sources import sinks
from sluicebed.sources.jsonl import read_jsonl
from sluicebed.sources.tables import table
from sluicebed.streaming import evaluate as streaming

_queries = {}
MODES = ("baseline", "multi_agent", "hybrid")
PACK_BUDGET = 2000


def query(f):
    _queries[f.__name__] = f
    return f


def pulls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pull_example")


def results(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_results(table(spark, d, "eval_result"))


def analysis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "analysis_row")


def responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_response")


# metrics


@query
def metrics_overall(spark, d):
    return metrics.overall(results(spark, d))


@query
def metrics_by_dimension(spark, d):
    return metrics.by_dimension(results(spark, d))


@query
def report_metrics(spark, d):
    return metrics.by_source_and_variant(results(spark, d))


@query
def verdict_counts(spark, d):
    return metrics.verdict_counts(results(spark, d))


@query
def report_denominators(spark, d):
    return metrics.denominators(results(spark, d)).select("mode", F.array_join("sizes", ",").alias("sizes"))


@query
def review_calls(spark, d):
    """Calls of the model that the baseline review of each record takes."""
    chunked = review.chunks(prs.review_text(pulls(spark, d)), "example_no", "review_text", 4096)
    return review.reviewed(chunked, "example_no", "Begin with a verdict.", budget=4096).groupBy("example_no").agg(F.count("*").alias("n_calls"))


@query
def attack_type_pivot(spark, d):
    return metrics.ranked_attack_types(results(spark, d))


@query
def detection_rates(spark, d):
    return metrics.detection_rates(analysis(spark, d))


@query
def finding_kind_counts(spark, d):
    return metrics.kind_counts(analysis(spark, d))


@query
def extension_counts(spark, d):
    return metrics.extension_counts(analysis(spark, d))


@query
def mode_alignment(spark, d):
    return metrics.modes_aligned(results(spark, d))


@query
def label_conflicts(spark, d):
    return metrics.label_conflicts(table(spark, d, "eval_result"))


@query
def duplicate_keys(spark, d):
    return prs.duplicate_keys(table(spark, d, "eval_result"), ("id", "malicious", "mode"))


@query
def label_histogram(spark, d):
    return pulls(spark, d).groupBy("malicious").agg(F.count("*").alias("n"))


@query
def bucket_counts(spark, d):
    return pulls(spark, d).groupBy(prs.cwe_bucket(F.col("cwe_id")).alias("bucket")).agg(F.count("*").alias("n"))


@query
def result_scores(spark, d):
    rows = table(spark, d, "eval_result")
    v = review.verdict(F.coalesce("response", F.lit("")))
    right = F.when(F.col("malicious"), v.isin("COMMENT", "BLOCK")).otherwise(v == "APPROVE")
    return rows.select("result_no", v.alias("parsed"), right.alias("parsed_correct"), (v != F.col("verdict")).alias("differs"))


# records


@query
def pull_projection(spark, d):
    raw = pulls(spark, d).withColumns({"cwe_dir": F.lit("cwe0"), "axis3": F.lit(None).cast("string"), "code": F.lit(None).cast("string")})
    out = prs.canonical(raw)
    return out.select(
        "id", "malicious", "attack", "cwe_id", "framing", "pr_title", "repo", "pr_number", "vuln_id", "enriched", "source", "variant", "parent_id",
        F.size("files").alias("n_files"), F.size("files_changed").alias("n_changed"),
    )


@query
def cwe_forms(spark, d):
    c = F.col("cwe_id")
    return pulls(spark, d).select(
        "example_no", prs.cwe_label(c).alias("label"), prs.cwe_plain(c).alias("plain"), prs.cwe_digits(c).alias("digits"), prs.cwe_bucket(c).alias("bucket"), cwe_codes(c).alias("codes")
    )


@query
def hard_split(spark, d):
    return prs.hard_split(pulls(spark, d)).select("example_no")


@query
def rows_with_code(spark, d):
    return prs.with_code(pulls(spark, d)).select("example_no")


@query
def missing_source(spark, d):
    return pulls(spark, d).groupBy("malicious").agg(F.count_if(F.coalesce(F.size("files"), F.lit(0)) <= 0).alias("n_missing"), F.count("*").alias("n"))


@query
def incomplete_rows(spark, d):
    return prs.incomplete(pulls(spark, d), ("pr_title", "pr_body", "diff")).select("example_no")


@query
def review_texts(spark, d):
    return prs.review_text(pulls(spark, d)).select("example_no", F.length("review_text").cast("long").alias("n_chars"), F.md5("review_text").alias("digest"))


@query
def language_gate(spark, d):
    files = pulls(spark, d).select(F.explode("files").alias("path", "source"))
    return files.groupBy(F.coalesce(prs.language(F.col("path")), F.lit("none")).alias("language")).agg(F.count("*").alias("n"))


@query
def changed_extensions(spark, d):
    return prs.changed_extensions(pulls(spark, d)).select("example_no", F.explode("changed_ext").alias("ext"))


@query
def context_overlay(spark, d):
    return prs.overlay(pulls(spark, d)).select("example_no", "path", F.length("source").cast("long").alias("n_chars"))


@query
def python_context(spark, d):
    return prs.python_context(pulls(spark, d))


@query
def repository_lookup(spark, d):
    return prs.look_up_repository(pulls(spark, d), table(spark, d, "repository"))


@query
def balanced_sample(spark, d):
    return prs.balanced_sample(pulls(spark, d), 100).select("example_no", "malicious", F.col("turn").cast("long").alias("turn"))


@query
def pending_work(spark, d):
    return prs.pending(pulls(spark, d), table(spark, d, "eval_result"), MODES)


@query
def clipped_texts(spark, d):
    return pulls(spark, d).select("example_no", rules.clip(F.col("pr_body")).alias("clipped"), rules.safe_path(F.col("id")).alias("safe_id"))


# diffs


@query
def diff_numbering(spark, d):
    return difflines.numbered(pulls(spark, d)).select("example_no", F.col("pos").cast("long").alias("pos"), "path", "op", "old_line", "new_line")


@query
def hunk_texts(spark, d):
    h = difflines.hunk_texts(pulls(spark, d))
    return h.select("example_no", "section_no", "path", "hunk_no", "n_lines", F.md5("hunk").alias("digest"))


@query
def diff_anchors(spark, d):
    return difflines.anchors(pulls(spark, d))


@query
def anchor_context(spark, d):
    return difflines.anchor_context(pulls(spark, d))


@query
def review_line_ids(spark, d):
    return difflines.review_lines(pulls(spark, d))


@query
def files_and_hunks(spark, d):
    return difflines.files_and_hunks(pulls(spark, d))


def changed(spark, d):
    """Changed lines as the rules read them: comments gone and literals blank."""
    lines = difflines.numbered(pulls(spark, d)).withColumn("line", F.coalesce("new_line", "old_line"))
    return stripping.masked_lines(lines.select("example_no", "path", "pos", "op", "line", "text"))


@query
def rule_hits(spark, d):
    return rules.rule_hits(changed(spark, d)).select("example_no", "path", F.col("pos").cast("long").alias("pos"), "op", "rule", "kind")


@query
def net_removed_guards(spark, d):
    return rules.net_removed(changed(spark, d)).select("example_no", "path", "rule", "line", "text")


@query
def first_sinks(spark, d):
    return rules.first_sinks(changed(spark, d)).select("example_no", "path", "rule", "line", "text")


@query
def csrf_deleted(spark, d):
    return rules.csrf_deleted(changed(spark, d)).select("example_no", "path", "line", "text")


@query
def bounds_weakened(spark, d):
    return rules.bounds_weakened(changed(spark, d))


def as_they_stand(spark, d):
    """Changed lines with comments and literals, for comparing the rules with an engine that can't mask."""
    return rules.changed_lines(pulls(spark, d))


@query
def raw_rule_hits(spark, d):
    return rules.rule_hits(as_they_stand(spark, d)).select("example_no", "path", F.col("pos").cast("long").alias("pos"), "op", "rule", "kind")


@query
def raw_net_removed_guards(spark, d):
    return rules.net_removed(as_they_stand(spark, d)).select("example_no", "path", "rule", "line", "text")


@query
def raw_first_sinks(spark, d):
    return rules.first_sinks(as_they_stand(spark, d)).select("example_no", "path", "rule", "line", "text")


@query
def raw_csrf_deleted(spark, d):
    return rules.csrf_deleted(as_they_stand(spark, d)).select("example_no", "path", "line", "text")


@query
def raw_bounds_weakened(spark, d):
    return rules.bounds_weakened(as_they_stand(spark, d))


def rates_of(spark, d, lines):
    hit = rules.flagged(lines).withColumn("hit", F.lit(True))
    rows = pulls(spark, d).select("example_no", "malicious", F.coalesce(cwe_codes(F.col("cwe_id")), F.lit("None")).alias("cwe")).join(hit, "example_no", "left")
    bad, raised = F.coalesce("malicious", F.lit(False)), F.coalesce("hit", F.lit(False))
    return rows.groupBy("cwe").agg(
        F.count_if(bad).alias("malicious_n"),
        F.count_if(~bad).alias("benign_n"),
        metrics.ratio(F.count_if(bad & raised), F.count_if(bad)).alias("tpr"),
        metrics.ratio(F.count_if(~bad & raised), F.count_if(~bad)).alias("fpr"),
    )


@query
def advisory_rates(spark, d):
    """Flagship: rows whose changed lines raise a finding, as rates by weakness."""
    return rates_of(spark, d, changed(spark, d))


@query
def raw_advisory_rates(spark, d):
    return rates_of(spark, d, as_they_stand(spark, d))


@query
def diff_findings(spark, d):
    return rules.findings_of(changed(spark, d))


# program analysis


@query
def stripped_sources(spark, d):
    files = pulls(spark, d).select("example_no", F.explode("files").alias("path", "source")).filter("source is not null")
    clean = files.withColumn("c", stripping.strip_udf()(F.col("source"), F.col("path")))
    return clean.select("example_no", "path", F.length("c.text").alias("n_chars"), F.size("c.warnings").alias("n_warnings"))


@query
def multilang_scan(spark, d):
    return multilang.scan_files(prs.overlay(pulls(spark, d)))


@query
def python_semantics(spark, d):
    return pysem.analyze_pulls(pulls(spark, d)).select("example_no", "seq", "kind", "path", "line", "detail", F.to_json("witness").alias("witness"))


@query
def analysis_reports(spark, d):
    r = findings.reports(findings.analyze(pulls(spark, d)))
    return r.select("example_no", "advisory", F.size("findings").alias("n_findings"), F.size("warnings").alias("n_warnings"))


@query
def distinct_findings(spark, d):
    return findings.distinct_whole(findings.exploded(analysis(spark, d)), "id").select("id", "kind", "path", "line", "detail", F.col("seq").cast("long").alias("seq"))


@query
def distinct_finding_details(spark, d):
    return findings.distinct_detail(findings.exploded(analysis(spark, d)), "id").select("id", "kind", "path", "detail", "line")


@query
def advisory_rows(spark, d):
    return findings.advisory(findings.exploded(analysis(spark, d)), "id")


@query
def ablated_findings(spark, d):
    kept = findings.without(findings.exploded(analysis(spark, d)), ("symbolic", "taint"))
    return kept.groupBy("kind").agg(F.count("*").alias("n"))


@query
def top_advisory_findings(spark, d):
    top = findings.top_advisory(findings.exploded(analysis(spark, d)), "id", 20)
    return top.select("id", F.col("rank").cast("long").alias("rank"), "kind", "path", "line")


# reviews


@query
def parsed_verdicts(spark, d):
    return review.parsed(responses(spark, d))


@query
def chunk_verdicts(spark, d):
    return review.combined(review.parsed(responses(spark, d)))


def visible_lines(spark, d):
    rows = pulls(spark, d)
    first = rows.groupBy("id").agg(F.min("example_no").alias("example_no"))
    asked = first.join(responses(spark, d).select(F.col("pr_id").alias("id")).distinct(), "id", "left_semi")
    lines = difflines.review_lines(rows.join(asked.select("example_no"), "example_no", "left_semi"))
    return lines.join(asked, "example_no").select(F.col("id").alias("pr_id"), "line_id", "path", "line", "quote")


@query
def grounded_reviews(spark, d):
    g = review.grounded(review.parsed(responses(spark, d)), visible_lines(spark, d))
    return g.select("pr_id", "chunk_no", "auditor_verdict", "line_id", "path", "line", "grounded")


@query
def aggregated_verdicts(spark, d):
    g = review.grounded(review.parsed(responses(spark, d)), visible_lines(spark, d))
    adv = analysis(spark, d).groupBy(F.col("id").alias("pr_id")).agg(F.max("advisory").alias("advisory"))
    return review.aggregated(g, adv)


@query
def injection_flags(spark, d):
    f = review.injection_flags(responses(spark, d))
    return f.select("pr_id", "detected", "valid", F.md5("note").alias("digest"))


@query
def verdict_tally(spark, d):
    return review.verdict_tally(review.parsed(responses(spark, d)))


@query
def top_reviews(spark, d):
    g = review.grounded(review.parsed(responses(spark, d)), visible_lines(spark, d))
    return review.top_reviews(g).select("pr_id", "chunk_no", "auditor_verdict", F.col("rank").cast("long").alias("rank"))


@query
def packed_chunks(spark, d):
    lines = F.transform(F.split("diff", "\n"), lambda x: F.concat(x, F.lit("\n")))
    return pulls(spark, d).filter("diff is not null and diff != ''").select("example_no", review.packed_sizes(lines, PACK_BUDGET).cast("long").alias("n_chunks"))


@query
def review_chunks(spark, d):
    c = review.chunks(prs.review_text(pulls(spark, d)), "example_no", "review_text", 4096)
    return c.groupBy("example_no").agg(F.sum(F.length("chunk")).alias("n_chars"))


@query
def baseline_reviews(spark, d):
    answers = evaluate.baseline(pulls(spark, d), 4096)
    return review.scored(pulls(spark, d), answers).select("example_no", "verdict", "correct")


@query
def multi_agent_reviews(spark, d):
    rows = pulls(spark, d)
    return agents.multi_agent(rows, agents.bundle(rows, 4096, review.fake_model)[2])


@query
def hybrid_reviews(spark, d):
    rows = pulls(spark, d)
    steps = agents.bundle(rows, 4096, review.fake_model)
    answers = agents.hybrid(rows, steps, agents.analysis(rows), 4096, review.fake_model)
    return review.scored(rows, answers).select("example_no", "verdict", "correct")


@query
def bucket_notes(spark, d):
    return metrics.bucket_notes(pulls(spark, d), prs.cwe_bucket(F.split_part("id", F.lit(":"), F.lit(1))))


# sources, sinks, streams


@query
def jsonl_round_trip(spark, d):
    path = place(spark, "jsonl")
    kept = pulls(spark, d).drop("example_no", "loaded_at")
    sinks.write_once(kept, path)
    back = read_jsonl(spark, path, RAW_PULL)
    return back.groupBy(F.coalesce("variant", F.lit("None")).alias("variant")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.size("files"), F.lit(0))).alias("n_files"), F.sum(F.length("diff")).alias("n_chars")
    )


@query
def csv_report(spark, d):
    path = place(spark, "csv")
    sinks.write_csv(metrics.attack_types(results(spark, d)), path)
    back = spark.read.schema("attack_type string, baseline_malicious_n long, baseline_approved long, baseline_asr double, hybrid_malicious_n long, hybrid_approved long, hybrid_asr double").option("header", True).csv(path)
    return back.select("attack_type", "baseline_malicious_n", "hybrid_malicious_n", "hybrid_asr")


def result_stream(spark, d):
    """eval_result as a stream of its files; a single file is named by a pattern, as streams read folders and patterns only."""
    path = f"{d}/eval_result.parquet"
    place_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = place_.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place_).isDirectory()
    return spark.readStream.schema(table(spark, d, "eval_result").schema).option("pathGlobFilter", "*.parquet").parquet(path if folder else f"{path[:-1]}[t]")


@query
def streamed_keys(spark, d):
    rows = streaming.unique_stream(result_stream(spark, d), late="7 days")
    return streaming.drained(rows.select("id", "malicious", "mode"))


@query
def streamed_daily(spark, d):
    rows = streaming.rescored(result_stream(spark, d))
    got = streaming.drained(streaming.hourly(rows, late="7 days"), "complete")
    return got.select(F.col("window.start").alias("day"), "mode", "verdict", "n")


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _queries}
