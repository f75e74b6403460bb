"""Resumable evaluation: pending work, review, append, metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebed.operators import agents, findings, review
from sluicebed.operators.prs import balanced_sample, pending, review_text
from sluicebed.plans.shared import written
from sluicebed.sources.sinks import append_results, check_output, guard_run

MODES = ("baseline", "multi_agent", "hybrid", "analysis_only")
ABLATIONS = ("scanner", "injection", "stripping", "grounding", "taint", "symbolic", "cross_file", "diff")


@dataclass(frozen=True)
class Settings:
    """What a run depends on; checked when made."""

    modes: tuple[str, ...] = ("baseline",)
    disabled: tuple[str, ...] = ()
    budget: int = 4096
    limit: int | None = None
    seed: int = 42
    model: str = "fake"
    output: str = "results"

    def __post_init__(self):
        for name, chosen, known in (("modes", self.modes, MODES), ("disabled", self.disabled, ABLATIONS)):
            if extra := sorted(set(chosen) - set(known)):
                raise ValueError(f"unknown {name}: {', '.join(extra)}")
            if len(set(chosen)) < len(chosen):
                raise ValueError(f"{name} repeat")
        if self.budget < 512:
            raise ValueError("budget must be 512 or more")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be 1 or more")
        check_output(self.output)


def baseline(pulls: DataFrame, budget: int, model: Callable[[str, str], str] = review.fake_model) -> DataFrame:
    """(example_no, response): the worst verdict over chunks, then the chunks' answers in order."""
    chunked = review.chunks(review_text(pulls), "example_no", "review_text", budget, review.counter(model))
    answers = review.reviewed(chunked, "example_no", "Begin with a verdict.", model, budget)
    v = review.verdict(F.col("response"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "part_no", "response")))
    return answers.groupBy("example_no").agg(
        F.concat_ws("\n", review.worst(v), F.array_join(F.transform(parts, lambda x: x["response"]), "\n")).alias("response")
    )


def analysis_only(pulls: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """(example_no, response): COMMENT if the analysis is advisory, else UNKNOWN, and the report as JSON."""
    reports = findings.reports(findings.analyze(pulls, disabled))
    return pulls.select("example_no").join(reports, "example_no", "left").select(
        "example_no",
        F.concat_ws("\n", F.when(F.col("advisory"), "COMMENT").otherwise("UNKNOWN"), F.coalesce(F.to_json(F.struct("advisory", "findings", "warnings")), F.lit("{}"))).alias("response"),
    )


def run(pulls: DataFrame, done: DataFrame | None, settings: Settings, model: Callable[[str, str], str] | None = None) -> DataFrame:
    """Result rows of the work that `done` lacks, for all modes; appended to settings.output.

    The model is that of settings.model, unless one is given.

    Work is skipped by an anti join before anything is reviewed, so a run that was stopped goes on where it ended.
    """
    model = model or review.resolve(settings.model)
    guard_run(pulls, asdict(settings))
    first = pulls.groupBy("id", "malicious").agg(F.min("example_no").alias("example_no")).select("example_no")
    rows = pulls.join(first, "example_no")
    if settings.limit is not None:
        rows = rows.join(balanced_sample(rows, settings.limit, settings.seed).select("example_no"), "example_no", "left_semi")
    out = None
    for mode in settings.modes:
        todo = rows if done is None else rows.join(pending(rows, done, (mode,)).select("id", "malicious"), ["id", "malicious"], "left_semi")
        if mode in ("multi_agent", "hybrid"):
            steps = agents.bundle(todo, settings.budget, model, settings.disabled)
            if mode == "hybrid":
                answers = agents.hybrid(todo, steps, agents.analysis(todo, settings.disabled), settings.budget, model, settings.disabled)
            else:
                answers = agents.multi_agent(todo, steps[2], settings.disabled).withColumnRenamed("verdict", "response")
        else:
            answers = baseline(todo, settings.budget, model) if mode == "baseline" else analysis_only(todo, settings.disabled)
        part = review.scored(todo, answers).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    out = written(out)
    append_results(out, settings.output)
    return out
