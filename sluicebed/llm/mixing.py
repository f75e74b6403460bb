"""Mixing sources to target weights.

A classifier trained on rows whose source is known predicts for every row without one a posterior over the sources (soft
membership). Then every document gets a rate, the number of times it is used: rates between 0 and the cap of its source
are fitted by projected gradient steps so that the expected tokens of each source match its target. The fit has two turns:
first the documents whose source is known, then, where their rates have reached the caps and tokens are still missing, the
documents with posteriors. A source is short if the rate of its own documents has come to its cap in the first turn and
their tokens still lie below the target. All sums run over all documents; a step sends one number per source to the driver,
and a document's rate is a fold over the few gradients so far, so no step joins or rewrites the corpus.

The classifier is naive Bayes over token ids, fitted on at most TRAIN_ROWS labelled rows of each source (those with the
smallest hash of doc_id). Posteriors are rounded to steps of 1/20, so rows fall into cells of equal posterior and cap whose
tokens are summed once; rates are equal within a cell.

Cases: null and empty texts have no tokens; a source that means "not known" is missing; rows with a repeated or null doc_id
take the smallest source given for it, and all of them count; sources without a target get rate 0; a target without documents is reported as short; without any labelled row all posteriors are 0; an empty table
gives a report in which every positive target of 0 tokens is met.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebed.functions.names import plain_name
from sluicebed.llm.tokens import FOLDER, encoded
from sluicebed.plans.shared import written

TRAIN_ROWS = 400
STEPS = 60
PACE = 0.9  # share of a residual that one step takes
GRID = 20
EVIDENCE = 10  # tokens of a text that count as independent of each other


def _targets(targets: DataFrame) -> list[tuple[str, str, int, int]]:
    rows = targets.select("source", plain_name(F.col("source")).alias("name"), "weight_pct", "max_repeat").collect()
    return sorted((r[0], r[1], r[2] or 0, r[3] or 0) for r in rows if r[1])


def labelled(documents: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(doc_id, name, ids): canonical source (null where missing) and token ids of each document."""
    ids = encoded(documents, folder)
    names = documents.select("doc_id", plain_name(F.col("source")).alias("name")).groupBy("doc_id").agg(F.min("name").alias("name"))
    return ids.join(names, ids["doc_id"].eqNullSafe(names["doc_id"]), "left").select(ids["doc_id"], "name", "ids")


@dataclass(frozen=True)
class Classifier:
    """Log-probabilities of token ids by source, and of the sources themselves."""

    table: np.ndarray
    prior: np.ndarray


def fit_classifier(docs: DataFrame, names: list[str], per_source: int = TRAIN_ROWS) -> Classifier:
    """Token probabilities from at most per_source labelled rows of each source (a documented bound), shares of the sources
    from all labelled rows."""
    low = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    ranges = docs.filter(F.col("name").isin(names)).groupBy("name").agg(F.count("*").alias("n"))
    sizes = {r[0]: r[1] for r in ranges.collect()}
    share = {name: min(1.0, 1.5 * per_source / n) for name, n in sizes.items()}
    prior = np.array([sizes.get(n, 0) + 0.5 for n in names], np.float64)
    prior = np.log(prior / prior.sum()) if len(names) else prior
    if not share:
        return Classifier(np.zeros((len(names), 0), np.float32), prior)
    cut = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    near = docs.filter(F.col("name").isin(names)).filter(
        (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6) < cut[F.col("name")]
    )
    held = near.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(low)), 1, per_source).alias("l"))
    chosen = held.select(F.explode("l.doc_id").alias("doc_id"))
    tokens = near.join(chosen, "doc_id").select("name", F.explode(F.array_distinct("ids")).alias("t"))
    counts = tokens.groupBy("name", "t").count().toPandas()
    width = int(counts["t"].max()) + 1 if len(counts) else 0
    table = np.full((len(names), width), 0.5, np.float32)
    at = {n: i for i, n in enumerate(names)}
    table[counts["name"].map(at).to_numpy(int), counts["t"].to_numpy(int)] += counts["count"].to_numpy(np.float32)
    return Classifier(np.log(table / table.sum(axis=1, keepdims=True)) if width else table, prior)


def posteriors(docs: DataFrame, names: list[str], classifier: Classifier) -> DataFrame:
    """docs with `post`, an array of the membership in each of names, in steps of 1/GRID."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(classifier)

    @F.pandas_udf("array<double>")
    def soft(ids: pd.Series) -> pd.Series:
        t, prior = model.value.table, model.value.prior
        out = []
        for x in ids:
            x = np.unique(np.asarray(x, np.int64)) if x is not None else np.array([], np.int64)
            x = x[x < t.shape[1]]
            if not t.size or not len(x):
                out.append([0.0] * t.shape[0])
                continue
            s = prior + t[:, x].mean(axis=1) * min(len(x), EVIDENCE)
            p = np.exp(s - s.max())
            out.append((np.round(p / p.sum() * GRID) / GRID).tolist())
        return pd.Series(out)

    hard = F.array(*[F.when(F.col("name") == n, 1.0).otherwise(0.0) for n in names])
    return docs.select(
        "doc_id", "name", F.size("ids").cast("long").alias("tokens"), F.when(F.col("name").isNotNull(), hard).otherwise(soft("ids")).alias("post")
    )


def _rate(gradients: list[list[float]], cap) -> F.Column:
    """The rate after these steps: each moves against the gradient and is clipped to [0, cap]."""
    if not gradients:
        return F.lit(0.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in gradients])

    def step(rate, g):
        move = F.aggregate(F.zip_with(F.col("post"), g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), F.least(cap, rate - move))

    return F.aggregate(steps, F.lit(0.0), step)


def _expected(cells: DataFrame, rate: F.Column, n: int) -> list[float]:
    """Expected tokens of each source at this rate."""
    sums = [F.coalesce(F.sum(F.col("tokens") * F.col("post")[i] * F.col("rate")), F.lit(0.0)) for i in range(n)]
    return list(cells.withColumn("rate", rate).agg(*sums).first())


def _descend(cells: DataFrame, cap: F.Column, wanted: list[float], steps: int, still: float) -> tuple[list[list[float]], list[float]]:
    """Projected gradient steps over these cells: the gradients and the tokens reached.

    A step divides each residual by the tokens that can still answer it, so the sums are reached in a few steps; it ends
    when no sum moves by more than this share of all wanted tokens.
    """
    n = len(wanted)
    mass = cells.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("post")[i] * F.col("post")[i]), F.lit(0.0)) for i in range(n)]).first()
    gradients: list[list[float]] = []
    reached = [0.0] * n
    for _ in range(steps):
        left = [w - r for w, r in zip(wanted, reached, strict=True)]
        gradients.append([-PACE * x / m if m else 0.0 for x, m in zip(left, mass, strict=True)])
        got = _expected(cells, _rate(gradients, cap), n)
        moved = max(abs(a - b) for a, b in zip(got, reached, strict=True))
        reached = got
        if moved <= still * max(1.0, sum(wanted)):
            break
    return gradients, reached


def fit_rates(docs: DataFrame, goal: list[tuple[str, str, int, int]], steps: int = STEPS) -> tuple[DataFrame, F.Column, dict]:
    """docs(doc_id, name, tokens, post) -> (cells, rate column, summary) of the fitted mix; see the head for its two turns."""
    caps = F.array(*[F.when(F.col("post")[i] > 0, F.lit(float(g[3]))).otherwise(F.lit(float("inf"))) for i, g in enumerate(goal)])
    least = F.array_min(caps)
    cap = F.when(least == float("inf"), 0.0).otherwise(least)
    targeted = F.col("name").isin([g[1] for g in goal])
    cells = written(
        docs.groupBy("post", F.when(targeted, F.col("name")).alias("name"), F.col("name").isNotNull().alias("known"))
        .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    )
    own = cells.filter("known").groupBy("name").agg(F.sum("tokens").alias("tokens")).collect()  # one row per target, one for the rest
    own_tokens = {r[0]: r[1] or 0 for r in own}
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    wanted = [total * g[2] / 100 for g in goal]
    if not goal:
        return cells, F.lit(0.0), {"own": own_tokens, "total": total, "own_reached": [], "soft_reached": [], "wanted": [], "capped": []}
    known, soft = cells.filter("known"), cells.filter("not known")
    first, own_reached = _descend(known, cap, wanted, steps, 1e-12)
    at_cap = known.filter("name is not null").select("name", ((_rate(first, cap) >= cap * (1 - 1e-9)) | (F.col("tokens") == 0)).alias("at")).groupBy("name").agg(F.min("at").alias("at")).collect()
    capped = {r[0]: r[1] for r in at_cap}
    second, soft_reached = _descend(soft, cap, [max(0.0, w - r) for w, r in zip(wanted, own_reached, strict=True)], steps, 1e-4)
    rate = F.when(F.col("name").isNotNull(), _rate(first, cap)).otherwise(_rate(second, cap))
    summary = {"own": own_tokens, "total": total, "own_reached": own_reached, "soft_reached": soft_reached, "wanted": wanted, "capped": [capped.get(g[1], True) for g in goal]}
    return cells, rate, summary


def prepared(documents: DataFrame, targets: DataFrame, folder: str = FOLDER) -> tuple[DataFrame, list]:
    goal = _targets(targets)
    names = [g[1] for g in goal]
    docs = written(labelled(documents, folder))
    return posteriors(docs, names, fit_classifier(docs, names)), goal


def mix(documents: DataFrame, targets: DataFrame, folder: str = FOLDER, seed: int = 42) -> DataFrame:
    """(doc_id, tokens, rate, copies): how often each document is used; copies round rates by a hash, within the cap."""
    docs, goal = prepared(documents, targets, folder)
    docs = written(docs)
    _, rate, _ = fit_rates(docs, goal)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) / 1e6
    return docs.withColumn("rate", rate).select(
        "doc_id", "tokens", "rate", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int").alias("copies")
    )


def mix_report(documents: DataFrame, targets: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(source, wanted, own_tokens, own_reached, soft_reached, share_of_size, share_of_mix, short): one row per source of targets.

    own_reached: tokens of the source's own documents at their fitted rate; soft_reached: expected tokens of documents without
    a source. share_of_size is what both reach of the mix's wanted size, share_of_mix of what all sources reach. short: the own
    documents are used as often as they may and still lie below the target; a source without documents is at its cap.
    """
    docs, goal = prepared(documents, targets, folder)
    _, _, s = fit_rates(written(docs), goal)
    mixed = sum(s["own_reached"]) + sum(s["soft_reached"]) or 1.0
    rows = []
    for i, (spelled, name, pct, most) in enumerate(goal):
        own, soft = float(s["own_reached"][i]), float(s["soft_reached"][i])
        if s["capped"][i]:  # within 1e-9 of the cap
            own = float(s["own"].get(name, 0) * most)
        missing = pct * s["total"] > 100 * own
        rows.append((spelled, s["wanted"][i], s["own"].get(name, 0), own, soft, (own + soft) / max(1, s["total"]), (own + soft) / mixed, s["capped"][i] and missing))
    return documents.sparkSession.createDataFrame(
        rows, "source string, wanted double, own_tokens long, own_reached double, soft_reached double, share_of_size double, share_of_mix double, short boolean"
    )
