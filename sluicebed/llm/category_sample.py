"""Sample matching target category proportions.

Quotas come from counts by category: seats are shared out in proportion to the target shares, each category kept between
its floor and what is there, and rounded by largest remainder; so seats that one category can't fill are handed on to the
others in proportion, and the sample has its full size where the categories hold enough records. The report names what each
category lacks and the share it reached. Members are the records with the smallest random keys. The key's cut is found from
counts by key range, so a category of any size is never sorted in one task.

Cases: null ids are no records; an id delivered several times is one record, taken from its lowest example_no; values that
mean "not known" match no category; empty tables give an empty sample and full shortfalls; equal keys are told apart by id.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sluicebed.functions.names import cwe_codes, plain_name
from sluicebed.plans.shared import written

RANGE_DIGITS = 4  # leading digits of a key that name its range: 65,536 ranges a category


def records(pulls: DataFrame) -> DataFrame:
    """(id, malicious, cwe, framing): one row per distinct id."""
    first = F.struct("example_no", "malicious", "cwe_id", "framing")
    return (
        pulls.filter("id is not null")
        .groupBy("id")
        .agg(F.min(first).alias("r"))
        .select("id", "r.malicious", cwe_codes(F.col("r.cwe_id")).alias("cwe"), plain_name(F.col("r.framing")).alias("framing"))
    )


def categories(targets: DataFrame) -> DataFrame:
    return targets.select(
        "category_no",
        "malicious",
        cwe_codes(F.col("cwe_id")).alias("cwe"),
        plain_name(F.col("framing")).alias("framing"),
        F.coalesce("share_pct", F.lit(0)).alias("share_pct"),
        F.coalesce("min_rows", F.lit(0)).alias("min_rows"),
    )


def apportioned(seats: int, wanted: dict[int, tuple[int, int, int]]) -> dict[int, int]:
    """category -> (share, least, most) to seats: in proportion to the shares, between least and most, whole numbers by
    largest remainder (ties to the lowest category). The sum is seats, or as near as the bounds allow."""
    fixed: dict[int, int] = {}
    while True:
        left = seats - sum(fixed.values())
        free = {c: w for c, w in wanted.items() if c not in fixed}
        whole = sum(w[0] for w in free.values())
        over = {c: left * s - most * whole for c, (s, _, most) in free.items() if left * s > most * whole}
        under = {c: least * whole - left * s for c, (s, least, _) in free.items() if left * s < least * whole}
        if not over and not under or not whole:
            break
        if sum(over.values()) >= sum(under.values()):
            fixed |= {c: wanted[c][2] for c in over}
        else:
            fixed |= {c: wanted[c][1] for c in under}
    if not whole:
        return fixed | {c: min(w[1], w[2]) for c, w in free.items()}
    out = {c: left * w[0] // whole for c, w in free.items()}
    for c in sorted(free, key=lambda c: (-(left * free[c][0] % whole), c))[: left - sum(out.values())]:
        out[c] += 1
    return fixed | out


def quotas(size: int, wanted: list[tuple[int, int, int, int]]) -> list[dict]:
    """wanted: (category, share in percent, floor, available) -> need, quota and shortfall of each category.

    need is the share rounded up or the floor. Rounding up can't be granted to all categories of a full sample, so where
    nothing is short a quota may lie one below its need; floors are kept wherever there are records.
    """
    whole = sum(w[1] for w in wanted)
    seats = size * whole // max(100, whole, 1)
    quota = apportioned(seats, {c: (s, min(f, have), have) for c, s, f, have in wanted})
    total = sum(quota.values())
    return [
        {
            "category_no": c, "share_pct": s, "need": (need := max(f, -(-size * s // 100))), "available": have, "quota": quota[c], "short": max(0, need - have),
            "reached_pct": 100 * quota[c] / total if total else 0.0,
        }
        for c, s, f, have in wanted
    ]


def sample_report(pulls: DataFrame, targets: DataFrame, share: Fraction = Fraction(1, 5)) -> DataFrame:
    """(category_no, share_pct, need, available, quota, short, reached_pct): one row per category of targets.

    The sample size is the given share of all records, rounded down; need is the larger of min_rows and share_pct percent
    of it, rounded up. Counts are taken over all records; only one count per category reaches the driver.
    """
    spark = pulls.sparkSession
    cats = categories(targets)
    counts = records(pulls).groupBy("malicious", "cwe", "framing").count()
    counts = written(counts)
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    same = [cats[c].eqNullSafe(counts[c]) & cats[c].isNotNull() for c in ("malicious", "cwe", "framing")]
    have = (
        cats.join(counts, same[0] & same[1] & same[2], "left")
        .groupBy("category_no", "share_pct", "min_rows")
        .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
        .orderBy("category_no")
        .collect()
    )
    size = int(total * share)
    rows = quotas(size, [(r[0], r[1], r[2], r[3]) for r in have])
    return spark.createDataFrame(
        [tuple(r.values()) for r in rows],
        "category_no int, share_pct int, need long, available long, quota long, short long, reached_pct double",
    )


def category_sample(pulls: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(id, category_no): of each category the records with the smallest keys (MD5 of seed and id), as many as its quota."""
    report = sample_report(pulls, targets)
    cats = categories(targets)
    drawn = records(pulls).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id")))).withColumn(
        "part", F.substring("key", 1, RANGE_DIGITS)
    )
    member = written(
        drawn.join(F.broadcast(cats.drop("share_pct", "min_rows")), ["malicious", "cwe", "framing"])
        .join(F.broadcast(report.select("category_no", "quota")), "category_no")
        .select("id", "category_no", "quota", "key", "part")
    )
    sums = W.Window.partitionBy("category_no").orderBy("part")
    parts = (
        member.groupBy("category_no", "part")
        .count()
        .withColumn("before", F.sum("count").over(sums) - F.col("count"))
        .select("category_no", "part", "before")
    )
    placed = member.join(parts, ["category_no", "part"]).filter("before < quota")
    rank = F.row_number().over(W.Window.partitionBy("category_no", "part").orderBy("key", "id"))
    return placed.withColumn("rank", F.col("before") + rank).filter("rank <= quota").select("id", "category_no")
