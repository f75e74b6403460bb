"""Splits that keep related records together.

Records are tied by keys that they share. Groups come from a distributed union-find: every task joins the rows it reads
into a local forest over rows and keys, and only one link per key and forest leaves the task. Those links are merged in
levels: each level builds local forests over fewer, larger shares of the remaining links, points every node to the
smallest root it has in any forest, and hands on only links between roots. No level gathers a component in one task:
a task holds at most LINKS_PER_TASK links, and levels go on until no link is left.

Cases: null keys tie nothing; rows without any key form a group of their own; repeated row numbers fall into one group;
an empty table gives an empty result; further columns are ignored unless named in `carry`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from sluicebed.functions.names import plain_name, repo_name
from sluicebed.plans.shared import written

ROWS_PER_FOREST = 200_000
LINKS_PER_TASK = 500_000


def _find(parent: dict, x):
    root = x
    while (up := parent[root]) != root:
        root = up
    while (up := parent[x]) != root:
        parent[x], x = root, up
    return root


def _row_forests(n_keys: int, carry: int, rows_per_forest: int):
    """Rows (row, key1..keyN, carried...) to forest rows: (row, null, root, carried) and (null, key, root, nulls)."""

    def flush(rows, keys, parent):
        lists = list(zip(*rows, strict=True))
        roots = [_find(parent, r) for r in lists[0]]
        nothing = [None] * len(keys)
        yield pd.DataFrame(
            {
                "row": pd.array([*lists[0], *nothing], dtype="Int64"),
                "key": [*[None] * len(rows), *keys],
                "root": [*roots, *(_find(parent, r) for r in keys.values())],
                **{f"c{i}": [*lists[1 + i], *nothing] for i in range(carry)},
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}
        keys: dict[str, int] = {}
        rows: list[tuple] = []
        for pdf in batches:
            names = list(pdf.columns)
            for rec in zip(*(pdf[c].tolist() for c in names), strict=True):
                row = rec[0]
                parent.setdefault(row, row)
                for k in rec[1 : 1 + n_keys]:
                    if k is None:
                        continue
                    other = keys.setdefault(k, row)
                    if other != row:
                        a, b = _find(parent, row), _find(parent, other)
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                rows.append((row, *rec[1 + n_keys :]))
            if len(rows) >= rows_per_forest:
                yield from flush(rows, keys, parent)
                parent, keys, rows = {}, {}, []
        if rows:
            yield from flush(rows, keys, parent)

    return run


def _link_forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) of one task to (node, root) of its local forest."""
    parent: dict[int, int] = {}
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            ra, rb = _find(parent, a) if a in parent else parent.setdefault(a, a), _find(parent, b) if b in parent else parent.setdefault(b, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    if parent:
        nodes = list(parent)
        yield pd.DataFrame({"node": nodes, "root": [_find(parent, x) for x in nodes]})


def _root_labels(links: DataFrame, links_per_task: int) -> DataFrame:
    """(node, label) for every node of links(a, b): label is the smallest node of its component."""
    levels: list[DataFrame] = []
    tasks = None
    while n := links.count():
        least = max(1, -(-n // links_per_task))
        tasks = max(least, tasks // 2) if tasks else max(least, min(64, n // 50_000))
        forests = links.repartition(tasks).mapInPandas(_link_forests, "node long, root long")
        level = written(forests.groupBy("node").agg(F.min("root").alias("lead"), F.collect_set("root").alias("roots")))
        levels.append(level.select("node", "lead"))
        links = (
            level.filter(F.size("roots") > 1)
            .select(F.explode("roots").alias("a"), F.col("lead").alias("b"))
            .filter("a != b")
            .distinct()
        )
        if tasks > 1:
            links = written(links)
    labels = None
    for level in reversed(levels):
        if labels is None:
            labels = level.select("node", F.col("lead").alias("label"))
        else:
            up = labels.select(F.col("node").alias("lead"), "label")
            labels = level.join(up, "lead", "left").select("node", F.coalesce("label", "lead").alias("label"))
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def linked_groups(
    df: DataFrame,
    row: str,
    keys: list[Column],
    carry: list[Column] | None = None,
    rows_per_forest: int = ROWS_PER_FOREST,
    links_per_task: int = LINKS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """Groups of rows that share a key, directly or through others.

    df: one record per row; row: its bigint column of row numbers; keys: string columns, null where missing (rows whose
    keys are equal strings are tied, so keys of different kinds need different prefixes); carry: string columns kept.
    Gives members(row, root, c0, c1...) and roots(root, group_no), group_no being the smallest row number of the group.
    """
    carry = carry or []
    n, c = len(keys), len(carry)
    out = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("key", T.StringType()), T.StructField("root", T.LongType())]
        + [T.StructField(f"c{i}", T.StringType()) for i in range(c)]
    )
    chosen = df.filter(F.col(row).isNotNull()).select(
        F.col(row).cast("long").alias("row"),
        *(k.alias(f"k{i}") for i, k in enumerate(keys)),
        *(k.cast("string").alias(f"c{i}") for i, k in enumerate(carry)),
    )
    forests = written(chosen.mapInPandas(_row_forests(n, c, rows_per_forest), out))
    members = forests.filter("row is not null").drop("key")
    by_key = forests.filter("key is not null").groupBy("key").agg(F.collect_set("root").alias("roots"))
    links = written(
        by_key.filter(F.size("roots") > 1)
        .select(F.explode("roots").alias("a"), F.array_min("roots").alias("b"))
        .filter("a != b")
        .distinct()
    )
    labels = _root_labels(links, links_per_task)
    roots = (
        members.select("root")
        .distinct()
        .join(labels.withColumnRenamed("node", "root"), "root", "left")
        .select("root", F.coalesce("label", "root").alias("group_no"))
    )
    return members, roots


def pull_keys() -> list[Column]:
    """Keys of a pull_example row; an id and a parent_id that are equal are one key."""
    exact = lambda name: F.when(F.trim(F.col(name)) != "", F.concat(F.lit("i:"), F.col(name)))
    return [
        exact("id"),
        exact("parent_id"),
        F.concat(F.lit("r:"), repo_name(F.col("repo"))),
        F.concat(F.lit("v:"), plain_name(F.col("vuln_id"))),
    ]


def mixed_groups(pulls: DataFrame) -> DataFrame:
    """(example_no, group_no) of groups of two or more rows, without groups that lie wholly in one repository."""
    members, roots = linked_groups(pulls, "example_no", pull_keys(), [repo_name(F.col("repo"))])
    per_root = members.groupBy("root").agg(
        F.count("*").alias("n"), F.count("c0").alias("named"), F.min("c0").alias("lo"), F.max("c0").alias("hi")
    )
    placed = per_root.join(roots, "root")
    mixed = (
        placed.groupBy("group_no")
        .agg(F.sum("n").alias("n"), F.sum("named").alias("named"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .filter("n > 1 and (named < n or lo != hi)")
        .select("group_no")
    )
    kept = roots.join(mixed, "group_no")
    return members.join(kept, "root").select(F.col("row").alias("example_no"), "group_no")


def place_sizes(sizes: list[tuple[int, int]], shares: list[float]) -> dict[int, list[int]]:
    """Greedy largest-first placing of groups: size -> how many groups of that size go to each split.

    sizes: (size, number of groups); every group goes to the split whose rows are furthest below its target, ties to the
    first. The choices made for `count` equal groups are the `count` largest of gap_i - j * size over all i and j, so a
    long run of them is placed by a threshold and only the last few one by one.
    """
    total = sum(s * c for s, c in sizes)
    whole = sum(shares) or 1.0
    gap = [total * x / whole for x in shares]
    out = {}
    for size, count in sorted(sizes, reverse=True):
        got = [0] * len(shares)
        if count > 2 * len(shares):
            above = lambda t: [max(0, math.ceil((g - t) / size)) for g in gap]  # noqa: E731, B023
            low, high = min(gap) - (count + 1) * size, max(gap)
            for _ in range(80):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(above(mid)) > count else (low, mid)
            got = above(high)
            gap = [g - k * size for g, k in zip(gap, got, strict=True)]
        for _ in range(count - sum(got)):
            i = max(range(len(gap)), key=lambda i: (gap[i], -i))
            got[i] += 1
            gap[i] -= size
        out[size] = got
    return out


def related_splits(pulls: DataFrame, targets: DataFrame) -> DataFrame:
    """(example_no, group_no, split_name) for every row of pulls, near the shares of targets(split_name, share).

    Only the histogram of group sizes reaches the driver (its length is at most the root of twice the number of rows).
    Ranks within one size come from counts by hash bucket, so equal sizes, which may hold most groups, stay spread.
    """
    members, roots = linked_groups(pulls, "example_no", pull_keys())
    sizes = written(
        members.groupBy("root")
        .agg(F.count("*").alias("n"))
        .join(roots, "root")
        .groupBy("group_no")
        .agg(F.sum("n").alias("size"))
        .withColumn("bucket", F.pmod(F.xxhash64("group_no"), F.lit(4096)).cast("int"))
    )
    goal = [(r[0], r[1]) for r in targets.select("split_name", "share").orderBy(F.desc("share"), "split_name").collect()]
    hist = [(r[0], r[1]) for r in sizes.groupBy("size").count().collect()]
    placed = place_sizes(hist, [s for _, s in goal])
    spark = pulls.sparkSession
    cuts = []
    for size, got in placed.items():
        low = 0
        for (name, _), k in zip(goal, got, strict=True):
            if k:
                cuts.append((size, low, low + k, name))
            low += k
    cut = spark.createDataFrame(cuts, "size long, low long, high long, split_name string")
    before = W.Window.partitionBy("size").orderBy("bucket")
    offsets = (
        sizes.groupBy("size", "bucket")
        .count()
        .withColumn("offset", F.sum("count").over(before) - F.col("count"))
        .drop("count")
    )
    ranked = sizes.join(offsets, ["size", "bucket"]).withColumn(
        "rank", F.col("offset") + F.row_number().over(W.Window.partitionBy("size", "bucket").orderBy("group_no")) - 1
    )
    chosen = ranked.join(cut, "size").filter("rank >= low and rank < high").select("group_no", "split_name")
    return (
        members.join(roots.join(chosen, "group_no"), "root")
        .select(F.col("row").alias("example_no"), "group_no", "split_name")
    )


def split_report(splits: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows, groups and share of each split against its target."""
    got = splits.groupBy("split_name").agg(F.count("*").alias("n_rows"), F.countDistinct("group_no").alias("n_groups"))
    total = got.agg(F.sum("n_rows").alias("total"))
    return (
        targets.join(got, "split_name", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select(
            "split_name",
            F.col("share").alias("wanted"),
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
            (F.coalesce("n_rows", F.lit(0)) / F.col("total")).alias("reached"),
        )
    )


def checked_splits(splits: DataFrame, pulls: DataFrame) -> DataFrame:
    """(repo, n_rows, n_splits): rows and splits of each repository; n_splits is 1 where none was parted."""
    named = pulls.select("example_no", repo_name(F.col("repo")).alias("repo")).filter("repo is not null")
    return named.join(splits, "example_no").groupBy("repo").agg(F.count("*").alias("n_rows"), F.count_distinct("split_name").alias("n_splits"))
