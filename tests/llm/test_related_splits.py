import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicebed.llm import related_splits as R

SCHEMA = "example_no long, id string, repo string, vuln_id string, parent_id string"


def brute(rows):
    """Groups by a plain union-find over exact keys."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for no, *keys in rows:
        for k in keys:
            if k is not None:
                a, b = find(("n", no)), find(k)
                if a != b:
                    up[a] = b
        find(("n", no))
    groups = {}
    for no, *_ in rows:
        groups.setdefault(find(("n", no)), []).append(no)
    return {n: min(g) for g in groups.values() for n in g}


@pytest.mark.parametrize(("rows_per_forest", "links_per_task"), [(3, 4), (50, 10), (10_000, 1_000_000)])
def test_levels_equal_one_forest(spark, rows_per_forest, links_per_task):
    rng = random.Random(5)
    rows = [(i, f"a{rng.randrange(250)}", f"b{rng.randrange(300)}" if rng.random() < 0.8 else None) for i in range(1, 301)]
    rows += [(1000 + i, "hot", None) for i in range(200)]  # one key holds two fifths of all rows
    df = spark.createDataFrame(rows, "n long, a string, b string").repartition(7)
    members, roots = R.linked_groups(df, "n", [F.concat(F.lit("a"), "a"), F.concat(F.lit("b"), "b")], None, rows_per_forest, links_per_task)
    got = {r[0]: r[1] for r in members.join(roots, "root").select("row", "group_no").collect()}
    assert got == brute([(n, a and "a" + a, b and "b" + b) for n, a, b in rows])


def test_ties_by_definition(spark):
    rows = [
        (1, "x", "O/a", None, None), (2, "x", "o/b", None, None),  # same id, two repositories
        (3, "p", "o/c", "V-1", None), (4, "q", "https://h.x/O/C.git", "v_2", None),  # one repository only: no case
        (5, "r", None, "S-9", None), (6, "s", None, "s9", None),  # same vulnerability, no repository
        (7, "t", "n/a", "unknown", "gone"), (8, "u", "o/z", "none", "gone"),  # a parent that was never delivered
        (9, "child", "o/y", None, "par"), (10, "par", "o/w", None, None),  # parent and child
        (11, None, None, None, None), (12, "", " ", "", ""), (13, "alone", "o/alone", None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"root": F.lit(1), "key": F.lit("k"), "row": F.lit(2)})
    assert {(r.example_no, r.group_no) for r in R.mixed_groups(df).collect()} == {(1, 1), (2, 1), (5, 5), (6, 5), (7, 7), (8, 7), (9, 9), (10, 9)}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, share double")
    assert R.mixed_groups(empty).count() == 0 and R.related_splits(empty, targets).count() == 0


def test_splits_keep_groups_and_shares(spark, data):
    pulls, targets = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("pull_example", "split_target"))
    got = R.related_splits(pulls, targets)
    assert got.count() == pulls.count() == got.select("example_no").distinct().count()
    assert got.groupBy("group_no").agg(F.count_distinct("split_name").alias("k")).filter("k > 1").count() == 0
    for r in R.split_report(got, targets).collect():
        assert abs(r.reached - r.wanted) < 0.15


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 40)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.lists(st.floats(0.05, 1), min_size=1, max_size=4))
def test_bulk_placing_equals_one_by_one(sizes, shares):
    total, whole = sum(s * c for s, c in sizes), sum(shares)
    gap = [total * x / whole for x in shares]
    want = {}
    for size, count in sorted(sizes, reverse=True):
        got = [0] * len(shares)
        for _ in range(count):
            i = max(range(len(gap)), key=lambda i: (gap[i], -i))
            got[i] += 1
            gap[i] -= size
        want[size] = got
    have = R.place_sizes(sizes, shares)
    for size, _ in sizes:  # equal gaps may be served in another order
        assert sum(have[size]) == sum(want[size]) and max(abs(a - b) for a, b in zip(have[size], want[size], strict=True)) <= 1
