import hashlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicebed.llm import category_sample as C

PULL = "example_no long, id string, malicious boolean, cwe_id string, framing string"
TARGET = "category_no int, malicious boolean, cwe_id string, framing string, share_pct int, min_rows int"


def frames(spark, n=100):
    rows = [(i, f"id{i}", i % 2 == 0, ["cwe79", "CWE-79", '["cwe79"]', " Cwe_79 "][i % 4], ["refactor", "REFACTOR", "re-factor"][i % 3]) for i in range(n)]
    rows += [(1000 + i, f"id{i}", i % 2 == 0, "cwe79", "refactor") for i in range(30)]  # delivered again
    rows += [(2000, None, True, "cwe79", "refactor"), (2001, "odd", None, None, "n/a"), (2002, "odd2", True, "unknown", "")]
    targets = [(1, True, "cwe79", "refactor", 60, 2), (2, False, "CWE79", "refactor", 30, 2), (3, True, "cwe22", "urgency", 10, 5)]
    return spark.createDataFrame(rows, PULL).withColumns({"key": F.lit(1), "part": F.lit(2), "quota": F.lit(3)}), spark.createDataFrame(targets, TARGET)


def test_report(spark):
    got = {r.category_no: r for r in C.sample_report(*frames(spark)).collect()}
    assert [(got[i].available, got[i].need, got[i].short) for i in (1, 2, 3)] == [(50, 12, 0), (50, 6, 0), (0, 5, 5)]  # 102 records, 20 to draw
    assert (got[1].quota, got[2].quota, got[3].quota) == (13, 7, 0)  # the seats of the third are handed on, 2 to 1
    assert abs(got[1].reached_pct - 65) < 1e-9


def test_sample_is_the_smallest_keys(spark):
    pulls, targets = frames(spark)
    got = C.category_sample(pulls, targets).collect()
    quota = {r.category_no: r.quota for r in C.sample_report(pulls, targets).collect()}
    for c, bad in ((1, True), (2, False)):
        mine = {r.id for r in got if r.category_no == c}
        ids = C.records(pulls).filter((F.col("malicious") == bad) & (F.col("cwe") == "cwe79")).select("id").collect()
        keys = sorted((hashlib.md5(f"42:{r.id}".encode()).hexdigest(), r.id) for r in ids)
        assert mine == {i for _, i in keys[: quota[c]]}


def test_empty(spark):
    pulls, targets = frames(spark)
    none = pulls.limit(0)
    assert C.category_sample(none, targets).count() == 0
    assert {r.category_no: r.short for r in C.sample_report(none, targets).collect()} == {1: 2, 2: 2, 3: 5}
    assert C.sample_report(pulls, targets.limit(0)).count() == 0


def test_quotas_add_up():
    rows = C.quotas(10, [(1, 50, 0, 100), (2, 49, 0, 100), (3, 1, 3, 100)])
    assert sum(r["quota"] for r in rows) == 10 and rows[2]["quota"] == 3


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 400), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9), st.integers(0, 90)), max_size=9))
def test_apportionment_keeps_bounds_and_size(seats, rows):
    wanted = {i: (s, min(f, have), have) for i, (s, f, have) in enumerate(rows)}
    got = C.apportioned(seats, wanted)
    assert all(w[1] <= got[i] <= w[2] for i, w in wanted.items())
    open_ = [i for i, w in wanted.items() if w[0]]
    least, most = sum(w[1] for w in wanted.values()), sum(wanted[i][2] for i in open_) + sum(wanted[i][1] for i in wanted if i not in open_)
    assert sum(got.values()) == min(max(seats, least), most) or not open_
    # among categories off their bounds the seats per share differ by rounding only
    free = [i for i in open_ if wanted[i][1] < got[i] < wanted[i][2]]
    for i in free:
        for j in free:
            assert abs(Fraction(got[i] * wanted[j][0] - got[j] * wanted[i][0])) <= wanted[i][0] + wanted[j][0]
