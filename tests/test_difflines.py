import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sluicebed.operators import difflines as D

CASE = (
    "diff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -3,4 +3,5 @@ def f\n a\n-b\n+c\n+d\n e\n\\ No newline at end of file\n"
    "diff --git a/y.py b/y.py\n--- a/y.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"
)


def frame(spark, *diffs):
    return spark.createDataFrame(list(enumerate(diffs)), "example_no long, diff string")


def reference(diff):
    """Numbering by a plain loop."""
    out, path, old, new = [], None, None, None
    for raw in re.split(D.LINE_END, re.sub(rf"(?:{D.LINE_END})\Z", "", diff)) if diff else []:
        if raw.startswith("diff --git "):
            path = None
        elif raw.startswith("+++ "):
            name = re.sub("^b/", "", raw[4:].strip(" "))
            path = None if name == "/dev/null" else name
        elif path is None:
            continue
        elif raw.startswith("@@"):
            m = re.search(D.HUNK, raw)
            if m:
                old, new = int(m[1]), int(m[2])
                out.append(("@", old, new))
        else:
            op = raw[:1] if raw[:1] in ("+", "-") else " "
            out.append((op, None if op == "+" else old, None if op == "-" else new))
            old = old + 1 if old is not None and op != "+" else old
            new = new + 1 if new is not None and op != "-" else new
    return out


def numbers(spark, diff):
    rows = D.numbered(frame(spark, diff)).orderBy("pos").collect()
    return [(r.op, r.old_line, r.new_line) for r in rows]


def test_numbers(spark):
    assert numbers(spark, CASE) == reference(CASE)
    assert numbers(spark, CASE)[1:5] == [(" ", 3, 3), ("-", 4, None), ("+", None, 4), ("+", None, 5)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["diff --git a/a b/a", "--- a/a", "+++ b/a", "+++ b/b", "+++ /dev/null", "@@ -1,2 +3 @@", "@@ -9 +9,2 @@ x", "@@ bad", "+x", "-y", " z", "", "\\ No newline", "++w", "--v"]), max_size=25))
def test_numbers_equal_a_plain_loop(spark, lines):
    diff = "\n".join(lines)
    assert numbers(spark, diff) == reference(diff)


def test_nothing_from_nothing(spark):
    df = frame(spark, None, "", "no diff at all")
    for f in (D.numbered, D.hunk_texts, D.anchors):
        assert f(df).count() == 0


def test_deletion_anchor_and_context(spark):
    source = "\n".join(f"line {i}" for i in range(1, 601))
    diff = "--- a/f.py\n+++ b/f.py\n@@ -500,5 +500,4 @@\n x\n x\n x\n-gone\n x\n"
    df = spark.createDataFrame([(1, diff, {"f.py": source})], "example_no long, diff string, files map<string,string>")
    assert {r.anchor for r in D.anchors(df).collect()} == {500, 503}
    lines = {r.line for r in D.anchor_context(df).collect()}
    assert lines == set(range(495, 509)) and 10 not in lines
    ids = D.review_lines(df).collect()
    assert {r.line_id for r in ids} == {f"L{i}" for i in range(1, 15)}
    assert {r.quote for r in ids if r.line == 503} == {"line 503"}


def test_files_without_hunks_are_whole(spark):
    df = spark.createDataFrame([(1, "", {"a.py": "x\n\ny\n"})], "example_no long, diff string, files map<string,string>")
    assert [(r.line_id, r.line) for r in D.review_lines(df).orderBy("line").collect()] == [("L1", 1), ("L2", 3)]
    assert D.files_and_hunks(df).first().full


def test_suspicious_files_first(spark):
    df = spark.createDataFrame([(1, "", {"a.py": "x", "b.py": "y"})], "example_no long, diff string, files map<string,string>")
    marks = spark.createDataFrame([(1, "b.py")], "example_no long, path string")
    assert [(r.line_id, r.path) for r in D.review_lines(df, marks).orderBy("line_id").collect()] == [("L1", "b.py"), ("L2", "a.py")]
