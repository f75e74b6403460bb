from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicebed.llm import pieces as P


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc .\n\r+-@é日\u0301\U0001f600", max_size=400), st.integers(4, 60), st.integers(0, 40), st.sampled_from(["diff", "files"]))
def test_pieces_cover_fit_and_overlap(text, limit, overlap, kind):
    got = P.spans(text, limit, overlap, kind)
    lap = min(overlap, limit - 1)
    assert all(0 < b - a <= limit for a, b in got)
    if text:
        assert got[0][0] == 0 and got[-1][1] == len(text)
    for (_, b), (c, _) in zip(got, got[1:], strict=False):
        assert c == b - lap
    joined = "".join(text[a if not i else got[i - 1][1] : b] for i, (a, b) in enumerate(got))
    assert joined == text


def test_natural_places():
    text = "\n\n".join("word " * 15 + "end." for _ in range(10))
    for a, b in P.spans(text, 200, 20)[:-1]:
        assert text[b - 1].isspace() or text[b : b + 1].isspace(), (a, b)
    diff = "".join(f"diff --git a/{i} b/{i}\n@@ -1 +1 @@\n" + "+x\n" * 20 for i in range(5))
    assert all(diff[b:].startswith("diff --git") for _, b in P.spans(diff, 220, 0, "diff")[:-1])


def test_only_values_above_their_limit(spark):
    rows = [(1, "d" * 10, {"a": "x" * 21, "b": "y" * 20}), (2, "e" * 11, None), (3, None, {"c": None, "d": ""}), (4, "\U0001f600" * 10, {"e": "日" * 21})]
    pulls = spark.createDataFrame(rows, "example_no long, diff string, files map<string,string>").withColumns({"value": F.lit("v"), "path": F.lit("p"), "field": F.lit(1)})
    limits = spark.createDataFrame([("diff", 10, 2), ("files", 20, 5)], "field_name string, max_chars int, overlap_chars int")
    assert {tuple(r) for r in P.cut_values(pulls, limits).collect()} == {(1, "files", "a"), (2, "diff", ""), (4, "files", "e")}
    parts = P.pieces(pulls, limits).orderBy("example_no", "field", "path", "piece_no").collect()
    assert [len(r.piece) for r in parts if r.example_no == 4] == [20, 6]
    assert P.pieces(pulls.limit(0), limits).count() == 0 and P.cut_values(pulls, limits.limit(0)).count() == 0
