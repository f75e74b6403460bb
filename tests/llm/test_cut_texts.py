import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebed.llm import cut_texts as C

SCHEMA = "doc_id long, text string, lang string, doc_kind string, source string"


def corpus(n=400):
    rng = random.Random(3)
    who, does = ["The worker", "The parser", "Each retry", "This guard", "Our loader"], ["reads", "drops", "checks", "copies", "keeps"]
    what, when = ["all pending rows", "the shared buffer", "a missing bound", "the last result"], ["", " if the flag is off", " before the lock is released", " because older clients rely on it"]
    say = lambda: f"{rng.choice(who)} {rng.choice(does)} {rng.choice(what)}{rng.choice(when)}."
    out = []
    for i in range(n):
        t = "\n\n".join(" ".join(say() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4)))
        t += rng.choice(["", "", "\n\n- read the row\n- scan the path in tests", "\n\nThanks", "\n\nCloses #" + str(rng.randrange(999)), "\n\n| a | b |\n|---|---|\n| x | 3 |"])
        out.append((i, t))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "note", "s") for i, t in rows], SCHEMA).withColumns({"key": F.lit("k"), "tag": F.lit(1), "contexts": F.lit(2), "n": F.lit(3), "e": F.lit(4)})
    return {r[0] for r in C.cut_texts(df).collect()}


def test_cut_and_whole(spark):
    rows = corpus()
    cut = {}
    for i in range(0, 400, 8):
        body = rows[i][1].split("\n\n")[0]
        at = len(body) * 2 // 3
        while not (body[at - 1].isalpha() and body[at].isalpha()):
            at -= 1
        cut[i] = body[:at]
    mixed = [(i, cut.get(i, t)) for i, t in rows]
    got = found(spark, mixed)
    assert len(got & set(cut)) >= 0.95 * len(cut) and len(got - set(cut)) <= 4


def test_marks_and_broken_ends(spark):
    rows = corpus()
    odd = [(1000, "The worker reads all…"), (1001, "The parser drops the [truncated]"), (1002, "Each retry keeps a… (continued)"), (1003, "The guard &quo"), (1004, "This guard copies �"), (1005, "See:\n```\nx = 1\ny = lo"), (1006, "See:\n```\nx = 1\n```"),
           (1007, "LGTM"), (1008, "+1"), (1009, ""), (1010, None), (1011, " \n"), (1012, "n/a"), (1013, "see above")]
    assert {i for i in found(spark, rows + odd) if i >= 1000} == {1000, 1001, 1002, 1003, 1004, 1005}


def test_copies_of_a_cut_text_stay_cut(spark):
    rows = corpus()
    copies = [(2000 + i, "The worker reads all pending rows. The parser checks the shared buf") for i in range(200)]
    got = found(spark, rows + copies)
    assert {i for i, _ in copies} <= got and len(got) <= 206


def test_counts_equal_brute_force():
    lines = ["The cat sat.", "- a b", "x" * 30, "| t | 1 |", "é日"]
    want = {}
    for line in lines:
        s = C._shown(line)
        for j in range(1, len(s)):
            for n in C.ORDERS:
                if j >= n:
                    want[(C.form(line), s[j - n : j])] = want.get((C.form(line), s[j - n : j]), 0) + 1
    total = 0
    for parts, kinds, skips in C._stretches(lines):
        pos, keys = C._contexts(parts, kinds)
        fresh = pos >= np.repeat(np.array(skips), [len(p) for p in parts])
        for n in C.ORDERS:
            total += int((keys[n][fresh] != 0).sum())
    assert total == sum(want.values())


@pytest.mark.parametrize("stretch", [15, 40, 10_000])
def test_long_lines_in_stretches_count_alike(monkeypatch, stretch):
    lines = ["".join(random.Random(1).choice("abc ") for _ in range(500)), "end of it", "z"]

    def counts():
        out = {}
        for parts, kinds, skips in C._stretches(lines):
            pos, keys = C._contexts(parts, kinds)
            fresh = pos >= np.repeat(np.array(skips), [len(p) for p in parts])
            for n in C.ORDERS:
                for k in keys[n][fresh].tolist():
                    if k:
                        out[k] = out.get(k, 0) + 1
        return out

    want = counts()
    monkeypatch.setattr(C, "STRETCH", stretch)
    assert counts() == want


def test_rates_and_empty(spark):
    df = spark.createDataFrame([(1, "x…", "en", "note", " A_b "), (2, "fine.", None, None, "a-B"), (3, None, "en", "note", None)], SCHEMA)
    assert {(r.source, r.n_docs, r.n_cut) for r in C.cut_rates(df).collect()} == {("ab", 2, 1), (None, 1, 0)}
    assert C.cut_texts(df.limit(0)).count() == 0 and C.cut_rates(df.limit(0)).count() == 0


def test_bitmaps_grow_with_the_contexts():
    assert C.bitmap_shape(0) == (C.BITS_LEAST, 1)
    for keys in (5_000, 10**6, 60_000_000):
        bits, ranges = C.bitmap_shape(keys)
        assert ranges == 1 and C.PER_KEY * keys <= bits < 2 * C.PER_KEY * keys + C.BITS_LEAST
    bits, ranges = C.bitmap_shape(10**9)
    assert bits == C.BITS_MOST and ranges * bits >= C.PER_KEY * 10**9


def test_ranges_of_contexts_count_alike(spark):
    """Varied texts: with small bitmaps in many ranges the counts are those of one bitmap and of brute force."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(30)) + "." for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    keys = C._end_contexts([t[: rng.randrange(5, 40)] for t in texts])
    ends = C.written(spark.createDataFrame([(int(k),) for k in set(keys.ravel().tolist()) - {0}], "key long"))
    want = {}
    for t in texts:
        for i in range(1, len(t)):
            for k in C._end_contexts([t[:i]])[0].tolist():
                want[k] = want.get(k, 0) + 1
    asked = {r[0] for r in ends.collect()}
    for most in (1 << 10, 1 << 30):
        got = {r.key: r.m for r in C.going_on(df, ends, most).collect() if r.key in asked}
        assert got == {k: n for k, n in want.items() if k in asked}
