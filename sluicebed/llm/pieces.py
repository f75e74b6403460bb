"""Splitting oversized items at natural boundaries.

A value above its limit is cut by a hierarchy of separators: section, paragraph, sentence or line, word, character. From
each start the piece is packed as full as the limit allows and ends at the last boundary of the highest level that leaves
it at least half full; if there is none, at the last boundary of any level; if there is none either, at the limit, but not
before a combining mark or inside a line end. The next piece starts `overlap` characters before the end of the last one.

Cases: null and empty values and values within the limit give no pieces; limits count Unicode code points; any overlap below
the limit is kept exactly, a negative one counts as 0 and one of the limit or more as the limit less one, the largest with
which a piece still brings something new.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where a new unit begins, by level, from the widest unit to the narrowest.
LEVELS = {
    "diff": (r"^diff --git ", r"^@@ ", r"(?<=\n)[ +-]?[ \t]*\n", r"(?<=\n)", r"(?<=[\s,;])(?=\S)"),
    "files": (
        r"(?<=\n\n)(?=\S)",
        r"(?<=\n)[ \t]*\r?\n",
        r"(?<=\n)|(?<=[.!?] )(?=\S)|(?<=[。！？])",
        r"(?<=\s)(?=\S)",
    ),
}
_compiled = {kind: [re.compile(p, re.M) for p in levels] for kind, levels in LEVELS.items()}


def spans(text: str, limit: int, overlap: int, kind: str = "files") -> list[tuple[int, int]]:
    """Start and end of each piece of text."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    marks: list[list[int] | None] = [None] * len(_compiled[kind])
    out, start = [], 0
    while True:
        full = start + limit
        if full >= n:
            out.append((start, n))
            return out
        end = 0
        for least in (start + max(overlap + 1, limit // 2), start + overlap + 1):
            for i, pattern in enumerate(_compiled[kind]):
                if marks[i] is None:
                    marks[i] = [m.start() for m in pattern.finditer(text)]
                at = bisect_right(marks[i], full) - 1
                if at >= 0 and marks[i][at] >= least:
                    end = marks[i][at]
                    break
            if end:
                break
        if not end:
            end = full
            while end > start + overlap + 1 and (unicodedata.combining(text[end]) or text[end - 1 : end + 1] == "\r\n"):
                end -= 1
        out.append((start, end))
        start = end - overlap


HELD = 4_000_000  # characters of pieces in one record batch
_KEY = "example_no long, field string, path string"
_CUT = pa.schema([("example_no", pa.int64()), ("field", pa.string()), ("path", pa.string())])
_PIECE = pa.schema([*_CUT, ("piece_no", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("piece", pa.string())])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str, list[tuple[int, int]]]]:
    """(key, value, spans) of each value."""
    for b in batches:
        for n, f, p, t, m, o in zip(*(b.column(c).to_pylist() for c in ("example_no", "field", "path", "value", "max_chars", "overlap_chars")), strict=True):
            yield (n, f, p), t, spans(t, m, o, f if f in _compiled else "files")


def _cut_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = []
    for key, _, got in _values(batches):
        if len(got) > 1:
            keys.append(key)
        if len(keys) == 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(_CUT.names, k, strict=True)) for k in keys], _CUT)
            keys = []
    if keys:
        yield pa.RecordBatch.from_pylist([dict(zip(_CUT.names, k, strict=True)) for k in keys], _CUT)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for key, text, got in _values(batches):
        for i, (a, b) in enumerate(got):
            rows.append((*key, i, a, b, text[a:b]))
            held += b - a
            if held >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)


def oversized(pulls: DataFrame, limits: DataFrame) -> DataFrame:
    """(example_no, field, path, value, max_chars, overlap_chars) of the values above their limit."""
    diffs = pulls.select("example_no", F.lit("diff").alias("field"), F.lit("").alias("path"), F.col("diff").alias("value"))
    files = pulls.select("example_no", F.explode("files").alias("path", "value")).select(
        "example_no", F.lit("files").alias("field"), "path", "value"
    )
    caps = {r[0]: (r[1], r[2]) for r in limits.select("field_name", "max_chars", "overlap_chars").collect()}
    parts = []
    for df, name in ((diffs, "diff"), (files, "files")):
        if name in caps and caps[name][0] is not None:
            cap, lap = caps[name][0], caps[name][1] or 0
            parts.append(
                df.filter(F.length("value") > cap).withColumns({"max_chars": F.lit(cap), "overlap_chars": F.lit(lap)})
            )
    if not parts:
        return diffs.withColumns({"max_chars": F.lit(0), "overlap_chars": F.lit(0)}).limit(0)
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def pieces(pulls: DataFrame, limits: DataFrame) -> DataFrame:
    """(example_no, field, path, piece_no, start, stop, piece): the ordered pieces of each value above its limit.

    One scan cuts and gives the pieces out as it goes, in batches of about HELD characters.
    """
    return oversized(pulls, limits).mapInArrow(_pieces, f"{_KEY}, piece_no int, start int, stop int, piece string")


def cut_values(pulls: DataFrame, limits: DataFrame) -> DataFrame:
    """(example_no, field, path): the values that came out in more than one piece."""
    return oversized(pulls, limits).mapInArrow(_cut_keys, _KEY)


def checked_pieces(pulls: DataFrame, limits: DataFrame) -> DataFrame:
    """(example_no, field, path, text, fits, laps): of each cut value the MD5 of its text put together from its pieces again,
    whether all pieces keep the limit, and whether each holds overlap_chars of the one before."""
    caps = F.create_map(*[x for r in limits.collect() for x in (F.lit(r["field_name"]), F.struct(F.lit(r["max_chars"]).alias("max"), F.lit(r["overlap_chars"]).alias("lap")))])
    cap = caps[F.col("field")]
    whole = pieces(pulls, limits).groupBy("example_no", "field", "path").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "stop", "piece"))).alias("p"))
    pairs = F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("a"), F.slice("p", 2, F.size("p") - 1).alias("b"))
    fresh = F.transform(pairs, lambda x: F.substr(x["b"]["piece"], cap["lap"] + 1))
    return whole.select(
        "example_no", "field", "path",
        F.md5(F.concat(F.col("p")[0]["piece"], F.array_join(fresh, ""))).alias("text"),
        F.forall("p", lambda x: F.length(x["piece"]) <= cap["max"]).alias("fits"),
        F.forall(pairs, lambda x: F.right(x["a"]["piece"], cap["lap"]) == F.left(x["b"]["piece"], cap["lap"])).alias("laps"),
    )
