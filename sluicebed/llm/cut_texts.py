"""Text cut off by field limits.

A character n-gram model read backward from a position tells line ends from places where a line goes on: for the last n
characters (n in ORDERS, the longest context seen SUPPORT times) it compares how often lines end there with how often they
continue. A text is cut if the log-odds of its end fall under the threshold of its language and kind of value; thresholds
are the middle of the emptiest stretch of each language's scores. Contexts are kept apart by the form of the line (prose,
list item, table row, heading, labelled line), since list items and labels end without a full stop. A mark put in place of
the rest, a broken character or entity and an unclosed code fence also show a cut.

All counts cover all rows. Contexts of the ends of texts are the only ones that are asked for, so ends are read first; a
bitmap of those contexts' hashes, 16 bits a context, is broadcast, and only what it holds is counted as going on. Where
there are more contexts than one bitmap of BITS_MOST bits takes, they are counted in ranges of hashes, each with a bitmap and
a scan of its own. Ends of texts count once for copies, so a cut text that is copied many times stays cut.

Cases: null, empty and blank texts are no cases; neither is a text of one line with fewer than REMARK_WORDS words and at most
REMARK_CHARS characters, a remark shorter than any field's limit, unless it bears a mark; copies of a cut text are cases; rows with a repeated doc_id are judged by
their own text; texts are read whole; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebed.functions.names import plain_name
from sluicebed.llm.prose import language_of_label
from sluicebed.plans.shared import join_hot, written

ORDERS = (1, 2, 4, 6, 8, 10)
SUPPORT = 20
THRESHOLD = -2.8
BITS_LEAST, BITS_MOST = 1 << 16, 1 << 30  # bits of a bitmap; the largest takes 128 MB and 67 million contexts
PER_KEY = 16
KINDS = 64  # kinds of text are told apart by a hash with so many values, so the tables of thresholds stay small
REMARK_CHARS, REMARK_WORDS = 24, 4
STRETCH = 400_000

# What is put in place of the rest, and what is left of a broken character or entity.
_MARK = re.compile(
    r"(?:\s*(?:…|\.\.\.+|[\[(<{]\s*(?:…|\.\.\.|(?:text |message |output |content )?(?:truncated|continued|cut(?: off)?|snip(?:ped)?|more|clipped|shortened|abridged|trimmed)"
    r"|gekürzt|abgeschnitten|tronqué|truncado|cortado|recortado|обрезано|сокращено|省略|截断|已截断|以下略)[^\])>}]{0,40}[\])>}]))+\s*\Z",
    re.I,
)
_BROKEN = re.compile(r"(?:�+|(?<!\S)&(?:#x?[0-9a-fA-F]*|[A-Za-z]{0,7})|&(?:#x?[0-9a-fA-F]*|[A-Za-z]{2,7})|</?[A-Za-z][^<>\n]{0,200}|\\u[0-9a-fA-F]{0,3})\s*\Z")
_BREAK = re.compile(r"\r\n|\r|\n")
_LEAD = re.compile(r"^[\s​﻿>]*")
_ITEM = re.compile(r"(?:[-*+•]|\d+[.)])\s+")
_LABEL = re.compile(r"([A-Z][\w-]{0,18}|cc|fixes|closes)(?=[: ]\s*[#@:]|: )")
_HEX = re.compile(r"\b(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{2,}\b")
_DIGITS = re.compile(r"\d+")


def form(line: str) -> str:
    """The form of a line. Text of several words after a label or a last cell is prose."""
    s = line[_LEAD.match(line).end() :]
    if s.startswith("|"):
        return "table" if len(s[s.rfind("|") + 1 :].split()) < 2 else "prose"
    m = _ITEM.match(s)
    if m:
        first = s[m.end() : m.end() + 1]
        return "task" if first.isascii() and first.islower() else "item"
    if s.startswith("#"):
        return "heading"
    m = _LABEL.match(s)
    return f"label {m[1]}" if m and len(s[m.end() :].split(None, 4)) < 4 else "prose"


def lines_of(text: str) -> tuple[list[str], bool, bool]:
    """(lines outside of code fences, whether the last of them is the text's last line, whether a fence stays open)."""
    inside, out, last = False, [], False
    for x in _BREAK.split(text.rstrip()):
        if "```" in x:
            inside ^= x.count("```") % 2 == 1
            last = False
        elif not inside and x.strip():
            out.append(x.strip())
            last = True
        else:
            last = False
    return out, last, inside


def _shown(line: str) -> str:
    """A line as the model sees it: with a mark at its beginning, numbers and hashes alike."""
    return "^" + _DIGITS.sub("0", _HEX.sub("h", line))


def _contexts(parts: list[str], kinds: list[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """For all characters of all parts: position in the part, and by order the hash of the context (0: none)."""
    lens = np.array([len(x) for x in parts])
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lens)
    pos = np.arange(len(codes)) - np.repeat(ends - lens, lens)
    kind = np.repeat(np.array(kinds, np.uint64) * np.uint64(0x9E3779B97F4A7C15), lens)
    out = {}
    h = np.zeros(len(codes), np.uint64)
    power = np.uint64(1)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) >= n:
            h[n - 1 :] += (codes[: len(codes) - n + 1] + np.uint64(1)) * power
        power = np.uint64(int(power) * 0x100000001B3 & (1 << 64) - 1)
        if n in ORDERS:
            k = (h ^ kind) + np.uint64(n * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
            k ^= k >> np.uint64(31)
            k *= np.uint64(0xBF58476D1CE4E5B9)
            k ^= k >> np.uint64(29)
            out[n] = np.where(pos >= n - 1, k | np.uint64(1), np.uint64(0)).view(np.int64)
    return pos, out


def _end_contexts(lines: list[str]) -> np.ndarray:
    """One row per line: the hashes of the contexts of its end, by order."""
    parts = [_shown(x)[-max(ORDERS) :] for x in lines]
    _, keys = _contexts(parts, [zlib.crc32(form(x).encode()) for x in lines])
    at = np.cumsum([len(x) for x in parts]) - 1
    return np.stack([keys[n][at] for n in ORDERS], axis=1)


def _stretches(lines: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Lines in stretches of about STRETCH characters: parts, kinds, and how many leading characters are counted already.

    Longer lines come in parts that overlap by a context; the last character of a line is left out, since it ends there.
    """
    parts, kinds, skips, held = [], [], [], 0
    lap = max(ORDERS) - 1
    for line in lines:
        s, kind = _shown(line)[:-1], zlib.crc32(form(line).encode())
        for start in range(0, len(s), STRETCH):
            lead = min(lap, start)
            parts.append(s[start - lead : start + STRETCH])
            kinds.append(kind)
            skips.append(lead)
            held += len(parts[-1])
            if held >= STRETCH:
                yield parts, kinds, skips
                parts, kinds, skips, held = [], [], [], 0
    if parts:
        yield parts, kinds, skips


_ENDS = "doc_id long, kind string, lang string, tag long, last boolean, sure boolean, contexts array<long>, n long"


def _read_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text (last) with the contexts of its end, and one per distinct context of earlier line ends."""
    for b in batches:
        lines, last_of, rows = [], [], []
        ids, kinds, langs, tags = (b.column(c).to_pylist() for c in ("doc_id", "kind", "lang", "tag"))
        for i, text in enumerate(b.column("text").to_pylist()):
            got, last, unclosed = lines_of(text)
            sure = unclosed or bool(_MARK.search(text)) or bool(_BROKEN.search(text))
            lines += got
            remark = len(got) == 1 and last and len(text.strip()) <= REMARK_CHARS and len(got[0].split()) < REMARK_WORDS
            last_of.append(len(lines) - 1 if last and not sure and not remark else None)
            rows.append(sure)
        if lines:
            table = _end_contexts(lines)
        finals = [x for x in last_of if x is not None]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(langs, pa.string()), pa.array(tags, pa.int64()),
                pa.array([True] * len(ids), pa.bool_()), pa.array(rows, pa.bool_()),
                pa.array([table[x].tolist() if x is not None else None for x in last_of], pa.list_(pa.int64())), pa.array([1] * len(ids), pa.int64()),
            ],
            ["doc_id", "kind", "lang", "tag", "last", "sure", "contexts", "n"],
        )
        if lines:
            early = np.ones(len(lines), bool)
            early[finals] = False
            keys_early, n_early = np.unique(table[early].ravel(), return_counts=True)
            keep = keys_early != 0
            keys_early, n_early = keys_early[keep], n_early[keep]
            none = lambda kind: pa.nulls(len(keys_early), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    none(pa.int64()), none(pa.string()), none(pa.string()), none(pa.int64()), pa.array([False] * len(keys_early), pa.bool_()), none(pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(keys_early) + 1), pa.int32()), pa.array(keys_early, pa.int64())), pa.array(n_early, pa.int64()),
                ],
                ["doc_id", "kind", "lang", "tag", "last", "sure", "contexts", "n"],
            )


PARTS = 64


def bitmap_shape(keys: int, least: int = BITS_LEAST, most: int = BITS_MOST) -> tuple[int, int]:
    """(bits of a bitmap, number of ranges of hashes) for so many keys: at least PER_KEY bits a key, and no bitmap above most."""
    ranges = max(1, -(-keys * PER_KEY // most))
    bits = least
    while bits < most and bits * ranges < keys * PER_KEY:
        bits *= 2
    return bits, ranges


def _bits(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(size // 8, np.uint8)
        np.bitwise_or.at(block, pdf["bit"].to_numpy() >> 3, (1 << (pdf["bit"].to_numpy() & 7)).astype(np.uint8))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "block": [block.tobytes()]})

    return run


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the keys, put together from PARTS parts."""
    size = bits // PARTS
    bit = F.pmod("key", F.lit(bits))
    parts = keys.select((bit / size).cast("int").alias("part"), (bit % size).cast("int").alias("bit")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.groupBy("part").applyInPandas(_bits(size), "part int, block binary").collect():
        out[r[0] * size // 8 : (r[0] + 1) * size // 8] = np.frombuffer(r[1], np.uint8)
    return out


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return np.mod(keys >> 34, ranges)


def _read_goes_on(bitmap, bits: int, ranges: int, chosen: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for b in batches:
            lines: list[str] = []
            for text in b.column("text").to_pylist():
                lines += lines_of(text)[0]
            for parts, kinds, skips in _stretches(lines):
                pos, keys = _contexts(parts, kinds)
                fresh = pos >= np.repeat(np.array(skips), [len(x) for x in parts])
                for n in ORDERS:
                    k = keys[n][fresh]
                    k = k[k != 0]
                    at = np.mod(k, bits)
                    k = k[(held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                    if ranges > 1:
                        k = k[_range_of(k, ranges) == chosen]
                    if len(k):
                        u, c = np.unique(k, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c, pa.int64())], ["key", "m"])

    return run


def going_on(texts: DataFrame, ends: DataFrame, most: int = BITS_MOST) -> DataFrame:
    """(key, m): how often each context of ends(key) goes on in texts(text); contexts outside of ends may come too."""
    bits, ranges = bitmap_shape(ends.count(), min(BITS_LEAST, most), most)
    out = None
    for r in range(ranges):
        mine = ends.select("key").filter(F.pmod(F.shiftright("key", 34), F.lit(ranges)) == r)
        shared = texts.sparkSession.sparkContext.broadcast(_bitmap(mine, bits))
        part = texts.select("text").mapInArrow(_read_goes_on(shared, bits, ranges, r), "key long, m long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("key").agg(F.sum("m").alias("m"))


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, lang, sure, score): log-odds of each text's end; sure: a mark, broken character or open fence."""
    texts = documents.filter(F.length(F.trim("text")) > 0).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.pmod(F.xxhash64(plain_name(F.col("doc_kind"))), F.lit(KINDS)).cast("string").alias("kind"),
        language_of_label(F.col("lang")).alias("lang"),
        F.xxhash64(F.trim(F.regexp_replace("text", r"\r\n?", "\n"))).alias("tag"),
        "text",
    )
    texts = texts.filter(F.col("text").rlike(r"\S"))
    read = written(texts.mapInArrow(_read_ends, _ENDS))
    finals = read.filter("last").drop("last", "n")
    early = read.filter("not last").select(F.col("contexts")[0].alias("key"), "n", F.lit(False).alias("asked"))
    once = finals.filter("contexts is not null").dropDuplicates(["tag"]).select(F.explode("contexts").alias("key"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("asked"))
    ends = written(early.unionByName(once.filter("key != 0")).groupBy("key").agg(F.sum("n").alias("e"), F.max("asked").alias("asked")).filter("asked").drop("asked"))
    counts = ends.join(going_on(texts, ends), "key", "left").select("key", "e", F.coalesce("m", F.lit(0)).alias("m"))
    asked = finals.filter("contexts is not null").select("doc_id", "tag", F.posexplode("contexts").alias("rank", "key")).filter("key != 0")
    found = join_hot(asked, written(counts), "key", asked.count())  # short contexts are shared by most texts
    best = found.filter((F.col("e") - 1 + F.col("m") >= SUPPORT) | (F.col("rank") == 0)).groupBy("doc_id", "tag").agg(
        F.max(F.struct("rank", "e", "m")).alias("b")
    )
    odds = F.log((F.col("b.e") - 0.7) / (F.col("b.m") + 0.3))
    return finals.select("doc_id", "tag", "kind", "lang", "sure").join(best, ["doc_id", "tag"], "left").select(
        "doc_id", "kind", "lang", "sure", odds.alias("score")
    )


def thresholds(scored: DataFrame) -> dict[tuple[str, str], float]:
    """(language, kind) -> threshold: the middle of the widest empty stretch of scores between -5 and -1.

    A group of fewer than 200 texts takes its language's threshold, a language of fewer than 200 THRESHOLD.
    """
    bins = scored.filter("score between -5 and -1").select("lang", "kind", F.floor(F.col("score") * 5).alias("bin"))
    counts: dict[tuple, dict[int, int]] = {}
    for r in bins.groupBy("lang", "kind", "bin").count().collect():
        for key in ((r[0], r[1]), (r[0], None)):
            h = counts.setdefault(key, {})
            h[r[2]] = h.get(r[2], 0) + r[3]
    sizes: dict[tuple, int] = {}
    for r in scored.filter("score is not null").groupBy("lang", "kind").count().collect():
        for key in ((r[0], r[1]), (r[0], None)):
            sizes[key] = sizes.get(key, 0) + r[2]

    def valley(h: dict[int, int]) -> float:
        best = (float("inf"), 0.0, THRESHOLD)
        for i in range(-21, -10):
            mass = sum(h.get(i + j, 0) * w for j, w in ((-2, 0.5), (-1, 1), (0, 1), (1, 1), (2, 0.5)))
            middle = (i + 0.5) / 5
            best = min(best, (mass, abs(middle - THRESHOLD), middle))
        return best[2]

    out = {}
    for key, n in sizes.items():
        own, lang = (key, n), ((key[0], None), sizes.get((key[0], None), 0))
        pick = own if own[1] >= 200 else lang if lang[1] >= 200 else None
        out[key] = valley(counts.get(pick[0], {})) if pick else THRESHOLD
    return out


def cut_texts(documents: DataFrame) -> DataFrame:
    """(doc_id) of the texts that were cut off."""
    scored = written(scores(documents))
    rows = [(lang, kind, t) for (lang, kind), t in thresholds(scored).items()]
    limits = documents.sparkSession.createDataFrame(rows, "l string, k string, threshold double")
    same = scored["lang"].eqNullSafe(limits["l"]) & scored["kind"].eqNullSafe(limits["k"])
    judged = scored.join(F.broadcast(limits), same, "left")  # one row per language and kind of text
    return judged.filter(F.col("sure") | (F.col("score") < F.coalesce("threshold", F.lit(THRESHOLD)))).select("doc_id").distinct()


def cut_rates(documents: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, rate) by canonical source; source is null where missing."""
    found = cut_texts(documents).withColumn("cut", F.lit(1))
    return (
        documents.select("doc_id", plain_name(F.col("source")).alias("source"))
        .join(found, "doc_id", "left")
        .groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.count("cut").alias("n_cut"))
        .withColumn("rate", F.col("n_cut") / F.col("n_docs"))
    )
