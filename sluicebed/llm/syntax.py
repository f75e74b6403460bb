"""Source files that do not parse.

A chunk of a file is read into a lexer-state map: for each state in which the chunk may begin (code, inside a comment,
inside a string that may span lines) the state in which it ends and its classes, one per token. Balanced stretches in
braces are parsed where they lie by the local grammar of the language (`grammars`) and shrink to a class that tells the
roles they can play, so a chunk's summary is its unmatched brackets with little between them. Maps are joined in order,
associatively; those of files with several chunks are reduced across tasks in levels, without their texts. What remains of
a file is parsed last. Python files are parsed by Python's own grammar, JSON by a strict reader.

Statuses: "invalid", or "deep" where a parser gave up because of nesting, which is never taken as valid.

Cases: null, empty and blank sources are valid; null paths and other suffixes give no row; a null map gives none; copies of
one source are parsed once per task; texts of any length are read whole.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebed.functions.lexing import SUFFIXES
from sluicebed.functions.names import repo_name
from sluicebed.llm.grammars import GRAMMARS
from sluicebed.llm.grammars.terminals import chunks, classes, join, state_map
from sluicebed.llm.grammars.terminals import START, WRONG
from sluicebed.plans.shared import written

CHUNK = 16_384
FAN = 8  # maps joined by one task of a level
DEPTH = 200_000  # frames of a grammar, which calls itself for nested brackets
INVALID, DEEP = "invalid", "deep"

_verdicts: dict[str, str | None] = {}


def verdict(got: list[str], lang: str) -> str | None:
    """Status of a whole file's classes, None if they are valid."""
    if WRONG in got:
        return INVALID
    key = f"{lang} {' '.join(got)}"
    if len(key) > 20_000:
        key = ""
    if key in _verdicts:
        return _verdicts[key]
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    try:
        out = None if GRAMMARS[lang].accepts(got) else INVALID
    except RecursionError:
        out = DEEP
    if key:
        if len(_verdicts) > 20_000:
            _verdicts.clear()
        _verdicts[key] = out
    return out


def _python(text: str) -> str | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return INVALID
        except (RecursionError, MemoryError):
            return DEEP
    return None


_JSON = re.compile(
    r'[ \t\n\r]*(?:(?P<open>[{\[])|(?P<close>[}\]])|(?P<comma>,)|(?P<colon>:)|(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<value>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))"
)


def _json_steps(text: str) -> bool:
    """True if the text is valid JSON, whatever its depth: one step a token, with a stack of open brackets."""
    stack: list[str] = []
    want = "value"  # value, first (a value or the end of a list), key, firstkey, colon, next
    pos, end = 0, len(text.rstrip(" \t\n\r"))
    while pos < end:
        m = _JSON.match(text, pos)
        if not m:
            return False
        pos, kind, t = m.end(), m.lastgroup, m.group(m.lastgroup)
        if kind == "open" and want in ("value", "first"):
            stack.append(t)
            want = "firstkey" if t == "{" else "first"
            continue
        if kind == "close":
            if not stack or want not in (("firstkey", "next") if t == "}" else ("first", "next")) or stack.pop() != {"}": "{", "]": "["}[t]:
                return False
            want = "next" if stack else "end"
        elif kind == "comma" and want == "next":
            want = "key" if stack[-1] == "{" else "value"
        elif kind == "colon" and want == "colon":
            want = "value"
        elif kind == "string" and want in ("key", "firstkey"):
            want = "colon"
        elif kind in ("string", "value") and want in ("value", "first"):
            want = "next" if stack else "end"
        else:
            return False
    return want == "end"


def _json(text: str) -> str | None:
    def no_constant(name: str):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=no_constant)
    except ValueError:
        return INVALID
    except RecursionError:
        return None if _json_steps(text) else INVALID
    return None


def status(text: str | None, lang: str, chunk: int = CHUNK) -> str | None:
    """Status of a whole text, None if it is valid."""
    if text is None or not text.strip():
        return None
    if lang == "py":
        return _python(text)
    if lang == "json":
        return _json(text)
    if len(text) <= chunk:
        got, state = classes(text, lang)
        return verdict(got, lang) if state in ("code", "html") else INVALID
    maps = [state_map(c, lang, not i) for i, c in enumerate(chunks(text, lang, chunk))]
    return joined_status(maps, lang)


def joined_status(maps: list[dict], lang: str) -> str | None:
    whole = joined(maps, lang)
    got, state = whole[START.get(lang, "code")]
    return verdict(got, lang) if state in ("code", "html") else INVALID


def joined(maps: list[dict], lang: str) -> dict:
    """The map of neighbouring maps, joined by pairs."""
    while len(maps) > 1:
        maps = [join(maps[i], maps[i + 1], lang) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def fails(text: str | None, lang: str) -> bool:
    """True if the whole text is not syntactically valid."""
    return status(text, lang) is not None


def _language(path):
    return F.create_map(*[x for s, lang in SUFFIXES.items() for x in (F.lit(s), F.lit(lang))])[F.regexp_extract(path, r"(\.[^./]+)$", 1)]


def sources(pulls: DataFrame, fields: tuple[str, ...] = ("files", "repository_files")) -> DataFrame:
    """(example_no, field, path, lang, source) of the files with a known suffix and a text that isn't blank."""
    parts = [
        pulls.select("example_no", F.lit(f).alias("field"), F.explode(f).alias("path", "source")) for f in fields
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return (
        whole.withColumn("lang", _language(F.col("path")))
        .filter(F.col("lang").isNotNull() & F.col("source").isNotNull())
        .select("example_no", "field", "path", "lang", "source")
    )


_OUT = "example_no long, field string, path string"
_FIRST = pa.schema(
    [("example_no", pa.int64()), ("field", pa.string()), ("path", pa.string()), ("lang", pa.string()), ("status", pa.string()), ("mark", pa.string()), ("chunk_no", pa.int32()), ("states", pa.string())]
)


def _packed(maps: dict) -> str:
    return json.dumps({s: [" ".join("\\n" if x == "\n" else x for x in got), end] for s, (got, end) in maps.items()})


def _unpacked(packed: str) -> dict:
    return {s: (["\n" if x == "\\n" else x for x in got.split(" ")] if got else [], end) for s, (got, end) in json.loads(packed).items()}


def _check(chunk: int):
    """Invalid files with their status; files of several chunks with a mark, and once per mark and task the chunks' maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int, int], tuple] = {}
        for b in batches:
            keep, statuses, marks = [], [], []
            for i, (lang, text) in enumerate(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)):
                key = (lang, hash(text), len(text))
                got = known.get(key)
                if got is None:
                    if len(known) > 200_000:
                        known.clear()
                    if len(text) > chunk and lang in GRAMMARS and text.strip():
                        mark = hashlib.blake2b(f"{lang}\n{text}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                        got = (None, mark)
                        for n, part in enumerate(chunks(text, lang, chunk)):
                            row = [None, None, None, lang, None, mark, n, _packed(state_map(part, lang, n == 0))]
                            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _FIRST, strict=True)], schema=_FIRST)
                    else:
                        got = (status(text, lang, chunk), None)
                    known[key] = got
                if got[0] or got[1]:
                    keep.append(i)
                    statuses.append(got[0])
                    marks.append(got[1])
            if keep:
                own = b.select(["example_no", "field", "path", "lang"]).take(pa.array(keep))
                none = pa.nulls(len(keep))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(statuses, pa.string()), pa.array(marks, pa.string()), none.cast(pa.int32()), none.cast(pa.string())], schema=_FIRST
                )

    return run


def _join_some(pdf: pd.DataFrame) -> pd.DataFrame:
    """The joined map of neighbouring chunks of one file."""
    pdf = pdf.sort_values("chunk_no")
    lang = pdf["lang"].iloc[0]
    whole = joined([_unpacked(x) for x in pdf["states"]], lang)
    return pd.DataFrame({"mark": [pdf["mark"].iloc[0]], "lang": [lang], "chunk_no": [int(pdf["group"].iloc[0])], "states": [_packed(whole)]})


def _last(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in pdf:
        p["status"] = [joined_status([_unpacked(x)], g) for x, g in zip(p["states"], p["lang"], strict=True)]
        yield p[["mark", "status"]]


def invalid_files(pulls: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(example_no, field, path, status) of the files that are not valid in the language of their suffix.

    One scan judges files of one chunk and reads the chunks of the others into maps; what it gives is written once, a small
    table. Maps are joined FAN at a time in as many levels as the longest file needs; only maps are shuffled.
    """
    first = written(sources(pulls).mapInArrow(_check(chunk), f"{_OUT}, lang string, status string, mark string, chunk_no int, states string"))
    short = first.filter("status is not null").select("example_no", "field", "path", "status")
    maps = first.filter("chunk_no is not null").select("mark", "lang", "chunk_no", "states").dropDuplicates(["mark", "chunk_no"])
    most = first.agg(F.max("chunk_no")).first()[0]
    if most is None:
        return short
    while most > 0:
        most //= FAN
        maps = maps.withColumn("group", F.floor(F.col("chunk_no") / FAN).cast("int")).groupBy("mark", "group").applyInPandas(
            _join_some, "mark string, lang string, chunk_no int, states string"
        )
    judged = maps.mapInPandas(_last, "mark string, status string").filter("status is not null")
    long = first.filter("mark is not null and example_no is not null").select("example_no", "field", "path", "mark").join(judged, "mark")
    return short.unionByName(long.select("example_no", "field", "path", "status"))


def invalid_rates(pulls: DataFrame) -> DataFrame:
    """(repo, lang, n_files, n_invalid, n_deep, rate): repo is the canonical name, null where missing; n_deep counts the
    files among n_invalid whose nesting a parser couldn't follow."""
    all_files = sources(pulls).select("example_no", "field", "path", "lang").join(
        invalid_files(pulls), ["example_no", "field", "path"], "left"
    )
    repos = pulls.select("example_no", repo_name(F.col("repo")).alias("repo"))
    return (
        all_files.join(repos, "example_no")
        .groupBy("repo", "lang")
        .agg(F.count("*").alias("n_files"), F.count("status").alias("n_invalid"), F.count_if(F.col("status") == DEEP).alias("n_deep"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )
