"""Blanking comments, docstrings and literal text of sources, line structure kept."""

from __future__ import annotations

import ast
import re
import warnings

import pandas as pd
from pyspark.sql import functions as F

from sluicebed.functions.lexing import tokens, unbalanced
from sluicebed.functions.schemas import LANGUAGES

#: The lexer of each language.
LEXER = {
    "python": "py", "javascript": "js", "typescript": "ts", "tsx": "ts", "c": "c", "cpp": "c", "java": "java", "php": "php", "go": "go", "ruby": "rb",
    "rust": "rs", "csharp": "cs", "bash": "sh", "swift": "java", "kotlin": "java", "scala": "java",
}


def language_of(path: str) -> str | None:
    name = path.rpartition("/")[2]
    return LANGUAGES.get(name[name.rfind(".") :].lower()) if "." in name[1:] else None


def _holes(text: str, start: int, stop: int, language: str) -> list[tuple[int, int]]:
    """Spans of interpolated code inside a literal."""
    opener = None
    token = text[start:stop]
    if language == "python" and re.match(r"[rRbB]?[fFtT][rRbB]?[\"']", token):
        opener = re.compile(r"(?<!\{)(?:\{\{)*\{(?!\{)")
    elif language in ("javascript", "typescript", "tsx") and token.startswith("`"):
        opener = re.compile(r"(?<!\\)\$\{")
    elif language == "ruby" and token[:1] in '"`' or language == "ruby" and token.startswith(("%Q", "%W", "%(", "%[", "%{")):
        opener = re.compile(r"(?<!\\)#\{")
    elif language == "php" and token[:1] in '"<':
        opener = re.compile(r"\{(?=\$)")
    elif language == "csharp" and token.startswith("$"):
        opener = re.compile(r"(?<!\{)\{(?!\{)")
    elif language in ("kotlin", "scala") and token.startswith('"'):
        opener = re.compile(r"(?<!\\)\$\{")
    out, at = [], start
    while opener and (m := opener.search(text, at, stop)):
        depth, i = 1, m.end()
        while i < stop and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        out.append((m.end(), i - 1 if not depth else i))
        at = i
    return out


def strip_source(source: str, path: str, mask: bool = False) -> tuple[str, list[str]]:
    """(text, warnings): comments and Python docstrings blanked, with mask literal text too; interpolated code stays.

    Line ends stay, so every line keeps its number. Languages without a lexer are given back unchanged with a warning.
    """
    language = language_of(path)
    if language is None:
        return source, [f"{path}: unsupported syntax for stripping"]
    toks = tokens(source, LEXER[language], inside=language == "php" and "<?" not in source)  # a part of a file has no open tag
    spans: list[tuple[int, int]] = []
    for kind, a, b in toks:
        if kind == "C":
            spans.append((a, b))
        elif kind == "S" and mask:
            at = a
            for x, y in _holes(source, a, b, language):
                spans.append((at, x))
                if mask and y > x:  # a literal inside of interpolated code
                    inner, _ = strip_source(source[x:y], path, mask=True)
                    spans += [(x + m.start(), x + m.end()) for m in re.finditer(r"\S+", source[x:y]) if not inner[m.start() : m.end()].strip()]
                at = y
            spans.append((at, b))
        elif kind == "U" and source[a : a + 2] == "/*":
            spans.append((a, b))
    notes = []
    broken = unbalanced(toks) or any(k in "UVXM" for k, _, _ in toks)
    if language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            broken = True
        else:
            broken = False
            spans += _docstrings(source, tree)
    if broken:
        notes.append(f"{path}: syntax errors; stripping coverage incomplete")
    out, at = [], 0
    for a, b in sorted(spans):
        a = max(a, at)
        if b > a:
            out += [source[at:a], re.sub(r"[^\r\n]", " ", source[a:b])]
            at = b
    return "".join([*out, source[at:]]), notes


def _docstrings(source: str, tree: ast.AST) -> list[tuple[int, int]]:
    lines = source.splitlines(keepends=True)
    starts = [0]
    for x in re.split(r"(?<=\n)", source):
        starts.append(starts[-1] + len(x))
    del lines
    out = []

    def place(line: int, column: int) -> int:
        text = source[starts[line - 1] : starts[line]]
        return starts[line - 1] + len(text.encode()[:column].decode(errors="ignore"))

    for node in ast.walk(tree):
        body = getattr(node, "body", None)
        if isinstance(node, ast.Module | ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and body:
            first = body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                out.append((place(first.lineno, first.col_offset), place(first.end_lineno, first.end_col_offset)))
    return out


def strip_udf(mask: bool = False):
    """Arrow UDF (source, path) -> struct<text, warnings>."""

    @F.pandas_udf("struct<text:string,warnings:array<string>>")
    def run(source: pd.Series, path: pd.Series) -> pd.DataFrame:
        got = [strip_source(s, p, mask) if s is not None and p is not None else (s, []) for s, p in zip(source, path, strict=True)]
        return pd.DataFrame({"text": [g[0] for g in got], "warnings": [g[1] for g in got]})

    return run


def masked_lines(lines):
    """Changed and context lines (example_no, path, pos, op, line, text) -> changed lines with masked text.

    Each side of a file's hunks is put together with its context, masked as one text and taken apart again by position, so
    repeated lines keep their own masked form.
    """
    sides = lines.filter("op in ('+', '-', ' ') and not (op = ' ' and startswith(text, '\\\\'))").withColumn(
        "side", F.explode(F.when(F.col("op") == "+", F.array(F.lit("new"))).when(F.col("op") == "-", F.array(F.lit("old"))).otherwise(F.array(F.lit("old"), F.lit("new"))))
    )
    grouped = sides.groupBy("example_no", "path", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "op", "line", "text"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.regexp_replace(x["text"], r"[\r\n]", " ")), "\n")
    clean = grouped.withColumn("clean", F.split(strip_udf(True)(text, F.col("path"))["text"], "\n"))
    zipped = clean.select("example_no", "path", F.explode(F.arrays_zip("l", "clean")).alias("z"))
    return zipped.select("example_no", "path", "z.l.pos", "z.l.op", "z.l.line", F.col("z.clean").alias("text")).filter("op != ' '")
