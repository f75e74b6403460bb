"""Sink and source scan of sources in languages other than Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebed.functions.lexing import tokens, unbalanced
from sluicebed.functions.schemas import LANGUAGES
from sluicebed.operators.stripping import LEXER, language_of

HIGH, MEDIUM = "high", "medium"
# Calls that act on their arguments, by language and risk, in alphabetical order.
SINKS = {
    "c": {HIGH: ("execl", "execv", "execve", "gets", "popen", "sprintf", "strcat", "strcpy", "system", "vsprintf"), MEDIUM: ("memcpy", "memmove", "scanf", "sscanf", "strncpy", "strncat")},
    "cpp": {HIGH: ("gets", "popen", "sprintf", "strcat", "strcpy", "system"), MEDIUM: ("memcpy",)},
    "go": {HIGH: ("Command", "Eval"), MEDIUM: ("Exec", "Query", "QueryRow")},
    "java": {HIGH: ("exec",), MEDIUM: ("createQuery", "execute", "executeQuery", "executeUpdate", "prepareStatement")},
    "javascript": {HIGH: ("Function", "eval", "exec", "execSync"), MEDIUM: ("spawn", "spawnSync")},
    "php": {HIGH: ("assert", "eval", "exec", "passthru", "popen", "proc_open", "shell_exec", "system", "unserialize"), MEDIUM: ("mysql_query", "mysqli_query", "pg_query", "sqlite_query")},
    "ruby": {HIGH: ("eval", "exec", "spawn", "system"), MEDIUM: ("constantize", "public_send", "send")},
    "rust": {HIGH: ("Command",), MEDIUM: ("from_str_radix",)},
    "tsx": {HIGH: ("Function", "eval", "exec", "execSync"), MEDIUM: ()},
    "typescript": {HIGH: ("Function", "eval", "exec", "execSync"), MEDIUM: ("spawn", "spawnSync")},
}
# Where untrusted data comes from, by language, in alphabetical order; "(" stands for a call, {..} for members.
_REQUEST = "req.{body,cookies,headers,params,query}"
_REQUEST_LONG = "request.{body,params,query}"
SOURCES = {
    "c": ("argv", "fgets(", "getenv(", "read(", "recv(", "scanf("),
    "cpp": ("argv", "fgets(", "getenv(", "std::cin"),
    "go": ("io.ReadAll(", "os.Args", "r.FormValue(", "r.Header.Get(", "r.URL.Query"),
    "java": ("args", "getHeader(", "getInputStream(", "getParameter(", "getQueryString("),
    "javascript": ("document.cookie", "location.{hash,href,search}", "process.argv", _REQUEST, _REQUEST_LONG),
    "php": ("$_{COOKIE,FILES,GET,POST,REQUEST,SERVER}", "file_get_contents('php://input"),
    "ruby": ("ARGV", "ENV", "params", "request.{body,headers,params}"),
    "rust": ("env::args", "env::var", "std::io::stdin"),
    "tsx": ("process.argv", _REQUEST),
    "typescript": ("process.argv", _REQUEST, _REQUEST_LONG),
}
# The texts of findings and warnings.
SAY = {
    "language": "{0}: language not known to this scan",
    "rules": "{0}: no sinks are listed for {1}",
    "syntax": "{0}: does not parse, so the scan may have missed calls",
    "sink": "{0} is called",
    "together": "{0} is called in a {1} function that reads untrusted data; no flow was proven",
    "risk": "{0} is dangerous in {1} whatever it is given; no flow was proven",
    "coverage": "{0} files in other languages than Python: calls and sources were matched by name, paths and imports were not followed",
}


def _source_pattern(names: tuple[str, ...]) -> re.Pattern[str]:
    parts = []
    for name in names:
        p = re.sub(r"\\{(.*?)\\}", lambda m: "(?:" + m[1].replace(",", "|") + ")", re.escape(name))
        p = p.replace(r"\(", r"\s*\(").replace("'", r"\s*['\"]")
        parts.append((r"\b" if name[0].isalpha() else "") + p + (r"\b" if p[-1] == ")" or p[-1].isalnum() else ""))
    return re.compile("|".join(parts))


_sources = {lang: _source_pattern(names) for lang, names in SOURCES.items()}
_risk = {lang: {name: risk for risk, names in by_risk.items() for name in names} for lang, by_risk in SINKS.items()}
_CONTROL = {"catch", "elseif", "for", "foreach", "if", "lock", "match", "return", "sizeof", "switch", "synchronized", "using", "when", "while", "with"}
_DEFINE = {"function", "func", "fn", "def", "sub"}


def functions_of(text: str, lang: str, toks: list | None = None) -> list[tuple[int, int]]:
    """Spans of the outermost functions: in Ruby def to its end, elsewhere a parameter list and the braces after it."""
    toks = [t for t in (toks or tokens(text, lang)) if t[0] not in "C"]
    out: list[tuple[int, int]] = []
    if lang == "rb":
        depth, start = 0, None
        line_start = True
        for kind, a, b in toks:
            if kind == "L":
                line_start = True
                continue
            t = text[a:b]
            if kind == "W":
                if t == "end" and depth:
                    depth -= 1
                    if not depth:
                        out.append((start, b))
                elif t == "def" or depth and (t in ("class", "module", "begin", "case", "do") or (t in ("if", "unless", "while", "until") and line_start)):
                    if not depth:
                        start = a
                    depth += 1
            line_start = False
        return out
    toks = [t for t in toks if t[0] != "L"]
    pair: dict[int, int] = {}
    stack: list[int] = []
    for i, (kind, _, _) in enumerate(toks):
        if kind in "([{":
            stack.append(i)
        elif kind in ")]}" and stack:
            j = stack.pop()
            pair[j] = i
    i, until = 0, -1
    while i < len(toks):
        kind, a, _ = toks[i]
        if kind == "(" and i in pair and i and i > until:
            prev = toks[i - 1]
            name = text[prev[1] : prev[2]]
            named = prev[0] == "W" and name not in _CONTROL
            j = pair[i] + 1
            while j < len(toks) and (toks[j][0] == "W" or text[toks[j][1] : toks[j][2]] in (":", "->", "=>", ".", ",", "*", "<", ">", "&", "|", "?", "::") or toks[j][0] in "([") and j - pair[i] < 24:
                j = pair[j] + 1 if toks[j][0] in "([" and j in pair else j + 1
            if named and j < len(toks) and toks[j][0] == "{" and j in pair:
                begin = i - 1
                while begin and text[toks[begin - 1][1] : toks[begin - 1][2]] not in (";", "{", "}", ")") and toks[begin - 1][0] != "D" and i - begin < 12:
                    begin -= 1
                out.append((toks[begin][1], toks[pair[j]][2]))
                until = pair[j]
                i = until
        i += 1
    return out


def calls_of(text: str, lang: str, toks: list | None = None) -> list[tuple[str, int, int]]:
    """(name, start, end) of the calls: a name before a parameter list, not where a function is defined."""
    toks = [t for t in (toks or tokens(text, lang)) if t[0] not in "CL"]
    out = []
    for i, (kind, a, b) in enumerate(toks[:-1]):
        if kind != "W":
            continue
        after = toks[i + 1]
        t = text[a:b].rstrip("!")
        called = after[0] == "(" or lang == "rb" and after[0] in "SW" and "\n" not in text[b : after[1]] and text[b : after[1]] != ""
        before = text[toks[i - 1][1] : toks[i - 1][2]] if i else ""
        if called and before not in _DEFINE and before != "new":
            end = after[2]
            depth = 0
            for k, _, y in toks[i + 1 :]:
                depth += (k in "([{") - (k in ")]}")
                if depth <= 0:
                    end = y
                    break
            out.append((t.rpartition("\\")[2], a, end))
    return out


def scan(path: str, source: str, disabled: frozenset[str] = frozenset()) -> tuple[list[dict], list[str]]:
    """Findings and warnings of one source: sinks, and taint where a source stands in the same outermost function (in the
    same file outside of functions) or the sink is of high risk. Later calls come first."""
    language = language_of(path)
    if language is None:
        return [], [SAY["language"].format(path)]
    if language == "python":
        return [], []
    if language not in SINKS:
        return [], [SAY["rules"].format(path, language)]
    lang = LEXER[language]
    toks = tokens(source, lang)
    notes = [SAY["syntax"].format(path)] if unbalanced(toks) or any(k in "UVXM" for k, _, _ in toks) else []
    spans = functions_of(source, lang, toks)
    has = [bool(_sources[language].search(source, a, b)) for a, b in spans]
    whole = bool(_sources[language].search(source))
    out: dict[tuple, dict] = {}
    for name, a, b in reversed(calls_of(source, lang, toks)):
        risk = _risk[language].get(name)
        if risk is None:
            continue
        line = source.count("\n", 0, a) + 1
        found = [("sink", SAY["sink"].format(name))]
        inside = next((h for (x, y), h in zip(spans, has, strict=True) if x <= a and b <= y), None)
        if "taint" not in disabled:
            if whole if inside is None else inside:
                found.append(("taint", SAY["together"].format(name, language)))
            elif risk == "high":
                found.append(("taint", SAY["risk"].format(name, language)))
        for kind, detail in found:
            out.setdefault((kind, line, detail), {"kind": kind, "path": path, "line": line, "detail": detail})
    return list(out.values()), notes


def scan_files(files: DataFrame, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """(example_no, seq, kind, path, line, detail) over files(example_no, path, source); warnings have kind "warning".

    The last warning of a row, with a null path, counts its files in languages with rules.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple] = {}
        for pdf in batches:
            rows = []
            for no, path, source in zip(pdf["example_no"], pdf["path"], pdf["source"], strict=True):
                if path is None or source is None or language_of(path) in (None, "python"):
                    continue
                key = (path, hash(source), len(source))
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = scan(path, source, disabled)
                found, notes = known[key]
                rows += [(no, i, f["kind"], path, f["line"], f["detail"]) for i, f in enumerate(found)]
                rows += [(no, len(found) + i, "warning", path, None, n) for i, n in enumerate(notes)]
            yield pd.DataFrame(rows, columns=["example_no", "seq", "kind", "path", "line", "detail"]).astype({"line": "Int64"})

    found = files.select("example_no", "path", "source").mapInPandas(run, "example_no long, seq int, kind string, path string, line long, detail string")
    before, after = SAY["coverage"].split("{0}")
    scanned = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1).isin(*[x for x, lang in LANGUAGES.items() if lang in SINKS])
    counted = files.filter(scanned & F.col("source").isNotNull()).groupBy("example_no").count().select(
        "example_no", F.lit(LAST).alias("seq"), F.lit("warning").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("line"),
        F.concat(F.lit(before), F.col("count").cast("string"), F.lit(after)).alias("detail"),
    )
    return found.unionByName(counted)


LAST = 2_000_000_000  # comes after all other warnings of a row
