"""Rule scan over changed lines.

A rule is a table of plain names; one builder makes its pattern. All rules are tested in one projection, once per line, so no
join with a rule table is planned. Rules read masked lines (comments gone, literals blank), see `stripping.masked_lines`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sluicebed.operators.difflines import numbered
from sluicebed.plans.shared import written


@dataclass(frozen=True)
class Rule:
    """What a rule looks for, without regard to case.

    names stand anywhere in a line, words between word boundaries; args are calls with one of the marks among their
    arguments, up to a class of characters that ends them; shapes are patterns that names can't say. In a name "(" may follow
    blanks, " " stands for blanks or none, "~" for anything.
    """

    kind: str
    cwe: str
    says: str
    names: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    args: tuple[str, ...] = ()
    marks: tuple[str, ...] = ()
    ends: str = ")"
    shapes: tuple[str, ...] = field(default=())

    def pattern(self) -> str:
        parts = [_spelled(n) for n in self.names]
        if self.words:
            parts.append(rf"\b(?:{'|'.join(_spelled(w) for w in self.words)})\b")
        if self.args:
            parts.append(rf"(?:{'|'.join(_spelled(a) for a in self.args)})\s*\([^{self.ends}]*(?:{'|'.join(_spelled(m) for m in self.marks)})")
        return "|".join([*parts, *self.shapes])


_SIGNS = {"(": r"\s*\(", " ": r"\s*", "~": ".*"}


def _spelled(name: str) -> str:
    return "".join(_SIGNS.get(c) or re.escape(c) for c in name)


# The names that each rule looks for, in alphabetical order.
REMOVED = {
    "R1": Rule(
        "diff_sanitizer_removed", "89", "SQL escaping or binding removed",
        names=("addslashes(", "bind_param", "mysqli_real_escape", "parameteriz", "PDO::quote", "pg_escape", "prepared statement", "quote(", "quoteIdentifier(", "sqlalchemy.text"),
    ),
    "R2": Rule(
        "diff_sanitizer_removed", "79", "HTML escaping removed",
        names=("bleach.clean", "DOMPurify", "encodeURIComponent", "escape", "htmlentities", "htmlspecialchars", "sanitize", "xss"),
    ),
    "R3": Rule(
        "diff_sanitizer_removed", "78", "shell quoting removed",
        names=("escapeshellarg", "escapeshellcmd", "pipes.quote", "Shellwords.escape", "shlex.quote", "subprocess.list2cmdline"),
    ),
    "R4": Rule("diff_sanitizer_removed", "416", "lifetime guard removed", names=("drop_in_place", "ManuallyDrop", "mem::forget", "Pin::new")),
    "R5": Rule(
        "diff_sanitizer_removed", "22", "path check removed",
        names=("basename(", "canonical", "filepath.Clean", "HasPrefix(~..", "os.path.normpath", "path.normalize", "Path.resolve", "realpath", "secure_filename", "strings.Contains(~.."),
    ),
    "R6": Rule(
        "diff_csrf_removed", "352", "CSRF guard removed",
        names=("@csrf", "csrf_protect", "csrf_token", "CsrfViewMiddleware", "protect_from_forgery", "verify_csrf"),
    ),
    "R7": Rule(
        "diff_authz_removed", "862", "authorization check removed",
        names=("@login_required", "authenticate!", "authoris", "authorize", "can?", "check_auth", "ensure_~user", "is_admin", "permission_required", "require_~auth"),
    ),
}
ADDED = {
    "R8": Rule("diff_sink", "89", "SQL built from parts", args=(". execute", ". executemany", ". query", "mysqli_query", "pg_query"), marks=("+", ".format("), ends=r";\n", shapes=(
        r"(?:\.\s*(?:execute(?:many)?|query)|(?:mysqli|pg)_query)\s*\([^;\n]*\s\.\s",  # joined by a point between blanks
    )),
    "R9": Rule(
        "diff_sink", "78", "command execution",
        words=("child_process", "exec", "execSync", "IO.popen", "Kernel.system", "open3", "os.system", "popen", "ProcessBuilder", "Runtime.exec", "subprocess.call", "subprocess.Popen", "subprocess.run", "system"),
        shapes=(r"\bspawn\s*\(", r"`[^`]*\$\{?\w"),  # a command with a variable in it
    ),
    "R10": Rule(
        "diff_sink", "79", "raw HTML output",
        names=("dangerouslySetInnerHTML", "document.write", "innerHTML", "outerHTML", "v-html"),
        shapes=(r"echo\s+\$_(?:GET|POST|REQUEST)", r"\{\{\s*\w+\s*\}\}(?!\s*(?:\||escape))"),
    ),
    "R11": Rule(
        "diff_sink", "22", "file path built from parts",
        args=("file_get_contents", "fopen", "include", "ioutil.ReadFile", "open", "os.Open", "os.Remove", "readFile", "require", "writeFile"), marks=("${", "../", "+"),
    ),
    "R12": Rule("diff_sink", "22", "writable directory mode", shapes=(r"\b(?:os\.)?(?:mkdir|makedirs)\s*\([^)]*0[0-7]*[2367]",)),
    "R13": Rule(
        "diff_sink", "94", "code evaluation or unsafe loading",
        words=("__import__", "eval", "exec", "Marshal.load", "pickle.loads"),
        shapes=(r"\b(?:compile|Function|unserialize|yaml\.load)\s*\(", r"\bset(?:Interval|Timeout)\s*\(\s*['\"]"),
    ),
    "R14": Rule("diff_sink", "416", "manual release", names=("dangling pointer", "drop_in_place", "ManuallyDrop"), shapes=(r"use.after.free", r"\bfree\s*\(")),
    "R15": Rule("diff_sink", "787,125", "unchecked buffer call", shapes=(r"\b(?:gets|memcpy|sprintf|strcat|strcpy)\s*\(",)),
}
CWES = {r: x.cwe for r, x in {**REMOVED, **ADDED}.items()} | {"R16": "125,787", "R17": "352"}
#: The guards of the second check for CSRF.
CSRF = "|".join(_spelled(n) for n in ("csrf_protect", "protect_from_forgery", "verify_csrf"))
HAS_IF = r"\bif\s*\("
# Cues of an upper bound, and the tokens that name one.
CUES = ("_MAX", "_SZ", "count", "length", "SIZE", "sizeof")
_cue = rf"(?:NR_\w+|{'|'.join(CUES)})"
UPPER = rf"{_cue}.*[<>]|[<>].*{_cue}|NR_syscalls"
BOUND_TOKENS = r"(NR_\w+|\w+_MAX|\w+_SZ|sizeof\s*\([^)]*\))"
FLAGS = "(?i)"


def clip(c: Column, limit: int = 120) -> Column:
    """White space collapsed, cut to limit characters with three dots."""
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.substring(one, 1, limit - 3), F.lit("...")))


def safe_path(c: Column) -> Column:
    """Only letters, digits and _ . / - in at most 100 characters."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_./-]", "_"), 1, 100)


def changed_lines(pulls: DataFrame) -> DataFrame:
    """(example_no, path, pos, op, line, text) of added and removed lines."""
    return numbered(pulls).filter("op in ('+', '-')").select(
        "example_no", "path", "pos", "op", F.coalesce("new_line", "old_line").alias("line"), "text"
    )


def applicable(target: str | None) -> set[str]:
    """Rules that speak of the weakness with this number, all if there is none. Scans never pass a record's label."""
    return {r for r, c in CWES.items() if target is None or target in c.split(",")}


def rule_hits(lines: DataFrame, flags: str = FLAGS, target: str | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """lines(example_no, path, pos, op, line, text) to one row per line and rule that matches: adds rule and kind.

    more: further patterns by name, whose matches come out with a null kind. Every pattern is tested once per line.
    """
    chosen = applicable(target)
    tests = [
        F.when(F.col("text").rlike(flags + x.pattern()), F.struct(F.lit(r).alias("rule"), F.lit(x.kind).alias("kind")))
        for r, x in {**REMOVED, **ADDED}.items()
        if r in chosen
    ]
    none = F.lit(None).cast("string")
    tests += [F.when(F.col("text").rlike(p), F.struct(F.lit(r).alias("rule"), none.alias("kind"))) for r, p in (more or {}).items()]
    if not tests:
        return lines.withColumns({"rule": F.lit(""), "kind": F.lit("")}).limit(0)
    # an outer explode, as the planner would test the patterns of an inner one a second time to filter empty arrays
    hit = lines.withColumn("hit", F.explode_outer(F.array_compact(F.array(*tests)))).filter("hit is not null")
    return hit.select("*", "hit.rule", "hit.kind").drop("hit")


GUARD, CONDITION = "guard", "if"


def all_hits(lines: DataFrame) -> DataFrame:
    """rule_hits with the lines that R16 and R17 read, which come out under the names CONDITION and GUARD."""
    return rule_hits(lines, more={GUARD: FLAGS + CSRF, CONDITION: HAS_IF})


def _hits(lines: DataFrame) -> DataFrame:
    return lines if "rule" in lines.columns else all_hits(lines)


def net_removed(lines: DataFrame) -> DataFrame:
    """(example_no, path, rule, kind, line, text): guards with more removed than added lines; the first removed line."""
    hits = _hits(lines).filter(F.col("rule").isin(*REMOVED))
    removed = F.col("op") == "-"
    return (
        hits.groupBy("example_no", "path", "rule", "kind")
        .agg(
            F.count_if(removed).alias("n_removed"),
            F.count_if(~removed).alias("n_added"),
            F.min(F.when(removed, F.struct("pos", "line", "text"))).alias("f"),
        )
        .filter("n_removed > n_added")
        .select("example_no", "path", "rule", "kind", "f.line", "f.text")
    )


def first_sinks(lines: DataFrame) -> DataFrame:
    """(example_no, path, rule, kind, line, text): the first added line of each sink rule whose text is not also removed.

    A removed line of the same text is a hit of the same rule, so the anti join is an aggregation by text.
    """
    hits = _hits(lines).filter(F.col("rule").isin(*ADDED))
    texts = hits.groupBy("example_no", "path", "rule", "kind", "text").agg(
        F.min(F.when(F.col("op") == "+", F.struct("pos", "line"))).alias("f"), F.max(F.col("op") == "-").alias("gone")
    )
    return (
        texts.filter("not gone and f is not null")
        .groupBy("example_no", "path", "rule", "kind")
        .agg(F.min(F.struct("f.pos", "f.line", "text")).alias("f"))
        .select("example_no", "path", "rule", "kind", "f.line", "f.text")
    )


def csrf_deleted(lines: DataFrame) -> DataFrame:
    """(example_no, path, line, text, pos): removed CSRF guards of files whose added lines hold none."""
    hit = _hits(lines).filter(F.col("rule") == GUARD)
    added = F.max(F.col("op") == "+").over(W.Window.partitionBy("example_no", "path"))
    return hit.withColumn("added", added).filter("op = '-' and not added").select("example_no", "path", "line", "text", "pos")


def _conjuncts(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"&&|\|\|"))


def bounds_weakened(lines: DataFrame) -> DataFrame:
    """(example_no, path, line, text): the first removed bound check of a file that a weaker one replaces.

    A removed "if (" with an upper bound or several conditions; an added "if (" that is shorter or has fewer conditions;
    and no added "if (" that keeps one of the removed one's bound tokens. One aggregation gathers both sides of a file's
    conditions, a bounded part of one diff, so no pairs of lines are joined.
    """
    ifs = _hits(lines).filter(F.col("rule") == CONDITION).withColumn(
        "bound", F.col("text").rlike(FLAGS + UPPER) | (_conjuncts(F.col("text")) > 0)
    )
    added, removed = F.col("op") == "+", (F.col("op") == "-") & F.col("bound")
    files = ifs.groupBy("example_no", "path").agg(
        F.min(F.when(added, F.length("text"))).alias("shortest"),
        F.min(F.when(added, _conjuncts(F.col("text")))).alias("fewest"),
        F.collect_set(F.when(added, F.col("text"))).alias("texts"),
        F.array_sort(F.collect_list(F.when(removed, F.struct("pos", "line", "text")))).alias("removed"),
    )

    def weaker(r: Column) -> Column:
        tokens = F.regexp_extract_all(r["text"], F.lit(BOUND_TOKENS), 1)
        kept = F.exists(tokens, lambda t: F.exists(F.col("texts"), lambda x: F.contains(x, t)))
        return ((F.col("shortest") < F.length(r["text"])) | (F.col("fewest") < _conjuncts(r["text"]))) & ~kept

    first = files.filter("shortest is not null and size(removed) > 0").withColumn("f", F.try_element_at(F.filter("removed", weaker), F.lit(1)))
    return first.filter("f is not null").select("example_no", "path", "f.line", "f.text")


def findings_of(lines: DataFrame) -> DataFrame:
    """(example_no, seq, kind, path, line, detail): all findings of the scan, in the order of rules within a file.

    Findings that agree in kind, path and detail count once. The hits are written out once, so lines are numbered, masked and
    tested in one pass, however many rules look at them afterwards.
    """
    lines = written(all_hits(lines))
    detail = F.create_map(*[F.lit(x) for r, rule in {**REMOVED, **ADDED}.items() for x in (r, rule.says)])
    order = {r: i for i, r in enumerate(["R1", "R2", "R3", "R4", "R5", "R6", "R7", "R16", "R8", "R9", "R10", "R11", "R12", "R13", "R14", "R15", "R17"])}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    plain = net_removed(lines).unionByName(first_sinks(lines)).withColumn("what", detail[F.col("rule")])
    weak = bounds_weakened(lines).withColumns({"rule": F.lit("R16"), "kind": F.lit("diff_bounds_weakened"), "what": F.lit("bounds check weakened")})
    csrf = csrf_deleted(lines).drop("pos").withColumns({"rule": F.lit("R17"), "kind": F.lit("diff_csrf_removed"), "what": F.lit("CSRF protection deleted")})
    whole = plain.unionByName(weak).unionByName(csrf).select(
        "example_no", "path", "kind", "line", F.concat(F.col("what"), F.lit(": `"), clip(F.col("text")), F.lit("`")).alias("detail"), rank[F.col("rule")].alias("rank")
    )
    same = W.Window.partitionBy("example_no", "kind", "path", "detail").orderBy("rank", "line")
    return whole.withColumn("nth", F.row_number().over(same)).filter("nth = 1").select("example_no", F.col("rank").alias("seq"), "kind", "path", "line", "detail")


def flagged(lines: DataFrame) -> DataFrame:
    """(example_no) with any finding; no details are made and nothing is ranked."""
    lines = written(all_hits(lines))
    parts = [f(lines).select("example_no") for f in (net_removed, first_sinks, bounds_weakened, csrf_deleted)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.distinct()
