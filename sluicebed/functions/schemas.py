"""Declared schemas: nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _b, _i, _l = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()
_f = T.StructField
TEXTS = T.MapType(_s, _s)

#: Raw metadata rows; keys may be missing. cwe_id is kept as JSON text where it is a list or object.
RAW_PULL = T.StructType(
    [_f(n, _s) for n in ("id", "attack", "axis3", "cwe_id", "framing", "pr_title", "pr_body", "diff", "code", "repo", "vuln_id", "source", "variant", "parent_id", "head_commit", "head_branch", "enrich_mode", "enrich_error")]
    + [_f("malicious", _b), _f("enriched", _b), _f("pr_number", _i), _f("files_changed", T.ArrayType(_s)), _f("failed_by", T.ArrayType(_s)), _f("files", TEXTS), _f("repository_files", TEXTS), _f("_corrupt_record", _s)]
)

PULL_COLUMNS = (
    "id", "malicious", "attack", "cwe_id", "framing", "pr_title", "pr_body", "diff", "files_changed", "files", "repository_files", "repo",
    "pr_number", "vuln_id", "failed_by", "enriched", "source", "variant", "parent_id", "head_commit", "head_branch",
)

FINDING = T.StructType([_f("kind", _s), _f("path", _s), _f("line", _i), _f("detail", _s), _f("witness", T.MapType(_s, _s))])
REPORT = T.StructType([_f("advisory", _b), _f("findings", T.ArrayType(FINDING)), _f("warnings", T.ArrayType(_s))])
EVIDENCE = T.StructType([_f("path", _s), _f("line", _i), _f("quote", _s)])
REVIEW = T.StructType([_f("verdict", _s), _f("grounded", _b), _f("reason", _s), _f("evidence", T.ArrayType(EVIDENCE)), _f("raw", _s)])
RESULT = T.StructType(
    [_f("id", _s), _f("malicious", _b), _f("mode", _s), _f("verdict", _s), _f("correct", _b)]
    + [_f(n, _s) for n in ("cwe_id", "framing", "variant", "parent_id", "source", "response")]
    + [_f("_corrupt_record", _s)]
)
ANALYSIS = T.StructType(
    [_f("id", _s), _f("cwe", _s), _f("malicious", _b), _f("changed_ext", T.ArrayType(_s)), _f("advisory", _b), _f("findings", T.ArrayType(FINDING)), _f("warnings", T.ArrayType(_s))]
)

#: The source that the tables give to records that name none (fixed value).
DEFAULT_SOURCE = "sevra"
#: Severity of verdicts, the worst last (fixed values).
VERDICTS = ("APPROVE", "COMMENT", "UNKNOWN", "BLOCK")
#: Finding kinds that make a report advisory (fixed values).
ADVISORY_KINDS = (
    "taint", "symbolic", "diff_sink", "diff_sanitizer_removed", "diff_bounds_weakened", "diff_csrf_removed", "diff_authz_removed",
)
SUPPORTED_CWES = ("cwe22", "cwe78", "cwe79", "cwe89", "cwe94", "cwe125", "cwe352", "cwe416", "cwe787", "cwe862")
#: Suffixes and languages (fixed values).
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".c": "c", ".h": "c",
    ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".java": "java", ".php": "php", ".go": "go", ".rb": "ruby",
    ".rs": "rust", ".cs": "csharp", ".sh": "bash", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
}
