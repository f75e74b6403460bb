"""Canonical forms of names that come in several spellings.

Every function takes a string column and gives null for null, blank and placeholder values. Names equal up to letter
case, outer blanks and the choice of "-", "_" or nothing as separator get one form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for "not known", in lower case, without separators.
PLACEHOLDERS = (
    "unknown", "na", "n/a", "none", "null", "nil", "nan", "undefined", "unspecified", "notknown", "notavailable",
    "notapplicable", "notset", "missing", "tbd", "tba", "todo", "unk", "empty", "blank", "void", "?", "??", "???", ".",
)


def squeezed(c: Column) -> Column:
    """Lower case, without outer blanks, "-" and "_"; "n/a" reads "na"."""
    low = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    return F.when(low == "n/a", F.lit("na")).otherwise(F.regexp_replace(low, "[-_]", ""))


def known(c: Column) -> Column:
    """Null where the squeezed name c is blank or a placeholder."""
    bare = F.regexp_replace(c, r"[\s()<>\[\]\"']", "")
    return F.when((bare == "") | bare.isin(*PLACEHOLDERS), None).otherwise(c)


def plain_name(c: Column) -> Column:
    """One form of a name such as vuln_id, framing or source."""
    return known(squeezed(c))


def repo_name(c: Column) -> Column:
    """owner/name of a repository given plainly or as an address of any form (scheme, host, scp form, ".git", slashes)."""
    s = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    s = F.when(s == "n/a", F.lit("na")).otherwise(s)
    s = F.regexp_replace(s, r"[?#].*$", "")
    s = F.regexp_replace(s, r"^[a-z][a-z0-9+.\-]*://[^/]*/+", "")
    s = F.regexp_replace(s, r"^[^/:]+:/*", "")
    s = F.regexp_replace(s, r"^[^/]*\.[^/]*/+(?=[^/]+/+[^/])", "")
    s = F.regexp_replace(s, r"^/+|/+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\.git$", ""), r"/+$", "")
    s = F.regexp_replace(s, r"^([^/]+)/+([^/]+)/.*$", "$1/$2")
    s = F.regexp_replace(F.regexp_replace(s, r"\.git$", ""), "[-_]", "")
    owner, name = F.split_part(s, F.lit("/"), F.lit(1)), F.split_part(s, F.lit("/"), F.lit(-1))
    return F.when(known(owner).isNull() & known(name).isNull(), None).otherwise(s)


def cwe_codes(c: Column) -> Column:
    """cweN of a weakness given as code, bare number or list; several codes are sorted and joined by commas."""
    parts = F.split(F.regexp_replace(F.lower(c), r"[\[\](){}\"'\s]", ""), "[,;|]")
    each = F.transform(
        parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"[-_:]", ""), r"^(?:cwe)?0*([0-9]+)$", "cwe$1")
    )
    kept = F.array_sort(F.array_distinct(F.filter(each, lambda p: known(p).isNotNull())))
    return F.when(F.size(kept) > 0, F.array_join(kept, ","))
