"""Normalizing, filtering, joining and sampling pull-request records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sluicebed.functions.names import repo_name
from sluicebed.functions.schemas import DEFAULT_SOURCE, LANGUAGES, PULL_COLUMNS


def blank_to(c: str | Column, default: str | None) -> Column:
    """c, or default where it is null or empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(F.regexp_replace(c, r"^(?U:\s)+", ""), r"(?U:\s)+$", "")


def cwe_label(c: Column) -> Column:
    """A weakness label given as string, JSON list or JSON object (its keys): sorted and joined by commas."""
    many = F.coalesce(F.from_json(c, "array<string>"), F.map_keys(F.from_json(c, "map<string,string>")))
    return F.when(strip(c).rlike(r"^[\[{]"), F.array_join(F.array_sort(many), ",")).otherwise(F.nullif(c, F.lit("")))


def cwe_plain(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("-"), F.lit(""))


def cwe_digits(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit(""))


def cwe_bucket(c: Column) -> Column:
    """The first of 78, 79, 89 and 94 among the numbers of a label, else unknown."""
    numbers = F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)
    out = F.lit("unknown")
    for n in reversed(("78", "79", "89", "94")):
        out = F.when(F.array_contains(numbers, n), F.lit(f"cwe{n}")).otherwise(out)
    return out


def canonical(raw: DataFrame) -> DataFrame:
    """Raw metadata rows to the 21 columns of a record.

    Empty strings, zero and empty collections take the default like missing ones; source, variant and repository_files
    take it only where the key is missing. The id of a row without one is "<cwe>:<repo>:pr<number>:<vuln>".
    """
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    files = F.coalesce("files", F.create_map().cast("map<string,string>"))
    changed = F.coalesce("files_changed", F.array().cast("array<string>"))
    number = F.nullif("pr_number", F.lit(0))
    code = F.nullif("code", F.lit(""))
    first = F.coalesce(F.try_element_at(changed, F.lit(1)), F.lit("snippet.py"))
    label = F.coalesce(cwe_label(F.col("cwe_id")), F.col("cwe_dir"))
    made = F.concat(none(F.col("cwe_dir")), F.lit(":"), blank_to("repo", "unknown"), F.lit(":pr"), none(number), F.lit(":"), blank_to("vuln_id", "unknown"))
    axis = F.nullif("axis3", F.lit(""))
    one = raw.select(
        F.coalesce(F.nullif("id", F.lit("")), made).alias("id"),
        "malicious",
        F.when(F.col("malicious"), F.coalesce(axis, F.nullif("attack", F.lit("")))).alias("attack"),
        label.alias("cwe_id"),
        F.coalesce(axis, F.nullif("framing", F.lit(""))).alias("framing"),
        *(blank_to(c, "").alias(c) for c in ("pr_title", "pr_body", "diff")),
        changed.alias("files_changed"),
        F.when((F.size(files) == 0) & code.isNotNull(), F.map_from_arrays(F.array(first), F.array(code))).otherwise(files).alias("files"),
        F.coalesce("repository_files", F.create_map().cast("map<string,string>")).alias("repository_files"),
        blank_to("repo", "unknown").alias("repo"),
        number.alias("pr_number"),
        blank_to("vuln_id", "unknown").alias("vuln_id"),
        F.coalesce("failed_by", F.array().cast("array<string>")).alias("failed_by"),
        F.coalesce("enriched", F.lit(False)).alias("flag"),
        F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("source"),
        F.coalesce("variant", F.lit("original")).alias("variant"),
        F.nullif("parent_id", F.lit("")).alias("parent_id"),
        F.nullif("head_commit", F.lit("")).alias("head_commit"),
        F.nullif("head_branch", F.lit("")).alias("head_branch"),
    )
    return one.withColumn("enriched", F.col("flag") | (F.size("files") > 0) | (F.col("diff") != "")).select(*PULL_COLUMNS)


def hard_split(pulls: DataFrame) -> DataFrame:
    """Malicious rows only if some reviewer failed on them; benign rows all."""
    return pulls.filter(~F.col("malicious") | (F.size(F.coalesce("failed_by", F.array().cast("array<string>"))) > 0))


def with_code(pulls: DataFrame) -> DataFrame:
    return pulls.filter((F.coalesce(F.size("files"), F.lit(0)) > 0) | (F.coalesce("diff", F.lit("")) != ""))


def incomplete(pulls: DataFrame, columns: tuple[str, ...] = ("pr_title", "diff")) -> DataFrame:
    """Rows with a blank value in one of the columns."""
    blank = F.lit(False)
    for c in columns:
        blank = blank | (F.coalesce(strip(F.col(c)), F.lit("")) == "")
    return pulls.filter(blank)


def require_complete(pulls: DataFrame, columns: tuple[str, ...] = ("pr_title", "diff"), show: int = 5) -> DataFrame:
    """pulls, or ValueError that names the first rows with blank values and counts the rest."""
    bad = incomplete(pulls, columns)
    ids = [r[0] for r in bad.select("id").orderBy("id").limit(show + 1).collect()]
    if ids:
        more = bad.count() - min(show, len(ids))
        raise ValueError(f"blank {' or '.join(columns)}: {', '.join(map(str, ids[:show]))}" + (f" +{more} more" if more > 0 else ""))
    return pulls


def require_unique(pulls: DataFrame, keys: tuple[str, ...] = ("id", "malicious")) -> DataFrame:
    twice = duplicate_keys(pulls, keys).limit(1).collect()
    if twice:
        raise ValueError(f"repeated key {tuple(twice[0])[: len(keys)]}")
    return pulls


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def review_text(pulls: DataFrame) -> DataFrame:
    """(example_no, review_text): four headed sections parted by blank lines."""
    part = lambda head, c: F.concat(F.lit(f"{head}:\n"), F.coalesce(c, F.lit("")))
    changed = F.array_join(F.coalesce("files_changed", F.array().cast("array<string>")), "\n")
    sections = [part("Title", F.col("pr_title")), part("Description", F.col("pr_body")), part("Changed files", changed), part("Diff", F.col("diff"))]
    return pulls.select("example_no", F.concat_ws("\n\n", *sections).alias("review_text"))


def suffix(path: Column) -> Column:
    """The last suffix of a path's name, with its dot, else empty."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1)


def language(path: Column) -> Column:
    """The language of a path's suffix, or null."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return known[F.lower(suffix(path))]


def changed_extensions(pulls: DataFrame) -> DataFrame:
    """(example_no, changed_ext): the distinct suffixes of the changed files, sorted."""
    each = F.transform(F.coalesce("files_changed", F.array().cast("array<string>")), lambda p: suffix(p))
    return pulls.select("example_no", F.array_sort(F.array_distinct(F.filter(each, lambda x: x.isNotNull() & (x != "")))).alias("changed_ext"))


def overlay(pulls: DataFrame, changed_only: bool = False) -> DataFrame:
    """(example_no, path, source): repository context with changed files on top, or the changed files alone.

    The maps are merged within the row; no shuffle.
    """
    empty = F.create_map().cast("map<string,string>")
    files, context = F.coalesce("files", empty), F.coalesce("repository_files", empty)
    kept = F.map_filter(context, lambda k, v: ~F.coalesce(F.map_contains_key(files, k), F.lit(False)))
    return pulls.select("example_no", F.explode(files if changed_only else F.map_concat(kept, files)).alias("path", "source"))


def python_context(pulls: DataFrame) -> DataFrame:
    """(example_no, path): Python files of the repository that the change doesn't hold."""
    empty = F.create_map().cast("map<string,string>")
    held = F.map_keys(F.coalesce("files", empty))
    rest = F.filter(F.map_keys(F.coalesce("repository_files", empty)), lambda p: (p.endswith(".py") | p.endswith(".pyi")) & ~F.array_contains(held, p))
    return pulls.select("example_no", F.explode(rest).alias("path"))


def look_up_repository(pulls: DataFrame, repositories: DataFrame) -> DataFrame:
    """(example_no, repository_id, error): each row's repository by owner and name without regard to case or notation.

    A row without a match stays, with an error. The first repository of a name counts. The repository side may grow with
    the data, so the join is left to the planner; rows without a name are spread over a salt and never meet in one task.
    """
    known = repositories.select("id", repo_name(F.concat_ws("/", "owner_name", "name")).alias("repo_key")).groupBy("repo_key").agg(F.min("id").alias("repository_id"))
    keyed = pulls.select("example_no", repo_name(F.col("repo")).alias("key"))
    salted = keyed.withColumn("repo_key", F.coalesce("key", F.concat(F.lit("?"), F.pmod("example_no", F.lit(64)).cast("string"))))
    return salted.join(known, "repo_key", "left").select(
        "example_no", "repository_id", F.when(F.col("repository_id").isNull(), F.lit("no such repository")).alias("error")
    )


def numbered(rows: DataFrame) -> DataFrame:
    """rows with example_no, a hash of the key (id, malicious); records that share a number are an error."""
    out = rows.withColumn("example_no", F.xxhash64("id", "malicious"))
    twice = out.groupBy("example_no").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two records share the number {twice[0][0]}")
    return out


def balanced_sample(pulls: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """Benign and malicious records in turns until limit; when one side ends the other goes on.

    The order within a side is by md5 of seed and row number. Only the first `limit` of each side are ranked: they are cut
    off by a distributed top-k before any window sees them.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("example_no").cast("string")))
    drawn = pulls.select("example_no", "malicious", key.alias("key"))
    sides = [drawn.filter(F.col("malicious") == m).orderBy("key").limit(limit) for m in (False, True)]
    ranked = [s.withColumn("turn", F.row_number().over(W.Window.orderBy("key"))) for s in sides]
    both = ranked[0].unionByName(ranked[1])
    return both.orderBy("turn", "malicious").limit(limit).select("example_no", "malicious", "turn")


def pending(pulls: DataFrame, results: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """(id, malicious, mode) of the work that no result covers yet."""
    keys = pulls.select("id", "malicious").filter("id is not null").distinct()
    work = keys.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    return work.join(results.select("id", "malicious", "mode").distinct(), ["id", "malicious", "mode"], "left_anti")
