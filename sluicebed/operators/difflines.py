"""Unified diffs as line tables: sections, hunks, numbering, anchors and context.

All of it is windows over (example_no, pos). One exchange by example_no serves every window of a plan, and a hash by that
unique key cannot be skewed except by one giant diff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Line ends as str.splitlines knows them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
HUNK = r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
CONTEXT = 5


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, raw): the lines of a text; a final line end makes no further line."""
    return (
        df.filter(F.col(text).isNotNull() & (F.col(text) != ""))
        .select(key, F.posexplode(F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END)).alias("pos", "raw"))
    )


def sections(pulls: DataFrame) -> DataFrame:
    """(example_no, pos, raw, section_no, path): every diff line with its section.

    A section starts at a "+++ " line and ends before "diff --git " or the next "+++ "; lines outside have no path, and a
    section whose new file is /dev/null has none either.
    """
    order = W.Window.partitionBy("example_no").orderBy("pos")
    lines = lines_of(pulls, "example_no", "diff")
    head = F.col("raw").startswith("+++ ")
    mark = head | F.col("raw").startswith("diff --git ")
    name = F.regexp_replace(F.trim(F.expr("substring(raw, 5)")), "^b/", "")
    marked = lines.withColumns({"mark": mark, "named": F.when(head, name)})
    cut = marked.withColumn("section_no", F.sum(F.col("mark").cast("int")).over(order))
    section = W.Window.partitionBy("example_no", "section_no").orderBy("pos")
    path = F.first("named").over(section)
    return cut.withColumn("path", F.when(path != "/dev/null", path)).select("example_no", "pos", "raw", "section_no", "path", "mark")


def numbered(pulls: DataFrame) -> DataFrame:
    """(example_no, pos, path, hunk_no, op, old_line, new_line, text) of the lines in sections.

    op is "+", "-", " " or "@". Only full hunk headers set the numbers; they go on over section heads until the next one.
    Added lines that begin with "++" and removed ones that begin with "--" count as what they are. A marker of a missing
    line end advances both numbers, as a context line does.
    """
    order = W.Window.partitionBy("example_no").orderBy("pos")
    in_section = F.col("path").isNotNull() & ~F.col("mark")
    at = F.col("raw").startswith("@@")
    full = in_section & at & F.col("raw").rlike(HUNK)
    plus = in_section & ~at & F.col("raw").startswith("+")
    minus = in_section & ~at & F.col("raw").startswith("-")
    other = in_section & ~at & ~plus & ~minus
    start = lambda g: F.when(full, F.regexp_extract("raw", HUNK, g).cast("long"))
    step = sections(pulls).withColumns(
        {
            "head": full.cast("int"),
            "op": F.when(plus, "+").when(minus, "-").when(other, " ").when(full, "@"),
            "old_start": start(1),
            "new_start": start(2),
            "old_step": (minus | other).cast("int"),
            "new_step": (plus | other).cast("int"),
        }
    )
    step = step.withColumn("hunk_no", F.sum("head").over(order))
    hunk = W.Window.partitionBy("example_no", "hunk_no").orderBy("pos")
    line = lambda side: F.first(f"{side}_start").over(hunk) + F.sum(f"{side}_step").over(hunk) - F.col(f"{side}_step")
    return step.withColumns({"old_line": line("old"), "new_line": line("new")}).filter("op is not null").select(
        "example_no",
        "pos",
        "path",
        "hunk_no",
        "op",
        F.when(F.col("op") != "+", F.col("old_line")).alias("old_line"),
        F.when(F.col("op") != "-", F.col("new_line")).alias("new_line"),
        F.when(F.col("op") == "@", F.col("raw"))
        .when(F.col("raw").startswith("\\"), F.col("raw"))
        .otherwise(F.expr("substring(raw, 2)"))
        .alias("text"),
    )


def hunk_texts(pulls: DataFrame) -> DataFrame:
    """(example_no, path, hunk_no, n_lines, hunk): the text of each hunk, header first."""
    own = W.Window.partitionBy("example_no", "section_no").orderBy("pos")
    starts = F.col("raw").startswith("@@ ").cast("int")
    held = (
        sections(pulls)
        .filter("path is not null and not mark")
        .withColumn("hunk_no", F.sum(starts).over(own))
        .filter("hunk_no > 0")
    )
    return held.groupBy("example_no", "section_no", "path", "hunk_no").agg(
        F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n").alias("hunk"),
    )


def anchors(pulls: DataFrame) -> DataFrame:
    """(example_no, path, anchor): hunk starts, added lines and the places of removed lines, in new line numbers."""
    own = W.Window.partitionBy("example_no", "section_no").orderBy("pos")
    header = F.col("raw").startswith("@@ ")
    start = F.when(header, F.nullif(F.regexp_extract("raw", HUNK, 2), F.lit("")).cast("long"))
    lines = sections(pulls).filter("path is not null and not mark").withColumns({"header": header.cast("int"), "start": start})
    hunk = W.Window.partitionBy("example_no", "section_no", "hunk_no").orderBy("pos")
    step = (F.col("raw").startswith("+") | F.col("raw").startswith(" ")).cast("int")
    placed = lines.withColumn("hunk_no", F.sum("header").over(own)).withColumn("step", F.when(F.col("header") == 1, 0).otherwise(step))
    placed = placed.withColumn("anchor", F.first("start").over(hunk) + F.sum("step").over(hunk) - F.col("step"))
    chosen = (F.col("header") == 1) | F.col("raw").startswith("+") | F.col("raw").startswith("-")
    return placed.filter(chosen & F.col("anchor").isNotNull()).select("example_no", "path", "anchor").distinct()


def source_lines(files: DataFrame) -> DataFrame:
    """(example_no, path, line, text) of files(example_no, path, source)."""
    return (
        files.filter("source is not null and source != ''")
        .select("example_no", "path", F.posexplode(F.split(F.regexp_replace("source", rf"(?:{LINE_END})\z", ""), LINE_END)).alias("pos", "text"))
        .select("example_no", "path", (F.col("pos") + 1).cast("long").alias("line"), "text")
    )


def _near_lines(pulls: DataFrame, around: int) -> DataFrame:
    """(example_no, path, lines, near): each changed file's lines and, where it has anchors, the line numbers around them.

    Anchors are gathered by file first, so the band join is one equi join of files, and only lines that are kept are ever
    made into rows.
    """
    by_file = anchors(pulls).groupBy("example_no", "path").agg(F.collect_set("anchor").alias("anchors"))
    near = F.array_distinct(F.flatten(F.transform("anchors", lambda a: F.sequence(F.greatest(F.lit(1), a - around), F.greatest(F.lit(1), a + around)))))
    files = pulls.select("example_no", F.explode("files").alias("path", "source")).filter("source is not null and source != ''")
    lines = F.split(F.regexp_replace("source", rf"(?:{LINE_END})\z", ""), LINE_END)
    return files.join(by_file, ["example_no", "path"], "left").select("example_no", "path", lines.alias("lines"), near.alias("near"))


def _rows(kept: DataFrame) -> DataFrame:
    chosen = F.filter("near", lambda n: n <= F.size("lines"))
    return kept.select("example_no", "path", "lines", F.explode(chosen).alias("line")).select(
        "example_no", "path", "line", F.element_at("lines", F.col("line").cast("int")).alias("text")
    )


def anchor_context(pulls: DataFrame, around: int = CONTEXT) -> DataFrame:
    """(example_no, path, line, text): the lines of changed files within `around` lines of an anchor."""
    return _rows(_near_lines(pulls, around).filter("near is not null"))


def review_lines(pulls: DataFrame, suspicious: DataFrame | None = None, around: int = CONTEXT) -> DataFrame:
    """(example_no, line_id, path, line, quote): numbered lines for the auditor.

    Lines of a file with hunks come from the hunks' context, files without any come whole; suspicious files first, then by
    path. Blank lines get no number; quotes are the stripped first 80 characters.
    """
    whole = F.sequence(F.lit(1).cast("long"), F.size("lines").cast("long"))
    chosen = _rows(_near_lines(pulls, around).withColumn("near", F.coalesce("near", whole)))
    if suspicious is not None:
        marks = suspicious.select("example_no", "path", F.lit(0).alias("rank")).distinct()
        chosen = chosen.join(marks, ["example_no", "path"], "left")
    else:
        chosen = chosen.withColumn("rank", F.lit(None).cast("int"))
    order = W.Window.partitionBy("example_no").orderBy(F.coalesce("rank", F.lit(1)), "path", "line")
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return (
        chosen.withColumn("quote", F.substring(text, 1, 80))
        .filter("quote != ''")
        .select("example_no", F.concat(F.lit("L"), F.row_number().over(order).cast("string")).alias("line_id"), "path", "line", "quote")
    )


def files_and_hunks(pulls: DataFrame) -> DataFrame:
    """(example_no, path, n_hunks, full): each changed file with its hunks; full where it has none and is reviewed whole."""
    files = pulls.select("example_no", F.explode("files").alias("path", "source")).select("example_no", "path")
    n = hunk_texts(pulls).groupBy("example_no", "path").agg(F.count("*").alias("n_hunks"))
    return files.join(n, ["example_no", "path"], "left").select(
        "example_no", "path", F.coalesce("n_hunks", F.lit(0)).alias("n_hunks"), F.col("n_hunks").isNull().alias("full")
    )
