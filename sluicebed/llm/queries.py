"""Queries of the problems of TESTDATA.md: name -> callable(spark, folder of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebed.llm import category_sample as cs
from sluicebed.llm import authorship, cut_texts, mixing, pieces, prose, syntax, tokens
from sluicebed.llm import related_splits as rs
from sluicebed.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rs.mixed_groups(table(spark, d, "pull_example"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return rs.related_splits(table(spark, d, "pull_example"), table(spark, d, "split_target"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return rs.split_report(p1_splits(spark, d), table(spark, d, "split_target"))


def p1_checked(spark: SparkSession, d: str) -> DataFrame:
    return rs.checked_splits(p1_splits(spark, d), table(spark, d, "pull_example"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_shares(spark, d).select("example_no", "field", "path", "lang")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return prose.prose(table(spark, d, "pull_example"), table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cases = authorship.not_by_hand(table(spark, d, "pull_example"), table(spark, d, "known_library"))
    return cases.select("example_no", "field", "path")


def p3_hand_written(spark: SparkSession, d: str) -> DataFrame:
    kept = authorship.hand_written(table(spark, d, "pull_example"), table(spark, d, "known_library"))
    return kept.select("example_no", "field", "path", F.length("source").alias("n_chars"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    report = cs.sample_report(table(spark, d, "pull_example"), table(spark, d, "sample_target"))
    return report.filter("short > 0").select("category_no")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return cs.sample_report(table(spark, d, "pull_example"), table(spark, d, "sample_target"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return cs.category_sample(table(spark, d, "pull_example"), table(spark, d, "sample_target"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "pull_example")).select("example_no", "field", "path")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, d, "pull_example"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.cut_values(table(spark, d, "pull_example"), table(spark, d, "piece_limit"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "pull_example"), table(spark, d, "piece_limit"))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    return pieces.checked_pieces(table(spark, d, "pull_example"), table(spark, d, "piece_limit"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decoded(p7_ids(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).filter("short").select("source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts.cut_texts(table(spark, d, "documents"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts.cut_rates(table(spark, d, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


_REPO = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(lower(repo), '^\s+|\s+$', '', 'g'), '[?#].*$', ''), '^[a-z][a-z0-9+.-]*://[^/]*/+', ''), '^[^/:]+:/*', ''), '^[^/]*\.[^/]*/+([^/]+/+[^/].*)$', '\1'),
  '^/+|/+$', '', 'g'), '\.git$', ''), '/+$', ''), '^([^/]+)/+([^/]+)/.*$', '\1/\2'), '[-_]', '', 'g')"""
_PLACES = "('', 'unknown', 'na', 'n/a', 'none', 'null', 'nil', 'nan', 'undefined', 'unspecified', 'notknown', 'notavailable', 'notapplicable', 'notset', 'missing', 'tbd', 'tba', 'todo', 'unk', 'empty', 'blank', 'void', '?', '??', '???', '.')"
_NAME = "regexp_replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '[-_]', '', 'g')"
_CWE = "regexp_replace(regexp_replace(lower({0}), '[\\[\\]\"''\\s_-]', '', 'g'), '^(?:cwe)?0*([0-9]+)$', 'cwe\\1')"


def _quota_sql(rounds: int) -> str:
    """SQL of the bounded apportionment: in each round categories beyond a bound are fixed there; rounds: at least as many as
    categories."""
    out = ["""a0 AS (SELECT *, least(min_rows, n) AS lo, n AS hi, CAST(NULL AS BIGINT) AS q, CAST(floor(size * (SELECT sum(share_pct) FROM c) / greatest(100, (SELECT sum(share_pct) FROM c))) AS BIGINT) AS seats FROM c)"""]
    for i in range(rounds):
        out.append(
            f"""b{i} AS (SELECT *, seats - coalesce(sum(q) OVER (), 0) AS rem, coalesce(sum(share_pct) FILTER (q IS NULL) OVER (), 0) AS w FROM a{i}),
          d{i} AS (SELECT *, sum(greatest(0, rem * share_pct - hi * w)) FILTER (q IS NULL) OVER () AS excess, sum(greatest(0, lo * w - rem * share_pct)) FILTER (q IS NULL) OVER () AS lack FROM b{i}),
          a{i + 1} AS (SELECT category_no, share_pct, min_rows, n, size, lo, hi, CASE WHEN q IS NOT NULL OR w = 0 THEN q WHEN excess >= lack AND rem * share_pct > hi * w THEN hi
            WHEN excess < lack AND rem * share_pct < lo * w THEN lo END AS q, seats FROM d{i})"""
        )
    out.append(
        f"""z AS (SELECT *, seats - coalesce(sum(q) OVER (), 0) AS rem, coalesce(sum(share_pct) FILTER (q IS NULL) OVER (), 0) AS w FROM a{rounds}),
          y AS (SELECT *, CASE WHEN q IS NOT NULL THEN q WHEN w = 0 THEN least(lo, hi) ELSE rem * share_pct // w END AS low, CASE WHEN q IS NULL AND w > 0 THEN rem * share_pct % w ELSE -1 END AS over FROM z),
          x AS (SELECT *, rem - sum(low) FILTER (q IS NULL) OVER () AS spare, row_number() OVER (ORDER BY over DESC, category_no) AS rank FROM y),
          quota AS (SELECT category_no, share_pct, n, greatest(min_rows, CAST(ceil(share_pct * size / 100) AS BIGINT)) AS need, CAST(low + CASE WHEN over >= 0 AND rank <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM x)"""
    )
    return ",\n          ".join(out)


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express over whole tables."""
    vuln, framing = _NAME.format("vuln_id"), _NAME.format("framing")
    counted = f"""f AS (SELECT id, malicious, {_CWE.format("cwe_id")} AS cwe, {framing} AS framing FROM pull_example WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY example_no) = 1),
          t AS (SELECT category_no, malicious, {_CWE.format("cwe_id")} AS cwe, {framing} AS framing, share_pct, min_rows FROM sample_target), m AS (SELECT category_no, id FROM t JOIN f USING (malicious, cwe, framing)),
          c AS (SELECT t.category_no, any_value(share_pct) AS share_pct, any_value(min_rows) AS min_rows, count(m.id) AS n, CAST(floor((SELECT count(*) FROM f) / 5) AS BIGINT) AS size FROM t LEFT JOIN m USING (category_no) GROUP BY t.category_no)"""
    return {
        "p1_checked": f"""WITH r AS (SELECT CASE WHEN {_REPO} NOT IN {_PLACES} THEN {_REPO} END AS repo FROM pull_example)
          SELECT repo, count(*) AS n_rows, 1 AS n_splits FROM r WHERE repo IS NOT NULL GROUP BY repo""",
        "p4_report": f"""WITH {counted}, {_quota_sql(20)}
          SELECT category_no, share_pct, need, n AS available, quota, greatest(0, need - n) AS short, CASE WHEN sum(quota) OVER () > 0 THEN 100.0 * quota / sum(quota) OVER () ELSE 0.0 END AS reached_pct FROM quota""",
        "p4_sample": f"""WITH {counted}, {_quota_sql(20)}
          SELECT m.id, m.category_no FROM m JOIN quota USING (category_no) QUALIFY row_number() OVER (PARTITION BY m.category_no ORDER BY md5('42:' || m.id), m.id) <= quota""",
        "p6_checked": """WITH v AS (SELECT example_no, 'diff' AS field, '' AS path, diff AS value FROM pull_example UNION ALL SELECT example_no, 'files', e.key, e.value FROM (SELECT example_no, unnest(map_entries(files)) AS e FROM pull_example))
          SELECT example_no, field, path, md5(value) AS text, true AS fits, true AS laps FROM v JOIN piece_limit ON field = field_name WHERE length(value) > max_chars""",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p1_found": f"""WITH RECURSIVE n AS (SELECT example_no, id, parent_id, CASE WHEN {_REPO} NOT IN {_PLACES} THEN {_REPO} END AS repo, CASE WHEN {vuln} NOT IN {_PLACES} THEN {vuln} END AS vuln FROM pull_example),
          k AS (SELECT example_no, 'i:' || id AS key FROM n WHERE trim(id) <> '' UNION SELECT example_no, 'i:' || parent_id FROM n WHERE trim(parent_id) <> '' UNION SELECT example_no, 'r:' || repo FROM n WHERE repo IS NOT NULL
            UNION SELECT example_no, 'v:' || vuln FROM n WHERE vuln IS NOT NULL),
          s AS (SELECT DISTINCT example_no AS a, min(example_no) OVER (PARTITION BY key) AS b FROM k), e AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
          r AS (SELECT example_no AS x, example_no AS g FROM n UNION SELECT e.b, r.g FROM r JOIN e ON r.x = e.a WHERE r.g < e.b),
          g AS (SELECT x AS example_no, min(g) AS group_no FROM r GROUP BY x),
          keep AS (SELECT group_no FROM g JOIN n USING (example_no) GROUP BY group_no HAVING count(*) > 1 AND (count(repo) < count(*) OR count(DISTINCT repo) > 1))
          SELECT example_no, group_no FROM g WHERE group_no IN (SELECT group_no FROM keep)""",
        "p4_found": f"""WITH f AS (SELECT id, malicious, {_CWE.format("cwe_id")} AS cwe, {framing} AS framing FROM pull_example WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY example_no) = 1),
          t AS (SELECT category_no, malicious, {_CWE.format("cwe_id")} AS cwe, {framing} AS framing, share_pct, min_rows FROM sample_target), c AS (SELECT t.category_no, any_value(share_pct) AS share_pct, any_value(min_rows) AS min_rows, count(f.id) AS n
            FROM t LEFT JOIN f ON f.malicious = t.malicious AND f.cwe = t.cwe AND f.framing = t.framing GROUP BY t.category_no)
          SELECT category_no FROM c WHERE n < greatest(min_rows, ceil(share_pct * floor((SELECT count(*) FROM f) / 5) / 100))""",
        "p6_found": """WITH v AS (SELECT example_no, 'diff' AS field, '' AS path, diff AS value FROM pull_example UNION ALL SELECT example_no, 'files', e.key, e.value FROM (SELECT example_no, unnest(map_entries(files)) AS e FROM pull_example))
          SELECT example_no, field, path FROM v JOIN piece_limit ON field = field_name WHERE length(value) > max_chars""",
    }
