import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sluicebed.plans import catalog

SQL = catalog.oracle_sql()


def value(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(value(r[i]) for i in order)) for r in data)


@pytest.fixture(scope="session")
def db(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, db, name):
    df = catalog.queries()[name](spark, data)
    want = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.fixture(scope="module")
def found(spark, data):
    """The rows of the queries without SQL."""
    return {name: catalog.queries()[name](spark, data).toPandas() for name in sorted(set(catalog.queries()) - set(SQL))}


def test_masked_hits_are_hits(spark, data, found):
    """Masking takes hits away and adds none, and what is flagged agrees with the findings."""
    key = ["example_no", "path", "pos", "op", "rule"]
    raw = catalog.queries()["raw_rule_hits"](spark, data).toPandas()
    if "path" not in raw:
        key.remove("path")
    keys = lambda t: set(map(tuple, t[key].to_numpy().tolist()))
    assert keys(found["rule_hits"]) and keys(found["rule_hits"]) <= keys(raw)
    assert set(found["net_removed_guards"].rule) <= {f"R{i}" for i in range(1, 8)} and set(found["first_sinks"].rule) <= {f"R{i}" for i in range(8, 16)}


def test_rates_count_all_rows(found, db):
    rates = found["advisory_rates"]
    assert rates.malicious_n.sum() + rates.benign_n.sum() == db.sql("SELECT count(*) FROM pull_example").fetchall()[0][0]
    flagged = (rates.malicious_n * rates.tpr.fillna(0) + rates.benign_n * rates.fpr.fillna(0)).sum()
    assert round(flagged) == found["diff_findings"].example_no.nunique()


def test_stripping_keeps_lengths(found, db):
    sizes = db.sql("SELECT example_no, e.key AS path, length(e.value) AS n FROM (SELECT example_no, unnest(map_entries(files)) AS e FROM pull_example) WHERE e.value IS NOT NULL").df()
    both = found["stripped_sources"].merge(sizes, on=["example_no", "path"], how="outer")
    assert (both.n == both.n_chars).all()


def test_findings_lie_in_their_files(found, db):
    sizes = db.sql("""SELECT example_no, e.key AS path, len(string_split(e.value, chr(10))) AS n FROM (SELECT example_no, unnest(map_entries(files)) AS e FROM pull_example
      UNION ALL SELECT example_no, unnest(map_entries(repository_files)) FROM pull_example) WHERE e.value IS NOT NULL""").df()
    most = sizes.groupby(["example_no", "path"]).n.max()
    for name in ("multilang_scan", "python_semantics"):
        rows = found[name].dropna(subset=["line"]) if "line" in found[name] else found[name].head(0)
        assert all(1 <= r.line <= most[r.example_no, r.path] for r in rows.itertuples()), name


def test_reviews_cover_all_rows(found, db):
    n = db.sql("SELECT count(*) FROM pull_example").fetchall()[0][0]
    for name in ("baseline_reviews", "multi_agent_reviews", "hybrid_reviews"):
        assert len(found[name]) == n and set(found[name].verdict) <= {"APPROVE", "COMMENT", "BLOCK", "UNKNOWN"}, name
    assert len(found["analysis_reports"]) <= n
    assert len(found["review_calls"]) == n and (found["review_calls"].n_calls >= 1).all()


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
