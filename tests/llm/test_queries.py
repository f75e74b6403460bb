import os

import duckdb
import pytest

from sluicebed.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    df, want = Q.queries()[name](spark, data), c.sql(Q.oracle_sql()[name])
    assert df.columns == want.columns
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))


COLUMNS = {
    "p1_found": ["example_no", "group_no"], "p2_found": ["example_no", "field", "path", "lang"], "p3_found": ["example_no", "field", "path"], "p4_found": ["category_no"], "p5_found": ["example_no", "field", "path"],
    "p6_found": ["example_no", "field", "path"], "p7_ids": ["doc_id", "ids"], "p8_found": ["source"], "p9_found": ["doc_id"],
}


#: Columns that name a row; a query gives each of them once.
KEYS = {
    "p1_splits": ["example_no"], "p1_report": ["split_name"], "p2_found": ["example_no", "field", "path", "lang"], "p2_shares": ["example_no", "field", "path", "lang"], "p3_found": ["example_no", "field", "path"],
    "p3_hand_written": ["example_no", "field", "path"], "p5_found": ["example_no", "field", "path"], "p5_rates": ["repo", "lang"], "p6_pieces": ["example_no", "field", "path", "piece_no"],
    "p7_ids": ["doc_id"], "p8_found": ["source"], "p8_report": ["source"], "p8_mix": ["doc_id"], "p9_found": ["doc_id"], "p9_rates": ["source"],
}


@pytest.fixture(scope="module")
def found(spark, data):
    """The rows of the queries without SQL."""
    return {name: Q.queries()[name](spark, data).toPandas() for name in sorted(set(Q.queries()) - set(Q.oracle_sql()))}


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


def test_columns_and_keys(found):
    assert set(found) <= set(KEYS)
    for name, rows in found.items():
        assert list(rows.columns) == COLUMNS.get(name, list(rows.columns))
        assert not rows.duplicated(KEYS[name]).any(), name


def test_splits_cover_all_rows(found, db):
    n = db.sql("SELECT count(*) FROM pull_example").fetchall()[0][0]
    assert len(found["p1_splits"]) == n == found["p1_report"].n_rows.sum()
    assert found["p1_splits"].groupby("group_no").split_name.nunique().max() == 1


def test_shares_of_a_file_add_up(found):
    shares = found["p2_shares"]
    assert shares.share.between(0, 1).all() and (shares.groupby(["example_no", "field", "path"]).share.sum() <= 1 + 1e-9).all()
    assert set(shares.lang) <= {"en", "de", "fr", "es", "pt", "ru", "zh", "ja"}


def test_hand_written_files_are_the_rest(found, db):
    key = ["example_no", "field", "path"]
    files = db.sql("SELECT example_no, 'files' AS field, unnest(map_keys(files)) AS path FROM pull_example UNION ALL SELECT example_no, 'repository_files', unnest(map_keys(repository_files)) FROM pull_example").df()
    keys = lambda t: set(map(tuple, t[key].to_numpy().tolist()))
    cases = {k for k in keys(found["p3_found"]) if k[1] != "files_changed"}
    assert keys(found["p3_hand_written"]) | cases == keys(files) and not keys(found["p3_hand_written"]) & cases


def test_rates_of_invalid_files(found):
    rates = found["p5_rates"]
    assert rates.n_invalid.sum() == len(found["p5_found"]) and (rates.n_deep <= rates.n_invalid).all() and ((rates.rate - rates.n_invalid / rates.n_files).abs() < 1e-9).all()


def test_pieces_are_numbered_and_keep_their_limit(found, db):
    limits = dict(db.sql("SELECT field_name, max_chars FROM piece_limit").fetchall())
    pieces = found["p6_pieces"]
    assert (pieces.piece.str.len() <= pieces.field.map(limits)).all() and ((pieces.stop - pieces.start) == pieces.piece.str.len()).all()
    assert (pieces.groupby(["example_no", "field", "path"]).piece_no.max() + 1 == pieces.groupby(["example_no", "field", "path"]).size()).all()


def test_tokens_of_all_documents(found, db):
    assert len(found["p7_ids"]) == db.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert found["p8_mix"].tokens.sum() == found["p7_ids"].ids.map(len).sum()


def test_the_mix_keeps_its_caps(found, db):
    caps = {r[0]: r[1] for r in db.sql("SELECT source, max_repeat FROM mix_target").fetchall()}
    report = found["p8_report"].set_index("source")
    assert (found["p8_mix"].copies <= max(caps.values())).all() and (found["p8_mix"].rate >= 0).all()
    assert set(found["p8_found"].source) == set(report.index[report.short])
    assert (report.own_reached <= report.own_tokens * report.index.map(caps) + 1e-6).all()


def test_rates_of_cut_texts(found, db):
    rates = found["p9_rates"]
    assert rates.n_docs.sum() == db.sql("SELECT count(*) FROM documents").fetchall()[0][0] and rates.n_cut.sum() >= len(found["p9_found"])
