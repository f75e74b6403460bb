import pytest
from pyspark.sql import functions as F

from sluicebed.functions.names import cwe_codes, plain_name, repo_name

SAME = ["harborline/atlas-core", " Harborline/Atlas_Core ", "https://git.example.test/harborline/atlas-core", "git@git.example.test:harborline/atlas-core.git",
        "ssh://git@h.x:22/harborline/atlas-core.git/", "git.example.test/harborline/atlas-core/", "HARBORLINE/ATLASCORE", "http://x/harborline/atlas-core/tree/main"]
NOTHING = ["unknown", "N/A", "n/a", " ", "", "none", None, "Unknown", "NULL"]


def one(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_repositories_in_any_notation_are_one(spark):
    assert set(one(spark, SAME, repo_name)) == {"harborline/atlascore"}


@pytest.mark.parametrize("f", [repo_name, plain_name, cwe_codes])
def test_placeholders_are_missing(spark, f):
    assert set(one(spark, NOTHING, f)) == {None}


def test_weaknesses(spark):
    assert one(spark, ["cwe79", '["cwe79"]', "CWE-79", "79", "CWE-079", "cwe_79"], cwe_codes) == ["cwe79"] * 6
    assert one(spark, ['["cwe20","cwe79"]', "cwe79,cwe20", "[]"], cwe_codes) == ["cwe20,cwe79", "cwe20,cwe79", None]
