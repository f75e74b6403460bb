import json
import os
import sqlite3
import subprocess

from pyspark.sql import functions as F

from sluicebed.__main__ import main
from sluicebed.operators import agents, metrics
from sluicebed.sources.gitrepo import enrich, look_up
from sluicebed.sources.jsonl import read_sqlite, split_path

ENV = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x", "PATH": "/usr/bin:/bin", "HOME": "/tmp"}


def git(where, *args):
    subprocess.run(["git", *args], cwd=where, env=ENV, check=True, capture_output=True)


def test_rows_from_git(spark, tmp_path):
    work = tmp_path / "w"
    work.mkdir()
    git(work, "init", "-q", "-b", "main")
    (work / "a.py").write_text("x = 1\n")
    (work / "b.py").write_text("y = 'é '\n", encoding="utf-8")
    git(work, "add", ".")
    git(work, "commit", "-qm", "one")
    git(work, "checkout", "-qb", "topic")
    (work / "a.py").write_text("x = 2\n")
    git(work, "commit", "-qam", "two")
    (tmp_path / "repos/Owner").mkdir(parents=True)
    git(tmp_path, "clone", "-q", "--bare", str(work), str(tmp_path / "repos/Owner/Name.git"))

    db = sqlite3.connect(tmp_path / "d.sqlite")
    db.executescript("CREATE TABLE pull_request(id, head_branch, base_branch, merge_base, base_repo_id, issue_id, idx); INSERT INTO pull_request VALUES (1,'topic','main',NULL,7,9,3),(2,'gone','main',NULL,7,NULL,4);")
    db.close()
    requests = read_sqlite(str(tmp_path / "d.sqlite"), "SELECT * FROM pull_request", spark, "id long, head_branch string, base_branch string, merge_base string, base_repo_id long, issue_id long, `index` long")
    repos = spark.createDataFrame([(7, "OWNER", "name")], "id long, owner_name string, name string")
    issues = spark.createDataFrame([(9, "title", "body")], "id long, name string, content string")
    wanted = spark.createDataFrame([(1, "owner", "NAME", 3), (2, "owner", "name", 4), (3, "owner", "none", 1)], "row_key long, owner string, name string, number long")
    rows = look_up(wanted, requests, repos, issues)
    assert {r.row_key: r.title for r in rows.collect()} == {1: "title", 2: None, 3: None}
    got = {r.row_key: r for r in enrich(rows, str(tmp_path / "repos"), with_context=True).collect()}
    assert got[1].files_changed == ["a.py"] and got[1].files == {"a.py": "x = 2\n"} and "+x = 2" in got[1].diff
    assert got[1].repository_files == {"b.py": "y = 'é '\n"} and got[1].enrich_error is None
    assert got[2].enrich_error and got[3].enrich_error == "no such pull request"


def test_enrichment_job(spark, tmp_path):
    test_rows_from_git(spark, tmp_path)
    db = sqlite3.connect(tmp_path / "forge.sqlite")
    db.executescript("""CREATE TABLE pull_request(id, head_branch, base_branch, merge_base, base_repo_id, issue_id, "index"); INSERT INTO pull_request VALUES (1,'topic','main',NULL,7,9,3);
      CREATE TABLE repository(id, owner_name, name); INSERT INTO repository VALUES (7,'Owner','Name'); CREATE TABLE issue(id, name, content); INSERT INTO issue VALUES (9,'from the forge','text');""")
    db.close()
    split = split_path(str(tmp_path / "meta"), "cwe79", True, "v2", "v1")
    os.makedirs(os.path.dirname(split), exist_ok=True)
    with open(split, "w") as f:
        f.write(json.dumps({"id": "p1", "repo": "owner/name", "pr_number": 3, "pr_title": "t", "pr_body": "b", "diff": "d"}) + "\n")
    main(["enrich", "--metadata-root", str(tmp_path / "meta"), "--database", str(tmp_path / "forge.sqlite"), "--repositories", str(tmp_path / "repos"), "--cwe", "cwe79", "--skip-benign", "--output", str(tmp_path / "e")])
    row = spark.read.json(str(tmp_path / "e")).first()
    assert row.id == "p1" and row.pr_title == "from the forge" and "+x = 2" in row.diff and row.files["a.py"] == "x = 2\n"


def test_console_table(spark):
    rows = spark.createDataFrame([("cwe862", True, True), ("cwe22", True, False), ("cwe999", False, True)], "cwe string, malicious boolean, advisory boolean")
    got = metrics.rate_table(rows).orderBy("place", "name").collect()
    assert [r.tpr for r in got][:2] == ["0%", "n/a"] and got[-1].name == "OVERALL" and got[-1].tpr == "50%" and got[-1].fpr == "100%" and len(got) == 12


def test_paths_are_quoted(spark):
    df = spark.createDataFrame([('a"b\\c.py',), ("é.py",)], "p string")
    assert [json.loads(r[0]) for r in df.select(agents.quoted(F.col("p"))).collect()] == ['a"b\\c.py', "é.py"]
