"""Filling pull-request rows from bare repositories and their lookup tables.

Each task calls git for its own rows, so the work spreads by rows; the repositories must lie where every executor reads
them. A row that fails stays, with its error, and no failure ends the job.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "row_key long, head_commit string, diff string, files_changed array<string>, files map<string,string>, repository_files map<string,string>, enrich_error string"


def _git(folder: str, *args: str) -> str:
    done = subprocess.run(["git", "--git-dir", folder, *args], capture_output=True, timeout=120, check=False)
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip()[:200] or f"git {args[0]} failed")
    return done.stdout.decode("utf-8", "replace")


def find_repository(root: str, owner: str, name: str) -> str:
    """<root>/<owner>/<name>.git, whatever the case of its letters."""
    at = root
    for part in (owner, f"{name}.git"):
        names = {n.lower(): n for n in sorted(os.listdir(at), reverse=True)}
        if part.lower() not in names:
            raise ValueError(f"no repository {owner}/{name}")
        at = os.path.join(at, names[part.lower()])
    return at


def fetched(folder: str, head: str, base: str | None, merge_base: str | None, with_context: bool) -> dict:
    """Commit, diff against the merge base, changed files with their text, and further Python files if wanted."""
    commit = _git(folder, "rev-parse", "--verify", f"{head}^{{commit}}").strip()
    start = merge_base or _git(folder, "merge-base", base or "HEAD", commit).strip()
    changed = [p for p in _git(folder, "diff", "--name-only", "-z", f"{start}...{commit}").split("\0") if p]
    tree = [p for p in _git(folder, "ls-tree", "-r", "-z", "--name-only", commit).split("\0") if p]
    there = set(tree)
    show = lambda p: _git(folder, "show", f"{commit}:{p}")
    context = {p: show(p) for p in tree if p.endswith((".py", ".pyi")) and p not in set(changed)} if with_context else {}
    return {
        "head_commit": commit,
        "diff": _git(folder, "diff", f"{start}...{commit}"),
        "files_changed": changed,
        "files": {p: show(p) for p in changed if p in there},
        "repository_files": context,
        "enrich_error": None,
    }


def enrich(rows: DataFrame, root: str, with_context: bool = False) -> DataFrame:
    """rows(row_key, owner_name, name, head_branch, base_branch, merge_base) to rows with what git holds of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    if not r.owner_name or not r.name or not r.head_branch:
                        raise ValueError("no such pull request")
                    got = fetched(find_repository(root, r.owner_name, r.name), r.head_branch, r.base_branch, r.merge_base, with_context)
                except (ValueError, OSError, subprocess.SubprocessError) as e:
                    got = {"head_commit": None, "diff": None, "files_changed": None, "files": None, "repository_files": None, "enrich_error": str(e)}
                out.append({"row_key": r.row_key, **got})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return rows.select("row_key", "owner_name", "name", "head_branch", "base_branch", "merge_base").mapInPandas(run, _OUT)


def look_up(wanted: DataFrame, requests: DataFrame, repositories: DataFrame, issues: DataFrame) -> DataFrame:
    """wanted(row_key, owner, name, number) with its pull request, repository and, where there is one, issue.

    Names match without regard to case; of several matches the one of the lowest request id counts; rows without a match
    stay with nulls.
    """
    repos = repositories.select(F.col("id").alias("base_repo_id"), "owner_name", "name", F.lower("owner_name").alias("o"), F.lower("name").alias("n"))
    titled = issues.select(F.col("id").alias("issue_id"), F.col("name").alias("title"), F.col("content").alias("body"))
    full = requests.join(repos, "base_repo_id").join(titled, "issue_id", "left")
    first = full.groupBy("o", "n", "index").agg(F.min(F.struct("id", "owner_name", "name", "head_branch", "base_branch", "merge_base", "title", "body")).alias("r"))
    asked = wanted.select("row_key", F.lower("owner").alias("o"), F.lower("name").alias("n"), F.col("number").alias("index"))
    return asked.join(first, ["o", "n", "index"], "left").select("row_key", "r.owner_name", "r.name", "r.head_branch", "r.base_branch", "r.merge_base", "r.title", "r.body")
