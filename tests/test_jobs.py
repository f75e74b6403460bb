import json

import pytest

from sluicebed.__main__ import main
from sluicebed.operators import agents, evaluate
from sluicebed.operators.rules import applicable
from sluicebed.sources.jsonl import load_benchmark, repaired_results
from tests.test_review import pulls

DIFF = "--- a/a.py\n+++ b/a.py\n@@ -1 +1,2 @@\n x = 1\n+eval(input())\n"


def benchmark(path, n=4):
    rows = [{"id": f"p{i}", "malicious": i % 2 == 0, "pr_title": "t", "pr_body": "b", "diff": DIFF, "cwe_id": "cwe94", "files": {"a.py": "x = 1\neval(input())\n"}, "files_changed": ["a.py"], "framing": "urgency"} for i in range(n)]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_jobs_end_to_end(spark, tmp_path, capsys):
    source = benchmark(tmp_path / "b.jsonl")
    main(["analyze", "--benchmark", source, "--output", str(tmp_path / "a")])
    main(["score", str(tmp_path / "a")])
    assert "cwe94" in capsys.readouterr().out
    main(["evaluate", "--benchmark", source, "--modes", "baseline,analysis_only", "--budget", "600", "--output", str(tmp_path / "r")])
    assert repaired_results(spark, str(tmp_path / "r")).count() == 8
    main(["evaluate", "--benchmark", source, "--modes", "baseline,analysis_only", "--budget", "600", "--output", str(tmp_path / "r"), "--resume"])
    assert repaired_results(spark, str(tmp_path / "r")).count() == 8
    main(["report", str(tmp_path / "r"), "--output", str(tmp_path / "o")])
    assert len(list((tmp_path / "o/metrics").glob("*.csv"))) == 1
    with pytest.raises(Exception, match="exist"):
        main(["analyze", "--benchmark", source, "--output", str(tmp_path / "a")])


def test_all_modes(spark, tmp_path):
    rows = load_benchmark(spark, path=benchmark(tmp_path / "b.jsonl")).selectExpr("xxhash64(id) as example_no", "*")
    calls = {"auditor": "BLOCK: bad\nEVIDENCE: L2", "detector": "CLEAN", "scanner": '[{"where": "eval", "path": "a.py", "reason": "r"}]', "hybrid": "COMMENT: look"}

    def model(system, user):
        name = "scanner" if system == agents.SCANNER else "detector" if system == agents.DETECTOR else "auditor" if system == agents.AUDITOR else "hybrid"
        if name == "hybrid":
            assert "Scanner signals: eval at a.py" in user and "BLOCK (grounded) at a.py:2" in user and "taint at a.py:2" in user and "Multi-agent verdict: BLOCK" in user
        return calls[name]

    out = evaluate.run(rows, None, evaluate.Settings(("multi_agent", "hybrid"), output=str(tmp_path / "r")), model)
    assert {(r.mode, r.verdict) for r in out.collect()} == {("multi_agent", "BLOCK"), ("hybrid", "COMMENT")}


def test_evidence_must_be_visible(spark, tmp_path):
    rows = load_benchmark(spark, path=benchmark(tmp_path / "b.jsonl", 1)).selectExpr("1L as example_no", "*")
    for line, want in (("L2", True), ("L9", False)):
        audits = agents.audited(rows, None, 4096, lambda s, u, n=line: f"BLOCK: x\nEVIDENCE: {n}")
        assert [r.grounded for r in audits.collect()] == [want]


def test_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_benchmark(spark, str(tmp_path / "none"), need_code=True)
    assert applicable(None) > applicable("89") == {"R1", "R8"}
    assert evaluate.run(pulls(spark), None, evaluate.Settings(output=str(tmp_path / "x"), limit=3)).count() == 3
