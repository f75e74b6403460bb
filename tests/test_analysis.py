import pytest

from sluicebed.operators import findings, multilang
from sluicebed.operators.pysem import SAY, analyze


def kinds(files, **k):
    return {f["kind"] for f in analyze(files, **k)[0]}


def test_alias_across_files_with_witness():
    found, _ = analyze({
        "app.py": "from tools.shell import launch as start\nn = int(input())\nif n >= 41:\n    if n < 42:\n        start(n)\n",
        "tools/shell.py": "import os\n\ndef launch(code):\n    command = code\n    os.system(command)\n",
    })
    assert ("cross_file", SAY["resolves"].format("tools.shell.launch", "tools/shell.py", 3)) in {(f["kind"], f["detail"]) for f in found}
    assert any("41" in f["witness"].values() for f in found if f["kind"] == "symbolic")


@pytest.mark.parametrize(
    ("source", "absent"),
    [("n = int(input())\nif n == 3 and n != 3:\n    exec(n)\n", "symbolic"), ("name = input()\nname = str('fixed')\nname = 'fixed'\nexec(name)\n", "taint"),
     ("word = input()\nif word == 'up' and word == 'down':\n    exec(word)\n", "symbolic"), ("word = input()\nif len(word) < 2 and len(word) > 5:\n    exec(word)\n", "symbolic")],
)
def test_what_cannot_happen(source, absent):
    assert absent not in kinds({"m.py": source})


def test_relative_import_and_shadowing():
    assert "taint" in kinds({"svc/api.py": "from .jobs import enqueue\nenqueue(input())\n", "svc/jobs.py": "def enqueue(task):\n    exec(task)\n"})
    assert "cross_file" not in kinds({"m.py": "from jobs import enqueue\nenqueue = print\nenqueue(input())\n", "jobs.py": "def enqueue(task):\n    exec(task)\n"})


@pytest.mark.parametrize(
    ("call", "tainted"),
    [('db.execute("DELETE FROM t WHERE k = %s", [key])', False), ('cursor.executemany("INSERT INTO t VALUES (%s)", [key])', False), ('db.execute("DELETE FROM " + key, [1])', True),
     ("db.execute(sql=key)", True), ('db.execute(statement="SELECT 1", parameters=[key])', False)],
)
def test_sql_arguments(call, tainted):
    found = kinds({"dao.py": f"key = input()\n{call}\n"})
    assert "sink" in found and ("taint" in found) == tainted


def test_side_effects_of_bound_values():
    found, _ = analyze({"dao.py": 'import os\ndb.execute("SELECT %s", os.popen(input()))\n'})
    assert [f["detail"] for f in found if f["kind"] == "taint"] == [SAY["taint"].format("os.popen")]


def test_requests():
    view = "def show({0}):\n    {1}exec({0}.args.get('id'))\n"
    found, notes = analyze({"v.py": view.format("request", "")})
    assert "taint" in {f["kind"] for f in found} and SAY["request"].format("v.py", 1) in " ".join(notes) or any("web request" in n for n in notes)
    found, notes = analyze({"v.py": view.format("query", "")})
    assert "taint" not in {f["kind"] for f in found} and any("is not followed" in n for n in notes)
    assert "taint" not in kinds({"v.py": view.format("request", "request = None\n    ")})
    assert "taint" in kinds({"v.py": "from flask import request as web\nexec(web.args.get('id'))\n"})


def test_coverage_is_told():
    _, notes = analyze({"w.py": "class Worker:\n    def step(self):\n        exec(input())\n\nwhile ready():\n    step()\n", "broken.py": "return return"})
    text = " ".join(notes)
    for part in ("bodies of classes are not followed", "functions inside others are not followed", "While statements are not followed", "is no valid Python"):
        assert part in text


@pytest.mark.parametrize(("disabled", "gone"), [("taint", {"taint", "symbolic"}), ("symbolic", {"symbolic"}), ("cross_file", {"cross_file"})])
def test_ablations(disabled, gone):
    files = {"cli.py": "from act import perform\narg = input()\nexec(arg)\nperform(arg)\n", "act.py": "def perform(what):\n    exec(what)\n"}
    assert gone <= kinds(files) and not kinds(files, disabled=frozenset([disabled])) & gone


def test_bounds_hold():
    endless = "def again(n):\n    again(n)\nagain(input())\n"
    assert any(SAY["depth"].split(": ")[1] in n for n in analyze({"r.py": endless})[1])
    many = "n = input()\n" + "if ready():\n    k = 2\n" * 12 + "exec(n)\n"
    assert {SAY["states"], SAY["steps"]} & set(analyze({"r.py": many})[1])


@pytest.mark.parametrize(
    ("path", "source", "want"),
    [("up.php", "<?php\nfunction store() {\n  $f = $_FILES['doc'];\n  passthru($f);\n}\n", ("taint", "together", "passthru", "php")),
     ("io.c", "int load(char *from) {\n  sprintf(line, from);\n  return 0;\n}\n", ("taint", "risk", "sprintf", "c")),
     ("h.go", "func find(w http.ResponseWriter, r *http.Request) {\n  name := r.URL.Query().Get(\"n\")\n  conn.QueryRow(name)\n}\n", ("taint", "together", "QueryRow", "go")),
     ("Dao.java", "class Dao {\n  int count(String s) {\n    return st.executeUpdate(s);\n  }\n}\n", ("sink", "sink", "executeUpdate", "java")),
     ("cli.ts", "execSync(process.argv[2]);\n", ("taint", "together", "execSync", "typescript")), ("job.rb", "def run\n  constantize(ENV['KIND'])\nend\n", ("taint", "together", "constantize", "ruby"))],
)
def test_other_languages(path, source, want):
    kind, text, name, language = want
    found, _ = multilang.scan(path, source)
    assert (kind, multilang.SAY[text].format(name, language)) in {(f["kind"], f["detail"]) for f in found}


def test_source_in_another_function_is_not_colocated():
    source = "func in(r *http.Request) string {\n  return r.FormValue(\"k\")\n}\n\nfunc out(k string) {\n  conn.Exec(k)\n}\n"
    assert {f["kind"] for f in multilang.scan("k.go", source)[0]} == {"sink"}


def test_members_and_calls_of_sources():
    seen = lambda lang, text: bool(multilang._sources[lang].search(text))
    assert seen("typescript", "req.body.id") and not seen("typescript", "req.socket") and seen("javascript", "location . hash".replace(" ", ""))
    assert seen("php", "file_get_contents( 'php://input')") and seen("php", "$_GET[1]") and not seen("php", "$_GETTER") and seen("go", "r.FormValue (x)") and not seen("go", "r.FormValues")


def test_languages_without_rules():
    assert multilang.scan("Main.cs", "Run(x);")[1] == [multilang.SAY["rules"].format("Main.cs", "csharp")]
    assert multilang.scan("notes.abc", "Run(x);")[1] == [multilang.SAY["language"].format("notes.abc")]


def test_layers_together(spark):
    df = spark.createDataFrame(
        [(1, {"t.py": "exec(input())\n", "t.ts": "execSync(req.query);\n", "t.md": "x"}, None, "--- a/t.py\n+++ b/t.py\n@@ -0,0 +1 @@\n+exec(input())\n"), (2, None, {"u.py": None}, None), (3, {}, {}, "")],
        "example_no long, files map<string,string>, repository_files map<string,string>, diff string",
    )
    found = findings.analyze(df)
    rows = found.filter("kind != 'warning'").collect()
    assert {(r.layer, r.path) for r in rows} == {("python", "t.py"), ("multilang", "t.ts"), ("diff", "t.py")}
    assert {r.layer for r in findings.analyze(df, ("diff",)).collect()} == {"python", "multilang"}
    report = findings.reports(found).filter("example_no = 1").first()
    assert report.advisory and multilang.SAY["coverage"].format(1) in report.warnings
