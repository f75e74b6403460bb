import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebed.llm import prose as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.FOLDER), reason="no tokenizer files here")

TEXTS = {
    "en": "The worker reads all pending rows and then waits for the next batch because older clients rely on it.",
    "de": "Der Leser behält den gemeinsamen Puffer und wartet dann auf den nächsten Schub weil ältere Geräte darauf bauen.",
    "fr": "La requête vérifie les lignes vides avant de libérer le verrou et garde la valeur brute.",
    "es": "La consulta conserva el último resultado y luego espera el siguiente lote sin tocar la interfaz pública.",
    "pt": "A consulta devolve todas as entradas pendentes e então aguarda o próximo lote sem mexer na interface.",
    "ru": "Обработчик запроса хранит исходное значение когда флаг выключен и ждёт следующую порцию.",
    "zh": "这个函数会检查未知的规则，然后再释放锁。后台任务会返回签名字段。",
    "ja": "この関数は二回目の試行の後で前回の結果を返します。パスの検査は空の行を捨てます。",
}


@pytest.fixture(scope="module")
def table():
    code = ["def f ( x ) : return x . y + z [ 1 ]", "const a = b ( c , 1 ) ; for ( let i = 0 ; i < n ; i += 1 ) { g ( i ) ; }"]
    return P.fit([(k, t) for k, t in TEXTS.items() for _ in range(3)], code)


def langs(table, source, lang):
    return set(P.Reader(table).source(source, lang))


@pytest.mark.parametrize("want", TEXTS)
def test_comments_and_literals_of_each_language(table, want):
    t = TEXTS[want]
    assert langs(table, f"# {t}\nx = 1\n", "py") == {want}
    assert langs(table, f'const x = "{t}";\n', "js") == {want}
    assert langs(table, f"/**\n * {t}\n * @param x\n */\nint f(void) {{ return 1; }}\n", "c") == {want}
    escaped = t.encode("ascii", "backslashreplace").decode()
    escaped = re.sub(r"\\x([0-9a-f]{2})", r"\\u00\1", escaped)
    assert langs(table, f'class A {{ String s = "{escaped}"; }}\n', "java") == {want}


@pytest.mark.parametrize(
    "source",
    ["# x = load(y, 3)\n", '# TODO: tidy\n# region io\n# noqa\n', 'q = "SELECT id, name FROM account WHERE id = ? ORDER BY name"\n', 'u = "https://docs.example.test/guide/start.html"\n', 'p = "/var/lib/relay/cache dir"\n', 'r = "^[a-z0-9_]+$"\n',
     'k = "user_id"\n', 'x = "INSERT INTO log (a, b) VALUES (?, ?)"\n', "# -*- mode: fixed -*-\n", "x = 1\n", "", "# short note\n"],
)
def test_what_is_no_prose(table, source):
    assert langs(table, source, "py") == set()


def test_wrapped_mixed_and_joined(table):
    wrapped = "# The worker reads all\n# pending rows and then\n# waits.\nx = 1\n"
    assert langs(table, wrapped, "py") == {"en"}
    assert langs(table, f"/* {TEXTS['de']} {TEXTS['en']} */\nint x;\n", "c") == {"de", "en"}
    assert langs(table, 'x = ("The worker "\n     "reads all rows")\n', "py") == {"en"}
    assert langs(table, 'var x = "The worker " +\n  "reads all rows";\n', "js") == {"en"}
    assert langs(table, "# one two\n\n# three four\n", "py") == set()


def test_broken_sources_are_read_on(table):
    assert langs(table, f'x = "open\n# {TEXTS["en"]}\n', "py") == {"en"}
    assert langs(table, f'int f() {{\n/* open\n  int x;\n// {TEXTS["fr"]}\n', "c") == {"fr"}
    assert langs(table, f"<<<<<<< HEAD\n// {TEXTS['es']}\n=======\n", "js") == {"es"}


def test_diff_counts_changed_lines_only(table):
    diff = (
        "diff --git a/old.py b/new.py\n--- a/old.py\n+++ b/new.py\n@@ -1,3 +1,3 @@\n"
        f" # {TEXTS['de']}\n-# {TEXTS['fr']}\n+# {TEXTS['en']}\n x = 1\n"
        "diff --git a/n.txt b/n.txt\n--- a/n.txt\n+++ b/n.txt\n@@ -1 +1 @@\n"
        f"-a\n+{TEXTS['ru']}\n"
    )
    got = {p: set(x) for p, x, _ in P.Reader(table).diff(diff)}
    assert got == {"new.py": {"fr", "en"}}


def test_hunk_inside_a_comment(table):
    diff = f"--- a/a.c\n+++ b/a.c\n@@ -5,3 +5,4 @@\n  * some words before\n+ * {TEXTS['en']}\n  */\n int x;\n"
    assert [set(x) for _, x, _ in P.Reader(table).diff(diff)] == [{"en"}]


def test_literals_as_read():
    assert P.unescaped(r"a\u00e9\x41\n\101\U0001F600", "py", False) == "aéA\nA😀"
    assert P.unescaped(r"\xc3\xa9", "c", False) == "é"
    assert P.unescaped(r"\u{e9}", "js", False) == "é" and P.unescaped(r"it\'s \n", "php", True) == r"it's \n"
    assert P.literal_text('f"a {b} c"', "py") == "a  x  c" and P.literal_text("r'\\n'", "py") == "\\n"


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    pulls = spark.read.parquet(f"{data}/pull_example.parquet")
    model = P.train(pulls, docs)
    right = [P.classify(t, model) == k for k, t in TEXTS.items()]
    assert np.mean(right) >= 7 / 8  # this table has one text each of some languages
    code = [P.classify(s, model) for s in ("for i in range ( 4 ) : load_path ( i , body )", "return decode_token ( payload , 3 )")]
    assert code == [None, None]


def test_operator(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(1, {"a.py": f"# {TEXTS['en']}\n", "b.md": TEXTS["en"], "c.js": None}, None), (2, None, f"--- a/x.rb\n+++ b/x.rb\n@@ -0,0 +1 @@\n+# {TEXTS['de']}\n"), (3, {}, ""), (4, {"a.py": ""}, "no diff")]
    df = spark.createDataFrame(rows, "example_no long, files map<string,string>, diff string").withColumns({"lang": F.lit("x"), "path": F.lit("y"), "source": F.lit("z"), "repo": F.lit("q")})
    assert {(r.example_no, r.field, r.path, r.lang) for r in P.prose(df, docs).collect()} == {(1, "files", "a.py", "en"), (2, "diff", "x.rb", "de")}
    assert P.prose(df.limit(0), docs).count() == 0
    assert {(r.example_no, r.lang) for r in P.prose(df.limit(0).unionByName(df.filter("example_no = 9")), docs.limit(0)).collect()} == set()
