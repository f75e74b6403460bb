import random

import pytest
from pyspark.sql import functions as F

from sluicebed.functions.lexing import SUFFIXES, tokens
from sluicebed.llm import authorship as A

GENERATED = "// Code generated by relaygen v0.1. DO NOT EDIT.\npackage x\n\nfunc A() int { return 1 }\n"
BARE = "package x\n\n" + "".join(f"func (m *S) GetF{i}() int32 {{\n\treturn m.F{i}\n}}\n" for i in range(12))
MINIFIED = "!function(t,e){" + "".join(f"var a{i}={i},b{i}=[{i},t.c];if(t.d>{i}){{e.k=a{i}}}else{{e.k=t.d||{{}}}};" for i in range(20)) + "}(this,{});"
BLOB = "unsigned char x[] = {\n" + "  0x3b, 0x1e, 0xa6, 0xdb,\n" * 20 + "};\n"
PACKED = 'export default "' + "aB3/" * 200 + '";\n'


def program(seed, n=8):
    rng = random.Random(seed)
    word = lambda: rng.choice("load read parse make send scan join rotate check merge".split()) + "_" + rng.choice("row path token body user form query batch".split())
    out = ["import os", ""]
    for _ in range(n):
        f, a = word(), word()
        out += [f"def {f}({a}, n):", f"    x = {word()}({a}, {rng.randrange(99)})", f"    for i in range({rng.randrange(9)}):", f"        {word()}(i, {a})", f'    log.info("{word()}", x)', "    return x", ""]
    return "\n".join(out)


def kind(text, path):
    lang = SUFFIXES.get(path[path.rfind(".") :])
    return A.content_kind(text, lang, A._token_hashes(text, lang)[1])


@pytest.mark.parametrize(
    ("text", "path", "want"),
    [(GENERATED, "a.go", "generated"), (BARE, "a.go", "generated"), (MINIFIED, "a.js", "minified"), (".a{color:#fff}" * 60, "a.css", "minified"), (BLOB, "a.c", "data"), (PACKED, "a.ts", "data"), (program(1), "a.py", None),
     ('x = "Code generated by mkstub. DO NOT EDIT."\n' + program(2), "a.py", None), ("# This writer stamps generated files so that nobody edits them.\n" + program(3), "a.py", None),
     ("# Bitte beachten: Diese Datei wurde automatisch erzeugt.\nx = 1\n", "a.py", "generated"), ('q = "' + "SELECT a, b " * 90 + 'FROM t"\n' + program(4, 3), "a.py", None), ("", "a.py", None)],
)
def test_content(text, path, want):
    assert kind(text, path) == want


LICENCE = [" ".join("".join(random.Random(i * 9 + j).choices("abcdefghij", k=3 + j)) for j in range(2 + i % 7)) for i in range(60)]
STAMPED = "Generated by mkstub from api.yaml. DO NOT EDIT."


@pytest.mark.parametrize("path", ["a.py", "a.rb", "a.js", "a.h", "a.rs", "a.css", "a.sql", "a.yaml", "a.html", "a.json"])
def test_stamps_below_long_licences(spark, path):
    left, right = {"py": ("# ", ""), "rb": ("# ", ""), "yaml": ("# ", ""), "css": ("/* ", " */"), "sql": ("-- ", ""), "html": ("<!-- ", " -->")}.get(path[2:], ("// ", ""))
    note = lambda *lines: "".join(f"{left}{x}{right}\n" for x in lines)
    files = {"x/" + path: note(*LICENCE, STAMPED) + "a\n", "y/" + path: note(*LICENCE) + "a\n" + note(STAMPED)}
    assert run(spark, [(1, "o/n", files, None, None)]) == {(1, "files", "x/" + path): "generated"}


def test_headings_are_no_stamps(spark):
    files = {"a.md": "# Auto-generated clients\n\nHow we make them.\n", "b.md": f"<!-- {STAMPED} -->\n# Clients\n"}
    assert run(spark, [(1, "o/n", files, None, None)]) == {(1, "files", "b.md"): "generated"}


PULL = "example_no long, repo string, files map<string,string>, repository_files map<string,string>, files_changed array<string>"


def run(spark, rows, libs=()):
    df = spark.createDataFrame(rows, PULL).withColumns({"owner": F.lit("x"), "path": F.lit("y"), "kind": F.lit("z"), "mark": F.lit(1)})
    lib = spark.createDataFrame(list(libs), "lib_id int, path string, source string")
    return {(r.example_no, r.field, r.path): r.kind for r in A.not_by_hand(df, lib).collect()}


def test_paths(spark):
    case = ["vendor/a/b.go", "x/node_modules/k/i.js", "go.sum", "web/package-lock.json", "api/x.pb.go", "p/x_pb2.py", "a/b.min.css", "third_party/k/core.c", "Godeps/_workspace/src/k/a.go", "assets/q-76627f.js"]
    hand = ["src/vendors/a.js", "src/thirdparty_billing/a.py", "app/generator/a.rb", "lib/minify/a.ts", "src/build/handler.py", "Makefile", "config/a.yaml", "docs/go.summary.md", "a/deadbeef.js"]
    got = run(spark, [(1, "o/n", None, None, [*case, *hand, None, case[0]])])
    assert set(got) == {(1, "files_changed", p) for p in case}


def test_copies_and_borrowed_functions(spark):
    lib = program(10, 12)
    renamed = "# local tweak\n" + lib.replace("import os", "import os\nimport sys")
    cut = "\n".join(lib.split("\n")[: int(lib.count("\n") * 0.8)])
    borrowed = program(11, 12) + "\n".join(lib.split("\n")[2:9])
    files = {"core/a.py": lib, "core/b.py": renamed, "core/c.py": cut, "core/d.py": borrowed, "core/e.py": "\n".join(lib.split("\n")[:9]), "core/f.py": program(12, 12)}
    got = run(spark, [(1, "o/n", files, {"x/g.py": lib}, ["core/a.py", "core/d.py", "gone.min.js"])], [(1, "lib/a.py", lib)])
    assert set(got) == {(1, "files", "core/a.py"), (1, "files", "core/b.py"), (1, "files", "core/c.py"), (1, "repository_files", "x/g.py"), (1, "files_changed", "core/a.py"), (1, "files_changed", "gone.min.js")}


def test_copies_without_a_library_recur(spark):
    shared = program(20, 14)
    rows = [(i, f"owner{i}/r", {f"x/{i}.py": shared if i < 12 else program(100 + i, 14)}, None, None) for i in range(24)]
    rows += [(100 + i, "same/r", {f"y/{i}.py": program(50, 14)}, None, None) for i in range(12)]  # one owner's copies are no recurrence
    got = run(spark, rows)
    assert set(got) == {(i, "files", f"x/{i}.py") for i in range(12)} and set(got.values()) == {"recurring"}


def test_owners_that_hold_a_copy_in_a_vendored_folder_count(spark):
    shared = program(21, 14)
    rows = [(i, f"owner{i}/r", {f"vendor/{i}.py" if i < 6 else f"src/{i}.py": shared}, None, None) for i in range(9)]
    got = run(spark, rows)
    assert got == {(i, "files", f"vendor/{i}.py" if i < 6 else f"src/{i}.py"): "recurring" for i in range(9)}


def test_recall_of_recurrence_alone(spark):
    """Copies of twelve sources, each lightly edited in its own way under its own path, among as many files of other hands."""
    rng, rows, want = random.Random(5), [], set()
    for c in range(12):
        lines = program(300 + c, 14 + c).split("\n")
        for o in range(10):
            mine = list(lines)
            for _ in range(2):
                mine.insert(rng.randrange(len(mine)), f"    audit_{o}_{rng.randrange(99)}({rng.randrange(9)})")
            n = len(rows)
            rows.append((n, f"owner{o}/r{c}", {f"src/m{n}.py": "\n".join(mine), f"src/own{n}.py": program(1000 + n, 14)}, None, None))
            want.add((n, "files", f"src/m{n}.py"))
    got = {k for k, kind in run(spark, rows).items() if kind == "recurring"}
    assert got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize(
    ("head", "want"),
    [("// changes will be lost when the tab closes", False), ("// Helpers for ids generated by the database", False), ("// This file was created by Jane Doe. Do what you like.", False), ("# Do not edit this list without asking the team", False),
     ("// The lexer must not change the file while the tool runs", False), ("# This script was written to build the docs.", False), ("/* Utilities to build the code editor. Do not touch the DOM here. */", False),
     ("# The code generator for widgets. Never modify the tree in place.", False), ("// Built-in functions of the language", False), ("// Generated by Django 3.2", True), ("/* Bison 3.0 generated file. Do not edit. */", True),
     ("# Any changes will be overwritten by the next build", True), ("# Arquivo gerado por uma ferramenta", True), ("// このファイルはツールにより自動生成されました。", True), ("// @generated", True), ("// Built from a.y by the parser compiler, please leave alone", True)],
)
def test_stamps_are_told_by_their_sentence(head, want):
    assert A.stamped(A.sentences(head)) is want
    assert A.stamped(A.sentences("// Copyright\n// of us\n" + head)) is want


def test_wrapped_sentences_are_one():
    assert not A.stamped(A.sentences("# Helpers for values\n# generated by the database.\n"))
    assert A.stamped(A.sentences("/*\n * This file was\n * generated by mkstub.\n */"))


def test_marks_tell_equal_lengths_apart(spark):
    got = A.sources(spark.createDataFrame([(1, "o/n", {"a.py": "x = 1", "b.py": "x = 2", "c.js": "x = 1", "d.py": "x = 1", "e.py": " "}, None, None)], PULL))
    marks = {r.path: r.mark for r in got.collect()}
    assert marks["a.py"] == marks["d.py"] and marks["e.py"] is None and len({bytes(m) for m in marks.values() if m}) == 3


def test_short_copies_recur_as_a_whole(spark):
    shared = "\n".join(program(22, 2).split("\n")[:10])
    size = len(A._token_hashes(shared, "py")[0])
    assert A.FAR_GRAM < size and len(A.winnow(A._token_hashes(shared, "py")[0], A.FAR_GRAM, A.FAR_WINDOW)) < A.LEAST
    bare = "import os\nimport logging\n\nlogger = logging.getLogger(__name__)\n"  # alike by chance
    files = lambda i: {f"x/{i}.py": f"# note {i}\n" + shared, f"y/{i}.py": bare, f"z/{i}.py": shared + f"\nrow_{i}(1)\n"}
    got = run(spark, [(i, f"owner{i}/r", files(i), None, None) for i in range(9)])
    assert got == {(i, "files", f"x/{i}.py"): "recurring" for i in range(9)}
    assert run(spark, [(i, f"owner{i % 7}/r", {f"x/{i}.py": shared}, None, None) for i in range(14)]) == {}


def test_winnowing_keeps_shared_stretches():
    a, b = list(range(100, 200)), list(range(300, 330)) + list(range(130, 160))
    assert set(A.winnow(a).tolist()) & set(A.winnow(b).tolist())
    assert len(A.winnow([1, 2])) == 0 and len(A.winnow(list(range(A.GRAM)))) == 1


def test_comments_and_literals_do_not_count():
    one = A.winnow(A._token_hashes('x = f("a", 1)  # note\ny = g(x, 2)\n', "py")[0]).tolist()
    two = A.winnow(A._token_hashes('# other\nx = f("b b", 77)\ny = g(x, 3)\n', "py")[0]).tolist()
    assert one == two and tokens("x", "py")


def test_nulls_and_empties(spark):
    assert run(spark, [(1, None, None, None, None), (2, "n/a", {"a.py": None, "b.py": "", "vendor/c.py": ""}, {}, [])]) == {(2, "files", "vendor/c.py"): "path"}
    df = spark.createDataFrame([], PULL)
    assert A.not_by_hand(df, spark.createDataFrame([], "lib_id int, path string, source string")).count() == 0


def test_the_rest_is_hand_written(spark):
    df = spark.createDataFrame([(1, "o/n", {"a.py": program(1), "go.sum": "x"}, {"b.c": BLOB}, None)], PULL)
    lib = spark.createDataFrame([], "lib_id int, path string, source string")
    assert [(r.field, r.path) for r in A.hand_written(df, lib).collect()] == [("files", "a.py")]
