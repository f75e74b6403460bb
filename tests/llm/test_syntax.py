import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluicebed.llm import syntax as S
from sluicebed.llm.grammars import terminals
from sluicebed.llm.grammars.terminals import chunks

VALID = {
    "js": 'import a from "b";\nexport default class A extends B { static #x = 1; async *f(x = 1, ...y) { return `a${`b${x}`}` ?? x?.y; } get z() { return /[/"]+/g.test(s) } }\nfor (const [k, v] of m) if (k) continue; else break\nlet r = a\n  .b()\n  .c\nconst t = x ? y : z, u = [1, , 2]\n#!x'.replace("\n#!x", ""),
    "ts": "export type A<T extends B = C> = { [K in keyof T]?: T[K] } | undefined;\ninterface I { readonly x: number; f(a: string): void }\nexport function f<T>(x: T, y?: number): x is string { return x as unknown as string }\nenum E { A = 1, B }\nabstract class C implements I { private x = 1; constructor(public y: number) { super() } }\n@dec() class D {}\n",
    "java": '@SuppressWarnings("x")\npackage a.b;\nimport static java.util.List.*;\n/** doc */\npublic final class A<T extends B<?>> extends C implements D, E {\n  private static final int[] X = {1, 2};\n  @Override public <U> Map<String, List<U>> f(final int a, String... b) throws X, Y {\n    if (a >= 1 && (int) b.length < 3) return (List<U>) x;\n    for (var e : b) { x = y -> y + 1; g(A::new); }\n    String s = """\n  text "quoted" {\n""";\n    switch (a) { case 1: break; default: throw new X("}"); }\n    return null;\n  }\n}\nrecord P(int x) {}\n'.replace("package", "package", 1).split("\n", 1)[1],
    "c": '#include <stdio.h>\n#define MAX(a, b) \\\n  ((a) > (b) ? (a) : (b))\nstatic const unsigned long long x[] = { 0x1fUL, -1, \'{\' };\nstruct s { int a : 3; char *b; };\nint main(int argc, char **argv) {\n  size_t n = sizeof(struct s) * 2;\n  printf("%d" "%s\\n", (int) n, argv[0]); /* { */\n  do { n--; } while (n > 0 && *p++);\nout:\n  return n ? 1 : 0;\n}\n',
    "go": 'package main\n\nimport (\n\t"fmt"\n\tx "os"\n)\n\ntype T[K comparable] struct {\n\tA int `json:"a"`\n\t*B\n}\n\nvar c = make(chan<- int, 1)\n\nfunc (t *T[K]) F(a, b int, f ...func(int) error) (n int, err error) {\n\tfor i := range a {\n\t\tgo func() { c <- i }()\n\t}\n\tif x, ok := m[k]; ok && x != nil {\n\t\treturn\n\t}\n\tswitch v := y.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\treturn []int{1}[0], nil\n}\n',
    "php": "<?php\ndeclare(strict_types=1);\nnamespace A\\B;\nuse C\\{D, E as F};\n#[Attr(1)]\nfinal class G extends H implements I {\n  use J;\n  const X = ['a' => 1, \"b$c\" => 2];\n  public function __construct(private ?int $x = null, public readonly string ...$y) {}\n  public static function f(array &$a): ?self { foreach ($a as $k => [$v, $w]) { echo \"{$a['x']} $v\"; } return $this?->x ?? fn($z) => $z ** 2; }\n}\n$s = <<<EOT\n  text \" {\n  EOT;\nif ($a): ?>\n<b>html { </b>\n<?php endif;\n",
    "rb": "require 'x'\nmodule A\n  class B < C\n    attr_accessor :a, :b\n    def initialize(a = {}, *b, c: 1, &d)\n      @a ||= a[:x]&.y\n      puts \"v #{a ? \"n\" : 'm'}\" unless b.empty?\n      x = if a then 1 else 2 end\n      y = [1, 2].map { |i| i + 1 }.select do |i| i > 1 end\n      while x < 3 do x += 1 end\n      s = <<~EOS\n        text \" end {\n      EOS\n      return x if x =~ /[\"'}]/ and not y\n    rescue Foo => e\n      raise ArgumentError, \"no\"\n    ensure\n      z = %w[a b]\n    end\n    def self.==(o) = o.class == self.class\n    def end?; self.end; end\n  end\nend\n",
    "py": "def f(x, /, *, y=1):\n    match x:\n        case [a, *_]: return f'{x!r}'\n",
    "json": '{"a": [1, -2.5e3, null, true], "b": "\\u00e9"}',
}
BROKEN = {
    "js": ["function f() { return [1, 2; }", "const x = = 5;\n", 'const s = "a\n";\n', "import os\nimport logging\n\ndef f(a, b):\n    return a\n", "package main\n\nimport (\n)\n", "let x = `a${b`;\n", "if (x) {\n<<<<<<< HEAD\n  y()\n=======\n  z()\n>>>>>>> b\n}\n", "function f("],
    "ts": ["export function f(x: string {\n}\n", "const x: number = ;\n", "import { a } from 'b';\nexport"],
    "java": ["class A { void f() { g(1; } }\n", 'class A { String s = "x; }\n', "const x = require('y');\nfunction f() {}\n", "class A { int x = 1 2; }\n", "class A { int f() { int x = 1\n return x; } }\n", "package a.b;\npublic class A {\n  void f() {\n", "#include <x.h>\nint f() { return 1; }\n"],
    "c": ["int f(void) { return (1; }\n", "int x = = 1;\n", "package main\n\nfunc f() {\n}\n", "import os\ndef f(a):\n    return a\n", "int f() { /* open\n", "static int"],
    "go": ["package a\nfunc f() { x := [1 }\n", "func f() {}\n", "package a\nfunction f(x) { return x; }\n", "package a\nvar x = `open\n"],
    "php": ['<?php\nfunction f() {\n  $x = "open\n  g("# none" . $y);\n  return $x;\n}\n', "<?php\nfunction f( { }\n", "<?php\n$x = 1 $y;\n", "<?php\n$a = 'open;\n", "<?php\nfunction f() {\n  return"],
    "rb": ["def f\n  if x\nend\n", "class A\n  def f(a, b)\n    x = [1\n  end\nend\n", 'x = "open\n', "def f\n  raise\n"],
    "py": ["def f(:\n", "x = 'a\n", "\tif x:\ny\n", "a\x00b"],
    "json": ["{'a': 1}", '{"a": 1,}', "[1, NaN]", "// x\n{}", '{"a": 1'],
}


@pytest.mark.parametrize("lang", VALID)
def test_valid(lang):
    assert not S.fails(VALID[lang], lang)
    assert not any(S.fails(x, lang) for x in (None, "", " \n\t"))


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, v in BROKEN.items() for t in v])
def test_broken(lang, text):
    assert S.fails(text, lang)


@pytest.mark.parametrize("lang", ["js", "ts", "java", "c", "go", "php", "rb"])
@pytest.mark.parametrize("size", [1, 20, 70])
def test_chunks_join_to_the_whole(lang, size):
    for text in (VALID[lang], *BROKEN[lang], *snippets(lang, "valid"), *snippets(lang, "invalid")):
        assert "".join(chunks(text, lang, size)) == text
        assert S.status(text, lang, size) == S.status(text, lang), text


def test_maps_join_associatively(monkeypatch):
    monkeypatch.setattr(terminals, "SHRINK", 4)
    for lang in ("js", "java", "c", "php"):
        maps = [terminals.state_map(c, lang, not i) for i, c in enumerate(chunks(VALID[lang], lang, 60))]
        left, right = maps[0], maps[-1]
        for m in maps[1:]:
            left = terminals.join(left, m, lang)
        for m in maps[-2::-1]:
            right = terminals.join(m, right, lang)
        assert S.joined_status([left], lang) == S.joined_status([right], lang) == S.joined_status(maps, lang) is None
        assert len(left[terminals.START.get(lang, "code")][0]) < 0.7 * len(terminals.classes(VALID[lang], lang)[0])  # blocks have shrunk to their roles


def snippets(lang, kind):
    """Small programs, told apart by lines of dashes."""
    text = (Path(__file__).parent / "snippets" / f"{lang}.{kind}.txt").read_text()
    return [s.strip("\n") + "\n" for s in re.split(r"^-{4,}\n", text, flags=re.M) if s.strip()]


@pytest.mark.parametrize("lang", ["js", "ts", "java", "c", "go", "php", "rb"])
def test_snippets(lang):
    assert [s for s in snippets(lang, "valid") if S.fails(s, lang)] == []
    missed = [s for s in snippets(lang, "invalid") if not S.fails(s, lang)]
    assert len(missed) <= 0.1 * len(snippets(lang, "invalid")), missed


def test_depth_is_never_valid():
    assert S.status("x=" + "-" * 20_000 + "1 1\n", "py") is not None
    assert S.status("[" * 20_000, "json") == S.INVALID and S.status('{"a":' * 20_000, "json") == S.INVALID
    assert S.status("[" * 20_000 + "1" + "]" * 20_000, "json") is None
    assert S.status("x = " + "(" * 5_000 + "1" + ")" * 5_000 + ";", "js") is None
    assert S.status("x = " + "(" * 5_000 + "1 +" + ")" * 5_000 + ";", "js") == S.INVALID


@pytest.mark.parametrize("text", ['{"a": [1, {"b": null}], "c": "x"}', "[]", "{}", "1", '[1,]', '{"a" 1}', '{"a": }', "[1 2]", '{"a": 1,}', "", "]", '"\\x"', "01", "[1]]", '{1: 2}', "tru"])
def test_json_steps_agree_with_the_reader(text):
    assert S._json_steps(text) == (S._json(text) is None and bool(text.strip()))


def test_truncated_texts_are_found():
    for lang, text in VALID.items():
        if lang in ("py", "json", "php"):
            continue
        cut = text[: int(len(text) * (0.4 if lang == "js" else 0.6))].rstrip()
        assert S.fails(cut, lang), (lang, cut[-40:])


def test_operator(spark):
    rows = [(1, {"a.py": "def f(:\n", "b.txt": "(((", "c.js": "x("}, {"d.json": "{", "e.go": None}, "o/n"), (2, None, None, None), (3, {"a.py": "def f(:\n", "f.c": ""}, {}, "n/a"),
            (4, {"big.js": "f(1);\n" * 50 + "g(\n", "ok.js": "f(1);\n" * 50}, None, "O/N")]
    df = spark.createDataFrame(rows, "example_no long, files map<string,string>, repository_files map<string,string>, repo string").withColumns({"path": F.lit("x"), "lang": F.lit("y"), "source": F.lit("z"), "field": F.lit(1)})
    want = {(1, "files", "a.py"), (1, "files", "c.js"), (1, "repository_files", "d.json"), (3, "files", "a.py"), (4, "files", "big.js")}
    assert {tuple(r)[:3] for r in S.invalid_files(df).collect()} == want
    assert {tuple(r)[:3] for r in S.invalid_files(df, chunk=40).collect()} == want  # long files go by chunks
    rates = {(r.repo, r.lang): (r.n_files, r.n_invalid) for r in S.invalid_rates(df).collect()}
    assert rates[("o/n", "js")] == (3, 2) and rates[(None, "py")] == (1, 1)
    assert S.invalid_files(df.limit(0)).count() == 0
