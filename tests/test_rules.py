"""Each rule against lines written by hand: what it sees on either side, and what masking takes away."""

import pytest

from sluicebed.operators import rules
from sluicebed.operators.difflines import numbered
from sluicebed.operators.stripping import masked_lines

# rule, path, a line that it sees, a line of the same kind that it must not see
TABLE = [
    ("R1", "db.php", "$name = addslashes ($raw);", '$name = "addslashes(";'),
    ("R1", "db.go", "stmt := preparedStatement(db)", "stmt := preparation(db)"),
    ("R1", "q.js", "const id = quoteIdentifier(col);", "const id = quotes;"),
    ("R2", "view.go", "out := escapeHTMLString(x)", 'out := "escape"'),
    ("R2", "view.rb", "text = my_escape_all(y)", "text = plain(y) # escape"),
    ("R2", "page.js", "DOMPurify.clean(html)", "purify(html)"),
    ("R3", "run.rb", "arg = Shellwords.escape(name)", "arg = words(name)"),
    ("R3", "run.py", "safe = shlex.quote(name)", "safe = shlex.split(name)"),
    ("R4", "cell.rs", "let pinned = Pin::new(&mut x);", "let p = new(&mut x);"),
    ("R5", "serve.go", 'if strings.Contains(p, x) || p == ".." { return strings.Contains(q, a..b) }', "if strings.Contains(p, x) { }"),
    ("R5", "serve.py", "base = os.path.realpath(root)", "base = os.path.join(root)"),
    ("R5", "up.php", "$n = basename ($n);", "$n = base($n);"),
    ("R6", "app.py", "app.add(CsrfViewMiddleware)", "app.add(ViewMiddleware)"),
    ("R6", "form.js", "send(csrf_token)", "send(token)"),
    ("R7", "ctl.rb", "authenticate! unless user.can?(:edit)", "check unless user"),
    ("R7", "ctl.py", "require_admin_auth(request)", "require_name(request)"),
    ("R7", "own.rb", "ensure_same_user(id)", "ensure_same(id)"),
    ("R8", "find.py", "db.execute(text + name)", "db.execute(text, name)"),
    ("R8", "find.php", "mysqli_query($c, $text . $name);", "mysqli_query($c, $text);"),
    ("R8", "f.java", "st. query(q.format(a))", "st.query(q)"),
    ("R9", "job.rb", "IO.popen(cmd)", "IO.read(cmd)"),
    ("R9", "job.js", "require(x).spawn (cmd)", "require(x).spawned"),
    ("R9", "job.py", "subprocess.Popen(cmd)", "subprocess.DEVNULL"),
    ("R10", "w.js", "node.innerHTML = text", "node.textContent = text"),
    ("R10", "w.html", "<p>{{ name }}</p>", "<p>{{ name.first }} {{ name }} | safe {{ name }}escape</p>"),
    ("R11", "io.py", "f = open(root + name)", "f = open(name)"),
    ("R11", "io.go", "os.Remove(dir + p)", "os.Rename(dir, p)"),
    ("R12", "mk.c", "mkdir(path, 0777);", "mkdir(path, 0500);"),
    ("R12", "mk.py", "os.makedirs(path, 0o750 & 072)", "os.makedirs(path)"),
    ("R13", "ev.py", "value = eval(text)", "value = evaluate(text)"),
    ("R13", "ev.php", "$o = unserialize ($s);", "$o = serialize($s);"),
    ("R13", "ev.py", "data = pickle.loads(raw)", "data = json.loads(raw)"),
    ("R14", "mem.c", "free(p);", "freeze(p);"),
    ("R14", "mem.rs", "ptr::drop_in_place(p);", "drop(p);"),
    ("R15", "buf.c", "strcpy (a, b);", "strlcpy(a, b);"),
]


def lines_of(spark, rows):
    """(number, path, op, text) as changed lines, masked as one file each."""
    df = spark.createDataFrame([(n, path, 0, op, 1, text) for n, path, op, text in rows], "example_no long, path string, pos int, op string, line long, text string")
    return masked_lines(df)


@pytest.mark.parametrize("op", ["+", "-"])
def test_every_rule_on_either_side(spark, op):
    rows = [(2 * i + k, path, op, line) for i, (_, path, *both) in enumerate(TABLE) for k, line in enumerate(both)]
    got = {(r.example_no, r.rule) for r in rules.rule_hits(lines_of(spark, rows)).collect()}
    assert {(2 * i, rule) for i, (rule, *_) in enumerate(TABLE)} <= got
    assert not {(2 * i + 1, rule) for i, (rule, *_) in enumerate(TABLE)} & got
    assert {rule for rule, *_ in TABLE} == {f"R{i}" for i in range(1, 16)}


def patch(path, minus, plus):
    return f"--- a/{path}\n+++ b/{path}\n@@ -1,{len(minus)} +1,{len(plus)} @@\n" + "".join(f"-{x}\n" for x in minus) + "".join(f"+{x}\n" for x in plus)


def scan(spark, diff):
    df = spark.createDataFrame([(1, diff)], "example_no long, diff string")
    lines = numbered(df).selectExpr("example_no", "path", "pos", "op", "coalesce(new_line, old_line) as line", "text")
    return [(r.kind, r.path, r.line, r.detail) for r in rules.findings_of(masked_lines(lines)).orderBy("seq", "path", "line").collect()]


EXPECTED = [
    # removed guards, net of added ones; csrf by both of its rules
    (patch("a.py", ["csrf_protect(view)", "safe = shlex.quote(x)", "view(x)"], ["view(y)"]), [
        ("diff_sanitizer_removed", "a.py", 2, "SQL escaping or binding removed: `safe = shlex.quote(x)`"),  # any call of a quote
        ("diff_sanitizer_removed", "a.py", 2, "shell quoting removed: `safe = shlex.quote(x)`"),
        ("diff_csrf_removed", "a.py", 1, "CSRF guard removed: `csrf_protect(view)`"),
        ("diff_csrf_removed", "a.py", 1, "CSRF protection deleted: `csrf_protect(view)`"),
    ]),
    # moved guards are no removals, repeated sinks count once, sinks that stood there before not at all
    (patch("b.py", ["n = shlex.quote(n)", "eval(old)"], ["m = shlex.quote(m)", "eval(old)", "eval(one)", "eval(two)"]), [("diff_sink", "b.py", 3, "code evaluation or unsafe loading: `eval(one)`")]),
    # a bound that goes
    (patch("c.c", ["  if (n >= 0 && n < BUF_MAX) {"], ["  if (n >= 0) {"]), [("diff_bounds_weakened", "c.c", 1, "bounds check weakened: `if (n >= 0 && n < BUF_MAX) {`")]),
    (patch("c.c", ["  if (n >= 0 && n < BUF_MAX) {"], ["  if (n < BUF_MAX) {"]), []),
    # comments and literals say nothing
    (patch("d.js", ["let a = 1; // innerHTML"], ["let a = `eval(x)`; /* system(x) */"]), []),
    (patch("e.py", ['"""', "verify_csrf in prose", '"""'], ["x = 'os.system'"]), []),
]


@pytest.mark.parametrize(("diff", "want"), EXPECTED)
def test_findings(spark, diff, want):
    assert scan(spark, diff) == want


def test_patterns_are_tested_once(spark):
    lines = lines_of(spark, [(1, "a.c", "+", "gets(x)")])
    plan = rules.all_hits(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gets|memcpy") == 1
