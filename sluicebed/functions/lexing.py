"""Lexers of the languages that the operators on sources read.

Each language has one compiled pattern; scanning gives the kind and span of every token without a step per character.
Kinds: C comment, S string or other literal text, U unterminated string or comment, V unterminated here-document, M conflict marker, N number, W word,
brackets as themselves, L line end, O operator, X a character with no place in the language, H text outside of code.
"""

from __future__ import annotations

import re

# Suffixes and their languages.
SUFFIXES = {
    ".py": "py", ".js": "js", ".ts": "ts", ".java": "java", ".c": "c", ".go": "go", ".php": "php", ".rb": "rb",
    ".json": "json",
}

_MARK = r"^(?:<{7}|>{7}|\|{7})(?=[ \t\r\n]|\Z)|^={7}(?=[ \t]*(?:[\r\n]|\Z))"
_DQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
_SQ = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_DQM = r'"(?:[^"\\]|\\[\s\S])*"'
_SQM = r"'(?:[^'\\]|\\[\s\S])*'"
_BLOCK, _LINE = r"/\*[\s\S]*?\*/", r"//[^\n]*"
_NUM = r"\.?[0-9](?:[eEpP][+-]|[0-9A-Za-z_.])*"
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"


def _pattern(*parts: tuple[str, str]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in parts), re.M)


_TAIL = (("L", r"\n"), ("B", r"[()\[\]{}]"))
_PATTERNS = {
    "js": _pattern(
        ("M", _MARK), ("C", rf"{_BLOCK}|{_LINE}|\A#![^\n]*"), ("S", rf"{_DQ}|{_SQ}"), ("T", "`"),
        ("U", r"/\*|[\"']"), ("W", r"[A-Za-z_$\u0080-\U0010ffff][\w$]*|\\u[0-9A-Fa-f]{4}[\w$]*|#[A-Za-z_$][\w$]*"), ("N", _NUM), *_TAIL,
        ("R", "/"), ("O", r"=>|\.\.\.|\+\+|--|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.|[=!]==?|[-+*%&|^<>]=|>>>=?|<<=?|>>=?|\*\*=?|[-+*%&|^<>=!~?:.,;@]"),
        ("X", r"[^\s]"),
    ),
    "java": _pattern(
        ("M", _MARK), ("C", rf"{_BLOCK}|{_LINE}"), ("S", rf'"""[\s\S]*?(?<!\\)"""|{_DQ}|{_SQ}'), ("U", r"/\*|[\"']"),
        ("W", r"[A-Za-z_$\u0080-\U0010ffff][\w$]*"), ("N", _NUM), *_TAIL,
        ("O", r"->|::|\.\.\.|\+\+|--|&&|\|\||[=!<>]=|[-+*/%&|^]=|>>>=|<<=|>>=|[-+*/%&|^<>=!~?:.,;@]"), ("X", r"[^\s]"),
    ),
    "c": _pattern(
        ("M", _MARK), ("C", rf"{_BLOCK}|//(?:[^\\\n]|\\(?:\r\n|[\s\S]))*"), ("D", r"^[ \t]*#(?:[^\\\n/]|\\(?:\r\n|[\s\S])|/(?![/*]))*"),
        ("S", rf"(?:u8|[uUL])?{_DQ}|[uUL]?{_SQ}"), ("U", r"/\*|[\"']"),
        ("W", r"[A-Za-z_$\u0080-\U0010ffff][\w$]*"), ("N", _NUM), *_TAIL,
        ("O", r"->|\.\.\.|\+\+|--|&&|\|\||<<=|>>=|<<|>>|[=!<>]=|[-+*/%&|^]=|[-+*/%&|^<>=!~?:.,;]"), ("X", r"[^\s]"),
    ),
    "go": _pattern(
        ("M", _MARK), ("C", rf"{_BLOCK}|{_LINE}"), ("S", rf"`[^`]*`|{_DQ}|{_SQ}"), ("U", r"/\*|[\"'`]"),
        ("W", r"[A-Za-z_\u0080-\U0010ffff]\w*"), ("N", _NUM), *_TAIL,
        ("O", r":=|<-|\.\.\.|\+\+|--|&&|\|\||&\^=?|<<=|>>=|<<|>>|[=!<>]=|[-+*/%&|^]=|[-+*/%&|^<>=!:.,;~]"), ("X", r"[^\s]"),
    ),
    "php": _pattern(
        ("M", _MARK), ("E", r"\?>\n?"), ("C", rf"{_BLOCK}|(?://|#(?!\[))(?:[^\n?]|\?(?!>))*"),
        ("I", '"'), ("S", rf"{_SQM}|`[^`]*`|<<<[ \t]*(?P<q>[\"']?)(?P<here>[A-Za-z_]\w*)(?P=q)\r?\n(?:[\s\S]*?\n)??[ \t]*(?P=here)\b"),
        ("V", r"<<<[ \t]*[\"']?[A-Za-z_]\w*[\"']?\r?\n"), ("U", r"/\*|[\"'`]"), ("W", r"\$*\\?[A-Za-z_\u0080-\U0010ffff]\w*(?:\\[A-Za-z_\u0080-\U0010ffff]\w*)*"), ("N", _NUM), *_TAIL,
        ("O", r"<=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|->|=>|::|\+\+|--|&&|\|\||\?\?|\*\*|<<|>>|<>|[=!<>]=|[-+*/%&|^.]=|#(?=\[)|[-+*/%&|^<>=!~?:.,;@$\\]"),
        ("X", r"[^\s]"),
    ),
    "rb": _pattern(
        ("M", _MARK), ("C", r"#[^\n]*|^=begin\b[\s\S]*?^=end\b[^\n]*|^__END__\r?\n[\s\S]*"),
        ("I", '"'), ("S", rf"{_SQM}|`(?:[^`\\]|\\[\s\S])*`|%[qQwWiIrsx]?(?:\[[^\]]*\]|\{{[^}}]*\}}|\([^)]*\)|<[^>]*>|\|[^|]*\||![^!]*!)[a-z]*|(?<![\w)\]]):\"(?:[^\"\\]|\\[\s\S])*\""),
        ("H", r"<<[~-]?(?P<q>[\"'`]?)(?P<here>[A-Z_a-z]\w*)(?P=q)"), ("U", r"[\"'`]|^=begin\b"),
        ("W", r"(?:@@?|\$)?[A-Za-z_\u0080-\U0010ffff]\w*[?!]?(?![=~]=?(?<=[!?]=))|\$[^\sA-Za-z]"), ("N", _NUM), *_TAIL, ("R", "/"),
        ("O", r"<=>|===|=~|!~|\*\*=?|\.\.\.?|&\.|->|=>|::|&&=?|\|\|=?|<<=?|>>=?|[=!<>]=|[-+*%&|^]=|[-+*%&|^<>=!~?:.,;\\]"),
        ("X", r"[^\s]"),
    ),
    "py": _pattern(
        ("C", r"#[^\n]*"),
        ("S", r"(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')"),
        ("U", r"[\"']"), ("W", r"[A-Za-z_\u0080-\U0010ffff]\w*"), ("N", _NUM), *_TAIL, ("O", r"[-+*/%&|^<>=!~:.,;@\\]+"), ("X", r"[^\s]"),
    ),
}
_PATTERNS["ts"] = _PATTERNS["js"]
_PATTERNS["rs"] = _pattern(
    ("M", _MARK), ("C", rf"{_BLOCK}|{_LINE}"), ("S", rf'b?r(?P<q>#*)"[\s\S]*?"(?P=q)|b?{_DQM}|b?\'(?:\\[^\n]|[^\'\\\n])[^\'\n]{{0,8}}?\''), ("U", r'/\*|"'),
    ("W", r"'?[A-Za-z_\u0080-\U0010ffff]\w*!?"), ("N", _NUM), *_TAIL, ("O", r"->|=>|::|\.\.=?|&&|\|\||<<=|>>=|<<|>>|[=!<>]=|[-+*/%&|^]=|[-+*/%&|^<>=!?:.,;@#$']"), ("X", r"[^\s]"),
)
_PATTERNS["sh"] = _pattern(
    ("C", r"(?:(?<=\s)|^)#[^\n]*"), ("S", rf"{_DQM}|'[^']*'"), ("U", r"[\"']"), ("W", r"[A-Za-z_$][\w$-]*"), ("N", _NUM), *_TAIL, ("O", r"[^\s\w()\[\]{}\"']"), ("X", r"[^\s]"),
)
_PATTERNS["cs"] = _pattern(
    ("C", rf"{_BLOCK}|{_LINE}"), ("S", rf'\$?@\$?"(?:[^"]|"")*"|\$?""\"[\s\S]*?""\"|\$?{_DQ}|{_SQ}'), ("U", r"/\*|[\"']"),
    ("W", r"@?[A-Za-z_\u0080-\U0010ffff]\w*"), ("N", _NUM), *_TAIL, ("O", r"=>|->|::|\?\?=?|\+\+|--|&&|\|\||[=!<>]=|[-+*/%&|^]=|[-+*/%&|^<>=!~?:.,;#$]"), ("X", r"[^\s]"),
)
_OPEN_PHP = re.compile(r"<\?(?:php\b|=)?")
_OPENERS = {"(": ")", "[": "]", "{": "}"}
#: Words after which a slash begins a pattern.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "and", "or", "not", "if", "unless", "when", "while", "until", "then", "elsif", "puts", "split", "match", "yield", "await"}
_regex_at = re.compile(_REGEX)
_template = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")


def _js_template(text: str, i: int) -> int:
    """End of the template literal whose "`" is at i, or -1."""
    n, i = len(text), i + 1
    depth: list[int] = []  # braces open in each ${}
    while i < n:
        if not depth:
            i = _template.match(text, i).end()
            if i >= n:
                return -1
            if text[i] == "`":
                return i + 1
            depth.append(0)
            i += 2
            continue
        ch = text[i]
        if ch in "\"'":
            m = re.compile(_DQ if ch == '"' else _SQ).match(text, i)
            if not m:
                return -1
            i = m.end()
        elif ch == "`":
            i = _js_template(text, i)
            if i < 0:
                return -1
        elif ch == "/" and text[i + 1 : i + 2] not in ("/", "*") and text[:i].rstrip()[-1:] in "(,=:[!&|?{;" and (m := _regex_at.match(text, i)):
            i = m.end()
        else:
            if ch == "{":
                depth[-1] += 1
            elif ch == "}":
                if depth[-1] == 0:
                    depth.pop()
                else:
                    depth[-1] -= 1
            i += 1
    return -1


_FLAT = {"rb": re.compile(r'"(?:[^"\\#]|\\[\s\S]|#(?!\{))*"'), "php": re.compile(r'"(?:[^"\\{]|\\[\s\S]|\{(?!\$))*"')}
_HOLE = {"rb": "#{", "php": "{$"}


def _interpolated(text: str, i: int, lang: str) -> int:
    """End of the double-quoted literal at i, which may hold code with literals of its own, or -1."""
    m = _FLAT[lang].match(text, i)
    if m:
        return m.end()
    n, hole, i = len(text), _HOLE[lang], i + 1
    while i < n:
        ch = text[i]
        if ch == "\\":
            i += 2
        elif ch == '"':
            return i + 1
        elif text.startswith(hole, i):
            depth, i = 1, i + len(hole)
            while i < n and depth:
                ch = text[i]
                if ch == '"':
                    i = _interpolated(text, i, lang)
                    if i < 0:
                        return -1
                    continue
                if ch == "'":
                    m = re.compile(_SQM).match(text, i)
                    if m:
                        i = m.end()
                        continue
                depth += (ch == "{") - (ch == "}")
                i += 1
        else:
            i += 1
    return -1


def _closes_condition(out: list[tuple[str, int, int]], text: str) -> bool:
    """True if the last token closes the condition of a statement, after which a slash begins a pattern."""
    depth, i = 0, len(out) - 1
    while i >= 0:
        kind = out[i][0]
        depth += (kind == ")") - (kind == "(")
        if depth == 0 and kind == "(":
            return i > 0 and text[out[i - 1][1] : out[i - 1][2]] in ("if", "while", "for", "with")
        i -= 1
    return False


def tokens(text: str, lang: str, pos: int = 0, inside: bool = False) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all tokens from pos on, without blanks; inside: the text goes on from earlier code."""
    out: list[tuple[str, int, int]] = []
    add = out.append
    pattern = _PATTERNS[lang]
    n = len(text)
    heredocs: list[tuple[str, bool]] = []
    if lang == "php" and not inside:
        m = _OPEN_PHP.search(text)
        if not m:
            return [("H", 0, n)] if text.strip() else []
        if text[: m.start()].strip():
            add(("H", 0, m.start()))
        pos = m.end()
    scan = pattern.finditer(text, pos)
    while True:
        again = None
        for m in scan:
            kind = m.lastgroup
            if kind in ("q", "here"):
                kind = "H" if lang == "rb" else "S"
            if kind == "B":
                kind = m.group()
            elif kind == "W" or kind == "O" or kind == "N" or kind == "S" or kind == "C":
                pass
            elif kind == "L":
                if heredocs:
                    i = m.end()
                    for word, indented in heredocs:
                        e = re.compile(rf"^{'[ ' + chr(9) + ']*' if indented else ''}{word}(?=\r?$)", re.M).search(text, i)
                        if not e:
                            add(("V", i, n))
                            return out
                        add(("S", i, e.start()))
                        i = e.end()
                    heredocs = []
                    again = i
                    break
            elif kind in "TI":
                e = _js_template(text, m.start()) if kind == "T" else _interpolated(text, m.start(), lang)
                if e < 0:
                    add(("U", m.start(), n))
                    return out
                add(("S", m.start(), e))
                again = e
                break
            elif kind == "R":
                prev = next((t for t in reversed(out) if t[0] not in "LC"), None)
                opens = prev is None or prev[0] in "O([{;" or (prev[0] == "W" and text[prev[1] : prev[2]] in _BEFORE_REGEX)
                if not opens and lang == "rb" and prev[0] == "W" and text[m.start() - 1] in " \t" and text[m.end() : m.end() + 1] not in (" ", "="):
                    opens = True
                if not opens and lang != "rb" and prev[0] == ")":
                    opens = _closes_condition(out, text)
                e = _regex_at.match(text, m.start()) if opens else None
                if e:
                    add(("S", m.start(), e.end()))
                    again = e.end()
                    break
                kind = "O"
                if text[m.end() : m.end() + 1] == "=":
                    add(("O", m.start(), m.end() + 1))
                    again = m.end() + 1
                    break
            elif kind == "H":
                prev = out[-1] if out else None
                tight = prev is not None and prev[0] in "WN)]S" and prev[2] == m.start()
                spaced = text[m.end("here") if m.group("here") else m.end() :][:0]
                word = m.group("here")
                if tight or (prev is not None and prev[0] in "N)]S" and text[m.start() + 2] not in "~-\"'`") or (not word[0].isupper() and text[m.start() + 2] not in "~-\"'`"):
                    add(("O", m.start(), m.start() + 2))
                    again = m.start() + 2 + len(spaced)
                    break
                heredocs.append((re.escape(word), text[m.start() + 2] in "~-"))
                kind = "S"
            elif kind == "E":
                add(("O", m.start(), m.end()))
                o = _OPEN_PHP.search(text, m.end())
                if not o:
                    return out
                again = o.end()
                break
            elif kind in "UV":
                add((kind, m.start(), n))
                return out
            add((kind, m.start(), m.end()))
        if again is None:
            if heredocs:
                add(("V", n, n))
            return out
        scan = pattern.finditer(text, again)


def unbalanced(toks: list[tuple[str, int, int]]) -> bool:
    """True if brackets do not pair up."""
    stack: list[str] = []
    for kind, _, _ in toks:
        if kind in "([{":
            stack.append(_OPENERS[kind])
        elif kind in ")]}" and (not stack or stack.pop() != kind):
            return True
    return bool(stack)
