"""From texts to the classes that the grammars read, chunk by chunk.

A chunk's reading depends on the state in which it begins: code, or inside a comment or literal that may span lines. Its
state map gives for each begin state the classes and the state in which the chunk ends; maps of neighbours join
associatively, and balanced stretches in braces shrink to one class that tells the roles they can play.
"""

from __future__ import annotations

import re

from sluicebed.functions.lexing import tokens
from sluicebed.llm.grammars import GRAMMARS
from sluicebed.llm.grammars.base import Broken

#: A character, number or literal without a place in the language; no grammar knows it.
WRONG = "E"
#: States other than code in which a chunk may begin, and where they end.
STATES = {
    "js": {"block": r"\*/"}, "ts": {"block": r"\*/"}, "java": {"block": r"\*/", "text": r'(?<!\\)"""'}, "c": {"block": r"\*/"},
    "go": {"block": r"\*/", "`": "`"}, "php": {"html": "", "block": r"\*/", '"': r'(?:[^"\\]|\\[\s\S])*?"', "'": r"(?:[^'\\]|\\[\s\S])*?'"},
    "rb": {'"': r'(?:[^"\\]|\\[\s\S])*?"', "'": r"(?:[^'\\]|\\[\s\S])*?'"},
}
#: The state in which a file begins, where it isn't code.
START = {"php": "html"}
_HEX = r"[\da-fA-F_]"
# What follows a hexadecimal e and a sign is an operand of its own; names after a point are members of the number.
_NUMBERS = {
    "js": rf"0[xX]{_HEX}+(?:n|[+-]\w*)?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.[\d_]+)(?:[eE][+-]?[\d_]+)?n?(?:\.[A-Za-z_$][\w$.]*)?|\d+\.\.[A-Za-z]\w*",
    "java": rf"0[xX]{_HEX}*\.?{_HEX}*(?:[pP][+-]?\d+)?(?:[lLfFdD]|[+-]\w*)?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.[\d_]+)(?:[eE][+-]?[\d_]+)?[lLfFdD]?",
    "c": r"0[xX][\da-fA-F.]*(?:[pP][+-]?\d+)?(?:[uUlLfFzZwWbBiI\d]*|[+-]\w*)|0[bB][01]+[uUlL]*|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[uUlLfFzZiIjJdDwWbB]*(?:16|32|64|128)?[xX]?",
    "go": rf"0[xX]{_HEX}*\.?{_HEX}*(?:[pP][+-]?\d+)?(?:i|[+-]\w*)?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?[\d_]*|\.[\d_]+)(?:[eE][+-]?[\d_]+)?i?",
    "php": rf"0[xX]{_HEX}+(?:[+-]\w*)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.[\d_]+)(?:[eE][+-]?[\d_]+)?",
    "rb": rf"(?:0[xX]{_HEX}+(?:[+-]\w*)?|0[bB][01_]+|0[oOdD][\d_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)r?i?(?:\.[.\w]*)?",
}
_NUMBERS["ts"] = _NUMBERS["js"]
_number = {lang: re.compile(p) for lang, p in _NUMBERS.items()}
_JS_STRING = re.compile(r"(?:[^\\]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|u\{[\da-fA-F]+\}|[^xu]))*", re.S)
_JAVA_ESCAPE = r"\\(?:[btnfrs\"'\\0-7]|u+[\da-fA-F]{4})"
_GO_ESCAPE = r"\\(?:[abfnrtv\\\"']|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8})"
_STRINGS = {
    "java": re.compile(rf"\"\"\"[\s\S]*|\"(?:[^\"\\\n]|{_JAVA_ESCAPE})*\"|'(?:[^'\\\n]{{1,2}}|\\(?:[btnfrs\"'\\]|[0-7]{{1,3}}|u+[\da-fA-F]{{4}}))'"),
    "go": re.compile(rf"`[^`]*`|\"(?:[^\"\\\n]|{_GO_ESCAPE})*\"|'(?:[^'\\\n]|{_GO_ESCAPE})'"),
    "c": re.compile(r"(?:u8|[uUL])?\"[\s\S]*\"|[uUL]?'[\s\S]+'"),
}
_FLAGS = re.compile(r"/([dgimsuvy]*)\Z")
_HOLE = re.compile(r"\$\{([^{}`'\"]*)\}")
_AFTER_NUMBER = re.compile(r"\A[\d_]*(?:\.\d[\d_]*)?\w*(?:[eE][+-]?\d+)?|\.\.?\.?|\w+")
_CAPITALS = re.compile(r"[A-Z_][A-Z0-9_]*\Z")
_CONDITION = re.compile(r"[ \t]*#[ \t]*(if|elif|else|endif)")
_VALUES = {"js": ("true", "false", "null"), "java": ("true", "false", "null")}
_VALUES["ts"] = _VALUES["js"]
_words = {lang: {w: w for w in g.WORDS} | dict.fromkeys(_VALUES.get(lang, ()), "n") for lang, g in GRAMMARS.items()}
_holes: dict[tuple[str, str], bool] = {}
_LINES = {"js", "ts", "go", "rb", "c"}
_NAMED = ("w", "n", "s", ")", "]", "}", "end", "self", "nil", "true", "false")


def _hole_ok(code: str, lang: str) -> bool:
    """True if what stands in a template's ${} is an expression."""
    known = _holes.get((lang, code))
    if known is None:
        if len(_holes) > 50_000:
            _holes.clear()
        known = False
        for part in ("expression", "type") if lang == "ts" else ("expression",):
            try:
                g = GRAMMARS[lang](_plain(code, lang, tokens(code, lang))[0])
                getattr(g, part)()
                known = known or g.t[g.i] == ""
            except Broken:
                continue
        _holes[lang, code] = known
    return known


def _plain(text: str, lang: str, toks: list) -> tuple[list[str], str]:
    """Classes of tokens, and the state in which they end, for all languages but Ruby."""
    out: list[str] = []
    add = out.append
    words, number, lines = _words[lang], _number[lang], lang in _LINES
    good = _STRINGS.get(lang)
    script = lang in ("js", "ts")
    directive = joined = False
    declared: set[str] = set()
    for kind, a, b in toks:
        if directive:  # the rest of a directive's line, after a comment in it
            if kind == "L" and not joined:
                directive = False
                add("\n")
            joined = kind == "X" and text[a] == "\\"
            continue
        if kind in "([{)]}":
            add(kind)
        elif kind == "W":
            t = text[a:b]
            if lang == "php":
                add("v" if t[0] == "$" else words.get(t.lower(), "w"))
            elif lang == "java":
                x = words.get(t)
                if x is None:
                    if out and out[-1] in ("class", "interface", "enum", "record"):
                        declared.add(t)
                    x = "W" if t[0].isupper() or t in declared else "w"
                add(x)
            elif lang == "c":
                add(words.get(t) or ("W" if _CAPITALS.match(t) else "w"))
            else:
                add(words.get(t, "w"))
        elif kind == "O":
            t = text[a:b]
            add(";" if lang == "php" and t[:2] == "?>" else t)
        elif kind == "S":
            if good is not None:
                add("s" if good.fullmatch(text, a, b) else WRONG)
            elif script:
                c = text[a]
                if c == "`":
                    add("t" if "${" not in text[a:b] or all(_hole_ok(h, lang) for h in _HOLE.findall(text, a, b)) else WRONG)
                elif c == "/":
                    flags = _FLAGS.search(text, a, b)
                    add("s" if flags and len(set(flags[1])) == len(flags[1]) else WRONG)
                else:
                    add("s" if "\\" not in text[a:b] or _JS_STRING.fullmatch(text, a + 1, b - 1) else WRONG)
            else:
                add("s")
        elif kind == "N":
            add("n" if number.fullmatch(text, a, b) else WRONG)
        elif kind == "C":
            continue
        elif kind == "L":
            if lines:
                add("\n")
        elif kind == "D":
            m = _CONDITION.match(text, a)
            add(f"#{m[1]}" if m else "#")
            directive, joined = True, False
        elif kind == "H":
            add(";")
        elif kind in "VU":
            name = _state(text, a, lang) if kind == "U" else None
            if name:
                return out, name
            return [*out, WRONG], f"?{a}"
        elif kind == "X" and text[a] == "\\" and lang == "c" and re.compile(r"\\\r?\n").match(text, a):
            continue
        else:
            add(WRONG)
    return out, "code"


def _state(text: str, a: int, lang: str) -> str | None:
    opened = text[a : a + 3]
    name = "block" if opened[:2] == "/*" else "text" if opened == '"""' else opened[:1]
    return name if name in STATES[lang] else None


def _ruby(text: str, toks: list) -> tuple[list[str], str]:
    """Classes of Ruby's tokens: labels, symbols and blanks that matter are told apart here."""
    out: list[str] = []
    words, number = _words["rb"], _number["rb"]
    pending = skip = asked = 0
    prev = "\n"
    for n, (kind, a, b) in enumerate(toks):
        if kind == "C":
            continue
        if skip > a:
            continue
        if kind == "L":
            prev = "\n"
            out.append(prev)
            asked = 0
            continue
        blank = a == 0 or text[a - 1] in " \t\n\r"
        tight = text[b : b + 1]
        if kind == "W":
            t = text[a:b]
            before = out[-2] if len(out) > 1 else ""
            if tight == ":" and text[b + 1 : b + 2] != ":" and not (asked and prev == "?") and not (asked and text[b + 1 : b + 2] in (" ", "") and prev not in (",", "(", "{", "|", "\n", "w")):
                x, skip = "l", b + 1
            elif prev == "def" or prev == "." and before in ("self", "w") and len(out) > 2 and out[-3] == "def":
                x = "self" if t == "self" and tight == "." else "w"
                if tight == "=" and text[b + 1 : b + 2] not in ("=", "~", ">", "") and (text[b + 1] == "(" or text[b + 1].isalpha() or text[b + 1] == "_"):
                    skip = b + 1
            elif prev in (".", "&."):
                x = "w"
            else:
                x = words.get(t, "w")
        elif kind == "S":
            if pending and text[a - 1 : a] == "\n" and not text.startswith("<<", a):
                pending -= 1
                continue
            if text.startswith("<<", a) and b - a > 2 and text[a + 2] not in " \t":
                pending += 1
            if tight == ":" and text[a] in "\"'" and text[b + 1 : b + 2] != ":" and prev in (",", "(", "{", "|", "\n", "w", "_("):
                x, skip = "l", b + 1
            else:
                x = "s"
        elif kind == "N":
            x = "n" if number.fullmatch(text, a, b) else WRONG
            for part in _AFTER_NUMBER.findall(text[a:b])[1:]:  # 3.times, 0...n.size
                out.append(x)
                x = part if part[0] == "." else "n" if part[0].isdigit() else "w"
        elif kind in "([":
            x = f"_{kind}" if blank and prev != "\n" else kind
        elif kind in "{)]}":
            x = kind
        elif kind == "O":
            x = text[a:b]
            if x == ":" and tight.strip() and not (asked and blank and prev in _NAMED and text[b : b + 1] == " "):
                m = re.compile(r"[A-Za-z_@$\u0080-\U0010ffff][\w@$]*[?!]?(?:=(?![=~>]))?|\[\]=?|[-+!~]@|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[-+*/%<>&|^~`]").match(text, b)
                if m and not (asked and prev in _NAMED and blank):
                    x, skip = "s", m.end()
                    if prev == "s" and not blank:
                        x = ":"
                        skip = 0
                elif asked and prev in _NAMED:
                    asked -= 1
            elif x == "?":
                char = re.compile(r"\\?\S(?!\w)").match(text, b)
                if char and prev not in _NAMED:
                    x, skip = "s", char.end()
                else:
                    asked += 1
            elif x == ":" and asked:
                asked -= 1
            elif blank and tight.strip() and x in ("-", "+", "*", "&", "**", "::", "!", "~", "..", "...", "<<") and prev != "\n":
                x = f"u{x}"
        elif kind in "VU":
            name = _state(text, a, "rb") if kind == "U" else None
            if name:
                return out, name
            return [*out, WRONG], f"?{a}"
        elif kind == "X" and text[a] == "@" and len(out) > 1 and out[-2] == "def":  # def -@
            x = "@"
        else:
            x = WRONG
        prev = x
        out.append(x)
    return out, "code"


def classes(text: str, lang: str, state: str | None = None) -> tuple[list[str], str]:
    """The classes of a chunk that begins in this state, and the state in which it ends.

    A state that STATES does not name stands for an unclosed construct that only a reading from its beginning can close.
    """
    pos = 0
    head: list[str] = []
    state = state or START.get(lang, "code")
    if state not in ("code", "html"):
        rule = re.compile(STATES[lang][state])
        m = rule.match(text) if state in "\"'" else rule.search(text)
        if not m:
            return [], state
        pos = m.end()
        if state != "block":
            head = ["s"]
    elif text[:1] == "\ufeff":
        pos = 1
    toks = tokens(text, lang, pos, inside=state != "html")
    out, end = _ruby(text, toks) if lang == "rb" else _plain(text, lang, toks)
    if end == "code" and lang == "php" and (text.startswith("?>", toks[-1][1]) if toks and toks[-1][0] != "H" else state == "html"):
        end = "html"
    return head + out, end


def state_map(chunk: str, lang: str, first: bool) -> dict[str, tuple[list[str], str]]:
    """Begin state -> (classes, end state); the first chunk of a file begins in one state only."""
    states = [START.get(lang, "code")] if first else ["code", *STATES.get(lang, {})]
    return {s: (shrunk(got, lang), end) for s in states for got, end in (classes(chunk, lang, s),)}


def join(a: dict, b: dict, lang: str) -> dict:
    """The map of two neighbours; associative but for how far stretches have shrunk."""
    out = {}
    for state, (got, end) in a.items():
        if end in b:
            out[state] = (shrunk(got + b[end][0], lang), b[end][1])
        else:
            out[state] = ([*got, WRONG], end)
    return out


SHRINK = 24  # classes; shorter stretches are not worth a class of their own
_roles: dict[tuple, str] = {}


def shrunk(got: list[str], lang: str) -> list[str]:
    """The classes with every balanced stretch in braces replaced by one class that names its roles."""
    grammar = GRAMMARS[lang]
    stack: list[tuple[int, bool]] = []
    out: list[str] = []
    for x in got:
        out.append(x)
        if x == "{":
            stack.append((len(out) - 1, True))
        elif x in ("(", "[", "_(", "_["):
            stack.append((len(out) - 1, False))
        elif x in ("]", ")"):
            if stack and not stack[-1][1]:
                stack.pop()
            else:
                stack.clear()
        elif x == "}":
            if not stack or not stack[-1][1]:
                stack.clear()
                continue
            at, _ = stack.pop()
            if len(out) - at >= SHRINK:
                part = out[at:]
                if grammar.APART and not grammar.APART.isdisjoint(part) or WRONG in part:
                    continue
                key = (lang, *part)
                roles = _roles.get(key)
                if roles is None:
                    if len(_roles) > 20_000:
                        _roles.clear()
                    roles = _roles[key] = grammar.roles(part)
                if roles:
                    out[at:] = ["{#" + roles]
    return out


_NO_CUT = re.compile(r"[ \t]*/(?![/*])")  # a slash whose meaning depends on what stands before


def chunks(text: str, lang: str, size: int) -> list[str]:
    """Stretches of about size characters that end with lines: not with continued ones, and not inside a construct whose
    state has no name, read from code on."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        while True:
            end = text.find("\n", end - 1) + 1 or len(text)
            if end == len(text):
                break
            if text[max(0, end - 3) : end].endswith(("\\\n", "\\\r\n")) or _NO_CUT.match(text, end):
                end += 1
                continue
            _, state = classes(text[at:end], lang, START.get(lang, "code") if not at else "code")
            if state[0] != "?" or end - at > 64 * size:
                break
            end = min(len(text), end + size)
        out.append(text[at:end])
        at = end
    return out
