"""C.

Macros are not expanded, so what only a macro can mean is taken as they may mean it: a call in capitals stands as a statement
or a declaration of its own, a call before a block is a loop, types stand among arguments. Of alternatives under
#if, the first ones and the last ones are each read as a program.
"""

from __future__ import annotations

from sluicebed.llm.grammars.base import Broken, Grammar

# Words of the language by their part.
TYPES = frozenset(
    "void char short int long float double signed unsigned struct union enum const volatile restrict inline static extern register auto typedef bool _Bool _Complex _Noreturn _Atomic _Thread_local thread_local __inline __inline__ __restrict __const __volatile__ __extension__ constexpr typeof __typeof__ __typeof _Alignas alignas __attribute__ __attribute __declspec __signed__".split()
)
BASE = frozenset("void char short int long float double signed unsigned bool _Bool auto _Complex __signed__".split())
ONCE = frozenset("void char short int float double signed unsigned bool".split())
PARENS = frozenset("typeof __typeof__ __typeof _Alignas alignas __attribute__ __attribute __declspec _Atomic".split())
RESERVED = frozenset("break case continue default do else for goto if return sizeof switch while _Alignof alignof __alignof__ _Generic asm __asm__ __asm _Static_assert static_assert".split())
BINARY = frozenset("+ - * / % & | ^ && || == != < > <= >= << >>".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
PREFIX = frozenset("+ - ! ~ * & &&".split())
NAME = frozenset({"w", "W"})
OPERAND = frozenset({"w", "W", "n", "s", "(", "!", "~", "{", "++", "--", "sizeof", "__extension__", "-", "+", "&", "*"})
DIRECTIVES = frozenset({"#if", "#elif", "#else", "#endif", "#"})


class CSource(Grammar):
    BRACED = {"b": "statements", "v": "values", "f": "fields", "e": "constants", "x": "declarations"}
    WORDS = TYPES | RESERVED
    APART = frozenset({"#if", "#elif", "#else", "#endif"})

    @classmethod
    def accepts(cls, raw: list[str]) -> bool:
        if "#else" not in raw and "#elif" not in raw:
            return super().accepts([x for x in raw if x not in DIRECTIVES])
        return all(super(CSource, cls).accepts(x) for x in (chosen(raw, False), chosen(raw, True)))

    def prepared(self, raw: list[str]) -> list[str]:
        self.fresh, out = set(), []
        for x in raw:
            if x == "\n":
                self.fresh.add(len(out))
            elif x not in DIRECTIVES:
                out.append(x)
        return out

    # declarations

    def source(self) -> None:
        while self.t[self.i]:
            self.external()

    def declarations(self) -> None:
        while self.t[self.i] != "}":
            if not self.t[self.i]:
                raise Broken
            self.external()

    def external(self) -> None:
        t = self.t
        if self.take(";"):
            return
        if t[self.i] in ("asm", "__asm__", "__asm"):
            self.i += 1
            self.take("volatile")
            self.skip()
            self.take(";")
            return
        if t[self.i] in ("_Static_assert", "static_assert"):
            return self.asserted()
        if t[self.i] == "extern" and t[self.i + 1] == "s":
            self.i += 2
            if t[self.i] == "{" or t[self.i][:2] == "{#":
                return self.braced("x")
            return self.external()
        if t[self.i] in NAME and t[self.i + 1] == "(":  # a macro, or a function of type int
            close = self.end[self.i + 1]
            after = t[close + 1]
            if after == ";":
                self.i += 1
                self.arguments()
                self.i += 1
                return
            if after == "=" and t[self.i] == "W":
                self.i = close + 2
                self.value()
                self.take(";")
                return
            if after[:1] != "{" and (after == "" or close + 1 in self.fresh):
                if after not in TYPES or not self.attempt(lambda: self.declaration(True)):
                    self.i = close + 1
                return
        if t[self.i] == "W" and (t[self.i + 1] == "" or self.i + 1 in self.fresh and t[self.i + 1] not in ("{", "=", ";", ",", "[", ":")):
            at = self.i
            if not self.attempt(lambda: self.declaration(True)):
                self.i = at + 1
            return
        self.declaration(True)

    def asserted(self) -> None:
        self.i += 1
        self.arguments()
        self.need(";")

    def skip(self) -> None:
        """A balanced stretch in parentheses, read by the pairing of brackets only."""
        if self.t[self.i] != "(":
            raise Broken
        self.i = self.end[self.i] + 1

    def attributes(self) -> None:
        t = self.t
        while True:
            if t[self.i] in ("__attribute__", "__attribute", "__declspec"):
                self.i += 1
                self.skip()
            elif t[self.i] in ("asm", "__asm__", "__asm"):
                self.i += 1
                self.skip()
            elif t[self.i] == "[" and t[self.i + 1] == "[":
                self.i = self.end[self.i] + 1
            elif t[self.i] == "W" and t[self.i + 1] == "(" and t[self.end[self.i + 1] + 1] in ("{", ";", "=", ",", "W"):
                self.i = self.end[self.i + 1] + 1
            elif t[self.i] == "W" and (t[self.i + 1] in ("{", ";", "=", ",") or t[self.i + 1][:2] == "{#"):
                self.i += 1
            else:
                return

    def specifiers(self) -> int:
        """Reads the words before a declarator; the number that name a type."""
        t, named, typed = self.t, 0, False
        seen: set[str] = set()
        while True:
            x = t[self.i]
            if x in TYPES:
                self.i += 1
                if x in ("struct", "union", "enum"):
                    self.attributes()
                    tagged = t[self.i] in NAME
                    if tagged:
                        self.i += 1
                        if t[self.i - 1] == "W" and t[self.i] in NAME and (t[self.i + 1] == "{" or t[self.i + 1][:2] == "{#"):
                            self.i += 1
                    if x == "enum" and self.take(":"):
                        self.specifiers()
                    if t[self.i] == "{" or t[self.i][:2] == "{#":
                        self.braced("e" if x == "enum" else "f")
                    elif not tagged:
                        raise Broken
                    self.attributes() if t[self.i] in ("__attribute__", "__attribute") else None
                    named += 1
                    typed = True
                elif x in PARENS:
                    if t[self.i] == "(":
                        self.skip()
                    named += x in ("typeof", "__typeof__", "__typeof", "_Atomic")
                elif x in BASE:
                    named += 1
                    typed = True
                    if x in ONCE:
                        if x in seen:
                            raise Broken
                        seen.add(x)
            elif x == "[" and t[self.i + 1] == "[":
                self.i = self.end[self.i] + 1
            elif x in NAME:
                nxt = t[self.i + 1]
                if x == "W" and nxt == "(" and (t[self.end[self.i + 1] + 1] in TYPES or t[self.end[self.i + 1] + 1] in ("w", "W", "*")):
                    self.i = self.end[self.i + 1] + 1
                    named += 1
                elif nxt in TYPES or (nxt in NAME or nxt == "*") and (not typed or x == "W" or self.i in self.fresh or not seen and t[self.i + 2] == "(") or nxt == "(" and (t[self.i + 2] in ("*", "^") or not named and t[self.i + 2] == "W" and t[self.i + 3] == "*"):
                    self.i += 1
                    named += 1
                    typed = typed or x == "w"
                elif not named and nxt in (")", ",", "[", "...", ":"):
                    self.i += 1
                    named += 1
                else:
                    return named
            else:
                return named

    def declaration(self, outer: bool = False) -> None:
        t = self.t
        at = self.i
        named = self.specifiers()
        if self.take(";"):
            if not named and self.i - at < 2:
                raise Broken
            return
        if not named and self.i == at and not (outer and t[self.i] in NAME and t[self.i + 1] == "("):
            raise Broken
        while True:
            function = self.declarator()
            self.attributes()
            while function and t[self.i] in NAME and t[self.i + 1] == "(":  # a macro that annotates
                self.i = self.end[self.i + 1] + 1
            if function and (t[self.i] == "{" or t[self.i][:2] == "{#"):
                self.braced("b")
                return
            if function and outer and (t[self.i] in TYPES or t[self.i] in NAME and t[self.i + 1] in ("w", "*")):  # parameters in the old form
                while t[self.i] != "{" and t[self.i][:2] != "{#":
                    self.declaration()
                    if t[self.i - 1] != ";":
                        raise Broken
                self.braced("b")
                return
            if self.take("="):
                self.value()
            if not self.take(","):
                break
        self.need(";")

    def declarator(self, abstract: bool = False) -> bool:
        """True if it declares a function."""
        t = self.t
        while t[self.i] in ("*", "^") or t[self.i] in TYPES and t[self.i] not in ("struct", "union", "enum") or t[self.i] == "W" and t[self.i + 1] in ("w", "W", "*"):
            x = t[self.i]
            self.i += 1
            if x in PARENS and t[self.i] == "(":
                self.skip()
        function = False
        if t[self.i] in NAME:
            self.i += 1
        elif t[self.i] == "(" and not (abstract and (t[self.i + 1] in TYPES or t[self.i + 1] in (")", "w"))):
            self.i += 1
            self.attributes()
            function = self.declarator(abstract)
            self.need(")")
        elif not abstract:
            raise Broken
        while True:
            if t[self.i] == "(":
                self.i += 1
                function = True
                self.listed(self.parameter, ")", trailing=False)
            elif t[self.i] == "W" and t[self.i + 1] == "(" and t[self.i + 2] == "(":  # a macro around parameters
                self.i += 1
                self.skip()
                function = True
            elif t[self.i] == "[" and t[self.i + 1] != "[":
                self.i += 1
                while t[self.i] in TYPES:
                    self.i += 1
                if t[self.i] == "*" and t[self.i + 1] == "]":
                    self.i += 1
                elif t[self.i] != "]":
                    self.expression()
                self.need("]")
            else:
                return function

    def parameter(self) -> None:
        t = self.t
        if self.take("..."):
            if t[self.i] != ")":
                raise Broken
            return
        if t[self.i] in NAME and t[self.i + 1] in (",", ")"):
            self.i += 1
            return
        at = self.i
        if not self.specifiers() and self.i == at:
            raise Broken
        self.declarator(True)
        self.attributes()
        if t[self.i] in NAME:
            self.i += 1

    def fields(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if not t[self.i]:
                raise Broken
            if self.take(";"):
                continue
            if t[self.i] in ("_Static_assert", "static_assert"):
                self.asserted()
                continue
            if t[self.i] == "W" and t[self.i + 1] == "(" and t[self.end[self.i + 1] + 1] in (";", "}") or t[self.i] == "W" and t[self.i + 1] == ";":
                self.i = self.i + 1 if t[self.i + 1] == ";" else self.end[self.i + 1] + 1
                continue
            if t[self.i] == "W" and t[self.i + 1] == "(" and self.end[self.i + 1] + 1 in self.fresh:
                self.i = self.end[self.i + 1] + 1
                continue
            if not self.specifiers():
                raise Broken
            while t[self.i] != ";":
                if t[self.i] != ":":
                    self.declarator()
                if self.take(":"):
                    self.ternary()
                self.attributes()
                if not self.take(",") and t[self.i] != ";":
                    raise Broken
            self.i += 1

    def constants(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if t[self.i] not in NAME:
                raise Broken
            self.i += 1
            if t[self.i] == "(":
                self.skip()
                if not self.take(",") and t[self.i] not in (*NAME, "}"):
                    raise Broken
                continue
            self.attributes()
            if self.take("="):
                self.ternary()
            if not self.take(",") and t[self.i] != "}":
                raise Broken

    def value(self) -> None:
        x = self.t[self.i]
        if x == "{" or x[:2] == "{#":
            self.braced("v")
        else:
            self.assignment()

    def values(self) -> None:
        t = self.t
        while t[self.i] != "}":
            while t[self.i] == "." or t[self.i] == "[":
                if self.take("."):
                    if t[self.i] not in NAME:
                        raise Broken
                    self.i += 1
                else:
                    self.i += 1
                    self.ternary()
                    if self.take("..."):
                        self.ternary()
                    self.need("]")
                if self.take("="):
                    break
            if t[self.i] == "w" and t[self.i + 1] == ":":
                self.i += 2
            call = t[self.i] in NAME and t[self.i + 1] == "(" and (t[self.i] == "W" or self.end[self.i + 1] + 1 in self.fresh)
            self.value()
            if not self.take(",") and t[self.i] != "}" and not call:
                raise Broken

    # statements

    def statements(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if not t[self.i]:
                raise Broken
            self.statement(True)

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def begins_declaration(self) -> bool:
        t = self.t
        x = t[self.i]
        if x in TYPES:
            return x != "__extension__" or t[self.i + 1] != "("
        if x not in NAME:
            return x == "[" and t[self.i + 1] == "["
        i = self.i + 1
        if t[i] in NAME or t[i] in TYPES:
            return True
        if x == "W" and t[i] == "(" and t[self.end[i] + 1] in ("w", "W", "*"):
            after = self.end[i] + 1
            return after not in self.fresh and (t[after] == "w" or t[after] == "*" and t[after + 1] in ("w", "*"))
        while t[i] == "*" or t[i] in ("const", "volatile", "restrict", "__restrict"):
            i += 1
        if i > self.i + 1 and t[i] in NAME:
            return t[i + 1] in ("=", ";", ",", "[", "(", "__attribute__") or t[i + 1] == "W"
        return False

    def statement(self, local: bool = False) -> None:
        t = self.t
        x = t[self.i]
        act = self.STATEMENTS.get(x)
        if act is not None:
            self.i += 1
            return act(self)
        if x == "{" or x[:2] == "{#":
            return self.braced("b")
        if x in NAME:
            if t[self.i + 1] == ":":
                self.i += 2
                self.attributes()
                if t[self.i] == "}":
                    return None
                return self.statement(local)
            if t[self.i + 1] == "(":
                close = self.end[self.i + 1]
                after = t[close + 1]
                if after == "{" or after[:2] == "{#" or after in ("if", "for", "return") or after == "while" and x == "w":
                    if after[0] != "{" and x == "w":
                        raise Broken
                    self.i += 1
                    self.arguments()
                    return self.statement()
                if x == "W" and after not in (";", ",") and (close + 1 in self.fresh or after in ("}", "while")) and after not in BINARY and after not in ASSIGN and after not in ("?", ".", "->", "["):
                    self.i += 1
                    self.arguments()
                    return None
            if x == "W" and (t[self.i + 1] in ("}",) or self.i + 1 in self.fresh and t[self.i + 1] in RESERVED):
                self.i += 1
                return None
        if x in ("asm", "__asm__", "__asm"):
            self.i += 1
            while t[self.i] in ("volatile", "__volatile__", "goto", "inline"):
                self.i += 1
            self.skip()
            return self.need(";")
        if x in ("_Static_assert", "static_assert"):
            return self.asserted()
        if self.begins_declaration():
            if x in ("__attribute__", "__attribute") and t[self.end[self.i + 1] + 1] == ";":
                self.i = self.end[self.i + 1] + 2
                return None
            return self.declaration()
        self.expression()
        return self.need(";")

    def _empty(self) -> None:
        pass

    def _if(self) -> None:
        self.paren()
        self.statement()
        if self.take("else"):
            self.statement()

    def _while(self) -> None:
        self.paren()
        self.statement()

    def _do(self) -> None:
        self.statement()
        self.need("while")
        self.paren()
        if self.t[self.i] != "}":
            self.need(";")

    def _for(self) -> None:
        t = self.t
        self.need("(")
        if self.begins_declaration():
            self.declaration()
        else:
            if t[self.i] != ";":
                self.expression()
            self.need(";")
        if t[self.i] != ";":
            self.expression()
        self.need(";")
        if t[self.i] != ")":
            self.expression()
        self.need(")")
        self.statement()

    def _return(self) -> None:
        x = self.t[self.i]
        if x == "{" or x[:2] == "{#":
            raise Broken
        if x != ";":
            self.expression()
        self.need(";")

    def _jump(self) -> None:
        self.need(";")

    def _goto(self) -> None:
        if self.take("*"):
            self.expression()
        elif self.t[self.i] in NAME:
            self.i += 1
        else:
            raise Broken
        self.need(";")

    def _case(self) -> None:
        self.ternary()
        if self.take("..."):
            self.ternary()
        self.need(":")
        if self.t[self.i] != "}":
            self.statement(True)

    def _default(self) -> None:
        self.need(":")
        if self.t[self.i] != "}":
            self.statement(True)

    # expressions; kinds: T target, O other

    def expression(self) -> str:
        kind = self.assignment()
        while self.take(","):
            self.assignment()
            kind = "O"
        return kind

    def assignment(self) -> str:
        kind = self.ternary()
        if self.t[self.i] in ASSIGN:
            if kind != "T":
                raise Broken
            self.i += 1
            self.value()
            return "O"
        return kind

    def ternary(self) -> str:
        t = self.t
        kind = self.unary()
        while True:
            x = t[self.i]
            if x in BINARY:
                self.i += 1
                self.unary()
                kind = "O"
            elif x == "?":
                self.i += 1
                if t[self.i] != ":":
                    self.expression()
                self.need(":")
                self.ternary()
                return "O"
            else:
                return kind

    def cast(self) -> int:
        """Index after the parenthesis at i if a type stands in it, else -1."""
        t = self.t
        i = self.i + 1
        close = self.end[self.i]
        if t[i] in TYPES and t[i] != "__extension__":
            return close + 1
        if t[i] in NAME and t[i + 1] in (*NAME, *TYPES) and t[i + 1] != "sizeof":
            return close + 1
        if t[i] in NAME and t[i + 1] == "(" and (t[i] == "W" and t[self.end[i + 1] + 1] == "*" or t[i + 2] == "*" and t[i + 3] == ")"):
            return close + 1
        if t[i] in NAME and i + 1 == close and t[close + 1] == "(" and t[close + 3] == ")" and (t[close + 2] in NAME or t[close + 2] in TYPES) and t[close + 4] in ("w", "n", "s"):
            return close + 1
        if t[i] in NAME:
            i += 1
            stars = i
            while t[i] == "*" or t[i] in TYPES:
                i += 1
            if i == close and (i > stars or t[close + 1] in OPERAND and t[close + 1] not in ("(", "-", "+", "&", "*", "++", "--")):
                return close + 1
        return -1

    def type_name(self) -> None:
        self.need("(")
        at = self.i
        self.specifiers()
        if self.i == at and self.t[self.i] in NAME:
            self.i += 1
        elif self.i == at:
            raise Broken
        self.declarator(True)
        self.need(")")

    def unary(self) -> str:
        t = self.t
        x = t[self.i]
        if x in PREFIX:
            self.i += 1
            self.unary()
            return "T" if x == "*" else "O"
        if x in ("++", "--"):
            self.i += 1
            if self.unary() != "T":
                raise Broken
            return "O"
        if x in ("sizeof", "_Alignof", "alignof", "__alignof__"):
            self.i += 1
            if t[self.i] == "(" and self.cast() >= 0:
                self.type_name()
                if t[self.i] == "{" or t[self.i][:2] == "{#":
                    self.braced("v")
                return "O"
            self.unary()
            return "O"
        if x == "__extension__":
            self.i += 1
            return self.unary()
        if x == "(":
            after = self.cast()
            if after >= 0:
                self.type_name()
                if t[self.i] == "{" or t[self.i][:2] == "{#":
                    self.braced("v")
                    return self.chain("T")
                self.unary()
                return "O"
        return self.postfix()

    def arguments(self) -> None:
        macro = self.t[self.i - 1] == "W"
        self.need("(")
        self.listed(self.macro_argument if macro else self.argument, ")", trailing=macro)

    def macro_argument(self) -> None:
        """What a macro may take beside values: nothing, an operator, a declaration, a block."""
        t = self.t
        if t[self.i] == ",":
            return
        if (t[self.i] in BINARY or t[self.i] in ASSIGN) and t[self.i + 1] in (",", ")"):
            self.i += 1
            return
        if t[self.i] in NAME and t[self.i + 1] in NAME:
            at = self.i
            if self.attempt(self.parameter) and t[self.i] in (",", ")"):
                return
            self.i = at
        if t[self.i] == "{" or t[self.i][:2] == "{#":
            if not self.attempt(lambda: self.braced("b")):
                self.braced("v")
            return
        self.argument()

    def argument(self) -> None:
        t = self.t
        if t[self.i] in TYPES or t[self.i] in NAME and t[self.i + 1] == "*" and t[self.i + 2] in ("*", ")", ","):
            at = self.i
            if self.attempt(self.parameter) and t[self.i] in (",", ")"):
                return
            self.i = at
        self.assignment()

    def postfix(self) -> str:
        t = self.t
        x = t[self.i]
        if x in NAME:
            self.i += 1
            if t[self.i] == "s" or x == "W" and t[self.i] in NAME and t[self.i + 1] == "s":
                self.strings()
                return self.chain("O")
            if x == "W" and t[self.i] == "w":  # a macro that casts
                return self.postfix()
            kind = "T"
        elif x == "s":
            self.strings()
            kind = "O"
        elif x == "n":
            self.i += 1
            if t[self.i] == "W":  # a macro that scales
                self.i += 1
            kind = "O"
        elif x == "(":
            self.i += 1
            if t[self.i] == "{" or t[self.i][:2] == "{#":
                self.braced("b")
                kind = "O"
            else:
                kind = self.expression()
            self.need(")")
        elif x == "_Generic":
            self.i += 1
            self.skip()
            kind = "O"
        else:
            raise Broken
        return self.chain(kind)

    def strings(self) -> None:
        """Literals side by side, with macros among them."""
        t = self.t
        while t[self.i] == "s" or t[self.i] in NAME:
            self.i += 1
            if t[self.i - 1] == "W" and t[self.i] == "(":
                self.skip()

    def chain(self, kind: str) -> str:
        t = self.t
        while True:
            x = t[self.i]
            if x in (".", "->"):
                self.i += 1
                if t[self.i] not in NAME:
                    raise Broken
                self.i += 1
                kind = "T"
            elif x == "(":
                kind = "T" if t[self.i - 1] == "W" else "O"  # a macro may stand for a target
                self.arguments()
            elif x == "[":
                self.i += 1
                self.expression()
                self.need("]")
                kind = "T"
            elif x in ("++", "--"):
                if kind != "T":
                    raise Broken
                self.i += 1
                kind = "O"
            else:
                return kind

    STATEMENTS = {
        ";": _empty, "if": _if, "while": _while, "do": _do, "for": _for, "switch": _while, "return": _return, "break": _jump, "continue": _jump, "goto": _goto, "case": _case, "default": _default,
    }


def chosen(raw: list[str], last: bool) -> list[str]:
    """The classes with one of the alternatives under each condition, the first or the last."""
    out: list[str] = []
    levels: list[bool] = []
    i, n = 0, len(raw)
    ends = _ends(raw) if last else {}
    while i < n:
        x = raw[i]
        if x == "#if":
            levels.append(not last or ends.get(i) is None)
        elif x in ("#elif", "#else") and levels:
            levels[-1] = ends.get(i, "") is None if last else False
        elif x == "#endif":
            if levels:
                levels.pop()
        elif x != "#" and all(levels):
            out.append(x)
        i += 1
    return out


def _ends(raw: list[str]) -> dict[int, int | None]:
    """Position of each branch's beginning -> that of the next branch, None for the last one."""
    out: dict[int, int | None] = {}
    open_at: list[int] = []
    for i, x in enumerate(raw):
        if x == "#if":
            open_at.append(i)
            out[i] = None
        elif x in ("#elif", "#else") and open_at:
            out[open_at[-1]] = i
            open_at[-1] = i
            out[i] = None
        elif x == "#endif" and open_at:
            open_at.pop()
    return out
