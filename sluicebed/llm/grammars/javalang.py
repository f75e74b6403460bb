"""Java, up to records, patterns, switch expressions and modules."""

from __future__ import annotations

from sluicebed.llm.grammars.base import Broken, Grammar

# Words of the language by their part.
PRIMITIVE = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
RESERVED = PRIMITIVE | MODIFIERS | frozenset(
    "assert break case catch class const continue do else enum extends finally for goto if implements import instanceof interface new package return super switch this throw throws try void while _".split()
)
SOFT = frozenset("exports module non open opens permits provides record requires sealed to transitive uses var when with yield".split())
NAME = SOFT | {"w", "W"}  # W: the name of a class, by its first letter or its declaration
BINARY = frozenset("+ - * / % & | ^ && || == != < <= <<".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())
#: Classes with which the operand of a cast to a named type begins.
OPERAND = NAME | {"s", "n", "(", "!", "~", "this", "super", "new", "switch"} | PRIMITIVE
#: Kinds of expression that are statements: assignments, calls, creations, steps.
ACTS = "AC"


class JavaSource(Grammar):
    BRACED = {"b": "statements", "c": "class_members", "s": "cases", "v": "values", "e": "enum_members", "m": "directives"}
    WORDS = RESERVED | SOFT

    def prepared(self, raw: list[str]) -> list[str]:
        out = []
        for x in raw:
            if x[0] == ">" and len(x) > 1:
                out += x
            elif x != "\n":
                out.append(x)
        return out

    # declarations

    def source(self) -> None:
        t = self.t
        at = self.i
        self.annotations()
        if self.take("package"):
            self.dotted()
            self.need(";")
        else:
            self.i = at
        while t[self.i] in ("import", ";"):
            if self.take(";"):
                continue
            self.i += 1
            if t[self.i] == "module" and t[self.i + 1] in NAME:
                self.i += 1
            self.take("static")
            self.name()
            while self.take("."):
                if self.take("*"):
                    break
                self.name()
            self.need(";")
        at = self.i
        self.annotations()
        if t[self.i] == "open" and t[self.i + 1] == "module" or t[self.i] == "module" and t[self.i + 1] in NAME:
            self.take("open")
            self.i += 1
            self.dotted()
            self.braced("m")
            return
        self.i = at
        while t[self.i]:
            if not self.take(";"):
                self.modifiers()
                self.type_declaration()

    def directives(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if t[self.i] not in ("requires", "exports", "opens", "uses", "provides"):
                raise Broken
            self.i += 1
            while t[self.i] in ("transitive", "static") and t[self.i + 1] != ";":
                self.i += 1
            self.dotted()
            if t[self.i] in ("to", "with"):
                self.i += 1
                self.dotted()
                while self.take(","):
                    self.dotted()
            self.need(";")

    def name(self) -> None:
        if self.t[self.i] not in NAME and self.t[self.i] != "_":
            raise Broken
        self.i += 1

    def dotted(self) -> None:
        self.name()
        while self.t[self.i] == ".":
            self.i += 1
            self.name()

    def annotations(self) -> None:
        t = self.t
        while t[self.i] == "@" and t[self.i + 1] != "interface":
            self.i += 1
            self.dotted()
            if t[self.i] == "(":
                self.i += 1
                self.listed(self.annotation_value, ")", trailing=False)

    def annotation_value(self) -> None:
        t = self.t
        if t[self.i] in NAME and t[self.i + 1] == "=":
            self.i += 2
        if t[self.i] == "@":
            self.annotations()
        elif t[self.i] == "{" or t[self.i][:2] == "{#":
            self.braced("v")
        else:
            self.ternary()

    def modifiers(self) -> None:
        t = self.t
        seen: set[str] = set()
        while True:
            x = t[self.i]
            if x in MODIFIERS and x in seen:
                raise Broken
            seen.add(x)
            if x == "@":
                if t[self.i + 1] == "interface":
                    return
                self.annotations()
            elif x in MODIFIERS and not (x == "default" and t[self.i + 1] in (":", "->")) and not (x == "synchronized" and t[self.i + 1] == "("):
                self.i += 1
            elif x == "sealed" and t[self.i + 1] in MODIFIERS | {"class", "interface"}:
                self.i += 1
            elif x == "non" and t[self.i + 1] == "-" and t[self.i + 2] == "sealed":
                self.i += 3
            else:
                return

    def type_declaration(self) -> None:
        t = self.t
        x = t[self.i]
        if x == "@":
            self.i += 1
            x = t[self.i]
            if x != "interface":
                raise Broken
        if x not in ("class", "interface", "enum", "record"):
            raise Broken
        self.i += 1
        self.name()
        self.type_parameters()
        if x == "record":
            self.parameters()
        for word in ("extends", "implements", "permits"):
            if self.take(word):
                self.type()
                while self.take(","):
                    self.type()
        self.braced("e" if x == "enum" else "c")

    def enum_members(self) -> None:
        t = self.t
        while t[self.i] not in (";", "}"):
            self.annotations()
            self.name()
            if t[self.i] == "(":
                self.arguments()
            if t[self.i] == "{" or t[self.i][:2] == "{#":
                self.braced("c")
            if not self.take(",") and t[self.i] not in (";", "}"):
                raise Broken
        if self.take(";"):
            self.class_members()

    def class_members(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if not t[self.i]:
                raise Broken
            if self.take(";"):
                continue
            self.modifiers()
            self.class_member()

    def class_member(self) -> None:
        t = self.t
        x = t[self.i]
        if x in ("class", "interface", "enum", "@") or x == "record" and t[self.i + 1] in NAME and t[self.i + 2] in ("(", "<"):
            return self.type_declaration()
        if x == "{" or x[:2] == "{#":
            return self.braced("b")
        self.type_parameters()
        self.annotations()
        if t[self.i] == "W" and t[self.i + 1] == "(":
            self.i += 1
            return self.method_rest(True)
        if t[self.i] in NAME and (t[self.i + 1] == "{" or t[self.i + 1][:2] == "{#"):
            self.i += 1
            return self.braced("b")
        if not self.take("void"):
            self.type()
        self.name()
        if t[self.i] == "(":
            return self.method_rest(False)
        self.declarators_rest()
        return self.need(";")

    def method_rest(self, body: bool) -> None:
        t = self.t
        self.parameters()
        self.dims()
        if self.take("throws"):
            self.type()
            while self.take(","):
                self.type()
        if t[self.i] == "{" or t[self.i][:2] == "{#":
            return self.braced("b")
        if body:
            raise Broken
        if self.take("default"):
            self.annotation_value()
        return self.need(";")

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")", trailing=False)

    def parameter(self) -> None:
        t = self.t
        self.modifiers()
        self.type()
        self.annotations()
        self.take("...")
        if t[self.i] == "this":
            self.i += 1
            return None
        self.name()
        while t[self.i] == "." and t[self.i + 1] in (*NAME, "this"):
            self.i += 2
        return self.dims()

    def dims(self) -> None:
        t = self.t
        while t[self.i] == "[" and t[self.i + 1] == "]":
            self.i += 2

    def declarators_rest(self) -> None:
        self.dims()
        if self.take("="):
            self.value()
        while self.take(","):
            self.name()
            self.dims()
            if self.take("="):
                self.value()

    def value(self) -> None:
        x = self.t[self.i]
        if x == "{" or x[:2] == "{#":
            self.braced("v")
        else:
            self.expression()

    def values(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if t[self.i] == "@":
                self.annotations()
            elif not (t[self.i] == "," and t[self.i + 1] == "}"):
                self.value()
            if not self.take(",") and t[self.i] != "}":
                raise Broken

    # types; read without exceptions, -1 for none

    def type_at(self, i: int, dims: bool = True) -> int:
        t = self.t
        while t[i] == "@" and t[i + 1] in NAME:
            self.i, at = i, self.i
            try:
                self.annotations()
                i = self.i
            except Broken:
                return -1
            finally:
                self.i = at
        if t[i] in PRIMITIVE:
            i += 1
        elif t[i] in NAME:
            while True:
                i += 1
                if t[i] == "<":
                    i = self.arguments_at(i)
                    if i < 0:
                        return -1
                if t[i] == "." and (t[i + 1] in NAME or t[i + 1] == "@"):
                    i += 1
                    if t[i] == "@":
                        i += 2
                    continue
                break
        else:
            return -1
        while dims and (t[i] == "[" and t[i + 1] == "]" or t[i] == "@" and t[i + 1] in NAME and t[i + 2] == "["):
            i += 2
        return i

    def arguments_at(self, i: int) -> int:
        t = self.t
        i += 1
        if t[i] == ">":
            return i + 1
        while True:
            while t[i] == "@" and t[i + 1] in NAME:
                i += 2
            if t[i] == "?":
                i += 1
                if t[i] in ("extends", "super"):
                    i = self.type_at(i + 1)
            else:
                i = self.type_at(i)
            while i >= 0 and t[i] == "&":
                i = self.type_at(i + 1)
            if i < 0:
                return -1
            if t[i] == ",":
                i += 1
            elif t[i] == ">":
                return i + 1
            else:
                return -1

    def type(self) -> None:
        i = self.type_at(self.i)
        if i < 0:
            raise Broken
        self.i = i

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                self.annotations()
                self.name()
                if self.take("extends"):
                    self.type()
                    while self.take("&"):
                        self.type()
                if not self.take(","):
                    break
            self.need(">")

    # statements

    def statements(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if not t[self.i]:
                raise Broken
            self.statement(True)

    def declared(self) -> bool:
        """True if a local declaration begins here."""
        t = self.t
        i = self.type_at(self.i)
        return i >= 0 and (t[i] in NAME or t[i] == "_") and t[i + 1] in ("=", ";", ",", ":", "[", ")")

    def local(self) -> None:
        self.type()
        self.name()
        self.declarators_rest()

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self, local: bool = False) -> None:
        t = self.t
        x = t[self.i]
        act = self.STATEMENTS.get(x)
        if act is not None:
            self.i += 1
            return act(self)
        if x == "{" or x[:2] == "{#":
            return self.braced("b")
        if x in NAME and t[self.i + 1] == ":":
            self.i += 2
            return self.statement()
        if x == "synchronized" and t[self.i + 1] == "(":
            self.i += 1
            self.paren()
            return self.braced("b")
        if x == "yield" and t[self.i + 1] not in ("=", ".", "++", "--", "[", "+=", "-="):
            self.i += 1
            self.expression()
            return self.need(";")
        if local:
            if x in ("class", "interface", "enum", "abstract", "static", "final", "@", "strictfp", "sealed") or x == "record" and t[self.i + 1] in NAME and t[self.i + 2] in ("(", "<"):
                self.modifiers()
                if t[self.i] in ("class", "interface", "enum", "@") or t[self.i] == "record" and t[self.i + 1] in NAME and t[self.i + 2] in ("(", "<"):
                    return self.type_declaration()
                self.local()
                return self.need(";")
            if (x in NAME or x in PRIMITIVE) and self.declared():
                self.local()
                return self.need(";")
        if self.expression() not in ACTS:
            raise Broken
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
        self.need(";")

    def _for(self) -> None:
        t = self.t
        self.need("(")
        if t[self.i] in ("final", "@") or self.declared():
            self.modifiers()
            self.local()
        elif t[self.i] != ";":
            self.acts()
        if self.take(":"):
            self.expression()
        else:
            self.need(";")
            if t[self.i] != ";":
                self.expression()
            self.need(";")
            if t[self.i] != ")":
                self.acts()
        self.need(")")
        self.statement()

    def acts(self) -> None:
        while True:
            if self.expression() not in ACTS:
                raise Broken
            if not self.take(","):
                return

    def _return(self) -> None:
        if self.t[self.i] != ";":
            self.expression()
        self.need(";")

    def _throw(self) -> None:
        self.expression()
        self.need(";")

    def _jump(self) -> None:
        if self.t[self.i] != ";":
            self.name()
        self.need(";")

    def _assert(self) -> None:
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def _try(self) -> None:
        t = self.t
        some = False
        if self.take("("):
            some = True
            while t[self.i] != ")":
                if t[self.i] in ("final", "@") or self.declared():
                    self.modifiers()
                    self.type()
                    self.name()
                    self.need("=")
                self.expression()
                if not self.take(";") and t[self.i] != ")":
                    raise Broken
            self.i += 1
        self.braced("b")
        while self.take("catch"):
            some = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.need(")")
            self.braced("b")
        if self.take("finally"):
            some = True
            self.braced("b")
        if not some:
            raise Broken

    def _switch(self) -> None:
        self.paren()
        self.braced("s")

    def cases(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if self.take("case"):
                while True:
                    if not self.take("default"):
                        self.label()
                    if not self.take(","):
                        break
                if t[self.i] == "when":
                    self.i += 1
                    self.expression()
            else:
                self.need("default")
            if self.take("->"):
                if t[self.i] == "{" or t[self.i][:2] == "{#":
                    self.braced("b")
                elif t[self.i] == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
                continue
            self.need(":")
            while t[self.i] not in ("case", "}") and not (t[self.i] == "default" and t[self.i + 1] in (":", "->")):
                if not t[self.i]:
                    raise Broken
                self.statement(True)

    def label(self) -> None:
        if not self.attempt(self.pattern, self.label_end):
            self.ternary()

    def label_end(self) -> None:
        if self.t[self.i] not in (",", ":", "->", "when"):
            raise Broken

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.t[self.i] == "(":
            self.i += 1
            self.listed(self.pattern, ")", trailing=False)
            if self.t[self.i] in NAME and self.t[self.i] != "when":
                self.i += 1
        elif self.t[self.i] != "when":
            self.name()
        else:
            raise Broken

    # expressions; kinds: T target, A assignment or step, C call or creation, O other

    def expression(self) -> str:
        t = self.t
        x = t[self.i]
        if (x in NAME or x == "_") and t[self.i + 1] == "->":
            self.i += 2
            self.lambda_body()
            return "O"
        if x == "(" and t[self.end[self.i] + 1] == "->":
            self.i += 1
            if t[self.i] in NAME and t[self.i + 1] in (",", ")"):
                self.listed(self.name, ")", trailing=False)
            else:
                self.listed(self.parameter, ")", trailing=False)
            self.i += 1
            self.lambda_body()
            return "O"
        kind = self.ternary()
        x = t[self.i]
        n = 0
        while t[self.i + n] == ">":
            n += 1
        if x in ASSIGN or n and t[self.i + n] == "=":
            if kind != "T":
                raise Broken
            self.i += n + 1
            self.expression()
            return "A"
        return kind

    def lambda_body(self) -> None:
        x = self.t[self.i]
        if x == "{" or x[:2] == "{#":
            self.braced("b")
        else:
            self.expression()

    def ternary(self) -> str:
        t = self.t
        kind = self.unary()
        while True:
            x = t[self.i]
            if x in BINARY:
                self.i += 1
                self.unary()
                kind = "O"
            elif x == ">":
                n = 1
                while t[self.i + n] == ">" and n < 3:
                    n += 1
                if t[self.i + n] == "=":
                    if n > 1:
                        return kind
                    n += 1
                self.i += n
                self.unary()
                kind = "O"
            elif x == "instanceof":
                self.i += 1
                if not self.attempt(self.pattern):
                    self.modifiers()
                    self.type()
                kind = "O"
            elif x == "?":
                self.i += 1
                self.expression()
                self.need(":")
                if t[self.i] in NAME and t[self.i + 1] == "->" or t[self.i] == "(" and t[self.end[self.i] + 1] == "->":
                    self.expression()
                else:
                    self.ternary()
                return "O"
            else:
                return kind

    def unary(self) -> str:
        t = self.t
        x = t[self.i]
        if x in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "O"
        if x in ("++", "--"):
            self.i += 1
            if self.unary() != "T":
                raise Broken
            return "A"
        if x == "(":
            i = self.type_at(self.i + 1)
            if i >= 0:
                while t[i] == "&":
                    i = self.type_at(i + 1)
                    if i < 0:
                        break
            if i >= 0 and t[i] == ")" and (t[self.i + 1] in PRIMITIVE or t[i + 1] in OPERAND):
                self.i = i + 1
                if t[self.i] in NAME and t[self.i + 1] == "->" or t[self.i] == "(" and t[self.end[self.i] + 1] == "->":
                    self.expression()
                else:
                    self.unary()
                return "O"
        return self.postfix()

    def arguments(self) -> None:
        self.need("(")
        self.listed(self.expression, ")", trailing=False)

    def postfix(self) -> str:
        t = self.t
        kind = self.primary()
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                if t[self.i] == "<":
                    i = self.arguments_at(self.i)
                    if i < 0:
                        raise Broken
                    self.i = i
                y = t[self.i]
                if y in NAME:
                    self.i += 1
                    kind = "T"
                elif y == "new":
                    self.created()
                    kind = "C"
                elif y in ("this", "super", "class"):
                    self.i += 1
                    kind = "O"
                else:
                    raise Broken
            elif x == "(":
                self.arguments()
                kind = "C"
            elif x == "[":
                if t[self.i + 1] == "]":
                    self.dims()
                    if t[self.i] != "::" and not (t[self.i] == "." and t[self.i + 1] == "class"):
                        raise Broken
                    continue
                self.i += 1
                self.expression()
                self.need("]")
                kind = "T"
            elif x == "::":
                self.i += 1
                if t[self.i] == "<":
                    self.i = self.arguments_at(self.i)
                if not self.take("new"):
                    self.name()
                kind = "O"
            elif x in ("++", "--"):
                if kind != "T":
                    raise Broken
                self.i += 1
                kind = "A"
            elif x == "<" and kind == "T":
                i = self.arguments_at(self.i)
                while i > 0 and t[i] == "." and t[i + 1] in NAME:
                    i += 2
                    if t[i] == "<":
                        i = self.arguments_at(i)
                while i > 0 and t[i] == "[" and t[i + 1] == "]":
                    i += 2
                if i < 0 or t[i] != "::":
                    return kind
                self.i = i
            else:
                return kind

    def primary(self) -> str:
        t = self.t
        x = t[self.i]
        if x in NAME:
            self.i += 1
            return "T"
        if x in ("n", "s", "this", "super"):
            self.i += 1
            return "O"
        if x == "(":
            self.i += 1
            kind = self.expression()
            self.need(")")
            return "T" if kind == "T" else "O"
        if x == "new":
            self.created()
            return "C"
        if x == "switch":
            self.i += 1
            self._switch()
            return "O"
        if x in PRIMITIVE or x == "void":
            self.i += 1
            self.dims()
            if not (t[self.i] == "::" or t[self.i] == "." and t[self.i + 1] == "class"):
                raise Broken
            return "O"
        raise Broken

    def created(self) -> None:
        t = self.t
        self.need("new")
        if t[self.i] == "<":
            self.i = self.arguments_at(self.i)
        i = self.type_at(self.i, dims=False)
        if i < 0:
            raise Broken
        self.i = i
        if t[self.i] == "(":
            self.arguments()
            if t[self.i] == "{" or t[self.i][:2] == "{#":
                self.braced("c")
            return
        if t[self.i] != "[":
            raise Broken
        sized = False
        while t[self.i] == "[":
            self.i += 1
            if t[self.i] != "]":
                sized = True
                self.expression()
            self.need("]")
        if not sized:
            self.braced("v")

    STATEMENTS = {
        ";": _empty, "if": _if, "while": _while, "do": _do, "for": _for, "return": _return, "throw": _throw, "break": _jump, "continue": _jump, "assert": _assert, "try": _try, "switch": _switch,
    }
