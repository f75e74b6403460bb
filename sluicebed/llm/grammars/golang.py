"""Go. Semicolons are put in where a line ends, as its specification says, before anything is read."""

from __future__ import annotations

from sluicebed.llm.grammars.base import Broken, Grammar

# Words of the language by their part.
WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BINARY = frozenset("+ - * / % & | ^ && || == != < > <= >= << >> &^".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
PREFIX = frozenset("+ - ! ^ * & <- ~".split())
#: Classes after which a line's end is a semicolon.
FINAL = frozenset("w n s break continue fallthrough return ++ -- ) ] }".split())


class GoSource(Grammar):
    BRACED = {"b": "statements", "v": "values", "f": "fields", "m": "methods", "s": "cases"}
    WORDS = WORDS
    level = 0  # below 0 a brace opens a block, not the values of a type

    def prepared(self, raw: list[str]) -> list[str]:
        out: list[str] = []
        for x in raw:
            if x == "\n":
                if out and (out[-1] in FINAL or out[-1][:2] == "{#"):
                    out.append(";")
            else:
                out.append(x)
        if out and out[-1] in FINAL:
            out.append(";")
        return out

    def name(self) -> None:
        self.need("w")

    def closed(self) -> None:
        """The end of a statement: a semicolon, which may be left out before a closing bracket."""
        if self.t[self.i] not in (")", "}"):
            self.need(";")

    # declarations

    def source(self) -> None:
        t = self.t
        while self.take(";"):
            pass
        self.need("package")
        self.name()
        self.need(";")
        while t[self.i] == "import":
            self.i += 1
            self.group(self.import_spec)
            self.need(";")
        while t[self.i]:
            if self.take(";"):
                continue
            x = t[self.i]
            if x == "func":
                self.function()
            elif x in ("var", "const", "type"):
                self.declaration()
            else:
                raise Broken
            self.need(";")

    def group(self, item) -> None:
        if self.take("("):
            while self.t[self.i] != ")":
                item()
                self.closed()
            self.i += 1
        else:
            item()

    def import_spec(self) -> None:
        if self.t[self.i] in ("w", "."):
            self.i += 1
        self.need("s")

    def declaration(self) -> None:
        x = self.t[self.i]
        self.i += 1
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[x])

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def var_spec(self) -> None:
        self.names()
        if self.take("="):
            return self.expressions()
        self.type()
        if self.take("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if self.t[self.i] not in ("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.t[self.i] == "[" and not self.attempt(self.type_parameters, self.type_begins):
            self.type()
            return
        self.take("=")
        self.type()

    def type_begins(self) -> None:
        if self.t[self.i] in (";", ")", ""):
            raise Broken

    def type_parameters(self) -> None:
        self.need("[")
        if self.t[self.i] == "]":
            raise Broken
        self.listed(self.type_parameter, "]")

    def type_parameter(self) -> None:
        self.name()
        if self.t[self.i] != ",":
            self.constraint()

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def function(self) -> None:
        t = self.t
        self.i += 1
        if t[self.i] == "(":
            self.parameters()
        self.name()
        if t[self.i] == "[":
            self.type_parameters()
        self.signature()
        if t[self.i] == "{" or t[self.i][:2] == "{#":
            self.body()

    def body(self) -> None:
        held, self.level = self.level, 0
        self.braced("b")
        self.level = held

    def signature(self) -> None:
        t = self.t
        self.parameters()
        if t[self.i] == "(":
            self.parameters()
        elif t[self.i] in ("w", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def parameters(self) -> None:
        """Types alone, or names with types in which a type follows its last name."""
        t = self.t
        self.need("(")
        forms = ""
        while t[self.i] != ")":
            forms += self.parameter()
            if not self.take(",") and t[self.i] != ")":
                raise Broken
        self.i += 1
        if "P" in forms and ("T" in forms or forms[-1] == "N"):
            raise Broken

    def parameter(self) -> str:
        """P a name and its type, N a name, which may be a type's, T a type."""
        t = self.t
        if t[self.i] == "w" and t[self.i + 1] in (",", ")"):
            self.i += 1
            return "N"
        if t[self.i] == "w" and t[self.i + 1] != ".":
            at = self.i
            self.i += 1
            if t[self.i] == "[" and not self.attempt(self.type, self.parameter_end):
                self.i = at
                self.type()
                return "T"
            if t[self.i - 1] == "w" and self.i == at + 1:
                self.take("...")
                self.type()
            return "P"
        self.take("...")
        self.type()
        return "T"

    def parameter_end(self) -> None:
        if self.t[self.i] not in (",", ")"):
            raise Broken

    # types

    def type(self) -> None:
        t = self.t
        x = t[self.i]
        if x == "w":
            self.i += 1
            if self.take("."):
                self.name()
            if t[self.i] == "[" and t[self.i + 1] != "]":
                self.attempt(lambda: self.need("["), lambda: self.listed(self.type, "]"))
        elif x == "*":
            self.i += 1
            self.type()
        elif x == "[":
            self.i += 1
            if not self.take("..."):
                if t[self.i] != "]":
                    held, self.level = self.level, 1
                    self.expression()
                    self.level = held
            self.need("]")
            self.type()
        elif x == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif x == "chan":
            self.i += 1
            self.take("<-")
            self.type()
        elif x == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif x == "func":
            self.i += 1
            self.signature()
        elif x == "struct":
            self.i += 1
            self.braced("f")
        elif x == "interface":
            self.i += 1
            self.braced("m")
        elif x == "(":
            self.i += 1
            self.type()
            self.need(")")
        else:
            raise Broken

    def fields(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if t[self.i] == "w" and t[self.i + 1] not in (";", ".", "}", "s"):
                at = self.i
                self.names()
                if not self.attempt(self.type, self.field_end):
                    self.i = at
                    self.type()
            else:
                self.type()
            self.take("s")
            self.closed()

    def field_end(self) -> None:
        if self.t[self.i] not in (";", "s", "}"):
            raise Broken

    def methods(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if t[self.i] == "w" and t[self.i + 1] == "(":
                self.i += 1
                self.signature()
            else:
                self.constraint()
            self.closed()

    # statements

    def statements(self) -> None:
        t = self.t
        while t[self.i] not in ("}", "case", "default"):
            if not t[self.i]:
                raise Broken
            if self.take(";"):
                continue
            self.statement()
            self.closed()

    def statement(self) -> None:
        t = self.t
        x = t[self.i]
        act = self.STATEMENTS.get(x)
        if act is not None:
            return act(self)
        if x == "{" or x[:2] == "{#":
            return self.body()
        if x == "w" and t[self.i + 1] == ":":
            self.i += 2
            if t[self.i] not in ("}", ";"):
                self.statement()
            return None
        return self.simple()

    def simple(self) -> bool:
        """A simple statement; true if it is an expression alone."""
        t = self.t
        at = self.i
        self.expressions()
        x = t[self.i]
        if x == ":=":
            if any(y != "w" if k % 2 == 0 else y != "," for k, y in enumerate(t[at : self.i])):
                raise Broken
            self.i += 1
            if t[self.i] == "range":
                self.i += 1
                self.expression()
            else:
                self.expressions()
            return False
        if x in ASSIGN:
            self.i += 1
            if x == "=" and t[self.i] == "range":
                self.i += 1
                self.expression()
            else:
                self.expressions()
            return False
        if x in ("++", "--"):
            self.i += 1
            return False
        if x == "<-":
            self.i += 1
            self.expression()
            return False
        return True

    def _if(self) -> None:
        t = self.t
        self.i += 1
        held, self.level = self.level, -1
        alone = t[self.i] != ";" and self.simple()
        if self.take(";"):
            alone = self.simple()
        if not alone:
            raise Broken
        self.level = held
        self.body()
        if self.take("else"):
            if t[self.i] == "if":
                self._if()
            else:
                self.body()

    def _for(self) -> None:
        t = self.t
        self.i += 1
        held, self.level = self.level, -1
        if t[self.i] == "range":
            self.i += 1
            self.expression()
        elif not (t[self.i] == "{" or t[self.i][:2] == "{#"):
            at = self.i
            alone = t[self.i] == ";" or self.simple()
            if self.take(";"):
                if t[self.i] != ";":
                    if not (t[self.i] == "{" or t[self.i][:2] == "{#"):
                        self.simple()
                self.need(";")
                if not (t[self.i] == "{" or t[self.i][:2] == "{#"):
                    self.simple()
            elif not alone and "range" not in t[at : self.i]:
                raise Broken
        self.level = held
        self.body()

    def _switch(self) -> None:
        t = self.t
        self.i += 1
        held, self.level = self.level, -1
        if not (t[self.i] == "{" or t[self.i][:2] == "{#"):
            if t[self.i] != ";":
                self.simple()
            if self.take(";") and not (t[self.i] == "{" or t[self.i][:2] == "{#"):
                self.simple()
        self.level = held
        held, self.level = self.level, 0
        self.braced("s")
        self.level = held

    def _select(self) -> None:
        self.i += 1
        held, self.level = self.level, 0
        self.braced("s")
        self.level = held

    def cases(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if self.take("case"):
                if not self.attempt(lambda: self.spaced(self.type), self.case_end):
                    self.simple()
            else:
                self.need("default")
            self.need(":")
            self.statements()

    def spaced(self, item) -> None:
        item()
        while self.take(","):
            item()

    def case_end(self) -> None:
        if self.t[self.i] != ":":
            raise Broken

    def _return(self) -> None:
        self.i += 1
        if self.t[self.i] not in (";", "}"):
            self.expressions()

    def _jump(self) -> None:
        self.i += 1
        self.take("w")

    def _goto(self) -> None:
        self.i += 1
        self.name()

    def _fall(self) -> None:
        self.i += 1

    def _call(self) -> None:
        self.i += 1
        if self.expression() != "C":
            raise Broken

    def _declared(self) -> None:
        self.declaration()

    # expressions; kinds: C call, Y what may be a type's name, O other

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> str:
        t = self.t
        kind = self.unary()
        while t[self.i] in BINARY:
            self.i += 1
            self.unary()
            kind = "O"
        return kind

    def unary(self) -> str:
        t = self.t
        x = t[self.i]
        if x in PREFIX:
            if x == "<-" and t[self.i + 1] == "chan":
                self.type()
                return self.chain("O")
            self.i += 1
            self.unary()
            return "O"
        return self.primary()

    def primary(self) -> str:
        t = self.t
        x = t[self.i]
        if x == "w":
            self.i += 1
            return self.chain("Y")
        if x in ("n", "s"):
            self.i += 1
            return self.chain("O")
        if x == "(":
            held, self.level = self.level, 1
            self.i += 1
            at = self.i
            if not self.attempt(self.expression, lambda: self.need(")")):
                self.i = at
                self.type()
                self.need(")")
            self.level = held
            return self.chain("O")
        if x == "func":
            self.i += 1
            self.signature()
            if t[self.i] == "{" or t[self.i][:2] == "{#":
                self.body()
            return self.chain("O")
        if x in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if t[self.i] == "{" or t[self.i][:2] == "{#":
                self.literal()
            return self.chain("O")
        raise Broken

    def literal(self) -> None:
        held, self.level = self.level, 1
        self.braced("v")
        self.level = held

    def values(self) -> None:
        t = self.t
        while t[self.i] != "}":
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(",") and t[self.i] != "}":
                raise Broken

    def element(self) -> None:
        x = self.t[self.i]
        if x == "{" or x[:2] == "{#":
            self.braced("v")
        else:
            self.expression()

    def chain(self, kind: str) -> str:
        t = self.t
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                    kind = "O"
                else:
                    self.name()
                    kind = "Y" if kind == "Y" else "O"
            elif x == "(":
                held, self.level = self.level, 1
                self.i += 1
                self.listed(self.argument, ")")
                self.level = held
                kind = "C"
            elif x == "[":
                held, self.level = self.level, 1
                self.i += 1
                if not self.attempt(self.index, lambda: self.need("]")):
                    self.listed(self.type, "]")
                self.level = held
                kind = "Y" if kind == "Y" else "O"
            elif (x == "{" or x[:2] == "{#") and kind == "Y" and self.level >= 0:
                self.literal()
                kind = "O"
            else:
                return kind

    def index(self) -> None:
        t = self.t
        if t[self.i] != ":":
            self.expression()
        for _ in range(2):
            if self.take(":") and t[self.i] not in ("]", ":"):
                self.expression()

    def argument(self) -> None:
        if not self.attempt(self.expression, self.argument_end):
            self.type()
        self.take("...")

    def argument_end(self) -> None:
        if self.t[self.i] not in (",", ")", "..."):
            raise Broken

    STATEMENTS = {
        "if": _if, "for": _for, "switch": _switch, "select": _select, "return": _return, "break": _jump, "continue": _jump, "goto": _goto, "fallthrough": _fall, "go": _call, "defer": _call,
        "var": _declared, "const": _declared, "type": _declared,
    }
