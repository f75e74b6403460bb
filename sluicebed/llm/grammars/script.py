"""JavaScript and TypeScript.

Statements, classes, modules, patterns and types as their specifications give them; a line end ends a statement where the
next class can't go on with it. What needs more than syntax (names, scopes, strict mode) is not asked.
"""

from __future__ import annotations

from sluicebed.llm.grammars.base import Broken, Grammar

# Words of the languages by their part.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with".split()
)
SOFT = frozenset(
    "abstract accessor as assert asserts async await declare from get global implements infer interface is keyof let module namespace of out override private protected public readonly satisfies set static type unique using yield".split()
)
MODIFIERS = frozenset("static public private protected readonly abstract override declare accessor async get set".split())
PREFIX = frozenset("! ~ + - typeof void delete await".split())
BINARY = frozenset("+ - * / % ** & | ^ && || ?? == != === !== < <= << in instanceof".split())
ASSIGN = frozenset("= += -= *= /= %= **= &= |= ^= <<= &&= ||= ??=".split())
NAME, PLAIN = SOFT | {"w"}, SOFT | {"w", "this", "super"}
#: Classes with which an expression can't begin.
STOPS = frozenset(") ] } ; , : = => . ?.".split()) | {""}


class JsSource(Grammar):
    BRACED = {"b": "statements", "o": "members", "c": "class_members", "s": "cases", "n": "exported", "p": "pattern_members"}
    WORDS = RESERVED | SOFT
    typed = False

    def prepared(self, raw: list[str]) -> list[str]:
        out, self.fresh = [], set()
        for x in raw:
            if x == "\n":
                self.fresh.add(len(out))
            elif x[0] == ">" and len(x) > 1:  # of several closings or an operator
                out += x
            else:
                out.append(x)
        return out

    # statements

    def source(self) -> None:
        while self.t[self.i]:
            self.statement()

    def statements(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if not t[self.i]:
                raise Broken
            self.statement()

    def ended(self) -> None:
        x = self.t[self.i]
        if x == ";":
            self.i += 1
        elif x != "}" and x != "" and self.i not in self.fresh:
            raise Broken

    def name(self) -> None:
        if self.t[self.i] not in NAME:
            raise Broken
        self.i += 1

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        x = self.t[self.i]
        if x == "w":
            if self.t[self.i + 1] == ":":
                self.i += 2
                return self.statement()
            self.expression()
            return self.ended()
        act = self.STATEMENTS.get(x)
        if act is not None and act(self):
            return None
        if x[:2] == "{#":
            return self.braced("b")
        if x in SOFT and self.t[self.i + 1] == ":":
            self.i += 2
            return self.statement()
        if x == "@":
            self.decorators()
            if self.t[self.i] in ("class", "abstract", "export"):
                return self.statement()
            raise Broken
        self.expression()
        return self.ended()

    def _block(self) -> bool:
        self.braced("b")
        return True

    def _empty(self) -> bool:
        self.i += 1
        return True

    def _declared(self) -> bool:
        if self.t[self.i] == "const" and self.t[self.i + 1] == "enum":
            self.i += 1
            return self._enum()
        fixed = self.t[self.i] == "const" and not self.typed
        self.i += 1
        self.declarations(fixed=fixed)
        self.ended()
        return True

    def _let(self) -> bool:
        nxt = self.t[self.i + 1]
        if nxt in NAME or nxt in ("[", "{") or nxt[:2] == "{#":
            return self._declared()
        return False

    def _using(self) -> bool:
        i = self.i + (self.t[self.i] == "await")
        if self.t[i] != "using" or self.t[i + 1] not in NAME or i + 1 in self.fresh or self.t[i + 2] != "=":
            return False
        self.i = i
        return self._declared()

    def declarations(self, loose: bool = False, fixed: bool = False) -> None:
        while True:
            pattern = fixed or self.t[self.i] not in NAME
            self.binding()
            if self.typed:
                self.take("!")
            self.typing()
            if self.take("="):
                self.assignment(loose)
            elif pattern and not loose and not self.typed:
                raise Broken
            if not self.take(","):
                return

    def _if(self) -> bool:
        self.i += 1
        self.paren()
        self.statement()
        if self.take("else"):
            self.statement()
        return True

    def _for(self) -> bool:
        t = self.t
        self.i += 1
        self.take("await")
        self.need("(")
        nxt = t[self.i + 1]
        if t[self.i] == "await" and nxt == "using" and t[self.i + 2] in NAME:
            self.i += 1
            nxt = t[self.i + 1]
        if t[self.i] in ("var", "const") or t[self.i] == "let" and (nxt in NAME or nxt in ("[", "{")) or t[self.i] == "using" and nxt in NAME and nxt != "of":
            self.i += 1
            self.declarations(True)
        elif t[self.i] != ";":
            self.expression(True)
        if t[self.i] in ("of", "in"):
            self.i += 1
            self.expression()
        else:
            self.need(";")
            if t[self.i] != ";":
                self.expression()
            self.need(";")
            if t[self.i] != ")":
                self.expression()
        self.need(")")
        self.statement()
        return True

    def _while(self) -> bool:
        self.i += 1
        self.paren()
        self.statement()
        return True

    def _do(self) -> bool:
        self.i += 1
        self.statement()
        self.need("while")
        self.paren()
        self.take(";")
        return True

    def _return(self) -> bool:
        self.i += 1
        if self.i not in self.fresh and self.t[self.i] not in ("", ";", "}"):
            self.expression()
        self.ended()
        return True

    def _throw(self) -> bool:
        self.i += 1
        if self.i in self.fresh:
            raise Broken
        self.expression()
        self.ended()
        return True

    def _jump(self) -> bool:
        self.i += 1
        if self.i not in self.fresh and self.t[self.i] in NAME:
            self.i += 1
        self.ended()
        return True

    def _debugger(self) -> bool:
        self.i += 1
        self.ended()
        return True

    def _try(self) -> bool:
        self.i += 1
        self.braced("b")
        some = False
        if self.take("catch"):
            some = True
            if self.take("("):
                self.binding()
                self.typing()
                self.need(")")
            self.braced("b")
        if self.take("finally"):
            some = True
            self.braced("b")
        if not some:
            raise Broken
        return True

    def _switch(self) -> bool:
        self.i += 1
        self.paren()
        self.braced("s")
        return True

    def cases(self) -> None:
        t, default = self.t, False
        while t[self.i] != "}":
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
                if default:
                    raise Broken
                default = True
            self.need(":")
            while t[self.i] not in ("case", "default", "}"):
                if not t[self.i]:
                    raise Broken
                self.statement()

    def _function(self) -> bool:
        self.i += 1
        self.take("*")
        self.name()
        self.function_rest(self.typed)
        return True

    def function_rest(self, bodiless: bool = False) -> None:
        self.type_parameters()
        self.parameters()
        self.typing()
        x = self.t[self.i]
        if x == "{" or x[:2] == "{#":
            self.braced("b")
        elif bodiless:
            self.ended()
        else:
            raise Broken

    def _async(self) -> bool:
        if self.t[self.i + 1] == "function" and self.i + 1 not in self.fresh:
            self.i += 1
            return self._function()
        return False

    def _class(self) -> bool:
        self.i += 1
        self.name()
        self.class_rest()
        return True

    def class_rest(self) -> None:
        self.type_parameters()
        if self.take("extends"):
            self.unary()
            self.type_arguments()
        if self.typed and self.take("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.braced("c")

    def _import(self) -> bool:
        t = self.t
        if t[self.i + 1] in ("(", "."):
            return False
        self.i += 1
        if self.take("s"):
            self.import_tail()
            return True
        if self.typed and t[self.i] == "type" and (t[self.i + 1] in ("{", "*") or t[self.i + 1] in NAME and t[self.i + 1] != "from" or t[self.i + 1] == "from" and t[self.i + 2] == "from"):
            self.i += 1
        if t[self.i] in NAME:
            self.i += 1
            if self.typed and self.take("="):
                self.expression()
                self.ended()
                return True
            if not self.take(","):
                self.need("from")
                self.need("s")
                self.import_tail()
                return True
        if self.take("*"):
            self.need("as")
            self.name()
        else:
            self.braced("n")
        self.need("from")
        self.need("s")
        self.import_tail()
        return True

    def import_tail(self) -> None:
        if self.t[self.i] == "with" or self.t[self.i] == "assert" and self.i not in self.fresh:
            self.i += 1
            self.braced("o")
        self.ended()

    def exported(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if self.typed and t[self.i] == "type" and t[self.i + 1] not in (",", "}", "as"):
                self.i += 1
            self.key_word()
            if self.take("as"):
                self.key_word()
            if not self.take(",") and t[self.i] != "}":
                raise Broken

    def key_word(self) -> None:
        x = self.t[self.i]
        if not (x.isalpha() and x != "t"):
            raise Broken
        self.i += 1

    def _export(self) -> bool:
        t = self.t
        self.i += 1
        x = t[self.i]
        if x == "default":
            self.i += 1
            x = t[self.i]
            if x == "function" or x == "async" and t[self.i + 1] == "function":
                self.i += 1 + (x == "async")
                self.take("*")
                if t[self.i] in NAME:
                    self.i += 1
                self.function_rest(self.typed)
            elif x in ("class", "@") or x == "abstract" and t[self.i + 1] == "class":
                self.decorators()
                self.take("abstract")
                self.need("class")
                if t[self.i] in NAME and t[self.i] != "implements":
                    self.i += 1
                self.class_rest()
            elif x == "interface" and self.typed:
                self.statement()
            else:
                self.assignment()
                self.ended()
            return True
        if self.typed and x == "type" and (t[self.i + 1] in ("*", "{") or t[self.i + 1][:2] == "{#"):
            self.i += 1
            x = t[self.i]
        if x == "*":
            self.i += 1
            if self.take("as"):
                self.key_word()
            self.need("from")
            self.need("s")
            self.import_tail()
        elif x == "{" or x[:2] == "{#":
            self.braced("n")
            if self.take("from"):
                self.need("s")
                self.import_tail()
            else:
                self.ended()
        elif self.typed and x == "=":
            self.i += 1
            self.expression()
            self.ended()
        elif self.typed and x == "as":
            self.i += 1
            self.need("namespace")
            self.name()
            self.ended()
        elif x in ("var", "let", "const", "function", "class", "async", "@", "import") or self.typed and x in ("type", "interface", "enum", "namespace", "module", "abstract", "declare"):
            self.statement()
        else:
            raise Broken
        return True

    def decorators(self) -> None:
        while self.take("@"):
            if self.t[self.i] == "(":
                self.paren()
            else:
                self.name()
                while self.take("."):
                    self.key_word()
                self.type_arguments()
            while self.t[self.i] == "(" and self.i not in self.fresh:
                self.arguments()

    # classes and functions

    def class_members(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if not t[self.i]:
                raise Broken
            if self.take(";"):
                continue
            self.class_member()

    def class_member(self) -> None:
        t = self.t
        self.decorators()
        if t[self.i] == "static" and (t[self.i + 1] == "{" or t[self.i + 1][:2] == "{#"):
            self.i += 1
            return self.braced("b")
        while t[self.i] in MODIFIERS and t[self.i + 1] not in ("(", "=", ";", ":", ",", "?", "!", "}", "<", "") and not (self.i + 1 in self.fresh and t[self.i] in ("get", "set", "async", "static") and t[self.i] != "static"):
            self.i += 1
        self.decorators()
        self.take("*")
        if self.typed and t[self.i] == "[" and t[self.i + 1] in NAME and t[self.i + 2] == ":":
            self.index_signature()
            return self.ended()
        self.key()
        if self.typed and t[self.i] in ("?", "!"):
            self.i += 1
        if t[self.i] in ("(", "<"):
            return self.function_rest(self.typed)
        self.typing()
        if self.take("="):
            self.assignment()
        return self.ended()

    def key(self) -> None:
        x = self.t[self.i]
        if x == "[":
            self.i += 1
            self.assignment()
            self.need("]")
        elif x.isalpha() and x != "t":
            self.i += 1
        else:
            raise Broken

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")")

    def parameter(self) -> None:
        t = self.t
        self.decorators()
        if self.typed:
            while t[self.i] in ("public", "private", "protected", "readonly", "override") and (t[self.i + 1] in NAME or t[self.i + 1] in ("{", "[")):
                self.i += 1
            if t[self.i] == "this":
                self.i += 1
                return self.typing()
        rest = self.take("...")
        self.binding()
        if self.typed:
            self.take("?")
        self.typing()
        if self.take("="):
            if rest:
                raise Broken
            self.assignment()
        if rest and self.t[self.i] != ")":
            raise Broken

    def binding(self) -> None:
        x = self.t[self.i]
        if x in NAME:
            self.i += 1
        elif x == "[":
            self.i += 1
            while self.take(","):
                pass
            self.listed(self.pattern_element, "]")
        else:
            self.braced("p")

    def pattern_element(self) -> None:
        self.take("...")
        self.binding()
        if self.take("="):
            self.assignment()
        while self.t[self.i] == "," and self.t[self.i + 1] == ",":
            self.i += 1

    def pattern_members(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if self.take("..."):
                self.name()
            else:
                plain = t[self.i] in NAME
                self.key()
                if self.take(":"):
                    self.binding()
                elif not plain:
                    raise Broken
                if self.take("="):
                    self.assignment()
            if not self.take(",") and t[self.i] != "}":
                raise Broken

    def arguments(self) -> None:
        self.i += 1
        self.listed(self.spread, ")")

    def spread(self) -> None:
        if self.t[self.i] == "...":
            self.i += 1
        self.assignment()

    # expressions; kinds: T a target of an assignment, P a pattern, O any other

    def expression(self, loose: bool = False) -> str:
        kind = self.assignment(loose)
        while self.t[self.i] == ",":
            self.i += 1
            self.assignment(loose)
            kind = "O"
        return kind

    def arrow(self, loose: bool) -> bool:
        """An arrow function that begins here, if there is one."""
        t, at = self.t, self.i
        i = at
        if t[i] == "async" and i + 1 not in self.fresh and (t[i + 1] in NAME or t[i + 1] in ("(", "<")):
            i += 1
        if t[i] in NAME and t[i + 1] == "=>":
            self.i = i + 2
        elif t[i] == "(" or t[i] == "<" and self.typed:
            if t[i] == "(":
                after = t[self.end[i] + 1]
                if after != "=>" and not (after == ":" and self.typed):
                    return False
                if after == "=>":
                    self.i = i
                    self.parameters()
                    self.i += 1
                    return self.arrow_body(loose)
            self.i = i
            if not self.attempt(self.type_parameters, self.parameters, self.typing, lambda: self.need("=>")):
                self.i = at
                return False
            if not self.attempt(lambda: self.arrow_body(loose)):
                self.i = at
                return False
            return True
        else:
            return False
        return self.arrow_body(loose)

    def arrow_body(self, loose: bool) -> bool:
        x = self.t[self.i]
        if x == "{" or x[:2] == "{#":
            self.braced("b")
        else:
            self.assignment(loose)
        return True

    def assignment(self, loose: bool = False) -> str:
        t = self.t
        x = t[self.i]
        if (x == "(" or t[self.i + 1] == "=>" or x == "async" or x == "<") and self.arrow(loose):
            return "O"
        if x == "yield" and (self.i + 1 in self.fresh or t[self.i + 1] not in ("=", "=>", ".", "(") or t[self.i + 1] == "("):
            self.i += 1
            if self.i not in self.fresh:
                if self.take("*"):
                    self.assignment(loose)
                elif t[self.i] not in STOPS and t[self.i] not in ("in", "of"):
                    self.assignment(loose)
            return "O"
        kind = self.unary()
        while True:
            x = t[self.i]
            if x in BINARY:
                if x == "in" and loose:
                    return kind
                self.i += 1
                self.unary()
                kind = "O"
            elif x == ">":
                self.i += 1
                n = 1
                while t[self.i] == ">" and n < 3:
                    self.i += 1
                    n += 1
                if t[self.i] == "=":
                    self.i += 1
                    if n > 1:
                        if kind != "T":
                            raise Broken
                        self.assignment(loose)
                        return "O"
                self.unary()
                kind = "O"
            elif x in ASSIGN:
                if kind != "T" and not (kind == "P" and x == "="):
                    raise Broken
                self.i += 1
                self.assignment(loose)
                return "O"
            elif x == "?":
                self.i += 1
                self.assignment()
                self.need(":")
                self.assignment(loose)
                return "O"
            elif self.typed and x in ("as", "satisfies") and self.i not in self.fresh:
                self.i += 1
                if not self.take("const"):
                    self.type()
                kind = "T" if kind == "T" else "O"
            else:
                return kind

    def unary(self) -> str:
        t = self.t
        x = t[self.i]
        if x in PREFIX:
            if x == "await" and (t[self.i + 1] in STOPS or t[self.i + 1] in BINARY and t[self.i + 1] not in ("+", "-", "/")):
                return self.postfix()
            self.i += 1
            self.unary()
            return "O"
        if x == "++" or x == "--":
            self.i += 1
            if self.unary() != "T":
                raise Broken
            return "O"
        return self.postfix()

    def postfix(self) -> str:
        kind = self.primary()
        t = self.t
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                if not t[self.i].isalpha():
                    raise Broken
                self.i += 1
                kind = "T"
            elif x == "(":
                self.arguments()
                kind = "O"
            elif x == "[":
                self.i += 1
                self.expression()
                self.need("]")
                kind = "T"
            elif x == "?.":
                self.i += 1
                y = t[self.i]
                if y.isalpha():
                    self.i += 1
                elif y not in ("(", "[", "t") and not (y == "<" and self.typed):
                    raise Broken
                kind = "O"
            elif x == "t":
                self.i += 1
                kind = "O"
            elif x == "++" or x == "--":
                if self.i in self.fresh:
                    return kind
                if kind != "T":
                    raise Broken
                self.i += 1
                return "O"
            elif self.typed and x == "!" and self.i not in self.fresh:
                self.i += 1
            elif self.typed and x == "<" and kind == "T":
                at = self.i
                if not (self.attempt(self.type_arguments) and (t[self.i] in ("(", "t", ")", ",", ";", "]", ":", "") or self.i in self.fresh)):
                    self.i = at
                    return kind
                kind = "O"
            else:
                return kind

    def primary(self) -> str:
        t = self.t
        x = t[self.i]
        if x == "w":
            self.i += 1
            return "T"
        if x == "n" or x == "s" or x == "t":
            self.i += 1
            return "O"
        if x == "(":
            self.i += 1
            kind = self.expression()
            self.need(")")
            return "T" if kind == "T" else "O"
        if x == "[":
            self.i += 1
            while t[self.i] != "]":
                if t[self.i] == ",":
                    self.i += 1
                    continue
                self.spread()
                if t[self.i] == ",":
                    self.i += 1
                elif t[self.i] != "]":
                    raise Broken
            self.i += 1
            return "P"
        if x == "{" or x[:2] == "{#":
            self.braced("o")
            return "P"
        if x == "this" or x == "super":
            self.i += 1
            return "O"
        if x == "function" or x == "async" and t[self.i + 1] == "function" and self.i + 1 not in self.fresh:
            self.i += 1 + (x == "async")
            self.take("*")
            if t[self.i] in NAME:
                self.i += 1
            self.function_rest()
            return "O"
        if x == "class":
            self.i += 1
            if t[self.i] in NAME and t[self.i] != "implements":
                self.i += 1
            self.class_rest()
            return "O"
        if x == "new":
            return self.created()
        if x == "import" and t[self.i + 1] in ("(", "."):
            self.i += 1
            if self.take("."):
                self.key_word()
            return "O"
        if x == "<" and self.typed:
            self.i += 1
            if not self.take("const"):
                self.type()
            self.need(">")
            self.unary()
            return "O"
        if x in SOFT:
            self.i += 1
            return "T"
        if x == "@":
            self.decorators()
            if t[self.i] != "class":
                raise Broken
            return self.primary()
        raise Broken

    def created(self) -> str:
        t = self.t
        self.i += 1
        if self.take("."):
            self.key_word()
            return "O"
        if t[self.i] == "new":
            self.created()
            return "O"
        self.primary()
        while True:
            if t[self.i] == ".":
                self.i += 1
                self.key_word()
            elif t[self.i] == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif t[self.i] == "t":
                self.i += 1
            elif self.typed and t[self.i] == "!" and self.i not in self.fresh:
                self.i += 1
            else:
                break
        if t[self.i] == "<" and self.typed:
            self.attempt(self.type_arguments)
        if t[self.i] == "(":
            self.arguments()
        return "O"

    def members(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if self.take("..."):
                self.assignment()
            else:
                self.member()
            if not self.take(",") and t[self.i] != "}":
                raise Broken

    def member(self) -> None:
        t = self.t
        while t[self.i] in ("async", "get", "set") and t[self.i + 1] not in ("(", ":", ",", "}", "=", "<"):
            self.i += 1
        starred = self.take("*")
        plain = t[self.i] in NAME and not starred
        self.key()
        if t[self.i] in ("(", "<"):
            self.function_rest()
        elif starred:
            raise Broken
        elif self.take(":"):
            self.assignment()
        elif not plain:
            raise Broken
        elif self.take("="):
            self.assignment()

    # types are read in TypeScript only

    def typing(self) -> None:
        pass

    def type(self) -> None:
        raise Broken

    def type_parameters(self) -> None:
        pass

    def type_arguments(self) -> None:
        pass

    def index_signature(self) -> None:
        raise Broken

    def _enum(self) -> bool:
        raise Broken

    STATEMENTS = {
        "{": _block, ";": _empty, "var": _declared, "const": _declared, "let": _let, "using": _using, "await": _using, "if": _if, "for": _for, "while": _while, "with": _while, "do": _do,
        "return": _return, "throw": _throw, "break": _jump, "continue": _jump, "debugger": _debugger, "try": _try, "switch": _switch,
        "function": _function, "async": _async, "class": _class, "import": _import, "export": _export,
    }


class TsSource(JsSource):
    BRACED = JsSource.BRACED | {"t": "type_members", "e": "enum_members"}
    typed = True

    def typing(self) -> None:
        if self.t[self.i] == ":":
            self.i += 1
            self.type()

    def type_parameters(self) -> None:
        if self.t[self.i] == "<":
            self.i += 1
            if self.t[self.i] == ">":
                raise Broken
            self.listed(self.type_parameter, ">")

    def type_parameter(self) -> None:
        t = self.t
        while t[self.i] in ("const", "in", "out") and t[self.i + 1] not in (",", ">", "extends", "="):
            self.i += 1
        self.name()
        if self.take("extends"):
            self.type()
        if self.take("="):
            self.type()

    def type_arguments(self) -> None:
        if self.t[self.i] == "<":
            self.i += 1
            if self.t[self.i] == ">":
                raise Broken
            self.listed(self.type, ">", trailing=False)

    def type(self) -> None:
        t = self.t
        if t[self.i] == "asserts" and (t[self.i + 1] in NAME or t[self.i + 1] == "this") and self.i + 1 not in self.fresh:
            self.i += 2
            if self.take("is"):
                self.type()
            return
        if (t[self.i] in NAME or t[self.i] == "this") and t[self.i + 1] == "is" and self.i + 1 not in self.fresh:
            self.i += 2
            return self.type()
        self.union()
        if t[self.i] == "extends" and self.i not in self.fresh:
            self.i += 1
            self.union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def union(self) -> None:
        t = self.t
        if t[self.i] in ("|", "&"):
            self.i += 1
        while True:
            self.type_operand()
            if t[self.i] in ("|", "&"):
                self.i += 1
            else:
                return

    def type_operand(self) -> None:
        t = self.t
        x = t[self.i]
        if x in ("keyof", "unique", "readonly", "infer") and t[self.i + 1] not in (",", ">", ")", ";", "|", "&", "=", "]", "}", "."):
            self.i += 1
            if x == "infer":
                self.name()
                if t[self.i] == "extends":
                    self.attempt(lambda: self.need("extends"), self.union)
                return None
            return self.type_operand()
        if x == "abstract" and t[self.i + 1] == "new":
            self.i += 1
            x = "new"
        if x == "new" or x == "<":
            self.i += x == "new"
            return self.function_type()
        if x == "(":
            if t[self.end[self.i] + 1] == "=>":
                if self.attempt(self.function_type):
                    return None
            self.i += 1
            self.type()
            self.need(")")
        elif x == "[":
            self.i += 1
            self.listed(self.tuple_item, "]")
        elif x == "{" or x[:2] == "{#":
            self.braced("t")
        elif x == "typeof":
            self.i += 1
            if self.take("import"):
                self.need("(")
                self.listed(self.type, ")")
            elif t[self.i] == "this":
                self.i += 1
            else:
                self.name()
            while self.take("."):
                self.key_word()
            if self.i not in self.fresh:
                self.type_arguments()
        elif x == "import":
            self.i += 1
            self.need("(")
            self.listed(self.type, ")")
            while self.take("."):
                self.key_word()
            self.type_arguments()
        elif x in ("s", "n", "t", "void", "this"):
            self.i += 1
        elif x == "-":
            self.i += 1
            self.need("n")
        elif x in NAME:
            self.i += 1
            while t[self.i] == ".":
                self.i += 1
                self.key_word()
            if t[self.i] == "<" and self.i not in self.fresh:
                self.type_arguments()
        else:
            raise Broken
        while t[self.i] == "[" and self.i not in self.fresh:
            self.i += 1
            if t[self.i] != "]":
                self.type()
            self.need("]")
        return None

    def function_type(self) -> None:
        self.type_parameters()
        self.parameters()
        self.need("=>")
        self.type()

    def tuple_item(self) -> None:
        t = self.t
        self.take("...")
        if t[self.i].isalpha() and (t[self.i + 1] == ":" or t[self.i + 1] == "?" and t[self.i + 2] == ":"):
            self.i += 1
            self.take("?")
            self.need(":")
        self.type()
        self.take("?")

    def type_members(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if not t[self.i]:
                raise Broken
            self.type_member()
            if t[self.i] in (",", ";"):
                self.i += 1
            elif t[self.i] != "}" and self.i not in self.fresh:
                raise Broken

    def type_member(self) -> None:
        t = self.t
        if t[self.i] in ("(", "<"):
            self.type_parameters()
            self.parameters()
            return self.typing()
        if t[self.i] == "new" and t[self.i + 1] in ("(", "<"):
            self.i += 1
            self.type_parameters()
            self.parameters()
            return self.typing()
        if t[self.i] in ("+", "-"):
            self.i += 1
            if t[self.i] != "readonly":
                raise Broken
        while t[self.i] in ("readonly", "get", "set") and t[self.i + 1] not in ("(", ":", ",", ";", "?", "}", "<", ""):
            self.i += 1
        if t[self.i] == "[" and t[self.i + 1] in NAME and t[self.i + 2] in (":", "in"):
            return self.index_signature()
        self.key()
        self.take("?")
        if t[self.i] in ("(", "<"):
            self.type_parameters()
            self.parameters()
        return self.typing()

    def index_signature(self) -> None:
        t = self.t
        self.i += 2
        if self.take(":"):
            self.type()
            self.need("]")
        else:
            self.need("in")
            self.type()
            if self.take("as"):
                self.type()
            self.need("]")
            if t[self.i] in ("+", "-"):
                self.i += 1
            self.take("?")
        self.typing()

    def enum_members(self) -> None:
        t = self.t
        while t[self.i] != "}":
            self.key()
            if self.take("="):
                self.assignment()
            if not self.take(",") and t[self.i] != "}":
                raise Broken

    def _enum(self) -> bool:
        self.i += 1
        self.name()
        self.braced("e")
        return True

    def _interface(self) -> bool:
        if self.t[self.i + 1] not in NAME or self.i + 1 in self.fresh:
            return False
        self.i += 2
        self.type_parameters()
        if self.take("extends"):
            self.type()
            while self.take(","):
                self.type()
        self.braced("t")
        return True

    def _type(self) -> bool:
        if self.t[self.i + 1] not in NAME or self.i + 1 in self.fresh:
            return False
        self.i += 2
        self.type_parameters()
        self.need("=")
        self.type()
        self.ended()
        return True

    def _declare(self) -> bool:
        nxt = self.t[self.i + 1]
        if self.i + 1 in self.fresh or nxt not in RESERVED and nxt not in SOFT:
            return False
        if nxt == "global":
            self.i += 2
            self.braced("b")
            return True
        self.i += 1
        self.statement()
        return True

    def _global(self) -> bool:
        if self.t[self.i + 1] != "{" and self.t[self.i + 1][:2] != "{#":
            return False
        self.i += 1
        self.braced("b")
        return True

    def _namespace(self) -> bool:
        t = self.t
        if self.i + 1 in self.fresh or not (t[self.i + 1] in NAME or t[self.i + 1] == "s" and t[self.i] == "module"):
            return False
        self.i += 2
        while self.take("."):
            self.name()
        if t[self.i] == "{" or t[self.i][:2] == "{#":
            self.braced("b")
        else:
            self.ended()
        return True

    def _abstract(self) -> bool:
        if self.t[self.i + 1] != "class":
            return False
        self.i += 1
        return self._class()

    STATEMENTS = JsSource.STATEMENTS | {
        "enum": _enum, "interface": _interface, "type": _type, "declare": _declare, "namespace": _namespace, "module": _namespace, "abstract": _abstract, "global": _global,
    }
