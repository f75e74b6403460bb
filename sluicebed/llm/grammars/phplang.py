"""PHP. Text outside of its tags is a statement; a closing tag ends one."""

from __future__ import annotations

from sluicebed.llm.grammars.base import Broken, Grammar

# Words of the language by their part, in lower case.
RESERVED = frozenset(
    """abstract and array as break callable case catch class clone const continue declare default do echo else elseif enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for
    foreach function global goto if implements include include_once instanceof insteadof interface isset list namespace new or print private protected public require require_once return static switch
    throw trait try unset use var while xor yield empty exit die eval match""".split()
)
SOFT = frozenset("enum readonly from self parent".split())
MODIFIERS = frozenset("public protected private static abstract final readonly var".split())
#: Words that stand as names where a name is asked.
NAMES = SOFT | {"w", "match"}
BINARY = frozenset("+ - * / % & | ^ && || == != <> === !== < > <= >= <=> << >> ** . ?? instanceof and or xor |>".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= **= .= ??=".split())
PREFIX = frozenset("+ - ! ~ @ &".split())
CALLS = frozenset("isset unset empty exit die eval list array".split())
ENDS = ("", "}", "endif", "endwhile", "endfor", "endforeach", "endswitch", "enddeclare", "else", "elseif", "case", "default")


class PhpSource(Grammar):
    BRACED = {"b": "statements", "c": "class_members", "s": "cases", "a": "arms", "u": "uses", "t": "traits", "x": "named"}
    WORDS = RESERVED | SOFT

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
        self.need(";")

    def name(self) -> None:
        if self.t[self.i] not in NAMES:
            raise Broken
        self.i += 1

    def word(self) -> None:
        x = self.t[self.i]
        if not (x == "w" or x in RESERVED or x in SOFT):
            raise Broken
        self.i += 1

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def opens(self) -> bool:
        x = self.t[self.i]
        return x == "{" or x[:2] == "{#"

    def attributes(self) -> None:
        t = self.t
        while t[self.i] == "#" and t[self.i + 1] == "[":
            self.i += 2
            while t[self.i] != "]":
                self.name()
                if t[self.i] == "(":
                    self.arguments()
                if not self.take(",") and t[self.i] != "]":
                    raise Broken
            self.i += 1

    def statement(self) -> None:
        t = self.t
        x = t[self.i]
        act = self.STATEMENTS.get(x)
        if act is not None:
            return act(self)
        if x == "{" or x[:2] == "{#":
            return self.braced("b")
        if x == "#":
            self.attributes()
            if t[self.i] in ("function", "class", "abstract", "final", "readonly", "interface", "trait", "enum"):
                return self.statement()
            self.expression()
            return self.ended()
        if x == "w" and t[self.i + 1] == ":" or x in ("enum", "readonly") and t[self.i + 1] == ":":
            self.i += 2
            return None
        if x == "readonly" and t[self.i + 1] in ("class", "final", "abstract") or x == "enum" and t[self.i + 1] in NAMES:
            return self._class()
        self.expression()
        return self.ended()

    def block(self, *ends: str) -> None:
        """The body of a control structure: a statement, or statements after a colon up to one of the words."""
        t = self.t
        if not self.take(":"):
            return self.statement()
        while t[self.i] not in ends:
            if t[self.i] in ENDS:
                raise Broken
            self.statement()
        return None

    def _empty(self) -> None:
        self.i += 1

    def _if(self) -> None:
        t = self.t
        self.i += 1
        self.paren()
        if t[self.i] != ":":
            self.statement()
            while t[self.i] == "elseif" or t[self.i] == "else" and t[self.i + 1] == "if":
                self.i += 1 if t[self.i] == "elseif" else 2
                self.paren()
                self.statement()
            if self.take("else"):
                self.statement()
            return
        self.block("elseif", "else", "endif")
        while self.take("elseif"):
            self.paren()
            self.need_colon()
            self.block("elseif", "else", "endif")
        if self.take("else"):
            self.need_colon()
            self.block("endif")
        self.need("endif")
        self.ended()

    def need_colon(self) -> None:
        if self.t[self.i] != ":":
            raise Broken

    def _while(self) -> None:
        self.i += 1
        self.paren()
        self.loop("endwhile")

    def loop(self, end: str) -> None:
        if self.t[self.i] == ":":
            self.block(end)
            self.need(end)
            self.ended()
        else:
            self.statement()

    def _do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.paren()
        self.ended()

    def _for(self) -> None:
        t = self.t
        self.i += 1
        self.need("(")
        for close in (";", ";", ")"):
            while t[self.i] != close:
                self.expression()
                if not self.take(",") and t[self.i] != close:
                    raise Broken
            self.i += 1
        self.loop("endfor")

    def _foreach(self) -> None:
        self.i += 1
        self.need("(")
        self.expression()
        self.need("as")
        self.target()
        if self.take("=>"):
            self.target()
        self.need(")")
        self.loop("endforeach")

    def target(self) -> None:
        self.take("&")
        if self.postfix() not in "TP":
            raise Broken

    def _switch(self) -> None:
        self.i += 1
        self.paren()
        if self.take(":"):
            self.cases()
            self.need("endswitch")
            self.ended()
        else:
            self.braced("s")

    def cases(self) -> None:
        t = self.t
        while t[self.i] not in ("}", "endswitch"):
            if self.take(";"):
                continue
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            if t[self.i] not in (":", ";"):
                raise Broken
            self.i += 1
            while t[self.i] not in ("case", "default", "}", "endswitch"):
                if not t[self.i]:
                    raise Broken
                self.statement()

    def _return(self) -> None:
        self.i += 1
        if self.t[self.i] != ";":
            self.expression()
        self.ended()

    def _jump(self) -> None:
        self.i += 1
        if self.t[self.i] == "n":
            self.i += 1
        self.ended()

    def _goto(self) -> None:
        self.i += 1
        self.name()
        self.ended()

    def _echo(self) -> None:
        self.i += 1
        self.expression()
        while self.take(","):
            self.expression()
        self.ended()

    def _global(self) -> None:
        self.i += 1
        self.target()
        while self.take(","):
            self.target()
        self.ended()

    def _static(self) -> None:
        t = self.t
        if t[self.i + 1] != "v":
            self.expression()
            return self.ended()
        self.i += 1
        while True:
            self.need("v")
            if self.take("="):
                self.expression()
            if not self.take(","):
                break
        return self.ended()

    def _const(self) -> None:
        self.i += 1
        self.constants()
        self.ended()

    def constants(self) -> None:
        while True:
            self.word()
            self.need("=")
            self.expression()
            if not self.take(","):
                return

    def _try(self) -> None:
        t = self.t
        self.i += 1
        self.braced("b")
        some = False
        while self.take("catch"):
            some = True
            self.need("(")
            self.name()
            while self.take("|"):
                self.name()
            self.take("v")
            self.need(")")
            self.braced("b")
        if self.take("finally"):
            some = True
            self.braced("b")
        if not some or t[self.i] in ("catch", "finally"):
            raise Broken

    def _declare(self) -> None:
        self.i += 1
        self.need("(")
        while True:
            self.name()
            self.need("=")
            self.expression()
            if not self.take(","):
                break
        self.need(")")
        if self.t[self.i] == ";":
            self.i += 1
        else:
            self.loop("enddeclare")

    def _namespace(self) -> None:
        t = self.t
        if t[self.i + 1] not in (*NAMES, "{") and t[self.i + 1][:2] != "{#":
            self.expression()
            return self.ended()
        self.i += 1
        if t[self.i] in NAMES:
            self.i += 1
        if self.opens():
            return self.braced("b")
        return self.ended()

    def _use(self) -> None:
        t = self.t
        self.i += 1
        if t[self.i] in ("function", "const"):
            self.i += 1
        while True:
            self.name()
            if self.take("\\"):
                self.braced("u")
            elif self.take("as"):
                self.name()
            if not self.take(","):
                break
        self.ended()

    def uses(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if t[self.i] in ("function", "const"):
                self.i += 1
            self.name()
            if self.take("as"):
                self.name()
            if not self.take(",") and t[self.i] != "}":
                raise Broken

    def _function(self) -> None:
        t = self.t
        i = self.i + 1 + (t[self.i + 1] == "&")
        if t[i] == "(":
            self.expression()
            return self.ended()
        self.i = i
        self.name()
        self.parameters()
        self.result()
        return self.braced("b")

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")")

    def parameter(self) -> None:
        t = self.t
        self.attributes()
        while t[self.i] in MODIFIERS:
            self.i += 1
            if self.take("("):
                self.word()
                self.need(")")
        if t[self.i] not in ("v", "&", "..."):
            self.type()
        self.take("&")
        self.take("...")
        self.need("v")
        if self.take("="):
            self.expression()
        if self.opens():
            self.skip_hooks()

    def skip_hooks(self) -> None:
        self.i = self.end[self.i] + 1 if self.t[self.i] == "{" else self.i + 1

    def type(self) -> None:
        t = self.t
        self.take("?")
        while True:
            if self.take("("):
                self.type()
                self.need(")")
            elif t[self.i] in NAMES or t[self.i] in ("array", "callable", "static"):
                self.i += 1
            else:
                raise Broken
            if t[self.i] == "|" or t[self.i] == "&" and t[self.i + 1] not in ("v", "...", "&"):
                self.i += 1
            else:
                return

    def result(self) -> None:
        if self.take(":"):
            self.type()

    def _class(self) -> None:
        t = self.t
        while t[self.i] in ("abstract", "final", "readonly"):
            self.i += 1
        x = t[self.i]
        if x not in ("class", "interface", "trait", "enum"):
            raise Broken
        self.i += 1
        self.name()
        if x == "enum" and self.take(":"):
            self.type()
        self.class_rest()

    def class_rest(self) -> None:
        for word in ("extends", "implements"):
            if self.take(word):
                self.name()
                while self.take(","):
                    self.name()
        self.braced("c")

    def class_members(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if not t[self.i]:
                raise Broken
            self.attributes()
            if self.take("use"):
                self.name()
                while self.take(","):
                    self.name()
                if self.opens():
                    self.braced("t")
                else:
                    self.ended()
                continue
            if t[self.i] == "case":
                self.i += 1
                self.word()
                if self.take("="):
                    self.expression()
                self.ended()
                continue
            at = self.i
            while t[self.i] in MODIFIERS:
                self.i += 1
                if t[self.i] == "(" and t[self.i + 2] == ")":
                    self.i += 3
            if self.take("const"):
                if not (t[self.i + 1] == "="):
                    self.type()
                self.constants()
                self.ended()
            elif self.take("function"):
                self.take("&")
                self.word()
                self.parameters()
                self.result()
                if self.opens():
                    self.braced("b")
                else:
                    self.ended()
            elif self.i > at:
                if t[self.i] != "v":
                    self.type()
                while True:
                    self.need("v")
                    if self.take("="):
                        self.expression()
                    if self.opens():
                        self.skip_hooks()
                        break
                    if not self.take(","):
                        self.ended()
                        break
            else:
                raise Broken

    def traits(self) -> None:
        t = self.t
        while t[self.i] != "}":
            self.word()
            if self.take("::"):
                self.word()
            if self.take("insteadof"):
                self.name()
                while self.take(","):
                    self.name()
            else:
                self.need("as")
                if t[self.i] in MODIFIERS:
                    self.i += 1
                if t[self.i] != ";":
                    self.word()
            self.ended()

    # expressions; kinds: T target, P pattern, O other

    def expression(self) -> str:
        t = self.t
        kind = self.unary()
        while True:
            x = t[self.i]
            if x in BINARY:
                self.i += 1
                kind = self.unary()  # $a && $b = f() is read as $a && ($b = f())
            elif x in ASSIGN:
                if kind != "T" and not (kind == "P" and x == "="):
                    raise Broken
                self.i += 1
                if x == "=":
                    self.take("&")
                self.expression()
                kind = "O"
            elif x == "?":
                self.i += 1
                if t[self.i] != ":":
                    self.expression()
                self.need(":")
                self.unary()
                while t[self.i] in ASSIGN:
                    self.i += 1
                    self.expression()
                kind = "O"
            elif x == "?:":
                self.i += 1
                self.unary()
                kind = "O"
            else:
                return kind

    def unary(self) -> str:
        t = self.t
        x = t[self.i]
        if x in PREFIX:
            self.i += 1
            kind = self.unary()
            return "T" if kind == "T" and x in "!@-+~" else "O"  # ! $a = f() is read as !($a = f())
        if x in ("++", "--"):
            self.i += 1
            if self.unary() != "T":
                raise Broken
            return "O"
        if x == "(" and t[self.i + 1] in ("w", "array") and t[self.i + 2] == ")" and (t[self.i + 3] in ("v", "w", "(", "s", "n", "[", "new", "@", "array", "clone", "match", "isset", "!", "empty", "static", "parent", "self")):
            self.i += 3
            return self.unary()
        act = self.WORDED.get(x)
        if act is not None:
            return act(self) or "O"
        return self.postfix()

    def _operand(self) -> None:
        self.i += 1
        self.expression()

    def _clone(self) -> None:
        self.i += 1
        self.unary()

    def _yield(self) -> None:
        t = self.t
        self.i += 1
        if self.take("from"):
            self.expression()
        elif t[self.i] not in (";", ")", ",", "]", ":"):
            self.expression()
            if self.take("=>"):
                self.expression()

    def _closure(self) -> str:
        t = self.t
        self.take("static")
        if self.take("fn"):
            self.take("&")
            self.parameters()
            self.result()
            self.need("=>")
            self.expression()
            return "O"
        self.need("function")
        self.take("&")
        self.parameters()
        if self.take("use"):
            self.need("(")
            while t[self.i] != ")":
                self.take("&")
                self.need("v")
                if not self.take(",") and t[self.i] != ")":
                    raise Broken
            self.i += 1
        self.result()
        self.braced("b")
        return self.chain("O")

    def _static_word(self) -> str:
        if self.t[self.i + 1] in ("function", "fn"):
            return self._closure()
        return self.postfix()

    def _attributed(self) -> str:
        self.attributes()
        return self.unary()

    def _new(self) -> str:
        t = self.t
        self.i += 1
        self.attributes()
        if t[self.i] in ("class", "readonly"):
            self.take("readonly")
            self.need("class")
            if t[self.i] == "(":
                self.arguments()
            self.class_rest()
            return self.chain("O")
        if self.take("("):
            self.expression()
            self.need(")")
        elif t[self.i] in NAMES or t[self.i] == "static":
            self.i += 1
        elif self.variable():
            while t[self.i] in ("->", "?->", "::", "["):
                x = t[self.i]
                self.i += 1
                if x == "[":
                    self.expression()
                    self.need("]")
                elif not self.variable():
                    self.word()
        else:
            raise Broken
        if t[self.i] == "(":
            self.arguments()
        return self.chain("O")

    def variable(self) -> bool:
        """A variable, also one whose name is computed."""
        t = self.t
        if self.take("v"):
            return True
        if t[self.i] == "$":
            while self.take("$"):
                pass
            if self.opens():
                self.braced("x")
                return True
            self.need("v")
            return True
        return False

    def named(self) -> None:
        self.expression()

    def arms(self) -> None:
        t = self.t
        while t[self.i] != "}":
            if not self.take("default"):
                self.expression()
                while self.take(","):
                    if t[self.i] == "=>":
                        break
                    self.expression()
            else:
                self.take(",")
            self.need("=>")
            self.expression()
            if not self.take(",") and t[self.i] != "}":
                raise Broken

    def _match(self) -> str:
        if self.t[self.i + 1] != "(":
            return self.postfix()
        close = self.end[self.i + 1] + 1
        if self.t[close] != "{" and self.t[close][:2] != "{#":
            return self.postfix()
        self.i += 1
        self.paren()
        self.braced("a")
        return self.chain("O")

    def arguments(self) -> None:
        t = self.t
        self.need("(")
        if t[self.i] == "..." and t[self.i + 1] == ")":
            self.i += 2
            return
        self.listed(self.argument, ")")

    def argument(self) -> None:
        t = self.t
        if t[self.i + 1] == ":" and (t[self.i] == "w" or t[self.i] in RESERVED or t[self.i] in SOFT):
            self.i += 2
        self.take("...")
        self.expression()

    def items(self, close: str) -> None:
        t = self.t
        while t[self.i] != close:
            if self.take(","):
                continue
            self.take("...")
            self.expression()
            if self.take("=>"):
                self.expression()
            if not self.take(",") and t[self.i] != close:
                raise Broken
        self.i += 1

    def postfix(self) -> str:
        t = self.t
        x = t[self.i]
        if self.variable():
            return self.chain("T")
        if x in ("n", "s"):
            self.i += 1
            return self.chain("O")
        if x == "(":
            self.paren()
            return self.chain("O")
        if x == "[":
            self.i += 1
            self.items("]")
            return self.chain("P")
        if x in CALLS:
            self.i += 1
            if t[self.i] == "(":
                self.i += 1
                self.items(")")
            elif x not in ("exit", "die", "array"):
                raise Broken
            return self.chain("P" if x == "list" else "O")
        if x in NAMES or x in ("static", "namespace"):
            self.i += 1
            if x == "namespace":
                self.take("\\")
                self.name()
            return self.chain("N")
        raise Broken

    def chain(self, kind: str) -> str:
        t = self.t
        while True:
            x = t[self.i]
            if x in ("->", "?->"):
                self.i += 1
                if self.opens():
                    self.braced("x")
                elif not self.variable():
                    self.word()
                kind = "T"
            elif x == "::":
                self.i += 1
                if self.variable():
                    kind = "T"
                elif self.opens():
                    self.braced("x")
                    kind = "O"
                else:
                    self.word()
                    kind = "N"
            elif x == "(":
                self.arguments()
                kind = "O"
            elif x == "[":
                self.i += 1
                if t[self.i] != "]":
                    self.expression()
                self.need("]")
                kind = "T"
            elif x in ("++", "--"):
                if kind != "T":
                    raise Broken
                self.i += 1
                kind = "O"
            else:
                return "O" if kind == "N" else kind

    STATEMENTS = {
        ";": _empty, "if": _if, "while": _while, "do": _do, "for": _for, "foreach": _foreach, "switch": _switch, "return": _return, "break": _jump, "continue": _jump, "goto": _goto, "echo": _echo,
        "global": _global, "static": _static, "const": _const, "try": _try, "declare": _declare, "namespace": _namespace, "use": _use, "function": _function,
        "class": _class, "abstract": _class, "final": _class, "interface": _class, "trait": _class,
    }
    WORDED = {
        "print": _operand, "include": _operand, "include_once": _operand, "require": _operand, "require_once": _operand, "throw": _operand, "clone": _clone, "yield": _yield,
        "fn": _closure, "function": _closure, "static": _static_word, "new": _new, "match": _match, "#": _attributed,
    }
