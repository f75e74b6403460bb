"""Ruby. Blanks before a bracket ("_[", "_(") and before a sign that touches what follows ("u-") are part of the classes."""

from __future__ import annotations

from sluicebed.llm.grammars.base import CLOSING, Broken, Grammar

# Words of the language.
WORDS = frozenset(
    "__FILE__ __LINE__ __ENCODING__ BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split()
)
BINARY = frozenset("+ - * / % ** & | ^ << >> && || == != === =~ !~ <=> < > <= >= .. ... u- u+ u* u** u& u<<".split())
ASSIGN = frozenset("= += -= *= /= %= **= &= |= ^= <<= >>= &&= ||=".split())
#: Classes after which a line goes on.
OPEN = (BINARY - {"..", "..."}) | ASSIGN | frozenset(", ( [ { _( _[ => l . &. :: u:: ! not and or ? : ~ \\".split())
#: Classes with which an argument without parentheses begins.
ARGUMENT = frozenset("w n s l u- u* u** u& u:: _[ _( -> ~ nil true false self not defined? super yield case def __FILE__ __LINE__ __ENCODING__ u! u.. u<< begin".split())
STOPS = frozenset("\n ) ] } then do if unless while until rescue and or , => : end | in".split()) | {""}
OPERATORS = frozenset("+ - * / % ** & | ^ << >> == != === =~ !~ <=> < > <= >= ! ~ [ _[ u- u+ u! u~ ` u* u& u<<".split())


class RubySource(Grammar):
    BRACED = {"h": "hash_pairs", "b": "block_body", "p": "pattern_pairs"}
    WORDS = WORDS
    loop = False  # in the condition of a loop, whose "do" opens its body
    depth = 0  # 1 in a list, where a comma ends an item

    def prepared(self, raw: list[str]) -> list[str]:
        out: list[str] = []
        n = len(raw)
        for i, x in enumerate(raw):
            if x == ";":
                x = "\n"
            if x != "\n":
                if x == "\\" and i + 1 < n and raw[i + 1] == "\n":
                    continue
                out.append(x)
            elif out and out[-1] != "\n" and not (out[-1] in OPEN and raw[i] == "\n") and not (i and raw[i - 1] == "\\"):
                j = i + 1
                while j < n and raw[j] == "\n":
                    j += 1
                if j < n and raw[j] in (".", "&.") and raw[i] == "\n":
                    continue
                out.append("\n")
        return out

    def pairs(self) -> dict[int, int]:
        out, stack = {}, []
        for i, x in enumerate(self.t):
            if x in ("(", "{", "[", "_(", "_["):
                stack.append(i)
            elif x == ")" or x == "}" or x == "]":
                if not stack or CLOSING[self.t[stack[-1]][-1]] != x:
                    raise Broken
                out[stack.pop()] = i
        if stack:
            raise Broken
        return out

    def lines(self) -> None:
        while self.t[self.i] == "\n":
            self.i += 1

    # statements

    def source(self) -> None:
        self.statements(("",))

    def statements(self, ends: tuple[str, ...]) -> None:
        t = self.t
        while True:
            self.lines()
            if t[self.i] in ends:
                return
            if t[self.i] == "":
                raise Broken
            self.statement()
            if t[self.i] != "\n" and t[self.i] not in ends:
                raise Broken

    def statement(self) -> None:
        t = self.t
        self.joined()
        while t[self.i] in ("if", "unless", "while", "until", "rescue"):
            self.i += 1
            self.joined()

    def joined(self) -> None:
        self.negated()
        while self.t[self.i] in ("and", "or"):
            self.i += 1
            self.lines()
            self.negated()

    def negated(self) -> None:
        t = self.t
        if t[self.i] == "not" and t[self.i + 1] not in ("(",):
            self.i += 1
            return self.negated()
        x = t[self.i]
        if x in ("*", "u*") or x in ("(", "_(") and t[self.end[self.i] + 1] in (",", "="):
            at = self.i
            if self.attempt(self.targets, lambda: self.need("="), self.values):
                return None
            self.i = at
        kind = self.argument(True)
        if t[self.i] == "," and kind == "T":
            self.i += 1
            if t[self.i] != "=":
                self.targets()
            self.need("=")
            self.values()
        elif t[self.i] == "=>":
            self.i += 1
            self.pattern_top()
        elif t[self.i] == "in" and not self.loop:
            self.i += 1
            self.pattern_top()
        return None

    def targets(self) -> None:
        t = self.t
        while True:
            if t[self.i] in ("*", "u*"):
                self.i += 1
                if t[self.i] not in (",", "=", ")", "in", "|"):
                    if self.operand(False) != "T":
                        raise Broken
            elif t[self.i] in ("(", "_("):
                self.i += 1
                self.targets()
                self.need(")")
            elif self.operand(False) != "T":
                raise Broken
            if not self.take(",") or t[self.i] == "=":
                return

    def values(self) -> None:
        """The right side of an assignment."""
        t = self.t
        while True:
            if t[self.i] in ("*", "u*"):
                self.i += 1
            self.argument(True)
            if not self.take(","):
                break
        if t[self.i] == "rescue":
            self.i += 1
            self.argument(True)

    # expressions; kinds: T target, K call with arguments but without parentheses, O other

    def argument(self, command: bool) -> str:
        t = self.t
        kind = self.unary(command)
        while True:
            x = t[self.i]
            if kind == "K":
                return kind
            if x in BINARY:
                self.i += 1
                self.lines() if x not in ("..", "...") else None
                if x in ("..", "...") and t[self.i] in STOPS:
                    return "O"
                kind = self.unary(command and x in ("&&", "||"))
                if kind == "T" and t[self.i] in ASSIGN and x not in ("&&", "||", ".."):
                    kind = "O" if x in ("==", "!=", "<", ">") else "T"
                elif kind == "T" and t[self.i] == ",":
                    kind = "O"
            elif x in ASSIGN:
                if kind != "T":
                    raise Broken
                self.i += 1
                self.lines()
                if t[self.i] in ("return", "break", "next", "redo", "retry"):
                    raise Broken
                if t[self.i] in ("*", "u*") and x == "=":
                    self.values()
                    return "O"
                kind = self.argument(command)
                if command and t[self.i] == "," and self.depth == 0:
                    self.i += 1
                    self.values()
                return "O" if kind != "K" else "K"
            elif x == "?":
                self.i += 1
                self.lines()
                held, self.loop = self.loop, False
                if t[self.i] == "l":
                    self.i += 1
                else:
                    self.argument(False)
                    self.lines()
                    self.need(":")
                self.loop = held
                self.lines()
                self.argument(False)
                return "O"
            else:
                return kind

    def unary(self, command: bool) -> str:
        t = self.t
        x = t[self.i]
        if x in ("!", "u!"):
            self.i += 1
            return "K" if self.unary(command) == "K" else "O"
        if x in ("-", "+", "~", "u-", "u+", "&", "u~"):
            self.i += 1
            self.unary(False)
            return "O"
        if x in ("..", "...", "u..", "u..."):
            self.i += 1
            self.unary(False)
            return "O"
        if x == "defined?":
            self.i += 1
            self.unary(False)
            return "O"
        if x == "not":
            self.i += 1
            if t[self.i] in ("(", "_("):
                return self.operand(False)
            return self.unary(command)
        return self.operand(command)

    def operand(self, command: bool) -> str:
        t = self.t
        x = t[self.i]
        kind = "O"
        if x == "w":
            self.i += 1
            kind = "T"
        elif x == "n":
            self.i += 1
        elif x == "s":
            while t[self.i] == "s":
                self.i += 1
        elif x in ("[", "_["):
            self.listing("]")
        elif x in ("(", "_("):
            self.parens()
        elif x in ("u::", "::"):
            self.i += 1
            self.need("w")
            kind = "T"
        elif x == "{" or x[:2] == "{#":
            self.braced("h")
        elif x == "->":
            self.lambda_rest()
        else:
            act = self.PRIMARY.get(x)
            if act is None:
                raise Broken
            self.i += 1
            kind = act(self) or "O"
            if kind == "J":  # a jump takes its values and ends the expression
                return "O"
        return self.chain(kind, command, x in ("w", "super", "yield"))

    def parens(self) -> None:
        self.i += 1
        held, self.loop, deep, self.depth = self.loop, False, self.depth, 0
        self.statements((")",))
        self.i += 1
        self.loop, self.depth = held, deep

    def listing(self, close: str) -> None:
        """Arguments in brackets."""
        t = self.t
        self.i += 1
        held, self.loop, deep, self.depth = self.loop, False, self.depth, 1
        self.lines()
        while t[self.i] != close:
            self.item(close == ")")
            self.lines()
            if t[self.i] == ",":
                self.i += 1
                self.lines()
            elif t[self.i] != close:
                raise Broken
        self.i += 1
        self.loop, self.depth = held, deep

    def item(self, command: bool) -> None:
        t = self.t
        x = t[self.i]
        if x in ("*", "u*", "**", "u**", "&", "u&"):
            self.i += 1
            if t[self.i] in (",", ")", "]", "\n"):
                return
            self.argument(False)
        elif x == "...":
            self.i += 1
        elif x == "l":
            self.i += 1
            self.lines() if t[self.i] == "\n" and t[self.i + 1] not in ("l",) else None
            if t[self.i] not in (",", ")", "]", "}", "\n", "") and t[self.i] not in ("if", "unless") or t[self.i] in ("if", "unless") and self.depth:
                self.argument(command)
        else:
            kind = self.argument(command)
            if kind == "K" and t[self.i] == "," and self.depth:
                raise Broken
            if t[self.i] == "=>":
                self.i += 1
                self.lines()
                self.argument(command)

    def chain(self, kind: str, command: bool, call: bool) -> str:
        t = self.t
        while True:
            x = t[self.i]
            if x in (".", "&."):
                self.i += 1
                self.lines()
                y = t[self.i]
                if y == "(":
                    self.listing(")")
                    kind, call = "O", True
                    continue
                if not (y == "w" or y in WORDS or y in OPERATORS or y == "l" or y == "n"):
                    raise Broken
                self.i += 1
                if y == "l":  # in a ternary: a ? b.c: d
                    self.i -= 1
                    t[self.i] = ":"
                    return "O"
                kind, call = "T", True
            elif x == "::":
                self.i += 1
                if t[self.i] != "w" and t[self.i] not in WORDS:
                    raise Broken
                self.i += 1
                kind, call = "T", True
            elif x == "(" and call:
                self.listing(")")
                kind = "O"
            elif x == "[" or x == "_[" and not (command and call) and kind == "T":
                self.listing("]")
                kind = "T"
            elif (x == "{" or x[:2] == "{#") and call:
                if x[:2] == "{#":
                    self.braced("b")
                else:
                    self.block("}")
                kind, call = "O", True
            elif x == "do" and call and not self.loop:
                self.block("end")
                kind, call = "O", True
            elif command and call and kind == "T" and x in ARGUMENT:
                self.bare_arguments()
                if t[self.i] == "do" and not self.loop:
                    self.block("end")
                    if t[self.i] in (".", "&."):
                        kind, call = "O", True
                        continue
                return "K"
            else:
                return kind

    def bare_arguments(self) -> None:
        t = self.t
        deep, self.depth = self.depth, 0
        while True:
            self.item(True)
            if not self.take(","):
                break
            self.lines()
            if t[self.i] in STOPS and t[self.i] not in ("if", "unless"):
                raise Broken
        self.depth = deep

    def block(self, close: str) -> None:
        self.i += 1
        held, self.loop, deep, self.depth = self.loop, False, self.depth, 0
        self.block_body(close)
        self.i += 1
        self.loop, self.depth = held, deep

    def block_body(self, close: str = "}") -> None:
        t = self.t
        self.lines()
        if t[self.i] == "||":
            self.i += 1
        elif t[self.i] == "|":
            self.i += 1
            self.parameters("|")
            self.need("|")
        if close == "end":
            self.body()
        else:
            self.statements(("}",))

    def lambda_rest(self) -> None:
        t = self.t
        self.i += 1
        if t[self.i] in ("(", "_("):
            self.i += 1
            self.parameters(")")
            self.need(")")
        elif t[self.i] not in ("{", "do") and t[self.i][:2] != "{#":
            self.parameters("{")
        if t[self.i] == "{":
            self.block("}")
        elif t[self.i] == "do":
            self.block("end")
        else:
            self.braced("b")

    def parameters(self, close: str) -> None:
        """Parameters up to the closing class, which is not read."""
        t = self.t
        self.lines()
        while t[self.i] != close and not (close == "{" and t[self.i] == "do"):
            x = t[self.i]
            if x in ("*", "u*", "**", "u**", "&", "u&"):
                self.i += 1
                if t[self.i] in ("w", "nil"):
                    self.i += 1
            elif x == "...":
                self.i += 1
            elif x in ("(", "_("):
                self.i += 1
                self.parameters(")")
                self.need(")")
            elif x == "l":
                self.i += 1
                if t[self.i] not in (",", close, "\n", ""):
                    self.default(close)
            elif x == "w":
                self.i += 1
                if self.take("="):
                    self.default(close)
            elif x == "\n" and close == "|":  # names of the block's own
                self.lines()
                while t[self.i] != "|":
                    self.need("w")
                    self.take(",")
                return
            else:
                raise Broken
            if close != "\n":
                if t[self.i] == "\n" and close != "|":
                    self.lines()
            if t[self.i] == ",":
                self.i += 1
                self.lines()
                if close != "|" and t[self.i] == close:
                    raise Broken
            elif t[self.i] != close and t[self.i] != "\n" and not (close == "{" and t[self.i] == "do"):
                raise Broken

    def default(self, close: str) -> None:
        if close == "|":
            self.unary(False)
            while self.t[self.i] in ("+", "-", "*", "/", "&&", "||", "<<"):
                self.i += 1
                self.unary(False)
        else:
            deep, self.depth = self.depth, 1
            self.argument(False)
            self.depth = deep

    def hash_pairs(self) -> None:
        t = self.t
        held, self.loop, deep, self.depth = self.loop, False, self.depth, 1
        self.lines()
        while t[self.i] != "}":
            if t[self.i] in ("**", "u**"):
                self.i += 1
                self.argument(False)
            elif t[self.i] == "l":
                self.i += 1
                self.lines() if t[self.i] == "\n" and t[self.i + 1] != "l" else None
                if t[self.i] not in (",", "}", "\n"):
                    self.argument(False)
            else:
                self.argument(False)
                self.lines()
                self.need("=>")
                self.lines()
                self.argument(False)
            self.lines()
            if t[self.i] == ",":
                self.i += 1
                self.lines()
            elif t[self.i] != "}":
                raise Broken
        self.loop, self.depth = held, deep

    # words

    def then(self) -> None:
        if self.t[self.i] not in ("\n", "then"):
            raise Broken
        self.lines()
        self.take("then")

    def condition(self) -> None:
        held, self.loop, deep, self.depth = self.loop, False, self.depth, 0
        self.lines()
        self.joined()
        self.loop, self.depth = held, deep

    def inner(self, *ends: str) -> None:
        held, self.loop, deep, self.depth = self.loop, False, self.depth, 0
        self.statements(ends)
        self.loop, self.depth = held, deep

    def _if(self) -> None:
        self.condition()
        self.then()
        self.inner("elsif", "else", "end")
        while self.take("elsif"):
            self.condition()
            self.then()
            self.inner("elsif", "else", "end")
        if self.take("else"):
            self.inner("end")
        self.need("end")

    def _unless(self) -> None:
        self.condition()
        self.then()
        self.inner("else", "end")
        if self.take("else"):
            self.inner("end")
        self.need("end")

    def _while(self) -> None:
        held, self.loop, deep, self.depth = self.loop, True, self.depth, 0
        self.joined()
        self.loop, self.depth = held, deep
        if self.t[self.i] not in ("\n", "do"):
            raise Broken
        self.lines()
        self.take("do")
        self.inner("end")
        self.need("end")

    def _for(self) -> None:
        held, self.loop = self.loop, True
        self.targets()
        self.need("in")
        self.argument(True)
        self.loop = held
        if self.t[self.i] not in ("\n", "do"):
            raise Broken
        self.lines()
        self.take("do")
        self.inner("end")
        self.need("end")

    def _case(self) -> None:
        t = self.t
        if t[self.i] != "\n":
            self.condition()
        self.lines()
        if t[self.i] not in ("when", "in"):
            raise Broken
        word = t[self.i]
        while self.take(word):
            if word == "when":
                deep, self.depth = self.depth, 1
                while True:
                    if t[self.i] in ("*", "u*"):
                        self.i += 1
                    self.lines()
                    self.argument(False)
                    if not self.take(","):
                        break
                    self.lines()
                self.depth = deep
            else:
                self.pattern_top()
                if t[self.i] in ("if", "unless"):
                    self.i += 1
                    self.joined()
            self.then()
            self.inner("when" if word == "when" else "in", "else", "end")
        if self.take("else"):
            self.inner("end")
        self.need("end")

    def body(self) -> None:
        """Statements with rescue, else and ensure, up to "end", which is not read."""
        t = self.t
        self.inner("rescue", "else", "ensure", "end")
        some = False
        while self.take("rescue"):
            some = True
            while t[self.i] not in ("\n", "then", "=>"):
                if t[self.i] in ("*", "u*"):
                    self.i += 1
                deep, self.depth = self.depth, 1
                self.argument(False)
                self.depth = deep
                if not self.take(","):
                    break
                self.lines()
            if self.take("=>"):
                if self.operand(False) != "T":
                    raise Broken
            self.then()
            self.inner("rescue", "else", "ensure", "end")
        if t[self.i] == "else":
            if not some:
                raise Broken
            self.i += 1
            self.inner("ensure", "end")
        if self.take("ensure"):
            self.inner("end")
        if t[self.i] != "end":
            raise Broken

    def _begin(self) -> None:
        self.body()
        self.need("end")

    def _def(self) -> None:
        t = self.t
        x = t[self.i]
        if x in ("(", "_("):
            self.parens()
            self.need(".")
            x = t[self.i]
        elif t[self.i + 1] == "." and (x in ("w", "self", "nil")):
            self.i += 2
            x = t[self.i]
        if x not in OPERATORS and x != "w" and x not in WORDS and x != "`":
            raise Broken
        self.i += 1
        if x in ("[", "_["):
            self.need("]")
            self.take("=")
        if x in ("+", "-", "!", "~", "u-", "u+", "u!", "u~"):
            self.take("@")
        if t[self.i] in ("(", "_("):
            self.i += 1
            held, self.loop = self.loop, False
            self.parameters(")")
            self.need(")")
            self.loop = held
        elif t[self.i] not in ("\n", "=", "end"):
            self.parameters("\n")
        if self.take("="):
            self.lines()
            self.argument(True)
            if self.take("rescue"):
                self.argument(True)
            return
        self.body()
        self.need("end")

    def _class(self) -> None:
        t = self.t
        if t[self.i] in ("<<", "u<<"):
            self.i += 1
            self.joined()
        else:
            self.path()
            if self.take("<"):
                self.joined()
        if t[self.i] != "\n" and t[self.i] != "end":
            raise Broken
        self.body()
        self.need("end")

    def path(self) -> None:
        if self.t[self.i] in ("::", "u::"):
            self.i += 1
        self.need("w")
        while self.t[self.i] == "::":
            self.i += 1
            self.need("w")

    def _module(self) -> None:
        self.path()
        self.body()
        self.need("end")

    def _jump(self) -> str:
        t = self.t
        if t[self.i] not in STOPS and t[self.i] not in ("&&", "||", "?", "."):
            self.values_list()
        return "J"

    def values_list(self) -> None:
        t = self.t
        deep, self.depth = self.depth, 0
        while True:
            if t[self.i] in ("*", "u*"):
                self.i += 1
            self.item(True)
            if not self.take(","):
                break
            self.lines()
        self.depth = deep

    def _call(self) -> str:
        return "T"

    def _self(self) -> None:
        return None

    def _alias(self) -> None:
        for _ in range(2):
            if self.t[self.i] not in ("w", "s") and self.t[self.i] not in WORDS and self.t[self.i] not in OPERATORS:
                raise Broken
            self.i += 1
            if self.t[self.i - 1] in ("[", "_["):
                self.need("]")

    def _undef(self) -> None:
        while True:
            if self.t[self.i] not in ("w", "s") and self.t[self.i] not in WORDS:
                raise Broken
            self.i += 1
            if not self.take(","):
                return

    def _hook(self) -> None:
        if self.t[self.i] == "{":
            self.block("}")
        else:
            self.braced("b")

    # patterns

    def pattern_top(self) -> None:
        t = self.t
        while True:
            self.pattern_item()
            if not self.take(","):
                return
            if t[self.i] in ("then", "\n"):
                return
            self.lines()

    def pattern_item(self) -> None:
        t = self.t
        if t[self.i] in ("*", "u*", "**", "u**"):
            self.i += 1
            if t[self.i] in ("w", "nil"):
                self.i += 1
        elif t[self.i] == "l":
            self.i += 1
            if t[self.i] not in (",", "}", ")", "\n", "then", "if", "unless", "", "and", "or"):
                self.pattern()
        else:
            self.pattern()

    def pattern(self) -> None:
        t = self.t
        while True:
            self.pattern_primary()
            if t[self.i] in ("..", "..."):
                self.i += 1
                if t[self.i] not in STOPS:
                    self.pattern_primary()
            if not self.take("|"):
                break
            self.lines()
        if self.take("=>"):
            self.need("w")

    def pattern_list(self, close: str) -> None:
        self.lines()
        while self.t[self.i] != close:
            self.pattern_item()
            self.lines()
            if not self.take(",") and self.t[self.i] != close:
                raise Broken
            self.lines()

    def pattern_pairs(self) -> None:
        self.pattern_list("}")

    def pattern_primary(self) -> None:
        t = self.t
        x = t[self.i]
        if x in ("[", "_["):
            self.i += 1
            self.pattern_list("]")
            self.i += 1
        elif x in ("(", "_("):
            self.i += 1
            self.pattern()
            self.need(")")
        elif x == "{" or x[:2] == "{#":
            self.braced("p")
        elif x == "^":
            self.i += 1
            if t[self.i] in ("(", "_("):
                self.parens()
            else:
                self.need("w")
        elif x in ("w", "::", "u::"):
            self.path()
            if t[self.i] in ("(", "["):
                close = CLOSING[t[self.i]]
                self.i += 1
                self.pattern_list(close)
                self.i += 1
        elif x in ("..", "...", "u..", "u..."):
            self.i += 1
            self.pattern_primary()
        elif x == "->":
            self.lambda_rest()
        else:
            self.unary(False)

    PRIMARY = {
        "if": _if, "unless": _unless, "while": _while, "until": _while, "for": _for, "case": _case, "begin": _begin, "def": _def, "class": _class, "module": _module,
        "return": _jump, "break": _jump, "next": _jump, "redo": _self, "retry": _self, "self": _self, "nil": _self, "true": _self, "false": _self,
        "__FILE__": _self, "__LINE__": _self, "__ENCODING__": _self, "super": _call, "yield": _call, "alias": _alias, "undef": _undef, "BEGIN": _hook, "END": _hook,
    }
