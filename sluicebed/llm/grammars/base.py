"""What the grammars share.

A grammar reads token classes: keywords and operators stand for themselves, names are "w", numbers "n", literals "s". A
balanced stretch in braces may come as one class "{#" with the letters of the roles in which it is a sentence of the
grammar, so that stretches are parsed where they lie and only their roles travel on.
"""

from __future__ import annotations

CLOSING = {"(": ")", "[": "]", "{": "}"}


class Broken(Exception):
    """The classes are no sentence of the grammar."""


class Grammar:
    #: role letter -> name of the method that reads what stands between the braces
    BRACED: dict[str, str] = {}
    WORDS: frozenset[str] = frozenset()
    #: classes that keep a stretch from being parsed by itself
    APART: frozenset[str] = frozenset()

    def __init__(self, raw: list[str]):
        self.t = [*self.prepared(raw), "", "", "", ""]
        self.i = 0
        self.end = self.pairs()

    def prepared(self, raw: list[str]) -> list[str]:
        return [x for x in raw if x != "\n"]

    def pairs(self) -> dict[int, int]:
        """Index of each opening bracket -> index of its closing one."""
        out, stack = {}, []
        for i, x in enumerate(self.t):
            if x == "(" or x == "{" or x == "[":
                stack.append(i)
            elif x == ")" or x == "}" or x == "]":
                if not stack or CLOSING[self.t[stack[-1]]] != x:
                    raise Broken
                out[stack.pop()] = i
        if stack:
            raise Broken
        return out

    def need(self, x: str) -> None:
        if self.t[self.i] != x:
            raise Broken
        self.i += 1

    def take(self, x: str) -> bool:
        if self.t[self.i] == x:
            self.i += 1
            return True
        return False

    def braced(self, role: str) -> None:
        t = self.t[self.i]
        if t == "{":
            self.i += 1
            getattr(self, self.BRACED[role])()
            self.need("}")
        elif t[:2] == "{#" and role in t:
            self.i += 1
        else:
            raise Broken

    def attempt(self, *steps) -> bool:
        """Try the steps in order from here; on failure come back."""
        at = self.i
        try:
            for s in steps:
                s()
        except Broken:
            self.i = at
            return False
        return True

    def listed(self, item, close: str, trailing: bool = True) -> None:
        """Items with commas up to the closing class, which is read too."""
        t = self.t
        while t[self.i] != close:
            item()
            if t[self.i] == ",":
                self.i += 1
                if not trailing and t[self.i] == close:
                    raise Broken
            elif t[self.i] != close:
                raise Broken
        self.i += 1

    def source(self) -> None:
        raise NotImplementedError

    @classmethod
    def accepts(cls, raw: list[str]) -> bool:
        """True if a whole file with these classes is valid."""
        try:
            g = cls(raw)
            g.source()
        except Broken:
            return False
        return g.t[g.i] == ""

    @classmethod
    def roles(cls, raw: list[str]) -> str:
        """The roles of a balanced stretch in braces."""
        out = ""
        try:
            g = cls(raw)
        except Broken:
            return out
        for role in cls.BRACED:
            g.i = 0
            try:
                g.braced(role)
            except Broken:
                continue
            if g.t[g.i] == "":
                out += role
        return out
