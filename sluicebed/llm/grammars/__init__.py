"""Local grammars of the languages that p5 judges: recursive descent over token classes, without the text."""

from __future__ import annotations

from sluicebed.llm.grammars.base import Broken, Grammar
from sluicebed.llm.grammars.clang import CSource
from sluicebed.llm.grammars.golang import GoSource
from sluicebed.llm.grammars.javalang import JavaSource
from sluicebed.llm.grammars.phplang import PhpSource
from sluicebed.llm.grammars.rubylang import RubySource
from sluicebed.llm.grammars.script import JsSource, TsSource

GRAMMARS: dict[str, type[Grammar]] = {
    "js": JsSource, "ts": TsSource, "java": JavaSource, "c": CSource, "go": GoSource, "php": PhpSource, "rb": RubySource,
}

__all__ = ["GRAMMARS", "Broken", "Grammar"]
