"""Natural language hidden inside code.

A lexer takes comments and string literals from each source (and from the added and removed lines of each section of a
diff); literals are read with their escapes, adjacent comment lines and concatenated literals together. Their sentences are
broken into subwords of a public tokenizer and scored under unigram counts of eight languages and of code; the class of
the largest posterior wins, and only sentences of a language count as prose.

The counts are fitted on a bounded sample: at most DOCS documents of each language (by label, the smallest hashes of
doc_id) and CODE rows of source files; two rounds of re-estimation over their sentences repair wrong labels. Everything else reads all
rows and whole texts.

Cases: null maps, sources and diffs give no row; unparsable sources are read on after the broken place; a null path gives no
row; copies are read once per task; other suffixes give no row; an empty documents table leaves only the script to tell
languages apart (ru, zh, ja).
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebed.functions.lexing import SUFFIXES, tokens
from sluicebed.llm.syntax import sources
from sluicebed.plans.shared import few_files

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k"
LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja")
DOCS, CODE = 120, 200
LEAST_WORDS, LEAST_CHARS = 4, 6

# Three-letter codes and names of the languages.
_LONG = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr",
    "spa": "es", "spanish": "es", "por": "pt", "portuguese": "pt", "rus": "ru", "russian": "ru", "zho": "zh", "chi": "zh", "chinese": "zh",
    "cmn": "zh", "jpn": "ja", "japanese": "ja", "jp": "ja", "cn": "zh",
}
# Common function words, which a narrow sample may lack.
_COMMON = {
    "en": "the of and to in is that it for was on are as with be by this not do have from at or an but which",
    "de": "der die das und in zu den ist nicht von mit sich des auf für ein eine dem im als auch werden wird durch",
    "fr": "le la les de des et en un une du dans est pour par sur que qui au pas plus avec ne se sera toute",
    "es": "el la los las de y en un una que se por con para no es al del lo su como más debe este",
    "pt": "o a os as de e em um uma que do da no na dos para com por se não ao mais como seu",
}
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002ffff]")
_KANA = re.compile(r"[\u3040-\u30ff]")
_CYRILLIC = re.compile(r"[\u0400-\u04ff]")
_LETTER = re.compile(r"[^\W\d_]")
_READ = re.compile(r"[A-Za-z\u00aa-\u024f\u0300-\u036f\u0400-\u04ff\u3005-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0002ffff]")
_A_WORD = re.compile(r"[\"'“”‘’«»„(\[*¿¡-]*[^\W\d_]+(?:['’-][^\W\d_]+)*['’]?[.,;:!?…\"'“”’»)\]*-]*")
_CAMEL = re.compile(r"[a-z0-9][A-Z]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？])|\n\s*\n")
_QUERY = re.compile(
    r"^\s*(?:SELECT\b[\s\S]+\bFROM\b|INSERT\s+INTO\b|UPDATE\b[\s\S]+\bSET\b|DELETE\s+FROM\b|(?:CREATE|ALTER|DROP)\s+(?:TABLE|INDEX|VIEW|DATABASE)\b|WITH\b[\s\S]+\bAS\s*\()", re.I
)
_CODE = re.compile(r"[=;{}]\s*$|^\s*(?:[\w$.]+\s*)?[\w$.\[\]]+\s*(?::?=|\+=)\s*\S|^\s*(?:return|import|from|def|class|if|for|while|const|let|var|function|func|package)\b[^.]*[({:;=]|\w\([^)]*\)\s*[;{]?\s*$|=>|->|&&|\|\||::")
_SPLIT = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|_+")
_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|((?:x[0-9A-Fa-f]{2}(?:\\(?=x[0-9A-Fa-f]{2}))?)+)|([0-7]{1,3})|(\r?\n)|([\s\S]))")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "e": "\x1b", "0": "\0", "s": " "}
_TAGLINE = re.compile(r"-\*-.*?-\*-|^\s*@\w+.*$|^\s*:(?:param|returns?|type|raises?)\b.*$", re.M)
_cache: dict[str, object] = {}


def subwords(text: str, folder: str = FOLDER) -> list[int]:
    """Token ids of a text, identifiers broken at case changes and underscores."""
    import base64

    import tiktoken

    if folder not in _cache:
        from sluicebed.llm.tokens import SPLIT

        with open(os.path.join(folder, f"{VOCABULARY}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _cache[folder] = tiktoken.Encoding(VOCABULARY, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _cache[folder].encode_ordinary(" " + _SPLIT.sub(" ", text).lower())


def unescaped(body: str, lang: str, single: bool) -> str:
    """A literal's content as the program reads it."""
    if "\\" not in body:
        return body
    if single and lang in ("php", "rb"):
        return re.sub(r"\\([\\'])", r"\1", body)

    def one(m: re.Match) -> str:
        brace, four, eight, hexes, octal, line, other = m.groups()
        code = brace or four or eight
        if code:
            if four and lang == "php":
                return m[0]
            return chr(min(int(code, 16), 0x10FFFF))
        if hexes:
            raw = bytes(int(h, 16) for h in re.findall(r"x([0-9A-Fa-f]{2})", hexes))
            if lang in ("c", "go", "php", "rb"):
                return raw.decode("utf-8", "replace")
            return raw.decode("latin-1")
        if octal:
            return chr(int(octal, 8))
        if line:
            return ""
        return _PLAIN.get(other, other)

    s = _ESCAPE.sub(one, body)
    if re.search(r"[\ud800-\udfff]", s):
        s = s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return s


def literal_text(token: str, lang: str) -> str:
    """The content of a string literal token."""
    m = re.match(r"([A-Za-z]{0,2}8?)(\"\"\"|'''|[\"'`])", token)
    if m and lang != "rb" or m and not m[1]:
        prefix, q = m[1].lower(), m[2]
        body = token[m.end() : -len(q)] if token.endswith(q) and len(token) >= m.end() + len(q) else token[m.end() :]
        if q == "`" and lang in ("js", "ts"):
            return re.sub(r"\$\{[^}]*\}", " x ", unescaped(body, lang, False))
        if "r" in prefix or q == "`" and lang == "go":
            return body
        body = unescaped(body, lang, q == "'")
        if "f" in prefix or lang == "rb":
            body = re.sub(r"#?\{[^{}]*\}", " x ", body)
        return body
    if token.startswith("<<<"):
        return token.partition("\n")[2].rpartition("\n")[0]
    if lang == "rb" and token.startswith("%"):
        return re.sub(r"^%[A-Za-z]?.|.[a-z]*$", "", token, flags=re.S)
    if token.startswith("/"):
        return ""
    return token


def comment_text(token: str, lang: str) -> str:
    """The words of a comment token, without marks and tag lines."""
    if token.startswith("=begin"):
        body = re.sub(r"\A=begin[^\n]*\n?|^=end[^\n]*\Z", "", token, flags=re.M)
    elif token.startswith("/*"):
        body = re.sub(r"^[ \t]*\*+(?!/)[ \t]?", "", token[2:].removesuffix("*/").lstrip("*!"), flags=re.M)
    else:
        body = re.sub(r"^(?://+[!/]?|#+!?)[ \t]?", "", token)
    if lang == "java" and "\\u" in body:
        body = unescaped(body, "java", False)
    return _TAGLINE.sub("\n", body)


def _lexed(text: str, lang: str, inside: bool = False) -> list[tuple[str, int, int]]:
    """Tokens of a text that may be broken or a part of a file: reading goes on after what cannot be closed."""
    out: list[tuple[str, int, int]] = []
    pos, started = 0, inside
    while True:
        got = tokens(text, lang, pos, inside=started)
        if lang == "php" and not started and len(got) == 1 and got[0][0] == "H":
            return []
        if not got or got[-1][0] not in "UV":
            out += got
            return out
        if got[-1][0] == "V":  # an unclosed here-document: its lines are read as code
            out += got[:-1]
            if got[-1][1] >= len(text):
                return out
            pos, started = max(got[-1][1], text.find("\n", got[-1][1]) + 1 if lang == "php" else 0), True
            continue
        out += got[:-1]
        a = got[-1][1]
        opened = text[a : a + 3]
        end = text.find("\n", a)
        end = len(text) if end < 0 else end
        if opened[:2] == "/*" or opened in ('"""', "'''"):
            pos = a + (2 if opened[:2] == "/*" else 3)
        else:
            out.append(("S", a, end))
            pos = end
        if pos >= len(text) or pos <= a:
            return out
        started = True


def pieces_of(text: str, lang: str, inside: bool = False) -> Iterator[tuple[int, int, str]]:
    """(start, end, words) of the comments and literals of a source; adjacent ones are joined."""
    toks = _lexed(text, lang, inside)
    held: list = []  # open run: kind, start, end, parts
    gap_ok, alone = False, True

    def flush():
        if held:
            yield held[1], held[2], ("\n" if held[0] == "C" else "").join(held[3])
            held.clear()

    queue = list(reversed(toks))
    line_breaks, glue = 0, False
    del gap_ok
    while queue:
        kind, a, b = queue.pop()
        if kind == "L":
            line_breaks += 1
            alone = True
            continue
        if kind == "C":
            token = text[a:b]
            inner = token.find("/*", 2) if token.startswith("/*") else -1
            if inner > 0:  # an unclosed comment ran into the next one
                queue += reversed([(k, x + a + inner, y + a + inner) for k, x, y in _lexed(text[a + inner : b], lang, True)])
                queue += reversed([(k, x + a + 2, y + a + 2) for k, x, y in _lexed(text[a + 2 : a + inner], lang, True)])
                continue
            line = not token.startswith(("/*", "=begin"))
            words = comment_text(token, lang)
            if held and held[0] == "C" and line and alone and held[4] and line_breaks <= 1:
                held[2] = b
                held[3].append(words)
            elif held and held[0] == "S" and not (line and alone):
                yield a, b, words
            else:
                yield from flush()
                held[:] = ["C", a, b, [words], line and alone]
            line_breaks, alone = 0, False
            continue
        if kind == "S":
            body = literal_text(text[a:b], lang)
            if held and held[0] == "S" and (glue or (lang in ("py", "c", "rb") and held[4] == "S")):
                held[2] = b
                held[3].append(body)
            else:
                yield from flush()
                held[:] = ["S", a, b, [body], "S"]
            glue, alone, line_breaks = False, False, 0
            continue
        if held and held[0] == "S" and kind == "O" and text[a:b] in ("+", "." if lang == "php" else "+", "\\"):
            glue = True
        else:
            if held and held[0] == "S":
                yield from flush()
            elif held and held[0] == "C":
                yield from flush()
            glue = False
        alone, line_breaks = False, 0
    yield from flush()


def sentences(words: str) -> list[str]:
    """Sentences of a comment or literal, wrapped lines joined; code lines stand alone."""
    out = []
    for para in _SENTENCE.split(words.replace("\r\n", "\n")):
        lines = [x.strip() for x in para.split("\n")]
        run: list[str] = []
        for x in lines:
            if not x:
                continue
            if _CODE.search(x) or _QUERY.search(x):
                if run:
                    out.append(" ".join(run))
                    run = []
                out.append(x)
                continue
            if run and len(run[-1].split()) < 3 and not _CJK.search(run[-1]):  # a label, not the start of a wrapped line
                out.append(" ".join(run))
                run = []
            run.append(x)
        if run:
            text = " ".join(run)
            if out and len(run) == 1 and 1 < len(text.split()) < LEAST_WORDS and text.endswith((".", "!")) and out[-1].endswith("."):
                out[-1] += " " + text
            else:
                out.append(text)
    return out


def size_of(sentence: str) -> tuple[int, int]:
    """(words, CJK characters) of a sentence that reads as prose; zeros if it reads as code, a query, path or label."""
    if _CODE.search(sentence) or _QUERY.search(sentence):
        return 0, 0
    cjk = len(_CJK.findall(sentence))
    letters = _LETTER.findall(sentence)
    if len(letters) > 2 * len(_READ.findall("".join(letters))):
        return 0, 0
    parts = sentence.split()
    words = sum(1 for p in parts if _A_WORD.fullmatch(p) and not _CAMEL.search(p))
    if cjk:
        return words, cjk if cjk >= 0.4 * len(re.sub(r"\s", "", sentence)) else 0
    return (words if words >= 0.6 * len(parts) else 0), 0


def fit(labelled: list[tuple[str, str]], code: list[str], folder: str = FOLDER, rounds: int = 2) -> np.ndarray:
    """Log unigram probabilities, one row per language and a last one for code, from (language, text) and code texts."""
    cut = [(LANGUAGES.index(lang), s) for lang, t in labelled for s in sentences(re.sub(r"```[\s\S]*?(?:```|\Z)", "\n\n", t)) if sum(size_of(s))]
    ids = [np.array(subwords(s, folder)) for _, s in cut]
    of = np.array([k for k, _ in cut], int)
    width = 1 + max([int(i.max()) for i in ids] + [50256])
    code_row = np.zeros(width)
    for c in code:
        np.add.at(code_row, subwords(c, folder), 1)
    table = None
    for _ in range(rounds + 1):
        counts = np.zeros((len(LANGUAGES) + 1, width))
        for k, i in zip(of, ids, strict=True):
            np.add.at(counts[k], i, 1)
        counts[-1] = code_row
        for lang, words in _COMMON.items():
            k = LANGUAGES.index(lang)
            weight = max(3.0, 0.003 * counts[k].sum())
            for w in words.split():
                np.add.at(counts[k], subwords(w, folder), weight)
        mass = counts.sum(axis=1, keepdims=True)
        # the same chance in every class for what it has not seen, or classes with few counts would win unknown words
        table = np.log(0.95 * counts / np.maximum(mass, 1) + 0.05 / width).astype(np.float32)
        table[mass[:, 0] == 0] = -30.0
        of = np.array([int(np.argmax(table[:-1, i].sum(axis=1))) for i in ids], int)
    return table


def classify(sentence: str, table: np.ndarray, folder: str = FOLDER) -> str | None:
    """The language of a sentence, or None for code: the largest posterior under equal priors."""
    n_cjk = len(_CJK.findall(sentence))
    scores = table[:, subwords(sentence, folder)].sum(axis=1)
    if n_cjk >= LEAST_CHARS and n_cjk * 2 >= len(_LETTER.findall(sentence)):
        best = ("ja" if _KANA.search(sentence) else "zh") if scores[6] == scores[7] else ("zh", "ja")[int(scores[7] > scores[6])]
        return "ja" if len(_KANA.findall(sentence)) * 5 > n_cjk else "zh" if not _KANA.search(sentence) and best == "ja" and scores[7] - scores[6] < 5 else best
    if len(_CYRILLIC.findall(sentence)) * 2 > len(_LETTER.findall(sentence)):
        return "ru"
    k = int(np.argmax(scores))
    return LANGUAGES[k] if k < len(LANGUAGES) and math.isfinite(float(scores[k])) and table[k, 0] > -29 else None


class Reader:
    """Languages of sources, with what was read before kept by hash."""

    def __init__(self, table: np.ndarray, folder: str = FOLDER):
        self.table, self.folder = table, folder
        self.known: dict[str, tuple[str | None, int, int]] = {}

    def languages(self, words: str, into: dict[str, int]) -> None:
        """Adds the characters of prose of each language that one comment or literal holds enough of."""
        here: dict[str, list[int]] = {}
        for s in sentences(words):
            got = self.known.get(s)
            if got is None:
                n, c = size_of(s)
                lang = classify(s, self.table, self.folder) if n >= 2 or c >= 2 else None
                if len(self.known) > 400_000:
                    self.known.clear()
                got = self.known[s] = (lang, n, c)
            lang, n, c = got
            if lang:
                x = here.setdefault(lang, [0, 0, 0])
                x[0], x[1], x[2] = max(x[0], n), max(x[1], c), x[2] + len(s)  # words of the longest run of prose
        for lang, (n, c, chars) in here.items():
            if c >= LEAST_CHARS if lang in ("zh", "ja") else n >= LEAST_WORDS:
                into[lang] = into.get(lang, 0) + chars

    def source(self, text: str, lang: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for _, _, words in pieces_of(text, lang):
            if len(words) >= LEAST_CHARS:
                self.languages(words, out)
        return out

    def diff(self, text: str) -> list[tuple[str, dict[str, int], int]]:
        """(path, languages, changed characters) of each section."""
        found: dict[str, tuple[dict[str, int], int]] = {}
        for path, hunks in sections(text):
            lang = SUFFIXES.get(path[path.rfind(".") :]) if "." in path else None
            if lang is None or lang == "json":
                continue
            out, size = found.get(path, ({}, 0))
            for old, new in hunks:
                for side in (old, new):
                    size += sum(len(t) for t, changed in side if changed)
                    self.side(side, lang, out)
            found[path] = (out, size)
        return [(p, o, n) for p, (o, n) in found.items()]

    def side(self, lines: list[tuple[str, bool]], lang: str, out: dict[str, int]) -> None:
        if not any(changed for _, changed in lines):
            return
        text = "\n".join(t for t, _ in lines)
        spans, at = [], 0
        for t, changed in lines:
            if changed:
                spans.append((at, at + len(t)))
            at += len(t) + 1
        lead = _open_head(text, lang)
        if lead:
            shift = len(lead)
            text, spans = lead + text, [(a + shift, b + shift) for a, b in spans]
        for a, b, words in pieces_of(text, lang, inside=True):
            inside = [(x, y) for x, y in spans if x < b and y > a]
            if not inside:
                continue
            if any(text.find("\n", a, b) >= 0 for _ in "x") and sum(min(y, b) - max(x, a) for x, y in inside) < 0.98 * (b - a - text.count("\n", a, b)):
                raw = "\n".join(text[max(x, a) : min(y, b)] for x, y in inside)
                words = _bare(raw, lang)
            if len(words) >= LEAST_CHARS:
                self.languages(words, out)


def _bare(raw: str, lang: str) -> str:
    """The words of some lines of a comment or literal."""
    lines = [re.sub(r"^\s*(?:/\*+!?|\*+/|\*(?!\S\*)|//+[!/]?|#+|=begin|=end|\"\"\"|''')[ \t]?|[ \t]*(?:\*/|\"\"\"|''')\s*$", "", x) for x in raw.split("\n")]
    return _TAGLINE.sub("\n", unescaped("\n".join(lines), lang, False))


def _open_head(text: str, lang: str) -> str:
    """What opens the comment or literal in which a hunk begins, or nothing."""
    if lang == "py":
        quotes = [m for m in re.finditer(r"\"\"\"|'''", text)]
        if len(quotes) % 2:
            head = text[: quotes[0].start()]
            lines = [x for x in head.split("\n") if x.strip()]
            if lines and not any(re.search(r"[=(]|^\s*(?:def|class|import|from|if|for|while|return|@|#)", x) for x in lines):
                return quotes[0][0] + "\n"
        return ""
    if lang == "rb":
        return "=begin\n" if re.search(r"^=end\b", text, re.M) and not re.search(r"^=begin\b[\s\S]*?^=end\b", text, re.M) else ""
    close, start = text.find("*/"), text.find("/*")
    return "/*\n" if close >= 0 and (start < 0 or close < start) and not re.search(r"//[^\n]*\*/", text[: close + 2]) and not re.search(r"[\"'][^\n]*\*/", text[text.rfind("\n", 0, close) + 1 : close + 2]) else ""


_HEADER = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")


def sections(diff: str) -> Iterator[tuple[str, list[tuple[list, list]]]]:
    """(new path, hunks) of each section of a unified diff; a hunk is its old and its new side as (line, changed)."""
    path, hunks, left_old, left_new = None, [], 0, 0
    old_path = None
    for line in diff.split("\n"):
        raw, line = line, line.rstrip("\r")
        if left_old > 0 or left_new > 0:
            op, rest = raw[:1], raw[1:]
            if op == "+":
                hunks[-1][1].append((rest, True))
                left_new -= 1
                continue
            if op == "-":
                hunks[-1][0].append((rest, True))
                left_old -= 1
                continue
            if op in (" ", "") and not (op == "" and left_old <= 0 and left_new <= 0):
                hunks[-1][0].append((rest, False))
                hunks[-1][1].append((rest, False))
                left_old -= 1
                left_new -= 1
                continue
            if op == "\\":
                continue
        m = _HEADER.match(line)
        if m and path is not None:
            hunks.append(([], []))
            left_old, left_new = int(m[1] or 1), int(m[2] or 1)
        elif line.startswith("diff --git "):
            if path is not None and hunks:
                yield path, hunks
            g = re.match(r'diff --git "?a/.*? "?b/(.*?)"?$', line)
            path, hunks, left_old, left_new, old_path = g[1] if g else None, [], 0, 0, None
        elif line.startswith("--- "):
            if path is not None and hunks:
                yield path, hunks
                hunks = []
            old_path = line[4:].split("\t")[0].strip('"')
        elif line.startswith("+++ "):
            new = line[4:].split("\t")[0].strip('"')
            new = (old_path or new) if new == "/dev/null" else new
            path = re.sub(r"^[ab]/", "", new)
            left_old = left_new = 0
    if path is not None and hunks:
        yield path, hunks


def language_of_label(c):
    """ISO code of a document's language label, or null."""
    low = F.lower(F.trim(c))
    base = F.regexp_extract(low, r"^([a-z]+)", 1)
    long = F.create_map(*[F.lit(x) for kv in _LONG.items() for x in kv])
    code = F.coalesce(long[base], base)
    return F.when(code.isin(*LANGUAGES), code)


def sample_texts(documents: DataFrame, per_language: int = DOCS) -> list[tuple[str, str]]:
    """At most per_language labelled texts of each language, those with the smallest hashes of doc_id."""
    kept = documents.select(language_of_label(F.col("lang")).alias("lang"), "text", F.xxhash64("doc_id").alias("h")).filter(
        "lang is not null and length(text) > 200"
    )
    cuts = kept.groupBy("lang").agg(F.count("*").alias("n")).collect()
    near = F.create_map(*[F.lit(x) for r in cuts for x in (r[0], min(1.0, 2.0 * per_language / r[1]))]) if cuts else None
    if near is None:
        return []
    part = kept.filter((F.pmod("h", F.lit(1 << 20)) / (1 << 20)) < near[F.col("lang")])
    top = part.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", F.substring("text", 1, 4000).alias("text")))), 1, per_language).alias("t"))
    return [(r[0], x["text"]) for r in top.collect() for x in r[1]]


def sample_code(pulls: DataFrame, n: int = CODE) -> list[str]:
    """The code of at most n rows without comments and literals: those with the smallest hashes in at most four files."""
    rows = few_files(pulls, ["example_no", "files"]).orderBy(F.xxhash64("example_no")).limit(n)
    out = []
    for r in rows.select("files").collect():
        for path, text in (r[0] or {}).items():
            lang = SUFFIXES.get((path or "")[(path or "").rfind(".") :])
            if lang and lang != "json" and text and len(text) < 20_000:
                toks = _lexed(text, lang)
                out.append(" ".join(text[a:b] for k, a, b in toks if k not in "CSL"))
                out += [s for _, _, w in pieces_of(text, lang) for s in sentences(w) if _QUERY.search(s) or _CODE.search(s)]
    return out


def train(pulls: DataFrame, documents: DataFrame, folder: str = FOLDER) -> np.ndarray:
    return fit(sample_texts(documents), sample_code(pulls), folder)


_OUT = "example_no long, field string, path string, lang string, n_chars long, share double"


def _batch(rows):
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["example_no", "field", "path", "lang", "n_chars", "share"])


def _files(model, folder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(model.value, folder), {}
        for b in batches:
            rows = []
            for no, path, lang, text in zip(*(b.column(c).to_pylist() for c in ("example_no", "path", "lang", "source")), strict=True):
                key = (lang, hash(text), len(text))
                got = known.get(key)
                if got is None:
                    if len(known) > 100_000:
                        known.clear()
                    got = known[key] = reader.source(text, lang)
                rows += [(no, "files", path, k, n, n / len(text)) for k, n in got.items()]
            yield _batch(rows)

    return run


def _diffs(model, folder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(model.value, folder), {}
        for b in batches:
            rows = []
            for no, text in zip(b.column("example_no").to_pylist(), b.column("diff").to_pylist(), strict=True):
                key = (hash(text), len(text))
                got = known.get(key)
                if got is None:
                    if len(known) > 50_000:
                        known.clear()
                    got = known[key] = reader.diff(text)
                rows += [(no, "diff", p, k, n, n / max(1, size)) for p, langs, size in got for k, n in langs.items()]
            yield _batch(rows)

    return run


def prose(pulls: DataFrame, documents: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(example_no, field, path, lang, n_chars, share): languages of the prose in files and diff.

    n_chars are the characters of prose in comments and literals, share is their part of the source (or changed lines).
    """
    model = pulls.sparkSession.sparkContext.broadcast(train(pulls, documents, folder))
    files = sources(pulls, ("files",)).filter("lang != 'json'").select("example_no", "path", "lang", "source")
    diffs = pulls.select("example_no", "diff").filter("diff is not null and diff != ''")
    return files.mapInArrow(_files(model, folder), _OUT).unionByName(diffs.mapInArrow(_diffs(model, folder), _OUT))
