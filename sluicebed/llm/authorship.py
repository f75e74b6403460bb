"""Generated, minified or vendored source files.

Normalized token streams (comments left out, literals reduced to their kind) are fingerprinted by winnowing. A file is a
vendored copy if most of its fingerprints are those of a known library and it holds most of that library, or if most of
its fingerprints recur in many unrelated repositories; a text too short for that is one if its whole token stream recurs
there. Fewer than FAR_GRAM tokens (an import and a logger) are alike by chance and show nothing. Content shows generated, minified and data files, paths show lock
files, vendored folders and outputs of tools. One pass reads the sources; only fingerprints are shuffled.

Cases: null maps, null, empty and blank sources are no cases unless their path is one; null paths give no row; an entry of
files_changed takes the answer of its source in files, and the answer of its path where files does not hold it; repeated
entries of files_changed give one row; without known_library only recurrence counts as copying.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebed.functions.names import repo_name
from sluicebed.functions.lexing import SUFFIXES, tokens
from sluicebed.plans.shared import broadcast_below, join_hot, written

GRAM, WINDOW = 6, 6
IN_LIBRARY, OF_LIBRARY = 0.6, 0.5  # shares of the file and of the library that a copy holds
LIBRARIES = 50_000
MARKS = 2_000_000  # most marks of texts that are broadcast
#: Fingerprints for recurrence span several statements, so that none recurs by chance however large the corpus is.
FAR_GRAM, FAR_WINDOW = 32, 16
OWNERS, RECUR, LEAST = 8, 0.8, 6  # owners that share a fingerprint, share of such fingerprints, fingerprints of a file

# Paths that alone say that nobody wrote the file by hand (Java regular expressions, lower-case paths).
LOCKS = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock", "poetry.lock", "pipfile.lock", "pdm.lock", "uv.lock",
    "cargo.lock", "go.sum", "go.work.sum", "gemfile.lock", "composer.lock", "mix.lock", "pubspec.lock", "podfile.lock", "cartfile.resolved", "package.resolved",
    "packages.lock.json", "flake.lock", "gradle.lockfile", "conan.lock", "paket.lock",
)
FOLDERS = "vendor|third_party|third-party|thirdparty|node_modules|bower_components|jspm_components|godeps|_vendor|external|externals|deps|site-packages|pods|carthage"
TOOLED = (
    r"_pb2(?:_grpc)?\.pyi?$", r"\.pb\.(?:go|cc|h|c|rb|gw\.go)$", r"_pb\.(?:js|ts|d\.ts|rb)$", r"outerclass\.java$", r"\.tab\.[ch]$", r"(?:^|/)lex\.yy\.c$",
    r"\.min\.(?:js|css|mjs)$", r"[-.](?=[0-9a-f]*[0-9])[0-9a-f]{6,}\.(?:js|css|mjs)$", r"\.(?:js|css)\.map$", r"\.bundle\.js$", r"\.g\.dart$",
    r"[._-]generated\.[a-z]+$", r"\.designer\.cs$", r"(?:^|/)dist/[^/]*\.(?:js|css)$",
)
BY_PATH = r"(?:^|/)(?:" + FOLDERS + r")/|(?:^|/)(?:" + "|".join(re.escape(x) for x in LOCKS) + r")$|" + "|".join(TOOLED)

# Words with which a leading comment says that a tool wrote the file, by their part in the sentence, as stems
# in en, de, es, fr, pt, ru, zh and ja.
SUBJECT = (
    "file", "code", "source", "module", "script", "header", "document", "output", "datei", "quelltext", "archivo", "fichero", "código", "fichier", "arquivo", "ficheiro", "файл", "код",
    "文件", "代码", "ファイル", "コード",
)
GENERATED = ("generated", "regenerated", "autogenerated", "auto-generated", "emitted", "generiert", "erzeugt", "generado", "généré", "gerado", "сгенерирован", "生成")
MADE = ("produced", "created", "built", "written", "compiled", "output of", "erstellt", "geschrieben", "creado", "producido", "produit", "créé", "criado", "produzido", "создан", "написан", "作成", "出力", "创建")
TOOL = (
    "automatic", "tool", "generator", "compiler", "build", "regenerate", "machine", "automatisch", "werkzeug", "automátic", "herramienta", "outil", "automatique", "ferramenta",
    "автоматическ", "инструмент", "генератор", "工具", "自动", "自動", "ツール",
)
EDIT = (
    "edit", "modif", "change", "alter", "touch", "änder", "bearbeit", "cambi", "changement", "alter", "mudanç", "редактир", "измен", "прав", "修改", "编辑", "更改", "編集", "変更",
)
NEVER = ("do not", "don't", "never", "must not", "should not", "instead of", "nicht", "kein", "no ", "ne pas", "ne ", "não", "не ", "请勿", "不要", "勿", "ないで", "しない")
LOST = ("lost", "overwritten", "overwrite", "discarded", "wiped", "verloren", "überschrieben", "perder", "perdid", "sobrescri", "perdu", "écras", "потеря", "перезапис", "丢失", "覆盖", "失われ", "上書き")
_LETTER = r"(?<![A-Za-z\u00c0-\u024f\u0400-\u04ff])"  # where a word of an alphabetic script may begin
_part = {
    name: _LETTER + "(?:" + "|".join(re.escape(w) for w in words) + ")"
    for name, words in (("subject", SUBJECT), ("generated", GENERATED), ("made", MADE), ("tool", TOOL), ("edit", EDIT), ("never", NEVER), ("lost", LOST))
}
_near = r"(?:[^.。!?;]|\.(?=\w)){0,60}?"
#: The word alone, as a mark; what follows it is of no importance.
_TAG = re.compile(r"@generated\b|(?:^|[*#/%;-]\s*|-\s)\s*auto-?\s?generated\b(?!\s+\w+\s+(?:are|is|values|ids))", re.I | re.M)
_BEGINS = r"^(?:\W|-\*-[^*]*-\*-)*(?:(?:this|the|der|die|das|el|la|le|o|a|este|esta|ce|cette|этот|此|この)\s*)?"
_GENERATED = re.compile(rf"{_part['subject']}{_near}{_part['generated']}|{_part['generated']}{_near}{_part['subject']}|{_BEGINS}{_part['generated']}", re.I | re.M)
_MADE = re.compile(rf"{_part['subject']}{_near}{_part['made']}|{_BEGINS}{_part['made']}", re.I | re.M)
_BY_TOOL = re.compile(
    rf"{_part['made']}{_near}(?<!\w)(?:by|with|from|using|von|mit|durch|por|con|com|par|avec)\s{_near}{_part['tool']}|{_part['made']}\W+(?:automat|автомат|инструмент)|(?:automati\w+|自动|自動|工具|ツール){_near}{_part['made']}", re.I
)
_TOOLED = re.compile(_part["tool"], re.I)
_BY = re.compile(rf"{_part['generated']}\W+(?:by|with|from|using|von|mit|aus|por|con|par|avec|de)\s+\S+", re.I)
_WARNED = re.compile(rf"{_part['never']}{_near}{_part['edit']}", re.I)
_LOST = re.compile(rf"{_part['edit']}{_near}{_part['lost']}", re.I)


_MARKS_OF_LINE = re.compile(r"^(?:[\s*#;%'|]|//+|--+|<!--|\(\*|\{-|/\*+|::|@?rem\b)+", re.I)


def sentences(comments: str) -> str:
    """Leading comments without their marks; a line that begins in lower case goes on with the line before."""
    out, fresh = [], True
    for line in comments.splitlines():
        s = " ".join(_MARKS_OF_LINE.sub("", line).split())
        if s:
            out.append(("\n" if fresh or not s[0].islower() else " ") + s)
        fresh = not s
    return "".join(out)


def stamped(head: str) -> bool:
    """True if leading comments say that a tool wrote the file: a mark; that the file was generated, by something or with a
    warning against edits; that it was made by a tool, or made with such a warning; or that a tool's next run undoes edits."""
    if _TAG.search(head):
        return True
    lost = _LOST.search(head) is not None
    if lost and _TOOLED.search(head):
        return True
    warned = lost or _WARNED.search(head) is not None
    if _GENERATED.search(head) and (warned or _TOOLED.search(head) or _BY.search(head)):
        return True
    return _MADE.search(head) is not None and (warned or _BY_TOOL.search(head) is not None)


#: Comments (and prologues) before the first line of another kind, for suffixes without a lexer; in prose "#" is a heading.
_LEADING = re.compile(
    r"\ufeff?(?:\s+|<\?xml[^>]*>|<!doctype[^>]*>|@charset[^;\n]*;|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\(\*[\s\S]*?\*\)|\{-[\s\S]*?-\}|(?://|--|::|[#;%']|@?rem\b)[^\n]*)*", re.I
)
_LEADING_PROSE = re.compile(r"\ufeff?(?:\s+|<!--[\s\S]*?-->|\[//\]:[ \t]*#[^\n]*|\.\.[ \t][^\n]*)*")
PROSE = (".md", ".markdown", ".mdx", ".rst", ".txt", ".adoc")
_WORDS = re.compile(r"\w+|[^\w\s]")
_hash_of: dict[str, int] = {}


def _token_hashes(text: str, lang: str | None) -> tuple[list[int], list[tuple[str, int, int]]]:
    """Hashes of the normalized tokens, and all tokens."""
    if lang is None or lang == "json":
        toks = [("W", m.start(), m.end()) for m in _WORDS.finditer(text)]
    else:
        toks = tokens(text, lang)
    if len(_hash_of) > 300_000:
        _hash_of.clear()
    out, known = [], _hash_of
    for kind, a, b in toks:
        if kind == "C" or kind == "L":
            continue
        t = kind if kind == "S" or kind == "N" else text[a:b]
        h = known.get(t)
        if h is None:
            h = known[t] = zlib.crc32(t.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFF
        out.append(h)
    return out, toks


def winnow(hashes: list[int], gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """The distinct fingerprints: the smallest hash of every window of token grams."""
    h = np.array(hashes, np.uint64)
    if len(h) < gram:
        return np.array([], np.int64)
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(0x100000001B3) + h[j : len(h) - gram + 1 + j]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    if len(grams) > window:
        grams = np.lib.stride_tricks.sliding_window_view(grams, window).min(axis=1)
    return np.unique(grams).view(np.int64)


def far_prints(hashes: list[int]) -> np.ndarray:
    """Fingerprints for recurrence; of a text with fewer than LEAST of them one hash of its whole token stream instead."""
    found = winnow(hashes, FAR_GRAM, FAR_WINDOW)
    if len(hashes) < FAR_GRAM or len(found) >= LEAST:
        return found
    return np.frombuffer(hashlib.blake2b(np.array(hashes, np.uint64).tobytes(), digest_size=8).digest(), np.int64)


def content_kind(text: str, lang: str | None, toks: list[tuple[str, int, int]], prose: bool = False) -> str | None:
    """generated, minified or data, if the text shows it; the stamp of a tool may stand anywhere in the leading comments."""
    if lang in (None, "json"):
        head = (_LEADING_PROSE if prose else _LEADING).match(text)[0]
    else:
        comments = []
        for kind, a, b in toks:
            if kind == "C":
                comments.append(text[a:b])
            elif kind not in "LHD" and not (kind == "W" and lang in ("go", "java") and text[a:b] == "package"):
                break
        head = "\n".join(comments)
    if stamped(sentences(head)):
        return "generated"
    code = words = values = n_lines = packed = 0
    for kind, a, b in toks:
        if kind == "L":
            n_lines += 1
        elif kind != "C":
            n = b - a
            if kind == "W":
                words += 1
            elif kind == "N":
                values += 1
            elif kind == "S":
                values += 1
                if n >= 200 and not re.search(r"\s", text[a + 1 : b - 1]):
                    packed += n
                n = min(n, 12)
            code += n
    n_lines = 1 + (n_lines if lang not in (None, "json") else text.count("\n"))
    if code > 400 and code / n_lines > 110 and lang != "json":
        return "data" if values > 0.7 * max(1, words + values) else "minified"
    if lang in (None, "json"):
        return None
    if packed > 0.6 * len(text):
        return "data"
    if values >= 40 and values > 0.7 * (words + values):
        return "data"
    shapes: dict[str, int] = {}
    for line in text.split("\n"):
        s = re.sub(r"\d+", "0", line.strip())
        if len(s) > 3:
            shapes[s] = shapes.get(s, 0) + 1
    total = sum(shapes.values())
    top = sum(sorted(shapes.values(), reverse=True)[:4])
    if total >= 6 and top >= 0.7 * total and max(shapes.values()) >= 4:
        return "generated"
    if total >= 6:  # one record after another, told apart by names and numbers only
        bare: dict[str, int] = {}
        for s, n in shapes.items():
            k = re.sub(r"\w*0\w*", "0", s)
            bare[k] = bare.get(k, 0) + n
        most = sorted(bare.values(), reverse=True)
        if sum(most[:3]) >= 0.75 * total and most[0] >= 5 and len(bare) <= max(4, total // 4):
            return "generated" if values < words else "data"
    return None


def library_prints(libraries: DataFrame) -> dict[int, np.ndarray]:
    """lib_id -> fingerprints; a fixed table of at most LIBRARIES published sources, read once on the driver."""
    out = {}
    rows = libraries.select("lib_id", "path", "source").limit(LIBRARIES + 1).collect()
    if len(rows) > LIBRARIES:
        raise ValueError(f"known_library has more than {LIBRARIES} rows; its prints are broadcast")
    for r in rows:
        if r[2]:
            out[r[0]] = winnow(_token_hashes(r[2], SUFFIXES.get((r[1] or "")[(r[1] or "").rfind(".") :]))[0])
    return {k: v for k, v in out.items() if len(v)}


def _is_copy(prints: np.ndarray, owner_of: dict[int, list[int]], sizes: dict[int, int]) -> bool:
    hits: dict[int, int] = {}
    for p in prints.tolist():
        for lib in owner_of.get(p, ()):
            hits[lib] = hits.get(lib, 0) + 1
    return any(n >= OF_LIBRARY * sizes[lib] and n >= IN_LIBRARY * len(prints) for lib, n in hits.items())


_READ = "example_no long, field string, path string, named boolean, kind string, mark binary, prints array<long>, owner string"


def _reader(libs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner_of, sizes = libs.value
        known: dict[bytes, tuple] = {}
        told: set[tuple] = set()
        for b in batches:
            kinds, prints, owners = [], [], []
            for path, text, owner, mark in zip(*(b.column(c).to_pylist() for c in ("path", "source", "owner", "mark")), strict=True):
                if mark is None:
                    kinds.append(None)
                    prints.append(None)
                    owners.append(None)
                    continue
                got = known.get(mark)
                if got is None:
                    if len(known) > 50_000:
                        known.clear()
                        told.clear()
                    lang = SUFFIXES.get(path[path.rfind(".") :] if "." in path else "")
                    hashes, toks = _token_hashes(text, lang)
                    kind = "copy" if _is_copy(winnow(hashes), owner_of, sizes) else content_kind(text, lang, toks, path.lower().endswith(PROSE))
                    found = far_prints(hashes)
                    got = known[mark] = (kind, found if len(found) else None)
                kinds.append(got[0])
                new = got[1] is not None and (mark, owner) not in told
                if new:
                    told.add((mark, owner))
                prints.append(got[1] if new else None)
                owners.append(owner if new else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("example_no"), b.column("field"), b.column("path"), b.column("named"), pa.array(kinds, pa.string()), b.column("mark"), pa.array(prints, pa.list_(pa.int64())), pa.array(owners, pa.string())],
                ["example_no", "field", "path", "named", "kind", "mark", "prints", "owner"],
            )

    return run


def sources(pulls: DataFrame) -> DataFrame:
    """(example_no, field, path, source, owner, named, mark) of the files of both maps.

    named: the path alone makes it a case. mark: 128 bits of the text and the suffix in which it is read, null without a text.
    """
    owned = pulls.withColumn("owner", F.split_part(repo_name(F.col("repo")), F.lit("/"), F.lit(1)))
    parts = [
        owned.select("example_no", F.lit(f).alias("field"), "owner", F.explode(f).alias("path", "source"))
        for f in ("files", "repository_files")
    ]
    suffix = F.regexp_extract(F.col("path"), r"(\.[^.]*)$", 1)
    has_text = F.col("source").rlike(r"\S")
    return parts[0].unionByName(parts[1]).filter("path is not null").withColumns(
        {"named": F.lower("path").rlike(BY_PATH), "mark": F.when(has_text, F.unhex(F.md5(F.concat(suffix, F.lit("\n"), F.col("source")))))}
    )


def read_files(pulls: DataFrame, libraries: DataFrame) -> DataFrame:
    """(example_no, field, path, named, kind, mark, prints, owner): what the sources and paths of both maps show by themselves.

    prints are the fingerprints of a text, once per task and owner. Every text is fingerprinted, also those that their path or
    content makes a case, as their owners count for the copies that stand elsewhere.
    """
    prints = library_prints(libraries)
    owner_of: dict[int, list[int]] = {}
    for lib, p in prints.items():
        for x in p.tolist():
            owner_of.setdefault(x, []).append(lib)
    shared = pulls.sparkSession.sparkContext.broadcast((owner_of, {k: len(v) for k, v in prints.items()}))
    return sources(pulls).select("example_no", "field", "path", "source", "owner", "named", "mark").mapInArrow(_reader(shared), _READ)


def recurring(files: DataFrame, owners: int = OWNERS, share: float = RECUR) -> DataFrame:
    """(mark): texts most of whose fingerprints recur under many owners."""
    printed = files.filter("prints is not null").select("mark", "owner", "prints")
    spread = (
        printed.filter("owner is not null")
        .select("owner", F.explode("prints").alias("print"))
        .distinct()
        .groupBy("print")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= owners)
        .select("print")
    )
    texts = printed.groupBy("mark").agg(F.first("prints").alias("prints"))
    total = printed.agg(F.sum(F.size("prints"))).first()[0] or 0
    each = texts.select("mark", F.size("prints").alias("size"), F.explode("prints").alias("print"))
    return (
        join_hot(each, written(spread), "print", total)
        .groupBy("mark", "size")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= F.col("size") * share)
        .select("mark")
    )


def _judged(pulls: DataFrame, libraries: DataFrame) -> DataFrame:
    """(example_no, field, path, mark, kind) of the cases in files and repository_files.

    kind is the strongest evidence: copy (of a known library), recurring, then what the content shows, then path.
    """
    files = written(read_files(pulls, libraries))
    copied = written(recurring(files)).withColumn("copied", F.lit(True))
    rows = files.drop("prints", "owner").join(broadcast_below(copied, MARKS), "mark", "left")
    kind = F.coalesce(F.when(F.col("kind") == "copy", F.col("kind")), F.when(F.col("copied"), F.lit("recurring")), F.col("kind"), F.when(F.col("named"), F.lit("path")))
    return rows.withColumn("kind", kind).filter("kind is not null").select("example_no", "field", "path", "mark", "kind")


def not_by_hand(pulls: DataFrame, libraries: DataFrame) -> DataFrame:
    """(example_no, field, path, kind) of the files nobody wrote by hand, in files, repository_files and files_changed."""
    cases = written(_judged(pulls, libraries).drop("mark"))
    listed = pulls.select(
        "example_no", F.explode(F.array_distinct("files_changed")).alias("path"), F.coalesce(F.map_keys("files"), F.array().cast("array<string>")).alias("held")
    ).filter("path is not null")
    absent = listed.filter(~F.array_contains("held", F.col("path")) & F.lower("path").rlike(BY_PATH)).select(
        "example_no", F.lit("files_changed").alias("field"), "path", F.lit("path").alias("kind")
    )
    present = (
        listed.filter(F.array_contains("held", F.col("path")))
        .select("example_no", "path")
        .join(cases.filter("field = 'files'").select("example_no", "path", "kind"), ["example_no", "path"])
        .select("example_no", F.lit("files_changed").alias("field"), "path", "kind")
    )
    return cases.unionByName(present).unionByName(absent)


def hand_written(pulls: DataFrame, libraries: DataFrame) -> DataFrame:
    """(example_no, field, path, source) of files and repository_files that remain.

    The second scan only needs the marks of the texts that are cases: they are broadcast while there are at most MARKS of
    them (48 MB), so no source is shuffled; beyond that the join by mark is the planner's.
    """
    marks = written(_judged(pulls, libraries).filter("kind != 'path' and mark is not null").select("mark").distinct())
    kept = sources(pulls).filter(~F.col("named"))
    return kept.join(broadcast_below(marks, MARKS), "mark", "left_anti").select("example_no", "field", "path", "source")
