"""Encoding of the whole corpus with a public tokenizer.

Texts are split into pre-tokens; each Arrow batch of texts is folded to its distinct pre-tokens and, for every text, the
sequence of their numbers, which keeps the positions. Only the distinct pre-tokens are shuffled by pre-token: where one
lands it is encoded once, and its ids are joined back to every batch that holds it. A second shuffle brings ids and
sequences of a batch together, and each text's ids are put in order. A pre-token has one row per batch however often it
stands there, so " the" fills no task, and what is shuffled is near the size of the compressed texts.

Cases: null and empty texts give the empty list; strings that look like special tokens are ordinary text; every row gives
one row, repeated ones too; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebed.plans.shared import written

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: The public split pattern of this tokenizer's kind (fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_cache: dict[str, object] = {}


def encoder(folder: str = FOLDER, name: str = NAME):
    """tiktoken encoding of the vocabulary file; one per process."""
    import tiktoken

    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _cache:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _cache[path] = tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _cache[path]


def token_bytes(spark, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(token_id, bytes): the token-byte table used for decoding."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        rows = [(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, f)]
    return spark.createDataFrame(rows, "token_id int, bytes binary")


def pretokens(text: str) -> list[str]:
    import regex

    if "split" not in _cache:
        _cache["split"] = regex.compile(SPLIT)
    return _cache["split"].findall(text)


_ROWS = "batch long, kind int, no long, word string, seq array<int>"
_FOLDED = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("no", pa.int64()), ("word", pa.string()), ("seq", pa.list_(pa.int32()))])
_PARTS = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("no", pa.int64()), ("seq", pa.list_(pa.int32()))])
WORD, TEXT = 0, 1


def _lists(values, starts):
    return pa.ListArray.from_arrays(pa.array(np.asarray(starts, np.int32), pa.int32()), pa.array(values, pa.int32()))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the rows of a batch: (batch, WORD, number, pre-token, -) and (batch, TEXT, doc_id, -, numbers)."""
    part = TaskContext.get().partitionId() << 32
    for k, b in enumerate(batches):
        words: dict[str, int] = {}
        numbers: list[int] = []
        starts = [0]
        for text in b.column("text").to_pylist():
            if text:
                numbers.extend([words.setdefault(w, len(words)) for w in pretokens(text)])
            starts.append(len(numbers))
        n, m = b.num_rows, len(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part + k] * m, pa.int64()), pa.array([WORD] * m, pa.int32()), pa.array(range(m), pa.int64()), pa.array(words, pa.string()), pa.nulls(m, pa.list_(pa.int32()))],
            schema=_FOLDED,
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([part + k] * n, pa.int64()), pa.array([TEXT] * n, pa.int32()), b.column("doc_id"), pa.nulls(n, pa.string()), _lists(np.array(numbers, np.int32), starts)],
            schema=_FOLDED,
        )


def _encode(folder: str, name: str):
    """(batch, no, word) of one share of the pre-tokens to (batch, WORD, no, ids); each is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(folder, name).encode_ordinary
        last, ids = None, []
        for b in batches:
            got = []
            for w in b.column("word").to_pylist():
                if w != last:
                    last, ids = w, one(w)
                got.append(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column("batch"), pa.array([WORD] * len(got), pa.int32()), b.column("no"), pa.array(got, pa.list_(pa.int32()))], schema=_PARTS
            )

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (batch, kind) to (doc_id, ids); a batch may go on in the next record batch."""
    current, held = None, []
    start = size = flat = None

    def close():
        """The ids of the current batch's pre-tokens by number."""
        no = np.concatenate([h[0] for h in held]) if held else np.array([], np.int64)
        lens = np.concatenate([h[1] for h in held]) if held else np.array([], np.int64)
        ids = np.concatenate([h[2] for h in held]) if held else np.array([], np.int32)
        at = np.zeros(len(no), np.int64)
        count = np.zeros(len(no), np.int64)
        at[no], count[no] = np.cumsum(lens) - lens, lens
        return at, count, ids

    for b in batches:
        keys = b.column("batch").to_numpy() * 2 + b.column("kind").to_numpy()
        lists = b.column("seq")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        edges = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)] if len(keys) else []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            batch, kind = divmod(int(keys[i]), 2)
            if batch != current:
                current, held, flat = batch, [], None
            seq, off = values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if kind == WORD:
                held.append((b.column("no").slice(i, j - i).to_numpy(), np.diff(off), seq))
                continue
            if flat is None:
                start, size, flat = close()
            n = size[seq]
            ends = np.cumsum(n)
            take = np.repeat(start[seq] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            yield pa.RecordBatch.from_arrays([b.column("no").slice(i, j - i), _lists(flat[take], np.r_[0, ends][off])], ["doc_id", "ids"])


def encoded(documents: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(doc_id, ids) of documents(doc_id, text); see the head of this module for the cases."""
    folded = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fold, _ROWS))
    words = folded.filter(F.col("kind") == WORD).select("batch", "no", "word")
    ids = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encode(folder, name), "batch long, kind int, no long, seq array<int>")
    texts = folded.filter(F.col("kind") == TEXT).select("batch", "kind", "no", "seq")
    together = ids.unionByName(texts).repartition("batch").sortWithinPartitions("batch", "kind")
    return together.mapInArrow(_assemble, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(doc_id, text) of encoded rows, by a join with the token-byte table (50,256 rows at most, so it is broadcast)."""
    table = F.broadcast(token_bytes(ids.sparkSession, folder, name))
    flat = ids.select("doc_id", F.posexplode_outer("ids").alias("pos", "token_id")).join(table, "token_id", "left")
    joined = flat.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("p"))
    return joined.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: F.coalesce(x["h"], F.lit(""))), "")), "UTF-8").alias("text"))
