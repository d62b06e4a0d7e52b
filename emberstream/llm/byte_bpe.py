"""Byte-level BPE encoding and decoding with a local rank file, over whole texts.

The rank file is read once on the driver and sent to the executors (a vocabulary, about 1 MB,
its size does not depend on the data). Long texts are cut only at safe boundaries: a blank with
a visible character on both sides always starts a new match of the pattern, so the ids of the
parts, joined, are those of the whole. A stretch without such a blank goes to the library whole. Only
white space of more than ``WHITE`` characters in a row is taken apart first, as the library's engine
fails on a million: such a run is one match, but for its last character if something visible follows,
with which the next match begins. What white space is has not changed between versions of Unicode.

Defined results: a null text counts as empty and has no ids; decoding gives the bytes of the
text, whether or not they are valid UTF-8 at the cuts; repeated rows are encoded each; an empty
table gives no rows; columns of the results' names (in any case) are replaced by them, others stay (``digests``
returns its own only).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import bounded_batches, column

#: Characters up to which a stretch is handed over in one call.
STRETCH = 4096
#: Python's white space is a superset of the pattern's, so what is visible here is visible there.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space up to which the library's own engine is asked to find the matches.
WHITE = 100_000
_WHITE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CODECS: dict[tuple[bytes, str], ByteBPE] = {}


def read_ranks(path: str) -> bytes:
    """The content of a rank file: base64 token and rank on each line."""
    return Path(path).read_bytes()


class ByteBPE:
    def __init__(self, ranks: bytes, pattern: str):
        self._ranks = ranks
        self._encoding = self._library("ranks", pattern)
        self._run = re.compile(_WHITE + "{%d,}" % (WHITE + 1))

    def _library(self, name: str, pattern: str):
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in self._ranks.splitlines() if line)}
        return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @cached_property
    def _one(self):
        """Takes all that it gets as one match. Made when first needed: workers hold each engine's tables."""
        return self._library("one match", "(?s).+")

    @staticmethod
    def stretches(text: str) -> Iterator[str]:
        """Cut at the last safe boundary before every ``STRETCH`` characters, or the next after."""
        start = 0
        while len(text) - start > STRETCH:
            cut, at = 0, start + STRETCH
            for width in (64, 1024, STRETCH):
                found = [m.start() for m in _SAFE.finditer(text, max(start + 1, at - width), at + 1)]
                if found:
                    cut = found[-1]
                    break
            if not cut:
                later = _SAFE.search(text, at)
                if later is None:
                    break
                cut = later.start()
            yield text[start:cut]
            start = cut
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= STRETCH:
            return self._encoding.encode_ordinary(text)
        ids: list[int] = []
        start = 0
        for run in self._run.finditer(text) if len(text) > WHITE else ():
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self._parts(text[start : run.start()]) + self._one.encode_ordinary(text[run.start() : end])
            start = end
        return ids + self._parts(text[start:])

    def _parts(self, text: str) -> list[int]:
        return [i for part in self.stretches(text) for i in self._encoding.encode_ordinary(part)]

    def decode(self, ids) -> bytes:
        return self._encoding.decode_bytes(ids)


def _codec(ranks: bytes, pattern: str) -> ByteBPE:
    key = (ranks, pattern)
    if key not in _CODECS:
        _CODECS[key] = ByteBPE(ranks, pattern)
    return _CODECS[key]


def _with_columns(df: DataFrame, source: str, makers: dict, without: tuple = ()) -> DataFrame:
    """Adds BINARY columns, each made by its function from the one before (the first from
    ``source``), over Arrow batches of bounded size, row by row; ``without`` are not returned."""
    bounded_batches(df.sparkSession)
    gone = {name.lower() for name in (*makers, *without)}
    kept = [c for c in df.columns if c.lower() not in gone]
    places = [df.columns.index(c) for c in kept]
    source_at = df.columns.index(source)

    def run(batches):
        for batch in batches:
            made, values = [], (v.as_py() for v in batch.column(source_at))
            for make in makers.values():
                made.append(pa.array([make(v) for v in values], pa.binary()))
                values = (v.as_py() for v in made[-1])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in places] + made, names=[*kept, *makers])
            made, values = None, None
            pa.default_memory_pool().release_unused()  # else a worker keeps what arrays grew through

    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.BinaryType()) for name in makers])
    return df.mapInArrow(run, schema)


def _encoder(ranks, pattern: str):
    return lambda text: np.array(_codec(ranks.value, pattern).encode(text or ""), "<u4").tobytes()


def _decoder(ranks, pattern: str):
    return lambda ids: _codec(ranks.value, pattern).decode(np.frombuffer(ids or b"", "<u4").tolist())


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col``: the ids as little-endian unsigned 32-bit integers."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return _with_columns(df, text_col, {ids_col: _encoder(ranks, pattern)})


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds ``bytes_col``: the bytes that the ids stand for."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return _with_columns(df, ids_col, {bytes_col: _decoder(ranks, pattern)})


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded", without: tuple = ()) -> DataFrame:
    """Adds both columns in one pass: the ids, and the bytes that these ids stand for."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return _with_columns(df, text_col, {ids_col: _encoder(ranks, pattern), bytes_col: _decoder(ranks, pattern)}, without)


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids and digest both: id, n_tokens, ids_sha256, decoded_sha256."""
    back = encode_decode(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), ranks_path, pattern, without=("text",))
    return back.select(F.col("id").alias(id_col), F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
