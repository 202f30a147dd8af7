"""Operator 10: byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text longer than ``piece_chars`` is cut before the library sees it, only where no match of the split pattern
can cross: before a single space that stands between two characters that are no white space. The pattern takes a
space only as the first character of a match or inside a run of white space, so the ids equal those of the whole
text. A text without such a place is encoded in one piece.

The rank file is read where the query is planned and broadcast (it is a file of about a megabyte); executors need no copy.

Null and empty texts have no ids. Rows are independent: repeated rows and ids repeat their results; columns other
than the id and the text are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._spark import ship

PIECE_CHARS = 1 << 16
_CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def encoder(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    return encoding(read_ranks(rank_path), pattern)


def read_ranks(rank_path: str) -> bytes:
    with open(rank_path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    """The tiktoken encoding of the lines of a rank file."""
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


@functools.lru_cache(maxsize=4)
def _digits(ranks: bytes, pattern: str) -> list[str]:
    return [str(i) for i in range(encoding(ranks, pattern).n_vocab)]


def cut(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of about size characters that join to text, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size - 1)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode_text(text: str | None, enc, piece_chars: int = PIECE_CHARS) -> list[int]:
    """The ids of a text, by an encoding."""
    if not text:
        return []
    if len(text) <= piece_chars:
        return enc.encode_ordinary(text)
    return [i for p in cut(text, piece_chars) for i in enc.encode_ordinary(p)]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per document: its id, n_tokens, and its ids as little-endian 32-bit integers."""
    ranks = ship(docs.sparkSession).sparkContext.broadcast(read_ranks(rank_path))

    def run(batches):
        enc = encoding(ranks.value, pattern)
        for b in batches:
            ids = [encode_text(t, enc, piece_chars) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """The raw bytes of each row's ids."""
    ranks = ship(encoded.sparkSession).sparkContext.broadcast(read_ranks(rank_path))

    def run(batches):
        enc = encoding(ranks.value, pattern)
        for b in batches:
            out = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Encode, then decode, each text in one pass; the digests of the ids and of the decoded bytes."""
    ranks = ship(docs.sparkSession).sparkContext.broadcast(read_ranks(rank_path))

    def run(batches):
        enc, digits = encoding(ranks.value, pattern), _digits(ranks.value, pattern)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1):
                ids = encode_text(t.as_py(), enc, piece_chars)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
                d.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
