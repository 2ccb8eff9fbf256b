"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import itertools
import string
import struct
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of all rows that no model may learn from; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: Bytes of texts that a slice holds, unless its first text alone is longer.
SLICE_BYTES = 1 << 21


def slices(batches, rows: int, text: int | None = None):
    """The batches again, in slices of at most ``rows`` rows: bounds what a task holds at once.

    With ``text``, the number of a column of texts, a slice also ends where their bytes add up to ``SLICE_BYTES``.
    """
    for batch in batches:
        ends = None
        if text is not None and batch.num_rows:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            n = rows
            if ends is not None:
                before = ends[at - 1] if at else 0
                n = min(rows, max(1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")) - at))
            yield batch.slice(at, n)
            at += n


def strings(column: pa.Array) -> list[str]:
    """Texts of a batch, null as empty."""
    return [x or "" for x in column.to_pylist()]


#: Pieces up to this length are kept with their ids.
KEPT_PIECE = 48


class OddSpace(Exception):
    """White space that a cut at single spaces can't tell apart."""


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for the letters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in visible]
    return {x: chr(x) for x in visible} | {x: chr(256 + k) for k, x in enumerate(hidden)}


_LETTERS = byte_letters()


class PieceIds(dict):
    """Ids of text pieces, each behind ``prefix``, as little-endian 32-bit bytes.

    Two generations of at most ``limit`` pieces: a full one becomes the old one, and
    pieces that are met again come over from there.
    """

    def __init__(self, tokenizer, limit: int, prefix: str = "", plain: PieceIds | None = None):
        super().__init__()
        self.tokenizer, self.limit, self.prefix, self.old = tokenizer, limit, prefix, {}
        self.plain = self if plain is None else plain
        self.model, self.normal = tokenizer.model, tokenizer.normalizer is not None

    def __missing__(self, piece: str) -> bytes:
        if self.prefix and (not piece or piece[0].isspace() or piece[-1].isspace()):
            raise OddSpace
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= KEPT_PIECE:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, piece: str) -> bytes:
        # the vocabularies cut between a letter and a run of marks, and around a single line break
        body = piece.rstrip(string.punctuation)
        if len(body) < len(piece) and body.lstrip(" ").isalpha():
            return self[body] + self.plain[piece[len(body) :]]
        head, line, tail = piece.partition("\n")
        if line and head and tail and "\n" not in tail and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self.plain[line] + self.plain[tail]
        word = self.word(piece)
        if word is not None:
            return ids_bytes([x.id for x in self.model.tokenize(word)])
        return ids_bytes(self.tokenizer.encode(self.prefix + piece, add_special_tokens=False).ids)

    def word(self, piece: str) -> str | None:
        """A piece that is one word of common letters, as the model's input: such a word needs no further cut."""
        if not piece.isalpha() or max(piece) >= "\u0370":
            return None
        if self.normal:
            piece = unicodedata.normalize("NFC", piece).lower()
            if not piece.isalpha() or max(piece) >= "\u0370":
                return None
        return (self.prefix + piece).encode().decode("latin-1").translate(_LETTERS)


def ids_bytes(ids) -> bytes:
    return np.array(ids, "<u4").tobytes() if len(ids) > 64 else struct.pack(f"<{len(ids)}I", *ids)


class TextEncoder:
    """A tokenizer of the ``tokenizers`` library that encodes each distinct piece of text once.

    Both public BPE vocabularies cut a text at white space before any merge, so
    the ids of a text are those of its pieces one after the other. Where spaces are kept
    (``keeps_space``), a single space belongs to the piece behind it; texts with other runs
    of white space are cut by a pattern. A text with one of the marks below is
    encoded whole: special tokens, and control characters that Python takes for white
    space and the tokenizers don't.
    """

    WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str, keeps_space: bool, limit: int = 350_000):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = PieceIds(self.tokenizer, limit)
        self.spaced = PieceIds(self.tokenizer, limit, " ", self.plain) if keeps_space else None
        self.runs = re.compile(r"\s*\S+|\s+").findall

    def __call__(self, text: str) -> bytes:
        for mark in self.WHOLE:
            if mark in text:
                return ids_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.spaced is None:
            return b"".join(map(self.plain.__getitem__, text.split()))
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return (self.plain[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))
        except OddSpace:
            return b"".join(map(self.plain.__getitem__, self.runs(text)))


_kept: dict = {}


def release() -> None:
    """Lets go what ``kept`` holds, and hands free memory back to the system.

    Python workers go from one operator's tasks to the next one's, and would otherwise hold the caches of all.
    """
    if _kept:
        _kept.clear()
        gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def kept(name, make):
    """What ``make`` gives, once a Python worker: kept between its tasks until one keeps or releases something else."""
    if name not in _kept:
        release()
        _kept[name] = make()
    return _kept[name]


def encoder(path: str, keeps_space: bool) -> TextEncoder:
    """One encoder a Python worker, kept between the tasks of one operator."""
    return kept((path, keeps_space), lambda: TextEncoder(path, keeps_space))


class Words(dict):
    """A number for each distinct word, in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def numbered(texts_words: list[list]) -> tuple[list, list[int]]:
    """Distinct words of some texts, and the number of each word in turn."""
    words = Words()
    numbers = list(map(words.__getitem__, itertools.chain.from_iterable(texts_words)))
    return list(words), numbers
