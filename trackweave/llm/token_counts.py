"""Token counts: the lengths, and only the lengths, that a public tokenizer gives for whole texts.

Runs as an Arrow function. Each text is cut at safe boundaries, every distinct piece is encoded
by the library once, in batches balanced by bytes, and its length is remembered in a bounded
memory; a text's count is the sum over its pieces.

A boundary is safe between a character that is no white space and an ASCII white-space
character: no alternative of the byte-level splitting pattern joins such a pair, the pattern looks
ahead within white space only and never back, and no added token holds white space. Behind
white space outside ASCII, and characters that only some count as white space, there is no boundary.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated rows, an empty table an empty one. Ids don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cache, tidy, with_fields

#: One encode_batch call gets about this many bytes.
BATCH_BYTES = 1 << 20
#: Texts that are Python objects at a time.
ROWS = 512
#: During a task, one to two times so many bytes of distinct pieces are remembered, those used last. Longer pieces aren't kept.
MEMORY, KEPT_CHARS, ENTRY_BYTES = 12 << 20, 64, 120

_PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space of Unicode outside ASCII, and ASCII separators that Python alone counts as white space.
_ODD_CHARS = "\x1c-\x1f\x85\xa0 ᠎ -​    　﻿"
_ODD = re.compile(f"[{_ODD_CHARS}]")
_ODD_PIECE = re.compile(rf"[ \t-\r{_ODD_CHARS}]*(?:[^ \t-\r{_ODD_CHARS}]+(?:[{_ODD_CHARS}][ \t-\r{_ODD_CHARS}]*)?)+|[ \t-\r{_ODD_CHARS}]+")
_OUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

_counters: dict[str, "PieceCounter"] = cache()


def pieces(text: str) -> list[str]:
    """The text cut at its safe boundaries; joined, they are the text."""
    return (_ODD_PIECE if _ODD.search(text) else _PIECE).findall(text)


def _n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class PieceCounter:
    """Token counts by one tokenizer file; one for each Python worker."""

    def __init__(self, path: str, memory: int = MEMORY, batch_bytes: int = BATCH_BYTES):
        self.memory, self.batch_bytes = memory, batch_bytes
        self.forget()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cut = lambda text: [text]  # its normaliser looks across white space
            self.encode = lambda batch: [len(ids) for ids in model.encode(batch, num_threads=1)]
        else:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            byte_level = type(model.pre_tokenizer).__name__ == "ByteLevel" and model.normalizer is None
            self.cut = pieces if byte_level else lambda text: [text]
            self.encode = lambda batch: [len(e) for e in model.encode_batch_fast(batch, add_special_tokens=False)]

    def forget(self) -> None:
        """Frees what was remembered; at the end of a task, since workers live on."""
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.held = 0

    def learn(self, new: list[str]) -> dict[str, int]:
        """Encodes ``new`` in batches of about the same number of bytes."""
        out, batch, size = {}, [], 0
        for i, piece in enumerate(new):
            batch.append(piece)
            size += _n_bytes(piece)
            if size >= self.batch_bytes or i == len(new) - 1:
                out.update(zip(batch, self.encode(batch), strict=True))
                batch, size = [], 0
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Counts of some texts, taken a few megabytes at a time."""
        out, group, size = [], [], 0
        for i, text in enumerate(texts):
            group.append(self.cut(text))
            size += _n_bytes(text)
            if size >= 4 * self.batch_bytes or i == len(texts) - 1:
                out += self._group(group)
                group, size = [], 0
        return out

    def _group(self, group: list[list[str]]) -> list[int]:
        if self.held > self.memory:
            self.known, self.older, self.held = {}, self.known, 0
        new = set().union(*group).difference(self.known)
        self.known.update((k, self.older[k]) for k in new & self.older.keys())
        found = self.learn(list(new - self.older.keys()))
        short = {k: v for k, v in found.items() if len(k) <= KEPT_CHARS}
        self.known.update(short)
        self.held += sum(map(len, short)) + ENTRY_BYTES * len(short)
        if len(short) == len(found):
            get = self.known.__getitem__
        else:
            known = self.known
            get = lambda k: known[k] if k in known else found[k]
        return [sum(map(get, parts)) for parts in group]


def count_tokens(text: Column, path: str) -> Column:
    """A struct (n_bytes, n_tokens) for the column ``text``, by the tokenizer file at ``path``."""

    @F.arrow_udf(_OUT)
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counters.get(path) or _counters.setdefault(path, PieceCounter(path))
        for batch in batches:
            sizes, counts = [], []
            for begin in range(0, len(batch), ROWS):
                texts = [x or "" for x in batch.slice(begin, ROWS).to_pylist()]
                sizes += map(_n_bytes, texts)
                counts += counter.count(texts)
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["n_bytes", "n_tokens"])
        counter.forget()
        tidy(_counters)

    return lengths(text)


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit), which replace columns of those names."""
    out = with_fields(docs, count_tokens(docs[f"`{text}`"], path), ["n_bytes", "n_tokens"])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
