"""Byte-level BPE encoding and decoding by a rank file, exact to the merges, in linear time.

The vocabulary stands in a pyahocorasick automaton, bytes mapped to Latin-1 characters. One scan
finds the longest tokens of a word, one after the other. A token may follow another only if the pair is
compatible, that is, if merging the joined bytes would leave the border between the two alone. From the first pair
that isn't, the encoder walks on from place to place, looking for the longest token at each. Where no compatible token fits, it steps back
and marks the place as dead, so every place is tried once. Compatibility of adjacent tokens is memoised.

Words are the matches of the splitting pattern. A text is first cut before ASCII white space that
follows other characters, where the pattern always splits too, and the ids of short pieces are
remembered in a bounded memory. Null and empty texts have no ids. Any text survives the round
trip; decoding is done from the ids alone. Repeated rows give repeated rows, an empty table an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cache, tidy, with_fields
from .token_counts import pieces

#: During a task, the ids of short pieces are remembered in one to two times MEMORY bytes, those used last; the fit of PAIRS pairs of tokens at most, as long as the vocabulary.
MEMORY, PAIRS, KEPT_CHARS = 48 << 20, 250_000, 64
#: About what an entry takes beside its characters.
ENTRY_BYTES = 200

_coders: dict[tuple[str, str], "ByteBpe"] = cache()


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.words = ranks, regex.compile(pattern)
        self.vocabulary = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.most = max(self.sizes.values(), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self._split_all()
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank in self.halves:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.tokens = pa.array([self.vocabulary.get(rank) for rank in range(max(self.vocabulary, default=-1) + 1)], pa.large_binary())
        self.fits: dict[int, bool] = {}  # by both ranks, each of 32 bits
        self.shorter: dict[int, int] = {}
        self.forget()

    def forget(self) -> None:
        """Frees what was remembered of texts; at the end of a task, since workers live on. Pairs of tokens that fit are kept."""
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= KEPT_CHARS:
            self.held += ENTRY_BYTES + len(piece) + len(ids)
            if self.held > MEMORY:
                self.known, self.older, self.held = {}, self.known, 0
            self.known[piece] = ids

    def _split_all(self) -> None:
        """The two tokens that each token is merged from; single bytes are their own halves.

        Tokens come by rank. The halves of one are the only cut into known tokens whose border
        no earlier merge crosses; a token without such a cut is never reached by merging.
        """
        for rank, token in sorted(self.vocabulary.items()):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                continue
            for at in range(1, len(token)):
                left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
                if left in self.halves and right in self.halves and self._border_holds(left, right):
                    self.halves[rank] = (left, right)
                    self.joined[left, right] = rank
                    break

    def _border_holds(self, left: int, right: int) -> bool:
        """Whether merging the bytes of ``left`` and ``right`` together keeps the border between them.

        Undoes merges next to the border from the latest to the earliest; the border falls if the two
        tokens then beside it would have merged before the merge just undone.
        """
        before = None
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and (before is None or merged < before):
                return False
            can_left, can_right = self.halves[left][1] != left, self.halves[right][0] != right
            if can_left and (left > right or not can_right):
                before, left = left, self.halves[left][1]
            elif can_right:
                before, right = right + 1, self.halves[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            found = self.fits[key] = self._border_holds(left, right)
        return found

    def next_shorter(self, rank: int) -> int:
        """The longest token that is a true prefix of this one; -1 if there is none."""
        found = self.shorter.get(rank)
        if found is None:
            token = self.vocabulary[rank]
            found = next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) in self.halves), -1)
            self.shorter[rank] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one match of the splitting pattern."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        text, fits = word.decode("latin-1"), self.fits
        out: list[int] = []
        last, covered = -1, 0
        for end, token in self.automaton.iter_long(text):
            if last >= 0:
                fit = fits.get(last << 32 | token)
                if not (self.compatible(last, token) if fit is None else fit):
                    break
            out.append(token)
            last, covered = token, end + 1
        if covered != sum(map(self.sizes.__getitem__, out)):  # a byte that is no token was skipped
            out, covered = [], 0
        return out if covered == len(word) else self._walk(text, out)

    def _walk(self, text: str, out: list[int]) -> list[int]:
        """The ids of a word that begins with the longest tokens ``out``, which fit; the longest one after them may not."""
        sizes, fits, shorter, size, most, longest = self.sizes, self.fits, self.shorter, len(text), self.most, self.automaton.iter_long
        dead: set[int] = set()
        at, last, new = sum(map(sizes.__getitem__, out)), out[-1] if out else -1, True
        token = -1
        while at < size:
            if new:
                end, token = next(longest(text[at : at + most]), (0, -1))
                if token >= 0 and sizes[token] != end + 1:
                    token = -1  # a byte that is no token stands here
            while token >= 0:
                end = at + sizes[token]
                if end not in dead:
                    if last < 0:
                        break
                    fit = fits.get(last << 32 | token)
                    if self.compatible(last, token) if fit is None else fit:
                        break
                token = shorter[token] if token in shorter else self.next_shorter(token)
            new = token >= 0
            if new:
                out.append(token)
                at, last = end, token
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
        return out

    def _remembered(self, piece: str) -> bytes | None:
        ids = self.known.get(piece)
        if ids is None and (ids := self.older.get(piece)) is not None:
            self._keep(piece, ids)
        return ids

    def _word_ids(self, word: str) -> bytes:
        ids = self._remembered(word)
        if ids is None:
            found = self.encode_word(word.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
            self._keep(word, ids)
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for piece in pieces(text):
            ids = self.known.get(piece)
            if ids is None and (ids := self._remembered(piece)) is None:
                words = self.words.findall(piece)
                if words == [piece]:
                    ids = self._word_ids(piece)
                else:
                    ids = b"".join(map(self._word_ids, words))
                    self._keep(piece, ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids) -> bytes | None:
        """The bytes of some ids; None if one of them is none of the vocabulary's."""
        try:
            return b"".join(map(self.vocabulary.__getitem__, ids))
        except KeyError:
            return None

    def decode_packed(self, packed: bytes) -> bytes:
        """The bytes of ids that stand as little-endian unsigned 32-bit integers, all of the vocabulary."""
        found = self.tokens.take(pa.array(np.frombuffer(packed, "<u4")))
        begin, end = found.offset, found.offset + len(found)
        at = np.frombuffer(found.buffers()[1], np.int64)[begin : end + 1] if len(found) else [0, 0]
        return found.buffers()[2][int(at[0]) : int(at[-1])].to_pybytes() if at[-1] > at[0] else b""


def _coder(path: str, pattern: str) -> ByteBpe:
    key = (path, pattern)
    return _coders.get(key) or _coders.setdefault(key, ByteBpe(read_ranks(path), pattern))


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """The ids of ``text`` as an array of integers; null and empty texts give an empty array."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(path, pattern)
        for batch in batches:
            packed = [coder.encode_bytes(x.as_py() or "") for x in batch]
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int64).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
        coder.forget()
        tidy(_coders)

    return encode(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """The text bytes of an array of ids; null gives null, as does an array with an unknown or null id; an empty array gives no bytes."""

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(path, pattern)
        for batch in batches:
            yield pa.array([coder.decode_bytes(x.as_py()) if x.is_valid else None for x in batch], pa.binary())
        tidy(_coders)

    return decode(ids)


def digest_column(text: Column, path: str, pattern: str) -> Column:
    """A struct (n_tokens, ids_sha256, decoded_sha256): each text is encoded, and its ids are decoded again."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @F.arrow_udf(kind)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(path, pattern)
        for batch in batches:
            rows: list[list] = [[], [], []]
            for text in pc.fill_null(batch, ""):
                packed = coder.encode_bytes(text.as_py())
                decoded = coder.decode_packed(packed)
                rows[0].append(len(packed) // 4)
                rows[1].append(hashlib.sha256(packed).hexdigest())
                rows[2].append(hashlib.sha256(decoded).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], kind.names)
        coder.forget()
        tidy(_coders)

    return digest(text)


def code_column(text: Column, path: str, pattern: str) -> Column:
    """A struct (ids, decoded_sha256): each text is encoded, and its ids are decoded again, by one worker."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())])

    @F.arrow_udf(kind)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(path, pattern)
        for batch in batches:
            packed, digests = [], []
            for text in batch:
                packed.append(coder.encode_bytes(text.as_py() or ""))
                digests.append(hashlib.sha256(coder.decode_packed(packed[-1])).hexdigest())
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int64).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.StructArray.from_arrays([ids, pa.array(digests, pa.string())], kind.names)
        coder.forget()
        tidy(_coders)

    return code(text)


def code_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ids and decoded_sha256 (of the bytes that the ids decode to), which replace columns of those names."""
    return with_fields(docs, code_column(docs[f"`{text}`"], path, pattern), ["ids", "decoded_sha256"])


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the array column ``ids``, which replaces a column of that name."""
    return with_fields(docs, F.struct(encode_column(docs[f"`{text}`"], path, pattern).alias("ids")), ["ids"])


def digest_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, which replace columns of those names."""
    return with_fields(docs, digest_column(docs[f"`{text}`"], path, pattern), ["n_tokens", "ids_sha256", "decoded_sha256"])
