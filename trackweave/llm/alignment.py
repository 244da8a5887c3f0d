"""Cross-tokenizer alignment: the tokens that two tokenizers give one text, cut into groups where both end, with links between overlapping tokens counted over the corpus.

A is a byte-level BPE file, which reads a space and the text; B is a sentencepiece model, which adds that space itself. A text is cut before
spaces that follow other characters: both tokenizers end a token there (A's pattern never joins such a pair; no piece
of B has its space mark behind another character, which is checked when the model is read), so no group crosses. Each distinct cut is encoded and aligned once for a chunk of documents:
a cumulative sum of token lengths gives the ends, intersect1d the common cuts, searchsorted the group of each token and the first and last
token that it overlaps, and repeat expands these ranges into links.

A chunk is a row of a table in the shared folder: its pairs of ids with their counts, and which pairs each document has how often. The
chunks' pair counts meet in two shuffles, first salted by chunk, then by pair; the totals return to the chunks that hold the pair, and a chunk's documents add theirs up.
What is shuffled is a row for each pair and chunk, not for each link, and no task holds more than a chunk or some pairs.

Texts that are null or empty, or that one of the two doesn't spell byte for byte, have no tokens: all figures are 0 and the digest column is ''.
A text is taken whole, however long. Equal texts count as often as they stand there, repeated rows give repeated rows, null ids stay; equal counts of a B id are all best. An empty table
gives an empty one. Only the id and the text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cache, cut, tidy

#: A chunk ends at so many bytes of text or distinct cuts; texts are encoded a few at a time. SALTS parts of a pair's rows are summed apart.
CHUNK_BYTES, CHUNK_CUTS, STEP_BYTES, SALTS = 12 << 20, 300_000, 1 << 20, 16
#: A pair is one number: A's id above B's.
B_BITS = 32

#: Characters other than a space that some library counts as white space; no cut behind them.
_WHITE = "\\s\\x1c-\\x1f\\x85᠎​⁠﻿"
_CUT = re.compile(f" +[^ ]*(?:(?<=(?! )[{_WHITE}]) +[^ ]*)*")
_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]

_pairs_of_tokenizers: dict[tuple[str, str], "Aligner"] = cache()


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """The two tokenizers and the bytes of their tokens; one for each Python worker."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of, vocabulary = _byte_of(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds its space mark behind another character")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = ([b"%d" % k for k in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")

    def encode(self, cuts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for cuts, each of which begins with a space, the one that B adds."""
        a = [e.ids for e in self.a.encode_batch_fast(cuts, add_special_tokens=False)]
        b = self.b.encode([c[1:] for c in cuts], num_threads=1)
        return a, [ids or [self.space] for ids in b]  # an empty rest has no prefix of its own

    def spelt(self, ids: list[int], table: list[bytes]) -> bytes:
        return b"".join(map(table.__getitem__, ids))


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(sizes.sum()))


def align(a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(common cuts, group of each A token, group of each B token, A tokens of the links, B tokens of the links) of two spellings of the same bytes."""
    a_ends, b_ends = np.cumsum(a_sizes[a_ids]), np.cumsum(b_sizes[b_ids])
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_starts = a_ends - a_sizes[a_ids]
    first, last = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_ends, a_ends, "left")
    n = last - first + 1
    return cuts, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), np.repeat(np.arange(len(a_ids)), n), _ranges(first, n)


class Chunk:
    """What some documents' texts hold: their distinct cuts with groups and links, and each document's cuts."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.known: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # None: not spelt
        self.figures: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.sums: list[tuple[int, ...]] = []
        self.digests: list[str] = []
        self.of_docs: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        parts = [_CUT.findall(f" {t}") if t else [] for t in texts]
        new = list(dict.fromkeys(c for cuts in parts for c in cuts if c not in self.known))
        if new:
            self._learn(new)
        figures = np.concatenate(self.figures) if self.figures else np.zeros((0, 4), np.int64)
        self.figures = [figures]
        self.ids.append(ids)
        for cuts in parts:
            mine = list(map(self.known.__getitem__, cuts))
            spelt = list(map(self.groups.__getitem__, mine))
            if not cuts or None in spelt:
                self.sums.append((0, 0, 0, 0))
                self.digests.append("")
                self.of_docs.append(np.zeros(0, np.int32))
            else:
                at = np.array(mine, np.int32)
                self.sums.append(tuple(figures[at].sum(axis=0).tolist()))
                self.digests.append(hashlib.sha256(b";".join(spelt)).hexdigest())
                self.of_docs.append(np.sort(at))
        self.size += sum(len(t) for t in texts if t)

    def _learn(self, new: list[str]) -> None:
        aligner = self.aligner
        a, b = aligner.encode(new)
        texts = [c.encode("utf-8", "surrogatepass") for c in new]
        whole = b"".join(texts)
        good = [True] * len(new)
        if not (whole == b"".join(aligner.spelt(x, aligner.a_bytes) for x in a) == b"".join(aligner.spelt(x, aligner.b_bytes) for x in b)):
            good = [t == aligner.spelt(x, aligner.a_bytes) == aligner.spelt(y, aligner.b_bytes) for t, x, y in zip(texts, a, b, strict=True)]
        base = len(self.groups)
        self.known.update(zip(new, range(base, base + len(new)), strict=True))
        a, b = ([ids if fit else [] for ids, fit in zip(x, good, strict=True)] for x in (a, b))
        n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        flat_a, flat_b = (np.array([i for ids in x for i in ids], np.int64) for x in (a, b))
        cuts, group_a, group_b, link_a, link_b = align(flat_a, flat_b, aligner.a_sizes, aligner.b_sizes)
        owner_a = np.repeat(np.arange(len(new)), n_a)
        last = np.concatenate([np.flatnonzero(np.diff(group_a)), [len(group_a) - 1]])[: len(cuts)] if len(cuts) else np.zeros(0, np.int64)
        n_groups = np.bincount(owner_a[last], minlength=len(new))
        n_links = np.bincount(owner_a[link_a], minlength=len(new))
        self.figures.append(np.stack([n_a, n_b, n_groups, n_links], axis=1))
        self.links.append(flat_a[link_a] << B_BITS | flat_b[link_b])
        self.groups += self._strings(n_a, n_b, flat_a, flat_b, group_a, group_b, owner_a, good)

    def _strings(self, n_a, n_b, flat_a, flat_b, group_a, group_b, owner_a, good) -> list[bytes | None]:
        """Each cut's groups as text: a name before each token's id says how it is joined to what stands before."""
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        names = [*map(self.aligner.a_names.__getitem__, flat_a.tolist()), *map(self.aligner.b_names.__getitem__, flat_b.tolist())]
        side = np.concatenate([2 * group_a, 2 * group_b + 1])[order]
        begins = np.concatenate([[True], side[1:] != side[:-1]])[: len(side)]
        marks = np.where(~begins, 0, np.where(side & 1, 1, 2))
        joined = [m + n for m, n in zip(map((b",", b"|", b";").__getitem__, marks.tolist()), itemgetter(*order.tolist())(names) if len(order) > 1 else [names[i] for i in order], strict=True)]
        ends = np.cumsum(n_a + n_b).tolist()
        out, begin = [], 0
        for end, fit in zip(ends, good, strict=True):
            out.append(b"".join(joined[begin:end])[1:] if fit else None)  # the first mark goes
            begin = end
        return out

    def row(self, number: int) -> dict[str, pa.Array]:
        """The chunk as a row: documents, distinct pairs with counts, cuts' places among the pairs, documents' cuts."""
        figures = np.concatenate(self.figures)
        links = np.concatenate(self.links) if self.links else np.zeros(0, np.int64)
        pairs, place = np.unique(links, return_inverse=True)
        of_docs = np.concatenate(self.of_docs)
        times = np.bincount(of_docs, minlength=len(figures))
        counts = np.bincount(place, np.repeat(times, figures[:, 3]), len(pairs)).astype(np.int64)
        used = counts > 0  # cuts of texts that aren't spelt link nothing
        renumbered = np.cumsum(used) - 1
        sizes = np.array([len(x) for x in self.of_docs], np.int32)
        steps = np.diff(of_docs, prepend=np.int32(0)).astype(np.int32)
        ids = pa.concat_arrays(self.ids)
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        sums = np.array(self.sums, np.int64).reshape(-1, 4)
        out = {"chunk": pa.array([number], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "digests": lists(self.digests, pa.string())}
        out |= {name: lists(sums[:, k], pa.int64()) for k, name in enumerate(_FIGURES)}
        out |= {"pairs": lists(pairs[used], pa.int64()), "counts": lists(counts[used], pa.int64())}
        out |= {name: pa.array([_packed(x)], pa.binary()) for name, x in (("cut_links", figures[:, 3].astype(np.int32)), ("places", np.where(used, renumbered, 0)[place].astype(np.int32)), ("doc_cuts", sizes), ("steps", steps))}
        return out


def _packed(x: np.ndarray) -> bytes:
    """Integers of 32 bits, byte by byte, so that the empty upper bytes shrink to nothing; their number stands in front."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 4 * n, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view(np.int32).ravel()


def chunks(docs: DataFrame, a_path: str, b_path: str, doc_id: str, text: str) -> DataFrame:
    """A row for each chunk of documents, in a table of the shared folder."""
    longs, packed = T.ArrayType(T.LongType()), T.BinaryType()
    kind = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[doc_id].dataType)), T.StructField("digests", T.ArrayType(T.StringType()))])
    for name, of in [*((f, longs) for f in _FIGURES), ("pairs", longs), ("counts", longs), *((x, packed) for x in ("cut_links", "places", "doc_cuts", "steps"))]:
        kind = kind.add(name, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (a_path, b_path)
        aligner = _pairs_of_tokenizers.get(key) or _pairs_of_tokenizers.setdefault(key, Aligner(*key))
        chunk, number = Chunk(aligner), TaskContext.get().partitionId() << 32

        for batch in batches:
            begin = 0
            sizes = np.cumsum(pc.binary_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
            while begin < len(batch):
                end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + STEP_BYTES, "right")) + 1
                end = min(max(end, begin + 1), len(batch))
                chunk.add(batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin).to_pylist())
                begin = end
                if chunk.size >= CHUNK_BYTES or len(chunk.groups) >= CHUNK_CUTS:
                    yield pa.RecordBatch.from_pydict(chunk.row(number))
                    chunk, number = Chunk(aligner), number + 1
        if chunk.sums:
            yield pa.RecordBatch.from_pydict(chunk.row(number))
        chunk = None
        tidy(_pairs_of_tokenizers)

    return cut(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, kind), "alignment-chunks")


def _held(rows: DataFrame) -> DataFrame:
    """(chunk, pair, n): the pairs of each chunk."""
    each = rows.select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    return each.select("chunk", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, links, is_best) of all chunks: how many links hold two ids linked, and whether no A id has more with this B id."""
    salted = _held(rows).groupBy("pair", (F.col("chunk") % SALTS).alias("salt")).agg(F.sum("n").alias("n"))
    totals = cut(salted.groupBy("pair").agg(F.sum("n").alias("links")), "alignment-pairs")
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    most = totals.groupBy(b_id.alias("b_id")).agg(F.max("links").alias("most"))
    joined = totals.withColumn("b_id", b_id).join(F.broadcast(most), "b_id")  # a row for each id of B's vocabulary at most
    return joined.select("pair", F.shiftright("pair", B_BITS).alias("a_id"), "b_id", "links", (F.col("links") == F.col("most")).alias("is_best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document; the id keeps its name."""
    rows = chunks(docs, a_path, b_path, doc_id, text)
    known = _held(rows).join(pair_counts(rows).select("pair", "links", "is_best"), "pair").select(F.col("chunk").alias("holder"), "pair", "links", "is_best")
    id_type = docs.schema[doc_id].dataType
    kind = T.StructType([T.StructField(doc_id, id_type), *(T.StructField(n, T.LongType()) for n in (*_FIGURES, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def finish(chunk: pa.Table, pairs: pa.Table) -> pa.Table:
        row = chunk.slice(0, 1).combine_chunks()
        flat = lambda name: row.column(name).chunk(0).flatten()
        binary = lambda name: _unpacked(row.column(name)[0].as_py())
        mine = flat("pairs").to_numpy(zero_copy_only=False)
        at = np.searchsorted(mine, pairs.column("pair").to_numpy())
        links, best = np.zeros(len(mine) + 1, np.int64), np.zeros(len(mine) + 1, np.int64)
        links[at], best[at] = pairs.column("links").to_numpy(), pairs.column("is_best").to_numpy().astype(np.int64)
        cut_ends = np.cumsum(binary("cut_links").astype(np.int64))
        places = binary("places")
        doc_ends = np.cumsum(binary("doc_cuts").astype(np.int64))
        cuts = np.cumsum(binary("steps").astype(np.int64))
        sums = []
        for value in (best, links):
            below = np.concatenate([[0], np.cumsum(value[places])])
            by_cut = below[cut_ends] - np.concatenate([[0], below[cut_ends[:-1]]]) if len(cut_ends) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(by_cut[cuts])]) if len(cuts) else np.zeros(1, np.int64)
            sums.append(np.diff(total[doc_ends], prepend=0))
        return pa.Table.from_arrays([flat("ids"), *map(flat, _FIGURES), *map(pa.array, sums), flat("digests")], names=kind.names)

    return rows.groupBy("chunk").cogroup(known.groupBy("holder")).applyInArrow(finish, kind)
