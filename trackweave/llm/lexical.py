"""Ranked lexical search, score at a time: postings grouped by exact impact are processed in descending order until bounds prove the best k.

Terms are maximal runs of ASCII letters and digits and of characters outside ASCII; only A-Z are lower-cased. Each
document's terms are counted once, in whole texts, and what it holds of the items' terms is kept with its length as a row
of a table in the shared folder. Three figures of the whole corpus (documents with terms, terms, and the documents of each
term) then make every impact an exact integer.

Documents are searched in blocks. A block's postings are ordered by term and falling impact; equal impacts of a term are one group. For an
item, all groups whose contribution reaches a level are added to the block's accumulators, the level falls by halves, and after each
level the sum of what each term has left at most is compared with the k-th best sum so far, that of earlier blocks of the task included.
Once the rest is smaller, no document that was not met can enter; all whose sum and the rest reach the k-th are scored again, completely, from their own
terms. A task passes on k rows an item, of which the best k remain.

Null and empty texts, and those without terms, are in no figure and no result, nor do items without terms give rows. Terms repeated in an item count
repeatedly. Equal scores go by ascending id, null ids first, and then rows repeat. Repeated documents are documents of their own, and so are repeated items:
each has its own k rows, under the same id. Empty tables give an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, tidy

#: A block ends at so many documents or postings. Items are searched in groups of about so many bytes, each with a pass of its own over the documents.
BLOCK_DOCS, BLOCK_POSTINGS, ITEM_BYTES = 8192, 1 << 20, 4 << 20
#: Numbers of the scoring rule.
TF_SCALE, TF_UNIT, LENGTH_UNIT, BASE, SLOPE, WEIGHT_SCALE = 1_000_000_000, 1000, 8, 25, 75, 1000
#: An impact's part without the term's weight is below 2 ** PART_BITS.
PART_BITS = 20

#: Bytes outside terms become spaces, A-Z become lower case.
_FOLDED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms(text: str | bytes | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    if not text:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(_FOLDED).split()


def term_lists(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: its length, and the numbers and counts of the vocabulary's terms in it."""
    kind = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    known = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, offsets, numbers, counts = [], [0], [], []
            for value in batch.column(1):
                words = terms(value.as_py())
                found = Counter(filter(None.__ne__, map(known.get, words)))
                lengths.append(len(words))
                numbers.extend(found.keys())
                counts.extend(found.values())
                offsets.append(len(numbers))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (numbers, counts)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], kind.names)
            yield out.filter(pa.array(np.array(lengths, np.int64) > 0))
        tidy()

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("binary")).mapInArrow(run, kind)


class Figures:
    """Figures of the corpus and the impacts that follow from them."""

    def __init__(self, docs: int, words: int, holders: np.ndarray):
        self.docs, self.words = docs, words
        self.weights = np.floor(WEIGHT_SCALE * np.log((2.0 * docs + 2) / (2.0 * holders + 1))).astype(np.int64)

    def length_share(self, n: np.ndarray) -> np.ndarray:
        most = int(n.max(initial=0))
        if SLOPE * most * self.docs < 1 << 63:
            return BASE + SLOPE * n * self.docs // self.words
        return np.array([BASE + SLOPE * x * self.docs // self.words for x in n.tolist()], np.int64)

    def part(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return TF_SCALE * tf // (TF_UNIT * tf + LENGTH_UNIT * self.length_share(n))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Block:
    """Some documents' postings by term and falling impact, and by document."""

    def __init__(self, ids: pa.Array, n: np.ndarray, offsets: np.ndarray, numbers: np.ndarray, tf: np.ndarray, figures: Figures):
        self.ids, self.offsets, self.numbers, self.weights = ids, offsets, numbers, figures.weights
        owners = np.repeat(np.arange(len(n)), np.diff(offsets))
        self.parts = figures.part(tf, n[owners])
        order = np.argsort(numbers.astype(np.int64) << PART_BITS | ((1 << PART_BITS) - 1 - self.parts), kind="stable")
        self.by_impact, self.owner = self.parts[order], owners[order]
        self.falling = -self.by_impact
        self.starts = np.searchsorted(numbers[order], np.arange(len(self.weights) + 1))

    def best(self, wanted: np.ndarray, times: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of all documents that may be among the k best, given the scores ``known`` of others."""
        factor = times * self.weights[wanted]
        live = (self.starts[wanted] < self.starts[wanted + 1]) & (factor > 0)
        wanted, factor = wanted[live], factor[live]
        at, stop = self.starts[wanted].copy(), self.starts[wanted + 1]
        sums = np.zeros(len(self.ids), np.int64)
        floor = self._kth(known, k)
        heads = factor * self.by_impact[at] if len(at) else np.zeros(0, np.int64)
        level = int(heads.max(initial=0))
        while (rest := int(heads.sum())) and rest >= floor:
            level //= 2
            ends = stop if level == 0 else np.array([a + int(np.searchsorted(self.falling[a:z], -(-(-level // f)), "right")) for a, z, f in zip(at.tolist(), stop.tolist(), factor.tolist(), strict=True)], np.int64)
            chosen = _ranges(at, ends - at)
            np.add.at(sums, self.owner[chosen], np.repeat(factor, ends - at) * self.by_impact[chosen])
            at = ends
            heads = np.where(at < stop, factor * self.by_impact[np.minimum(at, len(self.by_impact) - 1)], 0)
            floor = self._kth(np.concatenate([known, sums[sums > 0]]), k)
        places = np.flatnonzero((sums > 0) & (sums + rest >= floor))
        return places, self._complete(places, wanted, factor)

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> int:
        return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0

    def _complete(self, places: np.ndarray, wanted: np.ndarray, factor: np.ndarray) -> np.ndarray:
        by_term = np.zeros(len(self.weights), np.int64)
        by_term[wanted] = factor
        sizes = self.offsets[places + 1] - self.offsets[places]
        mine = _ranges(self.offsets[places], sizes)
        sums = np.concatenate([[0], np.cumsum(by_term[self.numbers[mine]] * self.parts[mine])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def _blocks(batches: Iterator[pa.RecordBatch], figures: Figures) -> Iterator[Block]:
    held: list[pa.RecordBatch] = []
    docs = postings = 0

    def block() -> Block:
        ids, n, numbers, counts = (pa.concat_arrays([b.column(i) for b in held]) for i in range(4))
        flat = numbers.flatten().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(np.diff(numbers.offsets.to_numpy()))])
        return Block(ids, n.to_numpy(zero_copy_only=False), offsets, flat, counts.flatten().to_numpy(zero_copy_only=False), figures)

    for batch in batches:
        for begin in range(0, len(batch), 1024):
            held.append(batch.slice(begin, 1024))
            docs += len(held[-1])
            postings += len(held[-1].column(2).flatten())
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                yield block()
                held, docs, postings = [], 0, 0
    if docs:
        yield block()


def _order(value) -> tuple:
    return (value is not None, value)


def _searched(lists: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], figures: Figures, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best of every item, by the item's place in ``items``."""
    kind = T.StructType([T.StructField("item", T.IntegerType()), lists.schema["doc_id"], T.StructField("score", T.LongType())])
    id_type = lists.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        best: list[list[tuple[int, object]]] = [[] for _ in items]
        for block in _blocks(batches, figures):
            for i, (wanted, times) in enumerate(items):
                places, scores = block.best(wanted, times, k, np.array([s for s, _ in best[i]], np.int64))
                if len(places):
                    floor = Block._kth(scores, k)
                    near = scores >= max(floor, 1)
                    met = best[i] + list(zip(scores[near].tolist(), block.ids.take(pa.array(places[near])).to_pylist(), strict=True))
                    met.sort(key=lambda x: (-x[0], _order(x[1])))
                    best[i] = met[:k]
        rows = [(i, d, s) for i, found in enumerate(best) for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], to_arrow_type(id_type)), pa.array([r[2] for r in rows], pa.int64())], kind.names)
        tidy()

    return lists.mapInArrow(run, kind)


def _grouped(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their terms, in groups of about ITEM_BYTES."""
    group, size = [], 0
    for row in items.select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).toLocalIterator():
        words = terms(row[1])
        if words:
            group.append((row[0], words))
            size += sum(map(len, words))
        if size >= ITEM_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for every item."""
    spark = docs.sparkSession
    item_type = items.schema[item_id].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())]))
    for group in _grouped(items, item_id, text):
        vocabulary = sorted({t for _, words in group for t in words})
        number = {t: i for i, t in enumerate(vocabulary)}
        lists = cut(term_lists(docs, vocabulary, doc_id, text), "term-lists")
        whole = lists.agg(F.count("*"), F.sum("n")).first()
        if not whole[0]:
            continue
        holders = np.zeros(len(vocabulary), np.int64)
        for term, n in lists.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the items at most
            holders[term] = n
        asked = []
        for _, words in group:
            counted = Counter(number[w] for w in words)
            asked.append((np.array(sorted(counted), np.int64), np.array([counted[t] for t in sorted(counted)], np.int64)))
        found = _searched(lists, asked, Figures(whole[0], whole[1], holders), k)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(group)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type)]))
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # a row an item of the group
    return out
