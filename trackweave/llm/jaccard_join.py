"""N-gram Jaccard join by vertical partitioning: components of texts whose shingle sets are similar.

The global order of n-grams is by frequency (in levels of bucketed counts over the whole corpus), then by hash. Pivots cut it into
fragments that hold about equally many n-grams of the corpus; a document is one segment per fragment. Candidates are found by n-grams inside fragments, after copies
were tied by equal parts; overlaps of a pair of documents are counted in each fragment separately and summed per pair.

1. Documents with equal sets become one node; its first document stands for all.
2. Star pairs: of the nodes with an equal part of their set, by ranges of hashes, the most typical one is the head; each node meets
   the head that it shares most parts with. These are linear in number, and tie the large groups of near copies together.
3. Prefix pairs: two similar sets share one of their rarest n-grams. Only n-grams that occur in more than one
   component so far are joined, inside their fragments, and only nodes of different components whose lengths and places
   in the order allow the threshold. So no pair of different groups that can link is left out. N-grams of very many nodes are
   taken to groups of nodes instead, and compared as in step 4.
4. Pairs inside a group of step 2 are all counted, block of nodes against block, so that no row is made for a pair.

The pairs of 2 and 3 pass a bound first: every n-gram toggles one bit of its node's sketch, so the sketches of two nodes
differ in no more bits than their sets in n-grams. What passes is verified exactly. A node that very many pairs share is dealt to several
tasks, by the other node of the pair. Component ids are the smallest document id in reach.
Every link is counted once, in step 3 or 4; a node's links count as many documents as the linked nodes stand for.

Null and empty texts have no shingles, link with nothing, and have their own id as component. Rows with a
null id are returned with a null component and link with nothing. Rows that repeat an id are judged one by one. An empty table gives an empty result; only the id and the text play a part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import key_filter, may_hold, sized
from .common import cut, tidy
from .components import components
from .shingles import chunks, mix, shingle_sets, slices

#: Fragments; bits of the table of counts, and of the blocks it is summed in; words of 64 bits in a sketch.
FRAGMENTS, COUNT_BITS, BLOCK_BITS, SKETCH = 16, 23, 17, 32
#: Pairs that one task takes of a node that many share; nodes of an n-gram beyond which no rows are made for its pairs.
PAIRS, MANY = 4096, 512
#: Nodes and n-grams in a block of a group, about; n-grams whose overlaps are counted at a time.
BLOCK_NODES, BLOCK_GRAMS, COLUMNS = 256, 1 << 19, 1 << 13

#: Levels of frequency that 64-bit counts can have.
LEVELS = 130

NODE = "struct<d: bigint, h: bigint>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prints(hashes: np.ndarray, owners: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: number of shingles, two 64-bit fingerprints of the set."""
    n = np.bincount(owners, minlength=size)
    out = []
    for salt in (11, 12):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes, salt), dtype=np.uint64)])
        ends = np.cumsum(n)
        out.append(mix(sums[ends] - sums[ends - n], salt))
    return n, out[0], out[1]


def _survey(n_gram: int):
    """Rows (doc_id, mark, n, h, h2) for documents, and at the end (block, counts) for the table of counts."""
    names = ["doc_id", "mark", "n", "h", "h2", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        counts = np.zeros(1 << COUNT_BITS, np.uint16)  # a task counts a bucket up to 65,535
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, end in chunks(texts):
                hashes, owners = shingle_sets(texts[begin:end], n_gram)
                bucket, more = np.unique((hashes & np.uint64(len(counts) - 1)).astype(np.int64), return_counts=True)
                counts[bucket] = np.minimum(counts[bucket] + more, 65535)
                n, h, h2 = _prints(hashes, owners, end - begin)
                none = pa.nulls(end - begin, pa.int32()), pa.nulls(end - begin, pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), batch.column(2).slice(begin, end - begin), pa.array(n, pa.int64()), pa.array(_signed(h)), pa.array(_signed(h2)), *none], names)
        empty = pa.nulls(1, pa.int64())
        for k, block in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
            packed = zlib.compress(block.astype("<u2", copy=False).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, empty, pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names)
        tidy()

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the blocks of a partition and keeps the half logarithms, levels of frequency, and how many n-grams each level holds."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(packed), "<u2").astype(np.uint64)
            sums[block] = sums[block] + counts if block in sums else counts
    for block, counts in sums.items():
        levels = np.floor(2 * np.log2(counts + 1.0)).astype(np.uint8)
        held = np.bincount(levels, counts.astype(float), minlength=LEVELS)
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "levels": [levels.tobytes()], "held": pa.array([held.tolist()], pa.list_(pa.float64()))})


class Order:
    """The global order of n-grams: a level of frequency for each bucket of hashes, and the pivots that cut the order into fragments.

    It has 2 ** COUNT_BITS bytes, whatever the corpus.
    """

    def __init__(self, levels: np.ndarray, pivots: np.ndarray):
        self.levels, self.pivots = levels, pivots

    def level(self, hashes: np.ndarray) -> np.ndarray:
        return self.levels[(hashes & np.uint64(len(self.levels) - 1)).astype(np.int64)]

    def fragment(self, hashes: np.ndarray) -> np.ndarray:
        """Within a level n-grams are ordered by hash, so their places are the level and the hash as a fraction."""
        return np.searchsorted(self.pivots, self.level(hashes) + (hashes >> np.uint64(11)).astype(float) / 2.0**53, "right")


def _order(survey: DataFrame) -> Order:
    rows = survey.where("block is not null").select("block", "counts").repartition("block").mapInArrow(_add_blocks, "block int, levels binary, held array<double>").collect()
    levels, held = np.zeros(1 << COUNT_BITS, np.uint8), np.zeros(LEVELS)
    for row in rows:
        levels[row.block << BLOCK_BITS : (row.block + 1) << BLOCK_BITS] = np.frombuffer(row.levels, np.uint8)
        held += np.array(row.held)
    ends = np.cumsum(held)
    wanted = ends[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS
    at = np.minimum(np.searchsorted(ends, wanted), LEVELS - 1)
    inside = np.where(held[at] > 0, (wanted - (ends[at] - held[at])) / np.maximum(held[at], 1), 0.0)
    return Order(levels, at + np.clip(inside, 0.0, 1.0))


def _sketches(hashes: np.ndarray, owners: np.ndarray, size: int) -> np.ndarray:
    """A row of SKETCH words for each text; every n-gram has toggled one bit."""
    odd = np.bincount(owners * (SKETCH * 64) + (hashes >> np.uint64(20)).astype(np.int64) % (SKETCH * 64), minlength=size * SKETCH * 64) & 1
    return np.packbits(odd.astype(np.uint8).reshape(size, -1), axis=1, bitorder="little").view("<i8")


def _describe(n_gram: int, num: int, den: int, order, nodes):
    """For each document that the bitmap of nodes may hold: segments (hash by fragment, 0 if empty), prefix (its rarest n-grams), sketch, typical (mean level)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = order.value, np.frombuffer(nodes.value, np.uint8)
        for batch in slices(batches):
            mine = pa.array(np.flatnonzero(may_hold(held, _mixed_ids(batch.column(0)))))
            ids, texts = batch.column(0).take(mine), batch.column(1).take(mine).to_pylist()
            for begin, end in chunks(texts):
                hashes, owners = shingle_sets(texts[begin:end], n_gram)
                size = end - begin
                n, h, _ = _prints(hashes, owners, size)
                fragment, level = table.fragment(hashes), table.level(hashes)
                # Parts for star pairs are by hash: copies differ in rare n-grams and agree in frequent ones, which one fragment may hold alone.
                cells = owners * FRAGMENTS + (hashes >> np.uint64(60)).astype(np.int64) % FRAGMENTS
                by_cell = np.argsort(cells, kind="stable")
                per_cell = np.bincount(cells, minlength=size * FRAGMENTS)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes[by_cell], 13), dtype=np.uint64)])
                ends = np.cumsum(per_cell)
                segments = sums[ends] - sums[ends - per_cell]
                typical = np.bincount(owners, level, minlength=size) / np.maximum(n, 1)
                rarest = np.lexsort((hashes, level, owners))
                ends = np.cumsum(n)
                length = np.where(n > 0, n - -(-n * num // den) + 1, 0)
                rank = np.arange(len(hashes)) - np.repeat(ends - n, n)
                first = rank < np.repeat(length, n)
                prefix, places = hashes[rarest][first], fragment[rarest][first]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, size), pa.array(_signed(h)), pa.array(n, pa.int64()), pa.array(typical),
                        pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * FRAGMENTS, pa.int32()), pa.array(_signed(segments))),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(_signed(prefix))),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(places, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * SKETCH, pa.int32()), pa.array(_sketches(hashes, owners, size).ravel())),
                    ],
                    ["doc_id", "h", "n", "typical", "segments", "prefix", "places", "sketch"],
                )

    return run


def _mixed_ids(ids: pa.Array) -> np.ndarray:
    return mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 17)


def _segments(n_gram: int, bits, order):
    """(doc_id, h, fragment, grams) of the documents whose node the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for batch in slices(batches):
            mine = np.flatnonzero(may_hold(held, _mixed_ids(batch.column(0))))
            if not len(mine):
                continue
            ids, texts = batch.column(0).take(pa.array(mine)), batch.column(1).take(pa.array(mine)).to_pylist()
            for begin, end in chunks(texts):
                hashes, owners = shingle_sets(texts[begin:end], n_gram)
                _, h, _ = _prints(hashes, owners, end - begin)
                cells = owners * FRAGMENTS + order.value.fragment(hashes)
                by_cell = np.argsort(cells, kind="stable")
                cells, hashes = cells[by_cell], hashes[by_cell]
                starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
                doc = cells[starts] // FRAGMENTS
                offsets = np.concatenate([starts, [len(cells)]]) if len(cells) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin).take(pa.array(doc)), pa.array(_signed(h)[doc]), pa.array(cells[starts] % FRAGMENTS, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_signed(hashes)))],
                    ["doc_id", "h", "fragment", "grams"],
                )

    return run


def _held_texts(bits):
    """The rows (doc_id, text) whose ids the bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(may_hold(held, _mixed_ids(batch.column(0))))))

    return run


def _overlaps(hashes: np.ndarray, owners: np.ndarray, first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """How many n-grams each text of ``first`` shares with each of ``second``, of ``size`` texts."""
    _, column, count = np.unique(hashes, return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    column, owners = new[column[shared]], owners[shared]
    order = np.argsort(column, kind="stable")
    column, owners = column[order], owners[order]
    out = np.zeros((len(first), len(second)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        begin, end = np.searchsorted(column, [low, low + COLUMNS])
        held = np.zeros((size, min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        held[owners[begin:end], column[begin:end] - low] = 1
        out += (held[first] @ held[second].T).astype(np.int64)
    return out


def _count_links(n_gram: int, num: int, den: int):
    """(d, h, links) of the nodes in rows (root, low, high, block, d, h, members, text) in order of (root, low, high): documents that each node of one block links in the other."""

    def counted(rows: list[tuple], same: bool, low: int) -> pa.RecordBatch:
        nodes: dict[tuple[int, int], int] = {}
        sides, members, hashes, owners, texts = [], [], [], [], [r[4] for r in rows]
        for begin, end in chunks(texts):
            found, owner = shingle_sets(texts[begin:end], n_gram)
            n, h, _ = _prints(found, owner, end - begin)
            starts = np.cumsum(n) - n
            for i, print_ in enumerate(_signed(h).tolist()):
                block, d, wanted, weight, _ = rows[begin + i]
                # Rows that repeat an id with the same text are one node; those with another text are another.
                if print_ == wanted and (d, wanted) not in nodes:
                    owners.append(np.full(n[i], len(nodes)))
                    nodes[d, wanted] = len(nodes)
                    hashes.append(found[starts[i] : starts[i] + n[i]])
                    sides.append(block == low)
                    members.append(weight)
        if not nodes:
            return pa.RecordBatch.from_pydict({k: pa.array([], pa.int64()) for k in ("d", "h", "links")})
        sizes, side, weights = np.array([len(x) for x in hashes]), np.array(sides), np.array(members, np.int64)
        first, second = np.flatnonzero(side), np.flatnonzero(side if same else ~side)
        common = _overlaps(np.concatenate(hashes), np.concatenate(owners), first, second, len(nodes))
        linked = common * den >= (sizes[first][:, None] + sizes[second][None, :] - common) * num
        links = np.zeros(len(nodes), np.int64)
        if same:
            np.fill_diagonal(linked, False)
            links[first] = linked @ weights[second]
        else:
            links[first], links[second] = linked @ weights[second], linked.T @ weights[first]
        d, h = zip(*nodes, strict=True)
        return pa.RecordBatch.from_pydict({"d": pa.array(d, pa.int64()), "h": pa.array(h, pa.int64()), "links": pa.array(links)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in slices(batches):
            for root_d, root_h, low, high, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (root_d, root_h, low, high) != key:
                    if rows:
                        yield counted(rows, key[2] == key[3], key[2])
                    key, rows = (root_d, root_h, low, high), []
                rows.append(tuple(row))
        if rows:
            yield counted(rows, key[2] == key[3], key[2])

    return run


def _find_links(n_gram: int, num: int, den: int):
    """(a_d, a_h, b_d, b_h): links of nodes in rows (group, low, high, block, d, h, root, text), in order of (group, low, high), between one block and the other; a < b, of different roots."""

    def linked(rows: list[tuple], same: bool, low: int) -> pa.RecordBatch:
        nodes: dict[tuple[int, int], tuple] = {}
        sides, hashes, owners, texts = [], [], [], [r[5] for r in rows]
        for begin, end in chunks(texts):
            found, owner = shingle_sets(texts[begin:end], n_gram)
            n, h, _ = _prints(found, owner, end - begin)
            starts = np.cumsum(n) - n
            for i, print_ in enumerate(_signed(h).tolist()):
                block, d, wanted, root_d, root_h, _ = rows[begin + i]
                if print_ == wanted and (d, wanted) not in nodes:
                    owners.append(np.full(n[i], len(nodes)))
                    nodes[d, wanted] = root_d, root_h
                    hashes.append(found[starts[i] : starts[i] + n[i]])
                    sides.append(block == low)
        names = ["a_d", "a_h", "b_d", "b_h"]
        if not nodes:
            return pa.RecordBatch.from_pydict({k: pa.array([], pa.int64()) for k in names})
        ids, roots = list(nodes), np.unique(np.array(list(nodes.values())), axis=0, return_inverse=True)[1].ravel()
        sizes, side = np.array([len(x) for x in hashes]), np.array(sides)
        first, second = np.flatnonzero(side), np.flatnonzero(side if same else ~side)
        common = _overlaps(np.concatenate(hashes), np.concatenate(owners), first, second, len(nodes))
        close = common * den >= (sizes[first][:, None] + sizes[second][None, :] - common) * num
        close &= roots[first][:, None] != roots[second][None, :]
        pairs = {(min(ids[first[i]], ids[second[j]]), max(ids[first[i]], ids[second[j]])) for i, j in zip(*np.nonzero(close), strict=True)}
        flat = list(zip(*[(*a, *b) for a, b in sorted(pairs)], strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in slices(batches):
            for *group, block, d, h, root_d, root_h, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group != key:
                    if rows:
                        yield linked(rows, key[2] == key[3], key[2])
                    key, rows = group, []
                rows.append((block, d, h, root_d, root_h, text))
        if rows:
            yield linked(rows, key[2] == key[3], key[2])
        tidy()

    return run


def _frequent(bits):
    """(node, n, at, fragment, gram): the prefixes' n-grams that the bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            prefix = batch.column("prefix")
            grams, ends = prefix.flatten().to_numpy(), np.cumsum(prefix.value_lengths().to_numpy(zero_copy_only=False))
            mine = np.flatnonzero(may_hold(held, grams))
            row = np.searchsorted(ends, mine, "right")
            at = mine - np.concatenate([[0], ends])[row]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(at, pa.int32()), batch.column("places").flatten().take(pa.array(mine)), pa.array(grams[mine])], ["node", "n", "at", "fragment", "gram"])

    return run


def _ids_as_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"key": _signed(_mixed_ids(batch.column(0)))})


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text: str, n_gram: int, num: int, den: int):
        self.spark = docs.sparkSession
        self.texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
        self.n_gram, self.num, self.den = n_gram, num, den

    def ids(self, ids: DataFrame) -> bytes:
        """The bitmap of some ids, sized for their number."""
        return key_filter(ids.mapInArrow(_ids_as_keys, "key long"), sized(ids.count()))

    def similar(self, overlap, n_a, n_b):
        return overlap * self.den >= (n_a + n_b - overlap) * self.num

    def near(self, pairs: DataFrame, told: DataFrame) -> DataFrame:
        """Of ``pairs`` (a, b), with sizes n_a and n_b, those whose sketches allow the threshold."""
        side = lambda x: told.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        total = F.col("n_a") + F.col("n_b")
        return both.where(apart * (self.num + self.den) <= total * (self.den - self.num)).select("a", "b", "n_a", "n_b").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of the distinct ``pairs`` (a, b, n_a, n_b), those that link: overlaps by fragment, summed per pair."""
        pairs = cut(pairs, "pairs")

        def parts(side: str) -> DataFrame:
            bits = self.spark.sparkContext.broadcast(self.ids(pairs.select(f"{side}.d").distinct()))
            found = self.texts.where("doc_id is not null").mapInArrow(_segments(self.n_gram, bits, self.order), "doc_id long, h long, fragment int, grams array<long>")
            return found.select(F.struct(F.col("doc_id").alias("d"), "h").alias(side), "fragment", F.col("grams").alias(f"grams_{side}"))

        # A node of very many pairs is several keys, by the other node.
        shares = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("shares")).where("shares > 1")
        dealt = pairs.join(shares, "b", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("a"), "shares"), F.lit(0).cast("long"))).drop("shares")
        heads = parts("b").join(shares, "b", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1).cast("long")) - 1))).drop("shares")
        met = dealt.join(parts("a"), "a").join(heads, ["b", "share", "fragment"])
        partial = met.select("a", "b", "n_a", "n_b", "fragment", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
        # Rows that repeat a document repeat its segments; each fragment counts once.
        partial = partial.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max("common").alias("common"))
        overlap = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("overlap"))
        return overlap.where(self.similar(F.col("overlap"), F.col("n_a"), F.col("n_b"))).select("a", "b")

    def links_inside(self, classes: DataFrame, roots: DataFrame) -> DataFrame:
        """(node, links): documents that each class links inside its group of ``roots``; all pairs of a group are compared, block by block."""
        mine = classes.select(F.struct("d", "h").alias("node"), "n", "members").join(roots, "node")
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_GRAMS)).alias("blocks")
        groups = mine.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), blocks).where("nodes > 1").drop("nodes")
        mine = cut(mine.join(groups, "root").select("root", "node", "members", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block")), "group-members")
        bits = self.spark.sparkContext.broadcast(self.ids(mine.select("node.d").distinct()))
        texts = self.texts.where("doc_id is not null").select("doc_id", "text").mapInArrow(_held_texts(bits), "doc_id long, text string")
        met = mine.join(texts, mine["node.d"] == texts["doc_id"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        met = met.select(F.col("root.d").alias("root_d"), F.col("root.h").alias("root_h"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node.d", "node.h", "members", "text")
        key = ["root_d", "root_h", "low", "high"]
        found = met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_count_links(self.n_gram, self.num, self.den), "d long, h long, links long")
        return found.select(F.struct("d", "h").alias("node"), "links")

    def links_of_many(self, grams: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b): linked nodes of different components among those that share an n-gram of very many nodes; they are compared block by block."""
        mine = cut(grams.select(F.struct(F.col("fragment").cast("long").alias("d"), F.col("gram").alias("h")).alias("group"), "node", "root", "n"), "many-nodes")
        size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_GRAMS)).alias("blocks")
        mine = mine.join(mine.groupBy("group").agg(size), "group")
        mine = cut(mine.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).drop("n"), "many-members")
        bits = self.spark.sparkContext.broadcast(self.ids(mine.select("node.d").distinct()))
        texts = self.texts.where("doc_id is not null").select("doc_id", "text").mapInArrow(_held_texts(bits), "doc_id long, text string")
        met = mine.join(texts, mine["node.d"] == texts["doc_id"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        met = met.select(F.col("group.d").alias("group_d"), F.col("group.h").alias("group_h"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node.d", "node.h", F.col("root.d").alias("root_d"), F.col("root.h").alias("root_h"), "text")
        key = ["group_d", "group_h", "low", "high"]
        found = met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_find_links(self.n_gram, self.num, self.den), "a_d long, a_h long, b_d long, b_h long")
        return found.distinct().select(F.struct(F.col("a_d").alias("d"), F.col("a_h").alias("h")).alias("a"), F.struct(F.col("b_d").alias("d"), F.col("b_h").alias("h")).alias("b"))

    def links_across(self, classes: DataFrame, pairs: DataFrame) -> DataFrame:
        """(node, links): documents that each class links by ``pairs`` (a, b). Nodes that aren't classes are left out, since a class stands for them."""
        side = lambda x: classes.select(F.struct("d", "h").alias(x), F.col("members").alias(f"members_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.select(F.col("a").alias("node"), F.col("members_b").alias("links")).union(both.select("b", "members_a"))

    def run(self) -> DataFrame:
        survey = cut(self.texts.mapInArrow(_survey(self.n_gram), "doc_id long, mark long, n long, h long, h2 long, block int, counts binary"), "survey")
        rows = survey.where("block is null").select("doc_id", "mark", "n", "h", "h2")
        order = self.order = self.spark.sparkContext.broadcast(_order(survey))
        live = rows.where("doc_id is not null and n > 0")
        classes = cut(live.groupBy("h", "h2", "n").agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("members")), "classes")
        nodes = self.spark.sparkContext.broadcast(self.ids(classes.select("d")))
        told = self.texts.where("doc_id is not null").mapInArrow(
            _describe(self.n_gram, self.num, self.den, order, nodes), "doc_id long, h long, n long, typical double, segments array<long>, prefix array<long>, places array<int>, sketch array<long>"
        )
        # The bitmap lets few documents through that aren't nodes. They are real documents, so what they link is linked.
        told = cut(told.where("n > 0").select(F.struct(F.col("doc_id").alias("d"), "h").alias("node"), "n", "typical", "segments", "prefix", "places", "sketch"), "described")
        nodes.unpersist()

        segments = told.select("node", "typical", F.posexplode("segments").alias("fragment", "segment")).where("segment <> 0")
        heads = segments.groupBy("fragment", "segment").agg(F.max(F.struct("typical", "node")).getField("node").alias("b"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
        shared = segments.select("node", "fragment", "segment").join(heads, ["fragment", "segment"]).where(F.col("node") != F.col("b"))
        shared = shared.groupBy("node", "b").agg(F.count(F.lit(1)).alias("equal"))
        stars = shared.groupBy("node").agg(F.max(F.struct("equal", "b")).getField("b").alias("b")).select(F.col("node").alias("a"), "b")
        starred = self.verified(self.near(stars, told))
        roots = cut(components(starred), "star-roots")

        # Most n-grams of a prefix occur once. They go before anything wide is shuffled: their counts are of bare numbers.
        twice = cut(told.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "shared-grams")
        held = self.spark.sparkContext.broadcast(key_filter(twice, sized(twice.count())))
        kept = told.select("node", "n", "prefix", "places").mapInArrow(_frequent(held), f"node {NODE}, n long, at int, fragment int, gram long")
        grams = cut(kept.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "prefixes")
        key = ["fragment", "gram"]
        ends = [f("root." + c).alias(f"{c}_{f.__name__}") for c in ("d", "h") for f in (F.min, F.max)]
        mixed = grams.groupBy(*key).agg(*ends, F.count(F.lit(1)).alias("nodes")).where("d_min <> d_max or h_min <> h_max")
        mixed = cut(mixed.select(*key, "nodes"), "mixed-grams")
        some = grams.join(mixed.where(F.col("nodes") <= MANY).select(*key), key, "left_semi")
        one = some.select(*key, *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "n", "at")])
        other = some.select(*key, *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "at")])
        most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        allowed = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & self.similar(most, F.col("n_a"), F.col("n_b"))
        close = one.join(other, (one["fragment"] == other["fragment"]) & (one["gram"] == other["gram"]) & allowed).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
        rest = self.verified(self.near(close, told))
        # Written by itself, this table's size is known: while it is small, the rows that it selects are found without a shuffle of all.
        many = cut(mixed.where(F.col("nodes") > MANY).select(*key), "frequent-grams")
        if not many.isEmpty():
            rest = rest.union(self.links_of_many(grams.join(many, key, "left_semi"), classes)).distinct()
        rest = cut(rest, "links-across")

        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest)
        final = components(links)
        counts = self.links_inside(classes, roots).union(self.links_across(classes, rest)).groupBy("node").agg(F.sum("links").alias("links"))
        member = classes.select("h", "h2", "n", "members", F.struct("d", "h").alias("node")).join(final, "node", "left").join(counts, "node", "left")
        n_links = F.col("members") - 1 + F.coalesce("links", F.lit(0).cast("long"))
        member = member.select("h", "h2", "n", F.coalesce("root", "node").alias("root"), n_links.alias("n_links"))
        # The root is the node with the smallest first document, so that document is the smallest in reach.
        first = (F.col("doc_id") == F.col("root.d")) & (F.col("h") == F.col("root.h"))
        named = live.join(member, ["h", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("root.d").alias("component_id"), "n_links", "h", "mark", first.alias("is_first"))
        return named.union(rows.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long"), "h", "mark", F.lit(True)))


def jaccard_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_gram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, n_links, h (of its set), mark (``xxhash64`` of its text), is_first.

    ``is_first`` marks the documents that have both the component's smallest id and the set that stands for it.
    """
    return _Join(docs, id_col, text, n_gram, num, den).run()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_gram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, n_links (other documents it links with); documents link at a Jaccard similarity of num / den or more."""
    return jaccard_rows(docs, id_col, text, n_gram, num, den).select("doc_id", "n_shingles", "component_id", "n_links")
