"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's inputs are its own features and those of the lines before and after it; neighbouring labels
are tied by transition weights. Forward-backward gives each line's marginal of being good, and the mean
of the marginals, weighted by line length, is the document's quality, put on a scale where 0.5 separates
best by a logistic fit of two numbers.

The field is fitted on a bounded sample of labelled documents (at most TRAIN_DOCS, those with the smallest hashes, and of these
the first that hold TRAIN_LINES lines together); each line of a sampled document carries the document's label. The fit climbs one
objective: the chains' mean log likelihood, each chain weighted once, for its class and by one over its lines, less a ridge. Only
the text is an input of a score. Lines without words are left out of the chain. Null, empty and blank texts get the share of good
documents in the sample. Rows are scored one by one: repeated rows get equal scores, ids don't matter, null ones neither. With no
labelled document of either class every score is that share (0.5 without any). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, tidy
from .shingles import chunks, mix, slices, word_hashes

#: Most documents and lines that the fit reads; rounds and step of the fit; weight of the squared weights.
TRAIN_DOCS, TRAIN_LINES, ROUNDS, STEP, RIDGE = 3000, 400_000, 120, 0.15, 1e-3
#: Texts that are Python objects at a time.
ROWS = 512

_CLASSES = ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!?", "|", ".,;:'\"()-/")
_TABLE = np.zeros((len(_CLASSES) + 1, 256), np.int64)
for _i, _chars in enumerate(_CLASSES):
    _TABLE[_i, [ord(c) for c in _chars]] = 1
_TABLE[-1, 128:] = 1
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\"')"]] = True
N_FEATURES = 17


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines with words: features, word characters (bytes), index of the text."""
    lines: list[bytes] = []
    owner: list[int] = []
    again: list[bool] = []
    for i, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in (text or "").encode("utf-8", "replace").split(b"\n"):
            line = line.strip(b" \t\r\x0b\x0c")
            if line:
                lines.append(line)
                owner.append(i)
                again.append(line in seen)
                seen.add(line)
    if not lines:
        return np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, np.int64)
    sizes = np.array([len(x) for x in lines])
    data = np.frombuffer(b"".join(lines), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    symbols, upper, lower, digits, marks, bars, points, wide = (np.add.reduceat(t[data], starts).astype(float) for t in _TABLE)
    words, place = word_hashes(lines)
    n = np.bincount(place, minlength=len(lines)).astype(float)
    chars = np.maximum(sizes - (n - 1), 1.0)
    same_line = place[1:] == place[:-1]
    echo = np.bincount(place[1:][same_line & (words[1:] == words[:-1])], minlength=len(lines))
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])[same_line]
    distinct = _distinct(words, place, len(lines))
    distinct_pairs = _distinct(pairs, place[1:][same_line], len(lines))
    letters = np.maximum(upper + lower + wide / 2, 1)
    features = np.stack(
        [
            np.ones(len(lines)), np.log1p(n) / 5, np.minimum(symbols / chars * 4, 2), upper / letters, digits / chars * 2, np.minimum(marks / n, 2),
            _END[data[starts + sizes - 1]], np.minimum(chars / n / 10, 3), echo / n, distinct / n, np.minimum(bars / n * 2, 2), np.array(again, float), points / chars * 4,
            wide / chars * 2, (data[starts] >= 65) & (data[starts] <= 90), np.where(n > 1, distinct_pairs / np.maximum(n - 1, 1), 1), n < 3,
        ],
        axis=1,
    ).astype(float)
    return features, chars, np.array(owner)


def _distinct(values: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=size).astype(float)


def with_neighbours(features: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and of the line after in its text, or zeros."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    if len(owner) > 1:
        same = owner[1:] == owner[:-1]
        before[1:][same] = features[:-1][same]
        after[:-1][same] = features[1:][same]
    return np.concatenate([features, before, after], axis=1)


@dataclass
class Field:
    weights: np.ndarray  # of inputs, for the label good against bad
    moves: np.ndarray  # 2 x 2, from a line's label to the next one's
    scale: tuple[float, float]  # of the logistic fit
    prior: float

    def marginals(self, inputs: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Each line's probability of being good, by forward-backward within its text."""
        return _chains(inputs @ self.weights, owner, self.moves)[0]

    def lines(self, texts: list[str | None]) -> list[list[float]]:
        """Of every text, the marginals of its lines with words; the prior for each if the field wasn't fitted."""
        features, _, owner = line_features(texts)
        if not len(owner):
            return [[] for _ in texts]
        good = self.marginals(with_neighbours(features, owner), owner) if len(self.weights) else np.full(len(owner), self.prior)
        ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
        return [good[e - n : e].tolist() for e, n in zip(ends.tolist(), np.bincount(owner, minlength=len(texts)).tolist(), strict=True)]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        for begin, end in chunks(texts):
            features, chars, owner = line_features(texts[begin:end])
            if len(owner) and len(self.weights):
                good = _weighted(self.marginals(with_neighbours(features, owner), owner), chars, owner, end - begin)
                some = np.bincount(owner, minlength=end - begin) > 0
                out[begin:end][some] = _logistic(self.scale[0] + self.scale[1] * _logit(good[some]))
        return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _weighted(good: np.ndarray, chars: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(owner, good * chars, minlength=size) / np.maximum(np.bincount(owner, chars, minlength=size), 1)


def _chains(unary: np.ndarray, owner: np.ndarray, moves: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good for each line, the expected number of each move (weighted by the line's chain), and each line's chain's log partition; ``owner`` ascends."""
    counts = np.unique(owner, return_counts=True)[1]
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    counts, firsts = counts[order], firsts[order]
    living = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), "right")  # chains with at least t + 1 lines
    score = np.stack([np.zeros(len(unary)), unary], axis=1)
    ahead, back, expected = score.copy(), np.zeros_like(score), np.zeros((2, 2))
    for t in range(1, counts[0]):
        at = firsts[: living[t]] + t
        ahead[at] += np.logaddexp(ahead[at - 1][:, :1] + moves[0], ahead[at - 1][:, 1:] + moves[1])
    for t in range(counts[0] - 2, -1, -1):
        at = firsts[: living[t + 1]] + t
        later = back[at + 1] + score[at + 1]
        back[at] = np.logaddexp(later[:, :1] + moves[:, 0], later[:, 1:] + moves[:, 1])
    whole = ahead + back
    total = np.logaddexp(whole[:, 0], whole[:, 1])
    inner = np.ones(len(unary), bool)
    inner[firsts + counts - 1] = False
    at = np.flatnonzero(inner)
    if len(at):
        pair = ahead[at][:, :, None] + moves[None] + (back[at + 1] + score[at + 1])[:, None, :] - total[at][:, None, None]
        expected = (np.exp(pair) * (1.0 if weight is None else weight[at][:, None, None])).sum(0)
    return np.exp(whole[:, 1] - total), expected, total


def climb(theta: np.ndarray, inputs: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The objective at ``theta`` (weights of inputs, then the four moves) and its slope. ``weight`` is the same for all lines of a chain."""
    moves = theta[-4:].reshape(2, 2)
    unary = inputs @ theta[:-4]
    good, expected, partition = _chains(unary, owner, moves, weight)
    same = np.flatnonzero(owner[1:] == owner[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[same].astype(int), y[same + 1].astype(int)), weight[same])
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    total = weight[first].sum()
    value = ((unary * y * weight).sum() + (seen * moves).sum() - (partition * weight)[first].sum()) / total - RIDGE / 2 * (theta**2).sum()
    slope = np.concatenate([inputs.T @ ((y - good) * weight), (seen - expected).ravel()]) / total - RIDGE * theta
    return value, slope


def fit(features: np.ndarray, chars: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> Field:
    """Fits the field; ``owner`` ascends from 0, ``labels`` are the texts' (0 or 1)."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if not len(owner) or labels.min() == labels.max():
        return Field(np.zeros(0), np.zeros((2, 2)), (0.0, 1.0), prior)
    inputs = with_neighbours(features, owner)
    y = labels[owner]
    # Both classes weigh the same, and every chain as much as one line.
    weight = np.where(y == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / np.bincount(owner)[owner]
    theta, first, second = np.zeros(inputs.shape[1] + 4), 0.0, 0.0
    for k in range(1, ROUNDS + 1):
        _, slope = climb(theta, inputs, owner, y, weight)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + STEP * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    field = Field(theta[:-4], theta[-4:].reshape(2, 2), (0.0, 1.0), prior)
    held = np.unique(owner)
    x, target = _logit(_weighted(field.marginals(inputs, owner), chars, owner, len(labels)))[held], labels[held]
    a, b = 0.0, 1.0
    for _ in range(50):  # Newton's method on two numbers
        p = _logistic(a + b * x)
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(target - p).sum() - 1e-2 * a, ((target - p) * x).sum() - 1e-2 * (b - 1)])
        hess = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        move = np.linalg.solve(hess, grad)
        a, b = a + move[0], b + move[1]
        if np.abs(move).max() < 1e-9:
            break
    field.scale = (float(a), float(b))
    return field


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Field:
    """Fits on at most ``train_docs`` labelled documents that aren't held out, those whose ids have the smallest hashes, and on ``train_lines`` lines of them.

    Texts with more than a hundredth of these lines come last, the shorter first, so that no long text takes the place of many; of a text with more lines than all, the first ones are taken.
    """
    known = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label}`").isin(0, 1) & ~held_out(F.col(f"`{id_col}`")))
    known = known.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.min(f"`{label}`").cast("int").alias("_label")).withColumn("_hash", F.md5(F.col("_id").cast("string")))
    sample = known.orderBy("_hash", "_id").limit(train_docs)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_hash", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i, hashed, label, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                features, chars, _ = line_features([text])
                features, chars = features[:train_lines], chars[:train_lines]
                yield pa.RecordBatch.from_pydict({"id": pa.array([i], pa.int64()), "hash": [hashed], "label": pa.array([label], pa.int32()), "n": pa.array([len(chars)], pa.int64()), "features": [features.astype("<f4").tobytes()], "chars": [chars.astype("<f4").tobytes()]})
        tidy()

    found = cut(texts.mapInArrow(run, "id long, hash string, label int, n long, features binary, chars binary"), "lines")
    long = F.when(F.col("n") > train_lines // 100, F.col("n")).otherwise(0)
    so_far = Window.orderBy(long, "hash", "id", "n").rowsBetween(Window.unboundedPreceding, 0)  # over a bounded sample
    few = found.select("hash", "id", "n").withColumn("_lines", F.sum("n").over(so_far)).where(F.col("_lines") <= train_lines).select("id").distinct()
    rows = found.join(F.broadcast(few), "id", "left_semi").collect()
    rows.sort(key=lambda r: (r.id, r.n, r.features))
    features = np.concatenate([np.zeros((0, N_FEATURES), "<f4"), *(np.frombuffer(r.features, "<f4").reshape(-1, N_FEATURES) for r in rows)]).astype(float)
    chars = np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(r.chars, "<f4") for r in rows)]).astype(float)
    return fit(features, chars, np.repeat(np.arange(len(rows)), [r.n for r in rows]), np.array([r.label for r in rows], float))


def classify(docs: DataFrame, field: Field, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``score`` and ``predicted``, which replace columns of those names."""

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tidy()
        for batch in batches:
            parts = [field.scores(batch.slice(k, ROWS).to_pylist()) for k in range(0, len(batch), ROWS)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        tidy()

    (held,) = fresh(docs, "_score")
    kept = [c for c in docs.columns if c.lower() not in (score.lower(), "predicted")]
    wide = docs.withColumn(held, quality(F.col(f"`{text}`")))
    return wide.select(*[wide[f"`{c}`"] for c in kept], wide[held].alias(score), (wide[held] >= 0.5).cast("int").alias("predicted"))


def label_lines(docs: DataFrame, field: Field, text: str = "text", out: str = "lines") -> DataFrame:
    """``docs`` with an array of (good, label) for the lines with words, in order: each line's probability of being good, and 1 if that is 0.5 or more."""
    kind = "array<struct<good: double, label: int>>"

    @F.arrow_udf(kind)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for begin in range(0, len(batch), ROWS):
                rows += field.lines(batch.slice(begin, ROWS).to_pylist())
            yield pa.array([[{"good": g, "label": int(g >= 0.5)} for g in row] for row in rows], pa.list_(pa.struct([("good", pa.float64()), ("label", pa.int32())])))
        tidy()

    (held,) = fresh(docs, "_lines")
    wide = docs.withColumn(held, judge(F.col(f"`{text}`")))
    return wide.select(*[wide[f"`{c}`"] for c in docs.columns if c.lower() != out.lower()], wide[held].alias(out))
