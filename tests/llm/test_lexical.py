"""Ranked lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from trackweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, rank string"


def words(text):
    return TERM.findall((text or "").translate(UP))


def model(docs, items, k):
    held = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    held = [x for x in held if x[2]]
    total, count = sum(x[2] for x in held), len(held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in held:
            m = 25 + 75 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        found.sort()
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(found[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k):
    return sorted(map(tuple, lexical.search(spark.createDataFrame([(*d, "x") for d in docs], KIND).repartition(3), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, rank string"), k).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    known = [f"{a}{b}" for a in ("ka", "Lo", "mé", "日", "7x") for b in range(30)]
    weights = [1 / (i + 1) for i in range(len(known))]
    docs = [(i, " ".join(rng.choices(known, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(n)]
    docs += [(n + j, docs[3][1]) for j in range(25)]  # copies, so that scores are equal
    docs += [(None, docs[3][1]), (n + 40, None), (n + 41, ""), (n + 42, " .,! "), (3, docs[5][1]), (n + 43, "KA1,ka1;É ka1")]
    items = [(i, " ".join(rng.choices(known, k=12))) for i in range(8)] + [(8, docs[3][1]), (9, None), (10, "--"), (11, "nowhere"), (12, "ka1 ka1 KA1 lo0"), (12, "ka1"), (None, "日3 É")]
    return docs, items


@pytest.mark.parametrize("sizes", [(8192, 1 << 20, 4 << 20), (7, 300, 40)])
def test_ranks_match_the_model(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK_DOCS", "BLOCK_POSTINGS", "ITEM_BYTES"), sizes, strict=True):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(1, 120)
    assert run(spark, docs, items, 10) == model(docs, items, 10)


def test_empty_tables(spark):
    docs, items = corpus(2, 5)
    assert run(spark, [], items, 3) == run(spark, docs, [], 3) == run(spark, [(1, None)], items, 3) == []


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x300))) + " Éa_b-C9 日本. ａ\x7fz\x80"
    assert [t.decode() for t in lexical.terms(text)] == words(text)


def test_stops_early_and_is_still_exact():
    """A block whose bounds can't reach what is known is left untouched; otherwise all that may be among the best are completed."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 12, 400)
    numbers = np.concatenate([np.sort(rng.choice(20, s, replace=False)) for s in sizes]).astype(np.int32)
    tf = rng.integers(1, 9, len(numbers)).astype(np.int32)
    n = np.maximum(np.add.reduceat(np.append(tf, 0), np.minimum(np.concatenate([[0], np.cumsum(sizes)[:-1]]), len(tf))), 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    figures = lexical.Figures(400, int(n.sum()), np.bincount(numbers, minlength=20))
    import pyarrow as pa

    block = lexical.Block(pa.array(range(400)), n, offsets, numbers, tf, figures)
    none = np.zeros(0, np.int64)
    for _ in range(40):
        wanted = np.sort(rng.choice(20, 6, replace=False))
        times = rng.integers(1, 4, 6)
        by_term = np.zeros(20, np.int64)
        by_term[wanted] = times * figures.weights[wanted]
        whole = np.array([int((by_term[numbers[a:z]] * block.parts[a:z]).sum()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)])
        places, scores = block.best(wanted, times, 5, none)
        assert scores.tolist() == whole[places].tolist()
        kth = np.sort(whole)[-5]
        assert set(np.flatnonzero((whole >= kth) & (whole > 0))) <= set(places.tolist())
        over = np.full(5, int(whole.max()) * 50)
        assert len(block.best(wanted, times, 5, over)[0]) == 0
