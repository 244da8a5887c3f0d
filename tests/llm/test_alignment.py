"""Cross-tokenizer alignment against a token-by-token model."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackweave.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
KIND = "doc_id long, text string, pair string, chunk string"
TEXTS = [
    None, "", " ", "   ", "one", "One two  three   ", " lead and tail ", "a\n\nb \n c\t d\r\n", "<s> </s> <unk> <0x41> <|endoftext|>x", "a▁b", "▁", "日本語 のテキスト\r\n", "x\x00y \x1f z \x85 q",
    "é\xa0x \xa0 \xa0y", "don't we'll  I'M 12345 678", "ﬁne ￼ \U0001f600\U0001f600 \U0001f469‍\U0001f52c", "z" * 5000, " ".join(["repeat"] * 3000), "wörd " * 50, "a 　 b ​ c ﻿ d", "don't we'll  I'M 12345 678",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment._byte_of()


def spelt(libraries, text):
    """(A's ids and bytes, B's ids and bytes), or None."""
    a, b, byte_of = libraries
    if not text:
        return None
    e = a.encode(f" {text}", add_special_tokens=False)
    one = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    two = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        two.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = f" {text}".encode()
    return (one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else None


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def model(libraries, texts):
    """Every document by comparing all tokens of both sides."""
    docs = []
    counts = Counter()
    for text in texts:
        found = spelt(libraries, text)
        if found is None:
            docs.append(None)
            continue
        one, two = map(spans, found)
        cuts = sorted({e for *_, e in one} & {e for *_, e in two})
        groups = []
        begin = 0
        for c in cuts:
            groups.append(",".join(str(i) for i, s, e in one if begin < e <= c) + "|" + ",".join(str(i) for i, s, e in two if begin < e <= c))
            begin = c
        links, low = [], 0
        for i, s, e in one:
            while two[low][2] <= s:
                low += 1
            k = low
            while k < len(two) and two[k][1] < e:
                links.append((i, two[k][0]))
                k += 1
        counts.update(links)
        docs.append((len(one), len(two), groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0,) * 6 + ("",))
        else:
            n_a, n_b, groups, links = d
            out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, counts, most


def figures(df):
    return sorted((r.doc_id is None, r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("chunk_bytes", [alignment.CHUNK_BYTES, 200])
def test_documents_match_the_model(spark, libraries, monkeypatch, chunk_bytes):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(alignment, "STEP_BYTES", 100)
    docs = spark.createDataFrame([(i, t, "p", "c") for i, t in enumerate(TEXTS)], KIND).repartition(3)
    expected, counts, most = model(libraries, TEXTS)
    assert figures(alignment.align_documents(docs, A, B)) == [(False, i, *x) for i, x in enumerate(expected)]
    found = alignment.pair_counts(alignment.chunks(docs, A, B, "doc_id", "text")).collect()
    assert {(r.a_id, r.b_id): (r.links, r.is_best) for r in found} == {p: (n, n == most[p[1]]) for p, n in counts.items()}


def test_whole_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    expected, *_ = model(libraries, [r.text for r in rows])
    assert figures(alignment.align_documents(docs, A, B)) == [(False, r.doc_id, *x) for r, x in zip(rows, expected, strict=True)]


def test_repeats_null_ids_and_empty_tables(spark, libraries):
    rows = [(1, "same words here", None, None), (1, "same words here", None, None), (None, "same words", None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, KIND).withColumn("n_a", F.lit("x"))
    found = alignment.align_documents(docs, A, B).collect()
    expected, *_ = model(libraries, [r[1] for r in rows])
    assert sorted((r.n_a, r.count_sum) for r in found) == sorted((x[0], x[5]) for x in expected)
    assert sorted((r.doc_id is None) for r in found) == [False, False, True, True]
    none = spark.createDataFrame([], KIND)
    assert alignment.align_documents(none, A, B).count() == 0


def test_links_are_the_overlaps():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(1, 5, 9)
        n = 40
        sides = []
        for _ in range(2):
            ends = np.unique(np.append(rng.integers(1, n, 12), n))
            sides.append(np.diff(ends, prepend=0))
        a, b = (np.arange(len(x)) for x in sides)
        cuts, group_a, group_b, link_a, link_b = alignment.align(a, b, *sides)
        ends_a, ends_b = map(np.cumsum, sides)
        every = {(i, j) for i in a for j in b if max(ends_a[i] - sides[0][i], ends_b[j] - sides[1][j]) < min(ends_a[i], ends_b[j])}
        assert set(zip(link_a.tolist(), link_b.tolist(), strict=True)) == every and len(link_a) == len(every)
        assert cuts.tolist() == sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        assert [int(sum(cuts < e)) for e in ends_a] == group_a.tolist() and [int(sum(cuts < e)) for e in ends_b] == group_b.tolist()
        assert sizes.min() > 0
