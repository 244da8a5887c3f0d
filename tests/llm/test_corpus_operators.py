"""The corpus operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trackweave.llm import byte_bpe, exact_topk, jaccard_join, language_id, licenses, line_crf, mixing, quality_rules, suffix_dedup, token_counts

WORDS = [a + b for a in ("ka", "lo", "mi", "Ne", "pü", "ro") for b in ("", "sa", "ti", "vo", "zu,")]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("\n" if rng.random() < 0.08 else "") for _ in range(n)).strip()


def corpus():
    rng = random.Random(7)
    base, passage = prose(rng, 150), prose(rng, 70)
    texts = [None, "", " \n\t", "one", "one two", "One  TWO", base, base, base + " tail", prose(rng, 3000) * 4]
    for k in range(12):
        words = base.split(" ")
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + str(k)
        texts.append(" ".join(words))
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 60) for _ in range(8)]
    texts += ["Er " * 400, "x" * 700, "x" * 700, "abc<|endoftext|> d'you　 \xa0 12345 日本語\r\n\r\n!!", "é" * 300]
    return [(i, t, "en", None if i % 11 == 3 else f"s{i % 4}", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_token_counts_match_the_library(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    clashing = docs.withColumn("N_TOKENS", F.lit("x"))
    rows = {r.doc_id: r for r in token_counts.token_counts(clashing, path, 100).collect()}
    for i, text, *_ in corpus():
        n = len(model.encode(text or "", add_special_tokens=False))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((text or "").encode()), n, n > 100)
    assert token_counts.token_counts(none, path, 100).count() == 0


def test_pieces_are_the_text():
    for _, text, *_ in corpus():
        assert "".join(token_counts.pieces(text or "")) == (text or "")


def test_byte_bpe_matches_the_library_and_comes_back(docs, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    out = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).withColumn("back", byte_bpe.decode_column(F.col("ids"), path, public_tokenizers.PATTERN))
    digests = {r.doc_id: r for r in byte_bpe.digest_documents(docs, path, public_tokenizers.PATTERN).collect()}
    for r in out.collect():
        ids = model.encode_ordinary(r.text or "")
        assert r.ids == ids and bytes(r.back) == (r.text or "").encode()
        assert digests[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(none, path, public_tokenizers.PATTERN).count() == 0


def repeats(texts, length):
    seen = {}
    for raw in texts:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for raw in texts:
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        out.append(np.cumsum(gone[:-1]) > 0)
    return out


@pytest.mark.parametrize("hot", [1 << 20, 1])
def test_suffix_dedup_matches_brute_force(docs, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    rows = corpus()
    raws = [(r[1] or "").encode() for r in rows]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs.withColumn("KEPT", F.lit(1))).collect()}
    for (i, *_), raw, gone in zip(rows, raws, repeats(raws, suffix_dedup.LENGTH), strict=True):
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum()) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, bytes(found[i].kept)) == (len(raw), int(gone.sum()), spans, kept)
    if hot > 1:
        assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [1 << 20, 300])
def test_suffix_dedup_broadcasts_no_table(docs, monkeypatch, hot):
    """Tables that grow with the corpus look small by their compressed files; none may go through the driver."""
    plans, cut = [], suffix_dedup.cut

    def told(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    monkeypatch.setattr(suffix_dedup, "cut", told)
    plans.append(suffix_dedup.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def test_suffix_dedup_cuts_long_texts_into_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    rng = random.Random(3)
    raws = [prose(rng, 400) for _ in range(3)]
    raws.append(raws[0][300:1500] + raws[1][:900])
    gone = repeats([r.encode() for r in raws], suffix_dedup.LENGTH)
    frame = spark.createDataFrame(list(enumerate(raws)), "doc_id long, text string")
    places = suffix_dedup.repeated_windows(frame.select(F.col("doc_id").alias("id"), "text")).collect()
    for r in places:
        start, masks = np.array([s["start"] for s in r.spans], np.int64), np.array([[s["m0"], s["m1"], s["m2"]] for s in r.spans], np.int64)
        assert (suffix_dedup.covered(len(raws[r.id].encode()), start, masks) == gone[r.id]).all()
    assert {r.id for r in places} == {i for i, g in enumerate(gone) if g.any()}


def test_suffix_array_matches_sorting(tmp_path):
    from trackweave.llm.induced_sort import suffix_array

    rng = random.Random(5)
    for trial in range(60):
        sigma = rng.choice([1, 2, 5, 40])
        text = [rng.randrange(sigma) for _ in range(rng.randint(1, 70))]
        text = (text[: max(1, len(text) // 4)] * 5)[: len(text)] if trial % 3 == 0 else text
        order, common = suffix_array(np.array(text, np.uint16), sigma, tmp_path / str(trial), memory=rng.choice([4, 16, 40, 1000]))
        right = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == right
        for a, b, n in zip(right, right[1:], common.tolist()[1:], strict=False):
            k = 0
            while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert n == k


def components_by_hand(rows, n, num, den):
    sets, root = {}, {}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components_match_brute_force(docs, n, num):
    found = jaccard_join.jaccard_components(docs, n_gram=n, num=num, den=100)
    assert {tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()} == components_by_hand(corpus(), n, num, 100)


@pytest.mark.parametrize(("n", "num", "block"), [(3, 90, 256), (5, 80, 2), (2, 50, 3)])
def test_jaccard_counts_every_link(docs, spark, monkeypatch, n, num, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", block)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 16 if block < 256 else 1 << 13)
    rows = [(i, text) for i, text, *_ in corpus()]
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    right = {a: sum(b != a and bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) for b in sets) for a in sets}
    found = jaccard_join.jaccard_components(docs, n_gram=n, num=num, den=100).select("doc_id", "n_links").collect()
    assert {r.doc_id: r.n_links for r in found} == right and max(right.values()) > 2


def test_jaccard_counts_links_of_repeated_ids(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, near), (4, near), (4, near), (4, near + " end"), (2, near), (7, near + " end"), (8, "end " + near), (9, None)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n_gram=3)
    assert sorted((r.doc_id or -1, r.n_links) for r in found.collect()) == [(-1, 0), (2, 5), (4, 5), (4, 5), (4, 5), (7, 5), (8, 5), (9, 0)]


def test_jaccard_handles_empty_tables_null_ids_and_repeated_rows(spark, none):
    assert jaccard_join.jaccard_components(none).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, None)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n_gram=3)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found.collect()) == [(-1, -1), (2, 2), (4, 2), (4, 2), (9, 9)]


def test_line_crf_learns_and_scores_odd_texts(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 != 0
        text = "\n".join(prose(rng, 12).capitalize().replace("\n", " ") + "." if good else " ".join(w.upper() + "!!" for w in prose(rng, 8).split()) for _ in range(1 + i % 4))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "\n \n"), (903, "word " * 60_000)], "doc_id long, text string").withColumn("SCORE", F.lit("x"))
    field = line_crf.train(docs, spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r for r in line_crf.classify(docs, field).withColumn("held_out", line_crf.held_out(F.col("doc_id"))).collect()}
    held = [i for i in range(240) if found[i].held_out]
    assert len(held) > 40 and all(found[i].predicted == int(i % 3 != 0) for i in held)
    assert found[900].score == found[901].score == found[902].score == pytest.approx(field.prior)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_line_crf_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    unary, moves, owner = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 0, 0, 0, 2, 2, 5])
    good, expected, _ = line_crf._chains(unary, owner, moves)
    right, right_moves, at = np.zeros(7), np.zeros((2, 2)), 0
    for size in (4, 2, 1):
        total, sums, pairs = 0.0, np.zeros(size), np.zeros((2, 2))
        for code in range(2**size):
            y = [code >> k & 1 for k in range(size)]
            w = np.exp(sum(unary[at + k] * y[k] for k in range(size)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            sums += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += w
        right[at : at + size] = sums / total
        right_moves += pairs / total
        at += size
    assert np.allclose(good, right) and np.allclose(expected, right_moves)


def test_line_crf_without_labels_gives_the_prior(docs, spark):
    field = line_crf.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in line_crf.classify(docs, field).collect()} == {0.5}


def test_quality_rules_match_brute_force(docs, none):
    found = {r.doc_id: r for r in quality_rules.apply_rules(docs.withColumn("Kept", F.lit(1))).collect()}
    for i, text, *_ in corpus():
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in (k, k + 1, k + 2)} if len(grams) < 2000 else None
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        if covered is not None:
            assert r.n_repeat_words == len(covered)
            assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert quality_rules.apply_rules(none).count() == 0


def test_quality_rules_judge_lines(spark):
    lines = {"Plain words end here.": False, "no mark at all": True, "A | b | c. | d": True, "SHOUTING LOUD WORDS HERE!!": True, "Click here for more.": True, "a### b$$$ c***.": True, "": False}
    frame = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: r.f for r in frame.withColumn("f", quality_rules.line_fails(F.col("line"))).collect()} == lines


def test_language_id_fuses_evidence(spark):
    rng = random.Random(4)
    syllables = {"en": ["the", "ing", "and", "wh"], "de": ["sch", "ung", "ei", "tz"]}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(n))
    labelled = spark.createDataFrame([(i, text(lang, 60), lang) for i, lang in enumerate(["en", "de"] * 20)], "doc_id long, text string, lang string")
    rows = [(i, f"https://{lang}.example.org/{lang}/{i}", f"<html lang='{lang}'><script>x</script><p>{text(lang, 30)}</p></html>") for i, lang in enumerate(["en", "de"] * 15)]
    rows += [(100, "https://de.example.org/de/x", "<html lang=de><p></p></html>"), (101, None, None), (102, "bad", "<p>" + text("en", 30))]
    found = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), language_id.fit(labelled)).collect()}
    assert all(found[i].lang == ["en", "de"][i % 2] for i in range(30))
    assert found[100].lang == "de" and found[102].lang == "en" and len(found) == 33
    assert language_id.identify(spark.createDataFrame([], "page_id long, url string, html string"), language_id.fit(labelled)).count() == 0


def test_licenses_are_found_whole_and_changed(spark, docs, none):
    rng = random.Random(8)
    mit, bsd = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["BSD-3-Clause"]
    broken = " ".join(w for k, w in enumerate(mit.split()) if k % 9 != 4)
    rows = [(0, prose(rng, 300) + "\n" + mit + "\n" + prose(rng, 300)), (1, broken.upper()), (2, " ".join(mit.split()[: len(mit.split()) // 2])), (3, None), (4, ""), (5, (bsd + " " + prose(rng, 200) + " ") * 3), (6, "license " * 5000)]
    found = {(r.doc_id, r.license): r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == {(0, "MIT"), (1, "MIT"), (5, "BSD-3-Clause")}
    assert found[0, "MIT"].coverage == 1.0 and found[5, "BSD-3-Clause"].finds == 3 and 0.8 <= found[1, "MIT"].coverage < 1
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_licenses_find_adjacent_copies(name):
    notice = licenses.TEMPLATES[name]
    size, scanner = len(licenses.words_of(notice)), licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    for before, after in (("", ""), ("x ", " y"), ("some words before ", " and some after")):
        for copies in (1, 2, 3, 7):
            own = [x for x in scanner.scan(before + " ".join([notice] * copies) + after) if x[0] == name]
            first = len(before.split())
            assert own == [(name, size, size, first + k * size, first + (k + 1) * size - 1) for k in range(copies)]


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert licenses.align(list("abcdef"), list("abXdef")) == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]


@pytest.mark.parametrize(("k", "bins", "block"), [(3, 256, 2048), (5, 4, 7)])
def test_exact_topk_matches_brute_force(spark, monkeypatch, k, bins, block):
    monkeypatch.setattr(exact_topk, "BINS", bins)
    monkeypatch.setattr(exact_topk, "DATA_BLOCK", block)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(i, [0.5, -0.25, 1.0, 0.0]) for i in range(60, 90)]
    rows += [(91, None), (92, [1.0, None, 0.0, 0.0]), (93, [float("nan"), 0.0, 0.0, 0.0]), (94, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = sorted(tuple(r) for r in exact_topk.top_k(frame, frame.where("vec_id % 20 = 0"), k).collect())
    whole = {i: np.floor(64 * np.array(v, "f4").astype("f8")).astype(int) for i, v in rows[:90]}
    right = [(q, n + 1, i, s) for q in whole if q % 20 == 0 for n, (s, i) in enumerate(sorted(((int(whole[q] @ v), i) for i, v in whole.items() if i != q), key=lambda x: (-x[0], x[1]))[:k])]
    assert found == sorted(right)


def test_exact_topk_ranks_repeated_queries_row_by_row(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in exact_topk.top_k(frame, asked, 4).collect())
    up = [(3, k + 1, 29 - k, 64 * 64 * (29 - k)) for k in range(4)]
    assert found == sorted([*up, *up, *[(3, k + 1, i, -64 * 64 * i) for k, i in enumerate([0, 1, 2, 4])]])


def test_exact_topk_never_broadcasts_blocks(spark):
    """Blocks of queries stand once for each slice, of which Spark's estimate of their small file knows nothing; their copies would go through the driver."""
    frame = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    plan = exact_topk.top_k(frame, frame.where("vec_id % 20 = 0"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_exact_topk_with_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_topk.top_k(frame, frame.where("vec_id = 0"), 20).collect()] == [(0, 1, 1, 0)]
    assert exact_topk.top_k(frame.limit(0), frame.limit(0), 20).count() == 0


def test_mixing_reaches_targets(docs, none):
    rows = mixing.mix(docs, shard_words=400).collect()
    again = mixing.mix(docs.repartition(5), shard_words=400).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == len(corpus())
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by_source.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert sum(group[0].target for group in by_source.values()) == pytest.approx(1.5 * total)
    for group in by_source.values():
        assert sum(r.taken for r in group) == pytest.approx(group[0].target, abs=32 * (1 + group[0].source_size / 400))
        assert group[0].target <= 2 * group[0].source_size
    assert mixing.mix(none).count() == 0


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(9)
    for _ in range(4):
        weights = [(f"k{i}", rng.randrange(0, 1000)) for i in range(9)] + [(None, 77)]
        seats = rng.randrange(1, 60)
        frame = spark.createDataFrame(weights, "key string, weight long").withColumn("seats", F.lit(seats).cast("long"))
        found = {r.key: r.quota for r in mixing.apportion(frame, [], ["key"], "weight", "seats").collect()}
        won = sorted(((-w / (2 * j + 1), k is None, k or "", j) for k, w in weights if w for j in range(seats)))[:seats]
        assert found == {k: sum((k is None, k or "") == x[1:3] for x in won) for k, _ in weights}


def test_production_settings_spill_and_recurse(tmp_path, monkeypatch):
    """A shard of the least size: the queue goes to disk, strings of names are sorted two levels deep, and the order is right."""
    from trackweave.llm import induced_sort

    rng, spilled = np.random.default_rng(1), []
    spill = induced_sort.DiskQueue._spill
    monkeypatch.setattr(induced_sort.DiskQueue, "_spill", lambda self: (spilled.append(self.n_held), spill(self))[1])
    base = np.frombuffer(" ".join(rng.choice(WORDS, 60_000)).encode(), np.uint8).astype(np.uint16) + 1
    pieces = [base[k : k + 300] for k in rng.integers(0, len(base) - 300, suffix_dedup.SHARD_BYTES // 600 + 1)]
    data = np.concatenate([np.append(p, 0) for p in (*pieces, *pieces)]).astype("<u2")
    levels: list[int] = []
    order, common = induced_sort.suffix_array(data, 257, tmp_path / "sort", levels=levels)
    assert len(data) >= suffix_dedup.SHARD_BYTES and len(levels) >= 3 and levels[0] > 4 * levels[2] and sum(spilled) > len(data)
    assert (np.sort(order) == np.arange(len(data))).all()
    for i in rng.integers(1, len(data), 4000).tolist():
        a, b = bytes(data[order[i - 1] :][:400].astype(">u2")), bytes(data[order[i] :][:400].astype(">u2"))
        n = next((k for k in range(0, min(len(a), len(b)), 2) if a[k : k + 2] != b[k : k + 2]), min(len(a), len(b))) // 2
        assert common[i] == min(n, induced_sort.CAP) and (a < b or n == 400)
    assert not any((tmp_path / "sort" / "deeper").glob("*"))


def test_nothing_is_removed_without_the_suffix_array(monkeypatch):
    import pyarrow as pa

    piece = b"x" * 150 + bytes(range(60))
    batch = pa.RecordBatch.from_pydict({"h1": [1], "h2": [2], "n": pa.array([11], pa.int32()), "m": [2], "piece": pa.array([piece], pa.binary())})
    (found,) = list(suffix_dedup._sorted_shard(iter([batch])))
    assert found.column("m0").to_pylist() == [(1 << 11) - 1]
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text, *_: (np.arange(len(text)), np.zeros(len(text), np.uint8)))
    assert sum(b.num_rows for b in suffix_dedup._sorted_shard(iter([batch]))) == 0


def test_suffix_dedup_tells_rows_apart(spark):
    rng = random.Random(12)
    shared, own = prose(rng, 60), prose(rng, 60)
    rows = [(None, shared), (3, shared), (3, shared), (3, own), (4, None), (5, "é" * 99), (6, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_Removed", F.lit("x"))
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.kept_text) for r in suffix_dedup.remove_repeats(frame, kept_as="text").collect())
    n = len(shared.encode())
    assert found == sorted([(-1, n, n, ""), (3, n, n, ""), (3, n, n, ""), (3, len(own.encode()), 0, own), (4, 0, 0, None), (5, 198, 0, "é" * 99), (6, 0, 0, "")], key=lambda r: (r[0], r[1], r[2], r[3] or "")) or len(found) == 7


def test_quality_verdicts_can_be_filtered(spark):
    import time

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def seconds(rows):
        began = time.time()
        rows.write.format("noop").mode("overwrite").save()
        return time.time() - began

    whole = quality_rules.apply_rules(docs)
    seconds(whole)
    assert seconds(whole.where("kept").where("not base_failed").select("doc_id", "kept")) < 3 * seconds(whole) + 1
    assert whole.where("kept").count() == sum(r.kept for r in whole.select("kept").collect())
    assert whole.where("not kept")._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_quality_counts_repeated_words_of_long_texts(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(n)) for n in (3, 40, 2500, 9000)]
    frame = spark.createDataFrame([(None if i == 1 else i, t) for i, t in enumerate(texts)] + [(7, texts[1]), (7, texts[1])], "doc_id long, text string").withColumn("N_WORDS", F.lit(1))
    found = sorted((r.n_words, r.n_repeat_words) for r in quality_rules.apply_rules(frame).collect())
    right = []
    for t in (*texts, texts[1], texts[1]):
        words = t.split(" ")
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = {g: 0 for g in grams}
        for g in grams:
            times[g] += 1
        right.append((len(words), len({j for k, g in enumerate(grams) if times[g] > 1 for j in (k, k + 1, k + 2)})))
    assert found == sorted(right)


def test_licenses_match_every_stretch_of_small_texts():
    rng = random.Random(3)
    for _ in range(300):
        letters = "abcdefgh"[: rng.choice([3, 5, 8])]
        template = licenses.Template([rng.choice(letters) for _ in range(rng.randint(3, 7))], licenses.COVERAGE)
        words = [rng.choice(letters + "xyz") for _ in range(rng.randint(0, 22))]
        if rng.random() < 0.5:
            k = rng.randrange(len(words) + 1)
            words[k:k] = [w for w in template.words if rng.random() < 0.95]
        found = list(template.finds(words, 0, len(words)))
        held = any(len(licenses.align(words[i:j], template.words)) >= template.least for i in range(len(words)) for j in range(i + 1, min(len(words), i + template.span) + 1))
        assert held == bool(found) and all(len(x) >= template.least for x in found)
        assert all(a[-1] < b[0] for a, b in zip(found, found[1:], strict=False))


def test_noisy_licenses_take_time_in_proportion():
    import time

    rng = random.Random(1)
    mit, scanner = licenses.words_of(licenses.TEMPLATES["MIT-text"]), licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    words = []
    for _ in range(12):
        copy = list(mit)
        for _ in range(25):
            copy.pop(rng.randrange(len(copy)))
        for _ in range(40):
            copy.insert(rng.randrange(len(copy) + 1), rng.choice([*mit, "stray", "word"]))
        words += copy
    began = time.process_time()
    found = [x for x in scanner.scan(" ".join(words)) if x[0] == "MIT-text"]
    assert len(found) >= 6 and time.process_time() - began < 10


def test_a_long_tag_is_read_once():
    import time

    began = time.process_time()
    assert language_id.declared("<meta " + "content-language' " * 60_000 + ">") == ""
    assert time.process_time() - began < 0.5
    assert language_id.declared("<meta http-equiv='Content-Language' x=1 CONTENT = 'DE-at'>") == "de"
    assert language_id.declared("<meta content='fr' http-equiv='content-language'><html lang=es>") == "es"


def test_one_long_text_does_not_switch_the_classifier_off(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(WORDS) for _ in range(40)) + "." for _ in range(40)]
    rows = [(i, good[i % 40] if i % 2 else "# $ | > ## %%") for i in range(60)]
    ids = [r[0] for r in rows]
    long = "\n".join(good * 5)
    for extra in range(100, 140):  # whichever of these has the smallest hash
        rows.append((extra, long))
        ids.append(extra)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 or i >= 100), 0) for i in ids], "doc_id long, quality int, toxic int")
    field = line_crf.train(docs, labels, train_lines=150)
    scores = {r.doc_id: r.score for r in line_crf.classify(docs, field).collect()}
    assert min(scores[i] for i in range(1, 60, 2)) > max(scores[i] for i in range(0, 60, 2))
    only = line_crf.train(docs.where("doc_id >= 100"), labels, train_lines=50)
    assert only is not None


def test_licenses_are_found_among_stray_words(spark):
    bsd = licenses.TEMPLATES["BSD-3-Clause"]
    spread = " ".join(w + " foo bar" for w in bsd.split())
    stray = "redistribution source " * 10 + " lorem" * 30 + " " + spread + " ipsum" * 40 + " permitted binary" * 9
    rows = [(1, spread), (2, stray), (2, stray), (None, spread)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("LICENSE", F.lit("x")).withColumn("_id", F.lit(0))
    found = sorted((r.doc_id or -1, r.license, r.matched) for r in licenses.scan_licenses(frame).collect())
    assert found == [(-1, "BSD-3-Clause", 21), (1, "BSD-3-Clause", 21), (2, "BSD-3-Clause", 21), (2, "BSD-3-Clause", 21)]
    whole = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE).scan("x " + licenses.TEMPLATES["MIT-text"] + " y")
    assert [(x[0], x[1] == x[2]) for x in whole] == [("MIT", True), ("MIT-text", True)]


def test_markup_without_ends_is_read_in_one_pass():
    import time

    began = time.time()
    assert language_id.visible("<script>" * 20_000).strip() == "" and language_id.visible("<" * 200_000) == "<" * 200_000
    language_id.visible("<!-- " * 40_000)
    language_id.declared("<html " * 30_000)
    assert time.time() - began < 5
    assert language_id.visible("a<b>c</b><!-- x > -->d<SCRIPT a>z<z</script >e &amp; f") == "a c  d e & f"
    assert language_id.declared("<meta http-equiv='content-language' content='DE'><html lang=fr>") == "de" and language_id.declared("<html lang='fr'>") == "fr"


def test_language_posteriors_match_plain_python(spark):
    import math

    rng = random.Random(14)
    names = ["de", "en"]
    table = np.log(np.random.default_rng(2).dirichlet(np.ones(language_id.BUCKETS), 2))
    rows = [(k if k != 5 else None, rng.choice(["https://a.de/de/x", "http://b.com/en/y", "https://c.a.de/z", None, "bad"]), rng.choice(["<html lang=de>", "<html lang='en'>", "<p>", ""]) + prose(rng, 8)) for k in range(40)]
    rows += rows[:3] + [(90, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("guess", F.lit("x")).withColumn("HOST", F.lit("y"))
    facts = []
    for _, url, html in rows:
        text = language_id.visible(html)
        likely = [float(v) * language_id.TEMPER for v in table @ (np.bincount(language_id.trigrams(text), minlength=language_id.BUCKETS) if text.strip() else np.zeros(language_id.BUCKETS))]
        host, suffix, code = language_id.address(url)
        facts.append({"likely": likely, "guess": likely.index(max(likely)), "host": host, "suffix": suffix, "code": code, "said": language_id.declared(html)})
    right = []
    for i, f in enumerate(facts):
        rest = facts[:i] + facts[i + 1 :]
        scores = []
        for k in (0, 1):
            mine = [g for g in rest if g["guess"] == k]
            base = (len(mine) + language_id.ADDED) / (len(rest) + 2 * language_id.ADDED)
            prior = base
            for key, strength in (("suffix", language_id.SUFFIX_STRENGTH), ("host", language_id.HOST_STRENGTH)):
                prior = (sum(g[key] == f[key] for g in mine) + strength * prior) / (sum(g[key] == f[key] for g in rest) + strength)
            score = f["likely"][k] + math.log(prior)
            for key in ("said", "code"):
                score += math.log((sum(g[key] == f[key] for g in mine) + language_id.ADDED) / (len(mine) + language_id.ADDED * len({g[key] for g in facts})))
            scores.append(score)
        best = scores.index(max(scores))
        right.append((names[best], round(1 / sum(math.exp(s - max(scores)) for s in scores), 6)))
    found = language_id.identify(frame, (names, table)).collect()
    assert sorted((r.lang, round(r.confidence, 6)) for r in found) == sorted(right)


def test_language_samples_are_the_smallest_hashes(spark):
    rows = [(i, "w" * (i + 1), "aa" if i % 10 else "bb") for i in range(300)] + [(None, "x", "aa"), (9, "zz", "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("slice", F.lit(1)).withColumn("_lang", F.lit(1))
    names, table = language_id.fit(frame, train_docs=7)
    sums = {}
    for lang in ("aa", "bb"):
        ids = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, x in rows if x == lang and i is not None)[:7]
        sums[lang] = sum(np.bincount(language_id.trigrams(t), minlength=language_id.BUCKETS) for i, t, x in rows if x == lang and i in {k for _, k in ids}) + language_id.ADDED
    assert names == ["aa", "bb"] and np.allclose(table, np.log(np.stack([sums[n] / sums[n].sum() for n in names])))
    assert language_id.fit(frame.limit(0))[0] == ["und"]


def test_exact_topk_takes_large_and_empty_vectors(spark):
    big = [1e12, -1e12, 3.0]
    rows = [(0, big), (1, big), (1, big), (2, [1.0, 2.0, 3.0]), (3, []), (4, []), (20, [1e300, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ids", F.lit(1)).withColumn("BLOCK", F.lit(1))
    found = sorted(tuple(r) for r in exact_topk.top_k(frame, frame.where("vec_id in (0, 3)"), 3).collect())
    most = exact_topk.MOST - 1
    small = int(np.floor(64 * 1e12)) * (64 - 128) + 192 * 192
    assert found == [(0, 1, 1, most), (0, 2, 1, most), (0, 3, 20, most), (3, 1, 4, 0)] and small < 0


def test_byte_bpe_knows_unknown_ids(spark):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(1, [1, 2]), (2, [10**9]), (3, [-1]), (4, []), (5, None), (6, [1, None])]
    frame = spark.createDataFrame(rows, "k int, ids array<int>").withColumn("b", byte_bpe.decode_column(F.col("ids"), path, pattern))
    found = {r.k: r.b for r in frame.collect()}
    assert found[1] and found[2] is None and found[3] is None and bytes(found[4]) == b"" and found[5] is None and found[6] is None
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string").withColumn("IDS", F.lit("x")).withColumn("decoded_SHA256", F.lit("x"))
    coded = byte_bpe.code_documents(docs, path, pattern).collect()
    assert len(coded) == 3 and len({tuple(r.ids) for r in coded}) == 1 and {r.decoded_sha256 for r in coded} == {hashlib.sha256(b"a b").hexdigest()}


def test_texts_with_odd_spaces_are_still_cut():
    text = "one\u00a0two " + "three four " * 50 + "five\u3000 six seven"
    found = token_counts.pieces(text)
    assert "".join(found) == text and len(found) > 90 and max(map(len, found)) < 20
    assert "\u00a0" not in [p[0] for p in found]


def test_line_crf_climbs_one_objective():
    rng = np.random.default_rng(0)
    owner, y = np.repeat([0, 1, 2], [4, 1, 3]), np.array([1, 1, 1, 1, 0, 1, 1, 1.0])
    inputs, weight, theta = rng.normal(size=(8, 3)), np.repeat([0.5, 2, 1], [4, 1, 3]), rng.normal(size=7)
    _, slope = line_crf.climb(theta, inputs, owner, y, weight)
    step = [(line_crf.climb(theta + 1e-6 * e, inputs, owner, y, weight)[0] - line_crf.climb(theta - 1e-6 * e, inputs, owner, y, weight)[0]) / 2e-6 for e in np.eye(7)]
    assert np.allclose(step, slope, atol=1e-7)


def test_line_crf_labels_lines(spark):
    good, bad = "Plain words end here and go on.", "BUY!! NOW!! BUY!!"
    rows = [(i, "\n".join([good] * 4) if i % 2 else "\n".join([bad] * 3)) for i in range(80)] + [(None, good), (7, good), (7, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Lines", F.lit(1))
    field = line_crf.train(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int"))
    asked = spark.createDataFrame([(1, f"{good}\n\n{good}\n{bad}\n{bad}"), (2, None), (3, " ")], "k int, text string").withColumn("Lines", F.lit(1))
    found = {r.k: r.lines for r in line_crf.label_lines(asked, field).collect()}
    assert [x.label for x in found[1]][0] == 1 and [x.label for x in found[1]][-1] == 0 and len(found[1]) == 4 and found[2] == [] and found[3] == []
    scored = line_crf.classify(docs, field).where("doc_id is null or doc_id = 7").collect()
    assert len(scored) == 4 and line_crf.classify(docs.limit(0), field).count() == 0


def test_jaccard_compares_groups_of_many_nodes(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MANY", 1)
    monkeypatch.setattr(jaccard_join, "PAIRS", 2)
    found = jaccard_join.jaccard_components(docs.withColumn("H", F.lit(1)).withColumn("mark", F.lit("x")), n_gram=2, num=50, den=100)
    assert {tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()} == components_by_hand(corpus(), 2, 50, 100)


def test_mixing_deals_groups_and_odd_rows(spark):
    rng = random.Random(15)
    rows = [(None if i % 9 == 0 else i // 2, prose(rng, rng.randint(1, 120)), rng.choice(["a", "a", "a", "b", None])) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("ring", "SHARD", "_s", "quota")})
    found = mixing.mix(frame, shard_words=150, group=3).collect()
    assert len(found) == 200 and all(0 <= r.taken <= 2 * r.size for r in found)
    for source in ("a", "b", None):
        mine = [r for r in found if r.source == source]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=32 * (1 + mine[0].source_size / 150))
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(frame.repartition(7), shard_words=150, group=3).collect()) == sorted((r.doc_id or -1, r.size, r.taken) for r in found)


def test_byte_bpe_encodes_a_word_once():
    """Words of a task's texts are encoded once, also when there are many; longest tokens that don't fit are stepped back from."""
    import tiktoken

    path, chance = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), random.Random(5)
    ranks = byte_bpe.read_ranks(path)
    coder, model = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = sorted({"".join(chance.choice(("th", "ou", "ing", "re", "an", "q", "é", "tion", "bl")) for _ in range(6)) for _ in range(100_000)})[:90_000]
    assert len(words) == 90_000
    text, asked, encode = " ".join(words), [], coder.encode_word
    coder.encode_word = lambda word: asked.append(word) or encode(word)
    ids = coder.encode(text)
    assert ids == model.encode_ordinary(text) and len(asked) >= 90_000
    asked.clear()
    assert coder.encode(text) == ids and not asked


def test_bitmaps_let_few_other_keys_through(spark):
    """A bitmap holds all its keys, and of others about one in two hundred at most, or what passes it would follow the size of the whole table."""
    from trackweave.llm.bitmaps import key_filter, may_hold, sized
    from trackweave.llm.shingles import mix

    keys = mix(np.arange(107_000, dtype=np.uint64), 17).view(np.int64)
    frame = spark.createDataFrame([(int(k),) for k in keys[:7_000]], "key long")
    bits = np.frombuffer(key_filter(frame, sized(7_000)), np.uint8)
    assert may_hold(bits, keys[:7_000]).all() and may_hold(bits, keys[7_000:]).mean() < 0.01
    crowded = np.frombuffer(key_filter(frame, (12, 1)), np.uint8)  # more keys than bits
    assert may_hold(crowded, keys[:7_000]).all()
    none = np.frombuffer(key_filter(frame.limit(0), sized(0)), np.uint8)
    assert not may_hold(none, keys).any()
