"""Language of web pages by Bayesian evidence fusion.

The posterior of a language is proportional to the product of

* the likelihood of the page's visible text under a byte-trigram model of each language, tempered by TEMPER, since trigrams aren't independent,
* the probability that a page in that language declares the markup language it does,
* the probability of the language code that the address holds,
* a prior of the page's host, smoothed towards its address suffix (top-level domain), and that towards the whole table.

Priors and the two declaration tables are counts by grouped aggregation over all pages, of the languages that the text alone
suggests; each page's own count is taken out of its priors. The trigram model is fitted on a bounded sample of labelled
documents (TRAIN_DOCS of each language, those with the smallest hashes).

Null or empty markup leaves the other evidence; a null address counts as host ''. Ties go to the first language by name. Repeated
rows and rows with a null id are pages of their own. An empty table gives an empty result; without labelled documents every page is "und".
Other columns play no part. Counts are joined to the pages by host, suffix and codes: a hot value has one row of counts, so Spark broadcasts
these or splits the pages' side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy
from .shingles import slices as in_slices

#: Documents of each language in the sample; buckets of trigrams; weight of a trigram's evidence; strengths of the priors; added counts.
TRAIN_DOCS, BUCKETS, TEMPER, HOST_STRENGTH, SUFFIX_STRENGTH, ADDED = 400, 1 << 14, 0.05, 4.0, 20.0, 0.5

_RAW = re.compile(r"(?i)<(script|style|noscript|template)\b")
_RAW_ENDS = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript", "template")}
_HEADS = re.compile(r"(?i)<(html|meta)\b")
#: What stands before a tag's language, if anything must, and the attribute that gives it; one after the other, so that a tag is read once.
_LANG = {
    "html": (None, re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})""")),
    "meta": (re.compile(r"""(?i)content-language["']"""), re.compile(r"""(?i)content\s*=\s*["']?([a-z]{2,3})""")),
}
_ADDRESS = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*(/[^?#]*)?")


def visible(markup: str | None) -> str:
    """The text without tags, comments and the bodies of scripts and the like, in one pass: what has no end is searched once only."""
    text, out, at, endless = markup or "", [], 0, set()
    while (k := text.find("<", at)) >= 0:
        out.append(text[at:k])
        end = -1
        if text.startswith("<!--", k) and "<!--" not in endless:
            end = text.find("-->", k + 4) + 2 if text.find("-->", k + 4) >= 0 else -1
            if end < 0:
                endless.add("<!--")
        elif (raw := _RAW.match(text, k)) and (name := raw[1].lower()) not in endless:
            found = _RAW_ENDS[name].search(text, raw.end())
            end = found.end() - 1 if found else -1
            if end < 0:
                endless.add(name)
        if end < 0:
            end = text.find(">", k + 1)
        if end < 0:
            at = k
            break
        out.append(" ")
        at = end + 1
    out.append(text[at:])
    return unescape("".join(out))


def declared(markup: str | None) -> str:
    """The language that the first html or meta tag with one declares."""
    text, at = markup or "", 0
    while found := _HEADS.search(text, at):
        end = text.find(">", found.end())
        tag = text[found.end() : end if end >= 0 else len(text)]
        before, attribute = _LANG[found[1].lower()]
        begin = before.search(tag) if before else None
        if (begin or not before) and (code := attribute.search(tag, begin.end() if begin else 0)):
            return code[1].lower()
        if end < 0:
            break
        at = end
    return ""


def address(url: str | None) -> tuple[str, str, str]:
    """Host, its last label, and a two-letter first part of the path, each '' if absent."""
    found = _ADDRESS.match(url or "")
    if not found:
        return "", "", ""
    host = (found[1] or "").lower().rstrip(".")
    first = (found[2] or "").split("/")[1:2]
    code = first[0].lower() if first and re.fullmatch("[A-Za-z]{2}", first[0]) else ""
    return host, host.rpartition(".")[2], code


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text, lower-cased, with white space as single spaces."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(18)).astype(np.int64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages by name, and log likelihoods of trigrams by language."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and id is not null")
    rows = rows.withColumn("hash", F.md5(F.col("id").cast("string"))).withColumn("slice", F.substring("hash", 1, 3))
    # A language may hold most rows. Counts by slice of the hash tell which slices hold its smallest hashes; only those are ranked.
    upward = Window.partitionBy("lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upward), F.lit(0)))
    slices = slices.where(F.col("before") < train_docs).select("lang", "slice")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    chosen = rows.select("id", "lang", "hash", "slice").join(slices, ["lang", "slice"], "left_semi").withColumn("place", place).where(F.col("place") <= train_docs)
    sample = rows.select("id", "lang", "text").join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in in_slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.bincount(trigrams(text or ""), minlength=BUCKETS)
        for name, counts in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "counts": [counts.astype("<i8").tobytes()]})

    sums: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(count, "lang string, counts binary").collect():
        sums[row.lang] = sums.get(row.lang, 0) + np.frombuffer(row.counts, "<i8")
    names = sorted(sums) or ["und"]
    table = np.stack([sums.get(n, np.zeros(BUCKETS)) for n in names]) + ADDED
    return names, np.log(table / table.sum(1, keepdims=True))


def _evidence(pages: DataFrame, names: list[str], table: np.ndarray, id_col: str, url: str, markup: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows: list[list] = [[] for _ in range(6)]
            for i, link, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                text = visible(html)
                counts = np.bincount(trigrams(text), minlength=BUCKETS) if text.strip() else np.zeros(BUCKETS)
                host, suffix, code = address(link)
                for out, value in zip(rows, (i, host, suffix, code, declared(html), (table @ counts * TEMPER).tolist()), strict=True):
                    out.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["id", "host", "suffix", "code", "said", "likely"])
        tidy()

    return pages.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{url}`"), F.col(f"`{markup}`")).mapInArrow(run, "id long, host string, suffix string, code string, said string, likely array<double>")


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, lang, confidence (of that language), text_lang (by the text alone), declared, host."""
    names, table = model
    rows = cut(_evidence(pages, names, table, id_col, url, markup), "evidence")
    every = range(len(names))
    best = lambda scores: (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    rows = rows.withColumn("guess", best(F.col("likely")))
    tally = [F.sum((F.col("guess") == k).cast("long")) for k in every]

    def counts(*keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array(*tally).alias(f"n_{'_'.join(keys)}"))

    def own(k) -> Column:
        return F.when(F.col("guess") == k, 1.0).otherwise(0.0)

    whole = [x or 0 for x in rows.agg(F.array(*tally).alias("n")).first().n]  # one number a language
    total, joined = sum(whole), rows
    for key in ("suffix", "host", "said", "code"):
        joined = joined.join(counts(key), key)
    sizes = {key: F.aggregate(f"n_{key}", F.lit(0).cast("long"), lambda a, x: a + x) for key in ("suffix", "host")}
    n_values = {key: rows.agg(F.count_distinct(key)).first()[0] or 1 for key in ("said", "code")}

    def posterior(k: int) -> Column:
        base = (F.lit(float(whole[k])) - own(k) + ADDED) / (total - 1 + ADDED * len(names))
        by_suffix = (F.col("n_suffix")[k] - own(k) + SUFFIX_STRENGTH * base) / (sizes["suffix"] - 1 + SUFFIX_STRENGTH)
        by_host = (F.col("n_host")[k] - own(k) + HOST_STRENGTH * by_suffix) / (sizes["host"] - 1 + HOST_STRENGTH)
        score = F.col("likely")[k] + F.log(by_host)
        for key, n in n_values.items():
            score = score + F.log((F.col(f"n_{key}")[k] - own(k) + ADDED) / (whole[k] - own(k) + ADDED * n))
        return score

    scored = joined.withColumn("scores", F.array(*[posterior(k) for k in every]))
    confidence = 1 / F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("scores")))
    label = F.array(*[F.lit(n) for n in names])
    return scored.select(F.col("id").alias("page_id"), F.get(label, best(F.col("scores"))).alias("lang"), confidence.alias("confidence"), F.get(label, F.col("guess")).alias("text_lang"), F.col("said").alias("declared"), "host")
