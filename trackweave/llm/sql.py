"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from .common import SPACE, WORD
from .mixing import BLOCK, GROUP, PASSES, SEED, SHARD_WORDS, SHARE
from .quality_rules import CAPITALS, MAX_LOST, MAX_REPEATED, MIN_WORDS, PHRASES, SEPARATOR, TERMINAL


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _bare(text: str) -> str:
    return f"length(regexp_replace({text}, '[{SPACE}]+', '', 'g'))"


def _fails(line: str) -> str:
    symbols = f"length({line}) - length(regexp_replace({line}, '[#*$%&|<>]', '', 'g'))"
    capitals = f"length(regexp_replace({line}, '[^\\p{{Lu}}]+', '', 'g')) * 10 > length(regexp_replace({line}, '[^\\p{{L}}]+', '', 'g')) * 6"
    rules = [
        f"NOT regexp_matches({line}, {_quoted(TERMINAL)})",
        f"({symbols}) * 10 > {_bare(line)}",
        f"len(regexp_extract_all({line}, {_quoted(SEPARATOR)})) >= 2",
        f"regexp_matches({line}, {_quoted(PHRASES)})",
        f"regexp_matches({line}, {_quoted(CAPITALS)}) AND {capitals}",
    ]
    return f"{_bare(line)} > 0 AND ({' OR '.join(f'({r})' for r in rules)})"


OP6 = f"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS words FROM b),
i AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM i),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM b),
f AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, count(*) FILTER ({_fails("line")}) AS failed, coalesce(sum({_bare("line")}) FILTER ({_fails("line")}), 0) AS lost FROM l WHERE {_bare("line")} > 0 GROUP BY doc_id),
a AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST({_bare("t")} AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(failed, 0) AS BIGINT) AS n_lines_failed, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
 FROM w LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)),
z AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * {MAX_LOST} AS kept FROM z"""

OP8 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p QUALIFY rank <= 20"""


def _apportioned(rows: str, group: str, key: str, weight: str, seats: str, out: str, name: str) -> str:
    """CTEs that add ``out`` to ``rows``: Sainte-Lague by the ranked quotients near the last winning one."""
    part = f"PARTITION BY {group}" if group else ""
    return f"""{name}1 AS (SELECT *, CAST(count(*) OVER ({part}) AS DOUBLE) AS n_, CAST(sum({weight}) OVER ({part}) AS DOUBLE) AS s_ FROM {rows}),
{name}2 AS (SELECT *, CASE WHEN s_ > 0 THEN CAST(greatest(0, floor(CAST({weight} AS DOUBLE) * ({seats} + -1 * n_ / 2) / s_ + 0.5) - 1) AS BIGINT) ELSE 0 END AS sure FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN s_ > 0 THEN CAST(greatest(sure, floor(CAST({weight} AS DOUBLE) * ({seats} + 1 * n_ / 2) / s_ + 0.5) + 1) AS BIGINT) ELSE 0 END AS most, {seats} - CAST(sum(sure) OVER ({part}) AS BIGINT) AS open_ FROM {name}2),
{name}4 AS (SELECT *, unnest(range(sure, most + 1)) AS j FROM {name}3),
{name}5 AS (SELECT *, row_number() OVER ({part} ORDER BY CAST({weight} AS DOUBLE) / (2 * j + 1) DESC, {key} NULLS LAST, j) <= open_ AND {weight} > 0 AS won FROM {name}4),
{name} AS (SELECT * EXCLUDE (n_, s_, sure, most, open_, j, won), any_value(sure) + count(*) FILTER (won) AS {out} FROM {name}5 GROUP BY ALL)"""


OP10 = f"""WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
o AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM o),
q AS (SELECT *, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(source_size * {PASSES} AS DOUBLE) AS cap, sum(source_size) OVER () * CAST({SHARE} AS DOUBLE) AS total FROM p),
r AS (SELECT *, total - coalesce(sum(cap) OVER up, 0) AS left_, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS rest_ FROM q WINDOW up AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, cap * rest_ <= left_ * weight AS capped FROM r),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * ((total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER ()) END AS target FROM s),
u AS (SELECT *, CAST(round(sum(target) OVER () / {BLOCK}) AS BIGINT) AS seats FROM t),
{_apportioned("u", "", "source", "target", "seats", "blocks", "v")},
w AS (SELECT source, source_size, target, blocks, CAST(greatest(1, ceil(source_size / CAST({SHARD_WORDS} AS DOUBLE))) AS BIGINT) AS n_shards FROM v),
x AS (SELECT z.*, source_size, target, blocks, md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h, n_shards FROM z JOIN w ON z.source IS NOT DISTINCT FROM w.source),
y AS (SELECT *, CAST('0x' || substr(h, 1, 15) AS BIGINT) % n_shards AS shard FROM x),
aa AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_ FROM y),
ab AS (SELECT source, shard, shard // {GROUP} AS part, CAST(sum(size) AS BIGINT) AS ring, any_value(blocks) AS blocks FROM y GROUP BY source, shard),
ag AS (SELECT source, part, CAST(sum(ring) AS BIGINT) AS whole, any_value(blocks) AS blocks FROM ab GROUP BY source, part),
{_apportioned("ag", "source", "part", "whole", "blocks", "part_blocks", "ah")},
ai AS (SELECT ab.source, shard, ab.part, ring, part_blocks FROM ab JOIN ah ON ab.source IS NOT DISTINCT FROM ah.source AND ab.part = ah.part),
{_apportioned("ai", "source, part", "shard", "ring", "part_blocks", "quota", "ac")},
ad AS (SELECT source, shard, ring, least(quota * {BLOCK}, ring * {PASSES}) AS quota, CAST('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(source, ''), CAST(shard AS VARCHAR))), 1, 15) AS BIGINT) % CAST(greatest(1, ceil(ring / CAST({BLOCK} AS DOUBLE))) AS BIGINT) * {BLOCK} AS start FROM ac),
ae AS (SELECT aa.*, greatest(ring, 1) AS ring, quota, start, start + quota % greatest(ring, 1) AS stop FROM aa JOIN ad ON aa.source IS NOT DISTINCT FROM ad.source AND aa.shard = ad.shard)
SELECT doc_id, size, source_size, target, CAST(quota // ring * size + greatest(0, least(end_, stop) - greatest(end_ - size, start)) + greatest(0, least(end_, stop - ring) - greatest(end_ - size, start - ring)) AS BIGINT) AS taken FROM ae"""


OP13 = f"""WITH d AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS words FROM documents),
n AS (SELECT d, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS words FROM benchmark),
q AS (SELECT i, item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT i, item_id, unnest(words) AS term FROM i) GROUP BY ALL),
p AS (SELECT d, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(docs) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term),
s AS (SELECT i, item_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (d), g GROUP BY i, item_id, d)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank, doc_id, score FROM s JOIN (SELECT d, doc_id FROM n) USING (d) WHERE score > 0 QUALIFY rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": OP6, "op8_exact_topk": OP8, "op10_mixing": OP10, "op13_lexical_search": OP13}
