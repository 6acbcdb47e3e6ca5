"""The corpus operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evoframe.llm import bpe, centroids, conversations, exact_dedup, line_dedup, lm_scoring, near_dedup, packing, pii, quality_rules, substring_dedup, token_counts, toxicity
from evoframe.llm.common import read

_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(read(spark, sf_dir, "documents"))


ORACLE_SQL["op10_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


@_query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality; background: all."""
    documents = read(spark, sf_dir, "documents")
    target = read(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.score(documents, lm_scoring.fit(documents, target))


@_query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, sf_dir, "documents"), words=4, percent=80)


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(read(spark, sf_dir, "documents"), _RANKS, public_tokenizers.PATTERN)


@_query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_spans(read(spark, sf_dir, "documents"))


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, read(spark, sf_dir, "labels")))


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(read(spark, sf_dir, "documents")))


@_query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(read(spark, sf_dir, "documents"), _RANKS, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, _RANKS))


@_query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"), dimensions=64, clusters=8, rounds=10, scale=1024, seed=3)


def _centroid_sql(rounds: int = 10) -> str:
    """Rounds as one common table each: ``a`` assigns, ``c`` moves the centroids."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.k, min(({distance}, c.c)) AS best FROM v CROSS JOIN c{i} c GROUP BY v.k)")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT a.best[2] AS c, p, sum(v.v[p]) AS s, count(*) AS n FROM a{i} a JOIN v ON v.k = a.k CROSS JOIN range(1, 65) AS t(p) GROUP BY ALL),
              c{i + 1} AS MATERIALIZED (
                SELECT c.c, coalesce(any_value(m.v), any_value(c.v)) AS v FROM c{i} c LEFT JOIN (
                  SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY p) AS v FROM s{i} GROUP BY c) m ON m.c = c.c GROUP BY c.c)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), v) - 1)::INTEGER AS c, v FROM v
  WHERE vec_id IS NOT NULL QUALIFY c < 8
), {", ".join(steps)}, i AS (SELECT best[2] AS c, sum(best[1])::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT v.vec_id, a.best[2]::INTEGER AS cluster, a.best[1]::BIGINT AS distance, i.cluster_inertia,
       (SELECT sum(cluster_inertia) FROM i)::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.k = a.k JOIN i ON i.c = a.best[2] JOIN c{rounds} c ON c.c = a.best[2]
"""


ORACLE_SQL["op11_centroid_clustering"] = _centroid_sql()


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.repair(conversations.damaged(read(spark, sf_dir, "conversations"))))


def _repair_sql() -> str:
    """Rows are taken from the last to the first; a state holds nine digits of cost, then the audit, so that text order is the order wanted."""
    add = lambda x, cost, edit: f"lpad((left({x}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{edit}' || substr({x}, 10)"
    after = (2, 2, 3, 2)
    inserted = lambda g, s: f"least({g}{s}, {add(f'{g}{after[s]}', 5, 'I')}, {add(f'{g}{after[after[s]]}', 10, 'II')})"
    keeps = ((("s", 1), ("u", 2)), (("u", 2),), (("a", 3),), (("u", 2),))

    def row(s: int) -> str:
        ways = [add(f"f{s}", 2, "D"), f"CASE WHEN live THEN {add(f'f{after[s]}', '1 + t', 'R')} ELSE '9' END"]
        ways += [f"CASE WHEN live AND initial = '{c}' THEN {add(f'f{to}', 't', 'K')} ELSE '9' END" for c, to in keeps[s]]
        return f"least({', '.join(ways)})"

    g = ", ".join(f"{row(s)} AS g{s}" for s in range(4))
    f = ", ".join(f"{inserted('g', s)} AS f{s}" for s in range(4))
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), h AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(key, ''), lambda ch: list_transform(range(8), lambda b: (unicode(ch)::BIGINT >> b) & 1))),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT) % 20 AS kind FROM o
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h CROSS JOIN range(2) AS t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS initial, rtrim(text, {blank}) AS ended FROM d
), r AS MATERIALIZED (
  SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
         WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM e
), p AS (SELECT *, fault IN ('', 'truncated') AS live, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS t FROM r),
b AS (
  SELECT conv_id, 0::BIGINT AS k, {', '.join(f"{inserted('g', s)} AS f{s}" for s in range(4))}
  FROM (SELECT DISTINCT conv_id, '000000000' AS g0, '500000000' AS g1, '500000000' AS g2, '000000000' AS g3 FROM o)
  UNION ALL
  SELECT conv_id, k, {f} FROM (
    SELECT b.conv_id, b.k + 1 AS k, {g} FROM b JOIN p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.n - p.pos = b.k)
), w AS (SELECT conv_id, left(arg_max(f0, k), 9)::BIGINT AS cost, substr(arg_max(f0, k), 10) AS audit FROM b GROUP BY conv_id),
x AS (
  SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM w
), y AS (
  SELECT conv_id, i, audit[i] AS edit, i - length(replace(left(audit, i), 'I', '')) AS inserts, length(replace(left(audit, i), 'D', '')) AS out FROM x
), z AS (
  SELECT y.*, r.role, r.text, r.initial, bool_or(out = 1 AND edit = 'K' AND r.initial = 's') OVER (PARTITION BY y.conv_id) AS led
  FROM y LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM y.conv_id AND r.pos = i - inserts AND edit <> 'I'
), q AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (out % 2 = 1) = coalesce(led, false) THEN 'assistant' ELSE 'user' END || ':' || coalesce(text, ''), chr(10) ORDER BY i)) AS repaired_sha256
  FROM z WHERE edit <> 'D' GROUP BY conv_id
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, w.cost, w.audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM w LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM w.conv_id
"""


ORACLE_SQL["op12_conversation_repair"] = _repair_sql()


@_query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.without_repeats(read(spark, sf_dir, "documents")))


ORACLE_SQL["op13_line_dedup"] = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), g AS (
  SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), m AS (
  SELECT k.doc_id, k.line, k.i, coalesce(k.doc_id <> g.first_id, false) AS gone FROM k LEFT JOIN g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
