"""Queries of the task evaluators, metrics, retrieval, cache and rate limits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evoframe.functions import text as T
from evoframe.operators import evaluation as E
from evoframe.operators import molecules as G
from evoframe.operators import retrieval as R
from evoframe.operators import selection as N
from evoframe.operators.corpus import build_index, retrieved
from evoframe.plans.queries import _ANSWER_SQL, _FIRST_SQL, _KNN_SQL, _STRIP, K, _docs
from evoframe.plans.registry import query
from evoframe.plans.templates import Template, template_answer, template_prompt, with_templates
from evoframe.plans.traj import LENGTH_BOUNDS, TRAJ_SQL, table, traj
from evoframe.plans.trial import TrialConfig, elites, tried
from evoframe.session import cut, spread, use_checkpoint_dir
from evoframe.sources.embedding_cache import EmbeddingCache, embedded_once
from evoframe.streaming.token_bucket import admitted

_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> ''))"
_JACCARD = "len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0)"

_TRUE = "concat(source, ' ', lang)"
_SAID = f"CASE doc_id % 4 WHEN 0 THEN {_TRUE} WHEN 1 THEN concat('x ', {_TRUE}, ' y') WHEN 2 THEN source ELSE concat(lang, ' ', source, ' more words') END"


_REPLY = f"CASE doc_id % 4 WHEN 0 THEN concat('so', chr(10), 'Answer: ', {_SAID}) WHEN 1 THEN concat('Final answer:  ', {_SAID}, chr(10), 'end') WHEN 2 THEN concat('thinking', chr(10), chr(10), {_SAID}, ' ', chr(10)) ELSE concat('a [ANSWER_START] ', {_SAID}, chr(10), '[ANSWER_END] b') END"


@query(
    "pqa_metrics",
    f"""WITH r AS (SELECT doc_id, {_TRUE} AS g, {_REPLY} AS t FROM documents), t AS (SELECT doc_id, lower(g) AS g, lower({_ANSWER_SQL}) AS p FROM r),
    w AS (SELECT *, {_WORDS.format('g')} AS a, {_WORDS.format('p')} AS b FROM t), o AS (SELECT *, {_JACCARD.format(a='a', b='b')} AS overlap FROM w)
    SELECT doc_id, p = g OR contains(p, g) OR overlap > 0.8 AS exact_match, round(CASE WHEN p = g THEN 1.0 WHEN contains(p, g) THEN 0.9 ELSE overlap END, 6)::DOUBLE AS accuracy FROM o""",
)
def _(spark, d):
    return _docs(spark, d).select("doc_id", E.question_answer(F.expr(_REPLY), F.expr(_TRUE)).alias("m")).select("doc_id", "m.exact_match", F.round("m.accuracy", 6).alias("accuracy"))


_ERR_SAID = "CASE doc_id % 6 WHEN 0 THEN 'Answer: True' WHEN 1 THEN 'it is false' WHEN 2 THEN 'no' WHEN 3 THEN 'None' WHEN 4 THEN 'maybe' ELSE '' END"


@query(
    "err_metrics",
    f"""WITH r AS (SELECT doc_id, {_ERR_SAID} AS t FROM documents), a AS (SELECT doc_id, lower({_ANSWER_SQL}) AS a FROM r),
    j AS (SELECT doc_id, (CASE WHEN contains(a, 'true') THEN true WHEN contains(a, 'false') THEN false ELSE a NOT IN ('', 'no', 'none', '0') END) = (doc_id % 2 = 0) AS exact_match FROM a)
    SELECT doc_id, exact_match, exact_match::INT::DOUBLE AS accuracy FROM j""",
)
def _(spark, d):
    return _docs(spark, d).select("doc_id", E.error_recognition(F.expr(_ERR_SAID), F.col("doc_id") % 2 == 0).alias("m")).select("doc_id", "m.*")


_ORD_SAID = "CASE doc_id % 6 WHEN 0 THEN '[0, 1, 2]' WHEN 1 THEN '(2, 1, 0)' WHEN 2 THEN '3' WHEN 3 THEN 'first then' WHEN 4 THEN '[1,0,2,7]' ELSE '[]' END"


_ORD_SQL = f"""WITH r AS (SELECT doc_id, concat('Answer: ', {_ORD_SAID}) AS t FROM documents), a AS (SELECT doc_id, {_ANSWER_SQL} AS a FROM r),
    l AS (SELECT doc_id, CASE WHEN regexp_full_match(a, '\\[(-?\\d+(\\s*,\\s*-?\\d+)*)?\\]|\\((-?\\d+(\\s*,\\s*-?\\d+)*)?\\)|-?\\d+') THEN list_transform(regexp_extract_all(a, '-?\\d+'), lambda x: x::INT) END AS said FROM a)"""
_HITS = "CASE WHEN said = [0, 1, 2] THEN 1.0 ELSE coalesce(len(list_filter([0, 1, 2], lambda i: said[i + 1] = i)), 0) / 3.0 END"


@query("ord_metrics", f"{_ORD_SQL} SELECT doc_id, coalesce(said = [0, 1, 2], false) AS exact_match, round({_HITS}, 6)::DOUBLE AS accuracy, CASE WHEN said IS NULL THEN 'not an ordering' END AS error FROM l")
def _(spark, d):
    m = E.ordering(F.concat(F.lit("Answer: "), F.expr(_ORD_SAID)), F.array(*[F.lit(i) for i in range(3)]))
    return _docs(spark, d).select("doc_id", m.alias("m")).select("doc_id", "m.exact_match", F.round("m.accuracy", 6).alias("accuracy"), "m.error")


@query(
    "ord_remapped",
    f"""{_ORD_SQL}, m AS (SELECT doc_id, CASE WHEN list_sort(list_distinct(said)) = [0, 1, 2] THEN list_transform(said, lambda i: [2, 1, 0][i + 1]) ELSE said END AS said FROM l)
    SELECT doc_id, coalesce(said = [0, 1, 2], false) AS exact_match, round({_HITS}, 6)::DOUBLE AS accuracy FROM m""",
)
def _(spark, d):
    wrong, right = (F.array(*[F.lit(i) for i in x]) for x in ((2, 1, 0), (0, 1, 2)))
    m = E.ordering(F.concat(F.lit("Answer: "), F.expr(_ORD_SAID)), right, wrong)
    return _docs(spark, d).select("doc_id", m.alias("m")).select("doc_id", "m.exact_match", F.round("m.accuracy", 6).alias("accuracy"))


@query(
    "gen_overlap",
    f"""WITH t AS (SELECT a.doc_id, a.text AS p, b.text AS g FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1), w AS (SELECT *, {_WORDS.format('p')} AS x, {_WORDS.format('g')} AS y FROM t)
    SELECT doc_id, round(CASE WHEN lower(p) = lower(g) THEN 1.0 ELSE coalesce({_JACCARD.format(a='x', b='y')}, 0.0) END, 6)::DOUBLE AS score FROM w""",
)
def _(spark, d):
    docs = _docs(spark, d)
    truth = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("truth"))
    return docs.join(truth, "doc_id").select("doc_id", F.round(E.generation_overlap(F.col("text"), F.col("truth")), 6).alias("score"))


@query(
    "classification_metrics",
    """WITH r AS (SELECT length(text) > 1000 AS p, quality = 1 AS g FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p = g) AS ok, count(*) FILTER (WHERE p AND g) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE NOT p AND g) AS fn, count(DISTINCT g) AS labels FROM r),
    m AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS pr, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS re FROM c)
    SELECT n, round(ok::DOUBLE / n, 6) AS accuracy, round(CASE WHEN labels = 2 THEN pr ELSE 0 END, 6) AS precision, round(CASE WHEN labels = 2 THEN re ELSE 0 END, 6) AS recall, round(CASE WHEN labels = 2 THEN coalesce(2 * pr * re / nullif(pr + re, 0), 0) ELSE 0 END, 6) AS f1 FROM m""",
)
def _(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").select((F.length("text") > 1000).alias("predicted"), (F.col("quality") == 1).alias("truth"))
    return E.classification(rows)


@query(
    "kendall_tau",
    """WITH r AS (SELECT conv_id, turn AS x, length(text) AS y FROM conversations), p AS (SELECT a.conv_id, sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.x < b.x)
    SELECT conv_id, round(sum(dx * dy)::DOUBLE / nullif(sqrt(sum(dx * dx)::DOUBLE * sum(dy * dy)::DOUBLE), 0), 6) AS tau FROM p GROUP BY conv_id""",
)
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return E.kendall_tau_b(rows, "conv_id", "turn", "n")


_NUM = "l_orderkey, l_linenumber, {0} AS exact_match, round(greatest(0.0::DOUBLE, 1 - l_linenumber::DOUBLE / (l_partkey + 100 + l_linenumber)::DOUBLE), 6) AS accuracy FROM lineitem"


def _numbers(spark, d, metric):
    p = F.concat(F.lit("about "), (F.col("l_partkey") + 100).cast("string"), F.lit(" g/mol"))
    g = (F.col("l_partkey") + 100 + F.col("l_linenumber")).cast("string")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", metric(p, g).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "m.exact_match", F.round("m.accuracy", 6).alias("accuracy"))


_OFF = "l_linenumber::DOUBLE / (l_partkey + 100 + l_linenumber)::DOUBLE"


@query("mol_weight_metrics", "SELECT " + _NUM.format(f"{_OFF} <= 0.01::DOUBLE"))
def _(spark, d):
    return _numbers(spark, d, E.molecular_weight)


@query("property_metrics", "SELECT " + _NUM.format(f"{_OFF} < 0.05::DOUBLE"))
def _(spark, d):
    return _numbers(spark, d, E.property_value)


_CHEM_SAID = "CASE doc_id % 4 WHEN 0 THEN upper(lang) WHEN 1 THEN concat('is ', lang, '!') WHEN 2 THEN concat('x', doc_id + 51) ELSE 'zzz' END"
_CHEM_TRUE = "CASE doc_id % 4 WHEN 2 THEN concat('', doc_id + 50) ELSE lang END"


@query(
    "general_chem_metrics",
    f"""WITH r AS (SELECT doc_id, lower({_CHEM_SAID}) AS a, lower({_CHEM_TRUE}) AS b FROM documents), n AS (SELECT *, {_FIRST_SQL.format('a')} AS p, {_FIRST_SQL.format('b')} AS g FROM r),
    o AS (SELECT *, p IS NOT NULL AND g IS NOT NULL AS numbers, contains(a, b) OR contains(b, a) AS within, CASE WHEN g = 0 THEN (p <> 0)::INT ELSE abs(p - g) / abs(g) END AS off FROM n)
    SELECT doc_id, CASE WHEN numbers THEN off < 0.05 ELSE within END AS exact_match, round(CASE WHEN numbers THEN greatest(0.0::DOUBLE, 1 - off) WHEN a = b THEN 1.0::DOUBLE WHEN within THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END, 6) AS accuracy FROM o""",
)
def _(spark, d):
    m = _docs(spark, d).select("doc_id", E.general_chemistry(F.expr(_CHEM_SAID), F.expr(_CHEM_TRUE)).alias("m"))
    return m.select("doc_id", "m.exact_match", F.round("m.accuracy", 6).alias("accuracy"))


_EDITED = "CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN concat(source, ' ') ELSE 'C=C' END"


@query(
    "molecule_edit",
    f"""WITH r AS (SELECT doc_id, {_STRIP.format(_EDITED)} AS said, {_STRIP.format('source')} AS truth FROM documents)
    SELECT doc_id, said <> '' AS valid, said <> '' AND said = truth AS exact_match, (said <> '' AND said = truth)::INT::DOUBLE AS accuracy FROM r""",
)
def _(spark, d):
    return _docs(spark, d).select("doc_id", E.molecule_edit(F.expr(_EDITED), F.col("source")).alias("m")).select("doc_id", "m.valid", "m.exact_match", "m.accuracy")


_STRUCTURE = "CASE WHEN doc_id % 2 = 0 THEN concat('is CC(=O)O', doc_id, ' or CCO') ELSE 'xyz' END"
_LONGEST = "CASE WHEN len({0}) > 0 THEN list_reduce({0}, lambda best, x: CASE WHEN length(x) > length(best) THEN x ELSE best END) END"


@query(
    "extract_structure",
    rf"""WITH r AS (SELECT doc_id, {_STRUCTURE} AS t FROM documents),
    f AS (SELECT doc_id, regexp_extract_all(t, '([CNOcnoFfPSpsBbBr?Ii][A-Za-z0-9@+\-\[\]\(\)\\=#$]+)', 1) AS one, regexp_extract_all(t, '([CNOcno][^\n]{{0,100}})', 1) AS two FROM r)
    SELECT doc_id, coalesce({_LONGEST.format('one')}, {_LONGEST.format('two')}) AS structure FROM f""",
)
def _(spark, d):
    return _docs(spark, d).select("doc_id", E.longest_structure(F.expr(_STRUCTURE)).alias("structure"))


_SURE = "concat('yes ', source, CASE WHEN doc_id % 2 = 0 THEN ' & ' ELSE ' ' END, doc_id % 100)"


@query(
    "confidence",
    rf"""WITH r AS (SELECT doc_id, {_STRIP.format(_SURE)} AS t FROM documents),
    m AS (SELECT doc_id, CASE WHEN regexp_matches(t, '&\s*\d') THEN regexp_extract(t, '^([^&]*?)\s*&\s*(\d+)', ['answer', 'n']) ELSE regexp_extract(t, '^([\s\S]*?)\s+(\d+)$', ['answer', 'n']) END AS m FROM r)
    SELECT doc_id, {_STRIP.format('m.answer')} AS answer, m.n::DOUBLE / 100 AS confidence FROM m""",
)
def _(spark, d):
    return _docs(spark, d).select("doc_id", E.confidence(F.expr(_SURE)).alias("m")).select("doc_id", "m.answer", "m.confidence")


@query("cache_split", "WITH c AS (SELECT DISTINCT sha256(concat(source, ':', text)) AS key FROM documents WHERE length(text) > 1500) SELECT doc_id, c.key IS NOT NULL AS hit FROM documents d LEFT JOIN c ON c.key = sha256(concat(d.source, ':', d.text))")
def _(spark, d):
    return _cached(spark, d).select("doc_id", "hit")


def _cached(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("source").alias("model"), "text")
    long_ = docs.where(F.length("text") > 1500).select(T.cache_key("model", "text").alias("key"), F.array(F.lit(1.0)).alias("embedding")).dropDuplicates(["key"])
    return R.lookup(docs, long_)


@query("cache_stats", "WITH c AS (SELECT DISTINCT sha256(concat(source, ':', text)) AS key FROM documents WHERE length(text) > 1500), l AS (SELECT sha256(concat(source, ':', text)) AS k FROM documents), h AS (SELECT k, k IN (SELECT key FROM c) AS hit FROM l) SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(count(*) FILTER (WHERE hit)::DOUBLE / count(*), 6) AS hit_rate, count(DISTINCT k) AS keys FROM h")
def _(spark, d):
    return R.hit_rate(_cached(spark, d))


def _lengths(texts):
    return [[float(len(t))] for t in texts]


@query(
    "embedding_cache_write_back",
    """WITH k AS (SELECT DISTINCT sha256('lengths:' || coalesce(text, '')) AS key FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id))
    SELECT d.doc_id, sha256('lengths:' || coalesce(text, '')) AS key, k.key IS NOT NULL AS hit, true AS held, length(coalesce(text, ''))::BIGINT AS value
    FROM documents d LEFT JOIN k ON k.key = sha256('lengths:' || coalesce(text, ''))""",
)
def _(spark, d):
    """A first run embeds the labelled documents, a second one all: hits before its write-back, and the cache after it."""
    cache = EmbeddingCache(spark, f"{use_checkpoint_dir(spark)}/cache-{uuid.uuid4()}")
    docs = _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("lengths").alias("model"))
    labelled = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id")
    cut(embedded_once(labelled, "text", _lengths, cache, "lengths"))
    before = cut(cache.lookup(docs).select("doc_id", "key", "hit", "text", "model"))
    cut(embedded_once(before.select("doc_id", "text"), "text", _lengths, cache, "lengths"))
    after = cache.lookup(before.withColumnRenamed("hit", "before"), "model", "text")
    found = cut(after.select("doc_id", "key", F.col("before").alias("hit"), F.col("hit").alias("held"), F.col("embedding")[0].cast("long").alias("value")))
    cache.clear()
    return found


_TERMS_SQL = """list_filter(list_transform(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: trim(w, '.,;:!?()[]"''')), lambda w: w <> '')"""


@query(
    "corpus_retrieval",
    f"""WITH d AS (SELECT doc_id, {_TERMS_SQL} AS words FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, words, len(words) AS n FROM d WHERE len(words) > 0),
    t AS (SELECT count(*) AS docs, avg(n) AS average FROM l), p AS (SELECT doc_id, n, unnest(words) AS term FROM l), c AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM c GROUP BY term), q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
    w AS (SELECT item_id, q.term, ln(1 + (docs - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS idf FROM q CROSS JOIN t LEFT JOIN f USING (term)),
    s AS (SELECT item_id, doc_id, round(sum(idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / average)))), 6) AS bm25 FROM w JOIN c USING (term) CROSS JOIN t GROUP BY ALL),
    m AS (SELECT item_id, sum(idf) AS most FROM w GROUP BY item_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id)::INTEGER AS rank FROM s)
    SELECT item_id, rank, doc_id, bm25, round(least(bm25 / most, 1.0::DOUBLE), 6) AS score FROM r JOIN m USING (item_id) WHERE rank <= 3""",
)
def _(spark, d):
    """The three best documents for every text of the benchmark."""
    index = build_index(_docs(spark, d), "doc_id")
    found = retrieved(table(spark, d, "benchmark"), index, 3, "item_id", "text")
    return found.select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), "bm25", "score")


#: A benzene ring with a chain and an end, both from a part's own numbers.
_RING_CHAIN = "concat('c1ccccc1', repeat('C', CAST(p_size % 7 AS INT)), CASE p_partkey % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'N' WHEN 2 THEN 'Cl' WHEN 3 THEN 'C(=O)O' ELSE 'C#N' END, CASE WHEN p_size > 45 THEN ')' ELSE '' END)"


@query(
    "molecule_counts",
    """WITH s AS (SELECT p_partkey, p_size % 7 AS n, p_partkey % 5 AS e, p_size <= 45 AS valid FROM part), c AS (
      SELECT *, 6 + n + CASE WHEN e IN (3, 4) THEN 1 ELSE 0 END AS carbon, 5 + 2 * n + CASE e WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 0 END AS hydrogen,
        CASE e WHEN 0 THEN 15.999 WHEN 1 THEN 14.007 WHEN 2 THEN 35.45 WHEN 3 THEN 2 * 15.999 ELSE 14.007 END AS other FROM s)
    SELECT p_partkey, valid, CASE WHEN valid THEN carbon END::INTEGER AS carbon, CASE WHEN valid THEN hydrogen END::INTEGER AS hydrogen, CASE WHEN valid THEN 6 END::INTEGER AS benzene_ring,
      CASE WHEN valid THEN 1 END::INTEGER AS ring_count, CASE WHEN valid THEN round(carbon * 12.011 + hydrogen * 1.008 + other, 3) END::DOUBLE AS weight,
      CASE WHEN valid THEN CASE e WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN n + 1 ELSE n END END::INTEGER AS rot_bonds,
      CASE WHEN valid THEN CASE WHEN e IN (0, 1, 3) THEN 1 ELSE 0 END END::INTEGER AS donors, CASE WHEN valid THEN CASE e WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END END::INTEGER AS acceptors FROM c""",
)
def _(spark, d):
    """Counts and descriptors on graphs; the SQL counts by formula."""
    rows = spread(table(spark, d, "part").select("p_partkey", F.expr(_RING_CHAIN).alias("structure")), G.PART_ROWS)
    rows = G.with_graph(rows, "structure")
    m, held = F.col("m"), G.descriptors(F.col("m"))
    counts = [G.group_count(m, g).alias(g) for g in ("carbon", "hydrogen", "benzene_ring")]
    return rows.select("p_partkey", m["valid"].alias("valid"), *counts, held["ring_count"].alias("ring_count"), held["weight"].alias("weight"), held["rot_bonds"].alias("rot_bonds"), held["HBD"].alias("donors"), held["HBA"].alias("acceptors"))


@query(
    "molecule_edits",
    """SELECT p_partkey, true AS valid, p_partkey % 3 <> 2 AS edit_valid, p_partkey % 3 = 0 AS exact_match, p_partkey % 3 = 0 AS same FROM part""",
)
def _(spark, d):
    """A chain that should gain a chlorine: it did, written from the other end; it did elsewhere; it did not."""
    chain = "repeat('C', CAST(3 + p_size % 7 AS INT))"
    said = f"CASE p_partkey % 3 WHEN 0 THEN concat({chain}, 'Cl') WHEN 1 THEN concat('C(Cl)', {chain}, 'O') ELSE {chain} END"
    rows = table(spark, d, "part").select("p_partkey", F.expr(chain).alias("source"), F.expr(said).alias("said"), F.expr(f"concat('Cl', {chain})").alias("truth"))
    found = G.edited(spread(rows, G.PART_ROWS), "source", "said", "truth", added="chlorine")
    return found.select("p_partkey", "valid", "edit_valid", "exact_match", (F.col("similarity") == 1).alias("same"))


_TOP_SQL = f"{_KNN_SQL}, top AS (SELECT sample_id, id, nid, rank::INT AS rank, round(1 / (1 + dist), 6) AS score FROM knn WHERE rank <= 3)"


@query("rag_top3", f"WITH {_TOP_SQL} SELECT sample_id, id, nid, rank, score FROM top")
def _(spark, d):
    return R.top(N.nearest(traj(spark, d), K)).select("sample_id", "id", "nid", "rank", "score")


@query("rag_context", f"WITH {_TOP_SQL} SELECT top.sample_id, id, string_agg(rank || '. ' || source, chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN documents ON doc_id = nid GROUP BY ALL")
def _(spark, d):
    found = R.top(N.nearest(traj(spark, d), K)).join(_docs(spark, d).select(F.col("doc_id").alias("nid"), F.col("source").alias("text")), "nid")
    return R.formatted(found)


@query("rag_reliable", f"WITH {_TOP_SQL} SELECT sample_id, id, score >= 0.15::DOUBLE AS reliable FROM top WHERE rank = 1")
def _(spark, d):
    return R.reliable(R.top(N.nearest(traj(spark, d), K)), 0.15)


_INTERVAL = 4 * 3600 * 1_000_000


@query(
    "token_bucket",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, us, n, true AS allowed, {2 * _INTERVAL}::BIGINT AS level FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.event_id, e.us, e.n, least({3 * _INTERVAL}, f.level + e.us - f.us) >= {_INTERVAL}, least({3 * _INTERVAL}, f.level + e.us - f.us) - CASE WHEN least({3 * _INTERVAL}, f.level + e.us - f.us) >= {_INTERVAL} THEN {_INTERVAL} ELSE 0 END
      FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, event_id, allowed, level::BIGINT AS level_us FROM f""",
)
def _(spark, d):
    return admitted(table(spark, d, "events"), "user_id", "ts", "event_id", 3, _INTERVAL).select(F.col("key").alias("user_id"), "event_id", "allowed", "level_us")


@query(
    "mean_kendall_tau",
    """WITH r AS (SELECT conv_id, turn AS x, length(text) AS y FROM conversations), p AS (SELECT a.conv_id, sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.x < b.x),
    t AS (SELECT conv_id, round(sum(dx * dy)::DOUBLE / nullif(sqrt(sum(dx * dx)::DOUBLE * sum(dy * dy)::DOUBLE), 0), 6) AS tau FROM p GROUP BY conv_id)
    SELECT round(coalesce(avg(tau), 0.0), 6) AS tau FROM t""",
)
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return E.mean_kendall_tau(rows, "conv_id", "turn", "n")


_MADE = "concat('CC(=O)Oc1', repeat('Cl', {i} % 4), 'Br', repeat('[Si]N', {i} % 3))"
_ATOM = "regexp_extract_all({0}, '(Cl|Br|Si|Se|se|[BCNOPSFIbcnops])', 1)"


def _count_sql(text: str, *symbols: str) -> str:
    return f"len(list_filter({_ATOM.format(text)}, lambda a: a IN ({', '.join(repr(s) for s in symbols)})))"


@query("atom_counts", f"SELECT doc_id, {_count_sql('s', 'C', 'c')}::INT AS carbon, {_count_sql('s', 'Cl')}::INT AS chlorine, {_count_sql('s', 'Si')}::INT AS silicon, NULL::INT AS ring FROM (SELECT doc_id, {_MADE.format(i='doc_id')} AS s FROM documents)")
def _(spark, d):
    made = F.expr(_MADE.format(i="doc_id"))
    return _docs(spark, d).select("doc_id", *[E.group_count(made, g).alias(n) for g, n in (("carbon", "carbon"), ("chlorine", "chlorine"), ("silicon", "silicon"), ("benzene_ring", "ring"))])


@query(
    "edit_checks",
    f"""WITH e AS (SELECT doc_id, {_MADE.format(i="doc_id")} AS s, {_MADE.format(i="(doc_id + 1)")} AS t FROM documents)
    SELECT doc_id, {_count_sql("t", "Cl")} = {_count_sql("s", "Cl")} + 1 AS added, {_count_sql("t", "N", "n")} = {_count_sql("s", "N", "n")} - 1 AS deleted,
      {_count_sql("t", "Cl")} = {_count_sql("s", "Cl")} + 1 AND {_count_sql("t", "N", "n")} = {_count_sql("s", "N", "n")} - 1 AS substituted, false AS uncounted FROM e""",
)
def _(spark, d):
    s, t = (F.expr(_MADE.format(i=i)) for i in ("doc_id", "(doc_id + 1)"))
    checks = {"added": E.edit_check(s, t, added="chlorine"), "deleted": E.edit_check(s, t, removed="nitrogen"), "substituted": E.edit_check(s, t, "chlorine", "nitrogen"), "uncounted": E.edit_check(s, t, added="hydrogen")}
    return _docs(spark, d).select("doc_id", *[c.alias(n) for n, c in checks.items()])


@query(
    "sentence_bleu",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(concat(source, ' ', lang, ', ', source, ' x', doc_id % 5)), '(\w+|[^\w\s])') AS p, regexp_extract_all(lower(concat(source, ' ', lang, ' ', source, ' x', doc_id % 3)), '(\w+|[^\w\s])') AS g FROM documents),
    grams AS (SELECT doc_id, 1 AS n, p, g FROM d UNION ALL SELECT doc_id, 2, list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]), list_transform(range(1, len(g)), lambda i: g[i] || ' ' || g[i + 1]) FROM d),
    c AS (SELECT doc_id, n, len(p) AS m, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda v: v = w)), len(list_filter(g, lambda v: v = w))))) AS hits FROM grams),
    r AS (SELECT doc_id, max(hits) FILTER (WHERE n = 1) AS one, exp(avg(ln(CASE WHEN hits > 0 THEN hits::DOUBLE ELSE 0.1::DOUBLE END / greatest(m, 1)))) AS mean FROM c GROUP BY doc_id)
    SELECT doc_id, round(CASE WHEN one = 0 THEN 0.0 ELSE mean * CASE WHEN len(p) > len(g) THEN 1.0 ELSE exp(1 - len(g)::DOUBLE / len(p)) END END, 6) AS bleu FROM r JOIN d USING (doc_id)""",
)
def _(spark, d):
    said, true = F.expr("concat(source, ' ', lang, ', ', source, ' x', doc_id % 5)"), F.expr("concat(source, ' ', lang, ' ', source, ' x', doc_id % 3)")
    return _docs(spark, d).select("doc_id", F.round(E.sentence_bleu(said, true), 6).alias("bleu"))


_TOKENS_SQL = r"regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s])')"


@query(
    "document_bleu",
    f"""WITH d AS (SELECT a.doc_id, {_TOKENS_SQL.format('a.text')} AS p, {_TOKENS_SQL.format('b.text')} AS g FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    grams AS (SELECT doc_id, 1 AS n, p, g FROM d UNION ALL SELECT doc_id, 2, list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]), list_transform(range(1, len(g)), lambda i: g[i] || ' ' || g[i + 1]) FROM d),
    x AS (SELECT doc_id, n, w, count(*) AS c FROM (SELECT doc_id, n, unnest(p) AS w FROM grams) GROUP BY ALL), y AS (SELECT doc_id, n, w, count(*) AS c FROM (SELECT doc_id, n, unnest(g) AS w FROM grams) GROUP BY ALL),
    h AS (SELECT doc_id, n, sum(least(x.c, y.c)) AS hits FROM x JOIN y USING (doc_id, n, w) GROUP BY ALL),
    r AS (SELECT doc_id, coalesce(max(hits) FILTER (WHERE n = 1), 0) AS one, exp(avg(ln(CASE WHEN hits > 0 THEN hits::DOUBLE ELSE 0.1::DOUBLE END / greatest(len(p), 1)))) AS mean FROM grams LEFT JOIN h USING (doc_id, n) GROUP BY doc_id)
    SELECT doc_id, round(CASE WHEN one = 0 THEN 0.0 ELSE mean * CASE WHEN len(p) > len(g) THEN 1.0 ELSE exp(1 - len(g)::DOUBLE / len(p)) END END, 6) AS bleu FROM r JOIN d USING (doc_id)""",
)
def _(spark, d):
    """Every document against the next one, whole texts."""
    docs = _docs(spark, d).select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id")
    return pairs.select("doc_id", F.round(E.sentence_bleu(F.col("text"), F.col("next")), 6).alias("bleu"))


@query(
    "task_dispatch",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ERR' WHEN 1 THEN 'PQA' WHEN 2 THEN 'ORD' WHEN 3 THEN 'GEN' ELSE 'SUM' END AS task,
    CASE doc_id % 5 WHEN 0 THEN n_chars % 2 = 0 WHEN 1 THEN lower(source) = lower(lang) OR contains(lower(source), lower(lang)) WHEN 2 THEN n_chars % 3 = 0 WHEN 3 THEN true ELSE false END AS exact_match,
    CASE doc_id % 5 WHEN 4 THEN 'unknown task type: SUM' END AS error FROM documents""",
)
def _(spark, d):
    said = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Answer: true' WHEN 1 THEN concat('Answer: ', source) WHEN 2 THEN concat('so\n[0, 1, ', n_chars % 3, ']') ELSE lang END")
    true = F.expr("CASE doc_id % 5 WHEN 0 THEN CAST(n_chars % 2 = 0 AS STRING) WHEN 2 THEN '{\"correct_steps\": [0, 1, 0]}' ELSE lang END")
    docs = _docs(spark, d)
    predictions = docs.select("doc_id", said.alias("prediction"))
    truths = docs.select("doc_id", F.expr("CASE doc_id % 5 WHEN 0 THEN 'err' WHEN 1 THEN 'Pqa' WHEN 2 THEN 'ORD' WHEN 3 THEN 'gen' ELSE 'sum' END").alias("task"), true.alias("truth"))
    return E.evaluated_batch(predictions, truths, "doc_id").select("doc_id", F.upper("task").alias("task"), "exact_match", "error")


#: Prompts of three datasets and of all others, whose values come from whole documents.
_TEMPLATES = {
    "src1": Template("Chemistry. {query} Reply as {\"result\": \"...\"}", "Known: {knowledge}. Chemistry. {query}", "json"),
    "src2": Template("Protocol: {query} [ANSWER_START]...[ANSWER_END]", "Known: {knowledge}. {query} {", "marked"),
    "src3": Template("{query}", "{knowledge}{query}{knowledge}", "line"),
    None: Template("Other: {query}", "Other: {query} by {knowledge}", "split"),
}
_FILLED = r"array_to_string(list_transform(regexp_extract_all({0}, '\{{\w+\}}|[^{{]+|\{{'), lambda p: CASE p WHEN '{{query}}' THEN coalesce(text, '') WHEN '{{knowledge}}' THEN coalesce(lang, '') ELSE p END), '')"
_CHOSEN = " ".join(f"WHEN {'source' if name else 'true'}{f' = {chr(39)}{name}{chr(39)}' if name else ''} THEN CASE WHEN doc_id % 2 = 1 THEN '{t.informed}' ELSE '{t.plain}' END" for name, t in _TEMPLATES.items())


@query("dataset_prompts", f"WITH t AS (SELECT *, CASE {_CHOSEN} END AS template FROM documents) SELECT doc_id, length({_FILLED.format('template')})::BIGINT AS n_chars, md5({_FILLED.format('template')}) AS prompt_md5 FROM t")
def _(spark, d):
    """Prompts by dataset, every second one with knowledge; values keep their braces."""
    rows = with_templates(_docs(spark, d), _TEMPLATES, "source")
    ask = template_prompt(F.col("text"), F.col("lang"), F.col("doc_id") % 2 == 1)
    return rows.select("doc_id", ask.alias("ask")).select("doc_id", F.length("ask").cast("long").alias("n_chars"), F.md5(F.col("ask").cast("binary")).alias("prompt_md5"))


_SAYS = """CASE doc_id % 5 WHEN 0 THEN concat(text, '{"result": "', lang, '"} then {"a": 1, "result" : "', source, '"}') WHEN 1 THEN concat('[ANSWER_START]', text, '[ANSWER_END] ', lang, ' [ANSWER_END]')
    WHEN 2 THEN concat(text, chr(10), 'the answer is  ', source, chr(10), ' ') WHEN 3 THEN concat('[ANSWER_END] [ANSWER_START] ', text, chr(10), 'Final answer: ', lang) ELSE text END"""
_LINE_SQL = _STRIP.format(f"regexp_replace({_STRIP.format(f'list_last(string_split({_STRIP.format(chr(116))}, chr(10)))')}, '(?i)^(answer:|the answer is|result:|final answer:)', '')")
_JSON_SQL = r"""list_last(regexp_extract_all(t, '\{[^{}]*"result"\s*:\s*"[^"]*"\s*\}'))"""
_MARKED_SQL = _STRIP.format(r"regexp_extract(t, '\[ANSWER_START\]([\s\S]*?)\[ANSWER_END\]', 1)")


@query(
    "dataset_answers",
    f"""WITH s AS (SELECT doc_id, {_SAYS} AS t, CASE source WHEN 'src1' THEN 'json' WHEN 'src2' THEN 'marked' WHEN 'src3' THEN 'line' ELSE ['json', 'marked', 'line', 'split'][doc_id % 4 + 1] END AS parser FROM documents),
    a AS (SELECT doc_id, parser, CASE WHEN parser = 'split' THEN {_STRIP.format('t')} WHEN parser = 'json' AND {_JSON_SQL} IS NOT NULL THEN {_JSON_SQL}::JSON ->> 'result'
      WHEN parser = 'marked' AND regexp_matches(t, '\\[ANSWER_START\\][\\s\\S]*?\\[ANSWER_END\\]') THEN {_MARKED_SQL} ELSE {_LINE_SQL} END AS answer FROM s)
    SELECT doc_id, parser, length(answer)::BIGINT AS n_chars, md5(answer) AS answer_md5 FROM a""",
)
def _(spark, d):
    """Answers in whole texts, each by the parser its row names."""
    parser = F.expr("CASE source WHEN 'src1' THEN 'json' WHEN 'src2' THEN 'marked' WHEN 'src3' THEN 'line' ELSE element_at(array('json', 'marked', 'line', 'split'), CAST(doc_id % 4 + 1 AS INT)) END")
    rows = _docs(spark, d).select("doc_id", parser.alias("parser"), F.expr(_SAYS).alias("t"))
    rows = rows.select("doc_id", "parser", template_answer(F.col("t"), F.col("parser")).alias("answer"))
    return rows.select("doc_id", "parser", F.length("answer").cast("long").alias("n_chars"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


_MARKS = "CASE doc_id % 4 WHEN 0 THEN concat('x <|think|> ', text, '<|answer|> ', source) WHEN 1 THEN concat(text, ' <|answer|> y <|think|> z') WHEN 2 THEN concat('<|think|> ', text) ELSE text END"
_BETWEEN = _STRIP.format("substring(t, strpos(t, '<|think|>') + 9, greatest(strpos(t, '<|answer|>') - strpos(t, '<|think|>') - 9, 0))")


@query(
    "reasoning_lengths",
    f"""WITH r AS (SELECT doc_id, {_MARKS} AS t FROM documents), p AS (SELECT doc_id, t, CASE WHEN strpos(t, '<|think|>') > 0 AND strpos(t, '<|answer|>') > 0 THEN {_BETWEEN} ELSE t END AS pure FROM r)
    SELECT doc_id, len(regexp_extract_all(t, '\\S+'))::BIGINT AS raw_words, len(regexp_extract_all(pure, '\\S+'))::BIGINT AS words, length(pure)::BIGINT AS chars FROM p""",
)
def _(spark, d):
    rows = _docs(spark, d).select("doc_id", F.expr(_MARKS).alias("t"))
    return rows.select("doc_id", *[T.reasoning_length("t", of).alias(of) for of in ("raw_words", "words", "chars")])


_TRIAL = TrialConfig(population=30, length_bounds=LENGTH_BOUNDS)


@query(
    "trial_elites",
    f"""WITH {TRAJ_SQL}, d AS (SELECT t.sample_id, t.id, t.pos, t.exact_match, t.length_score, CASE WHEN d.lang = 'en' THEN '' ELSE d.lang END AS knowledge, d.lang = 'de' OR lower(d.source) = 'src7' AS ok, t.reasoning FROM traj t JOIN documents d ON d.doc_id = t.id),
    f AS (SELECT *, round(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.3::DOUBLE * length_score + CASE WHEN knowledge <> '' AND regexp_matches(reasoning, '\\S') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS fitness FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY fitness DESC, pos) AS rank FROM f)
    SELECT sample_id, id, ok AS exact_match, fitness, rank::INT AS rank FROM r WHERE rank <= {_TRIAL.elites}""",
)
def _(spark, d):
    """Elites of the trial loop by its own fitness: truths as written, knowledge all or nothing."""
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), F.expr("CASE WHEN lang = 'en' THEN '' ELSE lang END").alias("knowledge"), F.expr("CASE WHEN lang = 'de' THEN source ELSE concat('Answer: ', source) END").alias("answer"), F.expr("CASE WHEN lang = 'de' THEN concat(' ', upper(source)) ELSE 'SRC7' END").alias("truth"))
    rows = tried(traj(spark, d).drop("fitness", "exact_match").join(docs, "id"), _TRIAL)
    return elites(rows, _TRIAL).select("sample_id", "id", "exact_match", "fitness", "rank")
