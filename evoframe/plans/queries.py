"""Every operator as a query over the driver's tables, with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evoframe.functions import text as T
from evoframe.functions.draws import uniform, uniform_sql
from evoframe.operators import evaluation as E
from evoframe.operators import population as P
from evoframe.operators import sampling as S
from evoframe.operators import selection as N
from evoframe.plans.registry import query
from evoframe.plans.traj import TRAJ_SQL, table, traj
from evoframe.session import cut

K = 5
SEED = 17

# ------------------------------------------------------------------ scalars over whole documents

_LEN = "len(regexp_extract_all(text, '\\S+'))"


def _docs(spark, d):
    return table(spark, d, "documents")


@query("word_count", f"SELECT doc_id, {_LEN}::BIGINT AS n_words FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.word_count("text").alias("n_words"))


@query("length_score", f"SELECT doc_id, CASE WHEN n < 100 THEN 0.0::DOUBLE WHEN n > 651 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM (SELECT doc_id, {_LEN} AS n FROM documents)")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.length_score("text", 100, 651).alias("score"))


@query("length_percentiles", f"SELECT round(quantile_cont(n, 0.15), 6)::DOUBLE AS p_low, round(quantile_cont(n, 0.85), 6)::DOUBLE AS p_high FROM (SELECT {_LEN}::DOUBLE AS n FROM documents)")
def _(spark, d):
    found = P.length_percentiles(_docs(spark, d), T.word_count("text"))
    return found.select(F.round("p_low", 6).alias("p_low"), F.round("p_high", 6).alias("p_high"))


# Answers in the shapes a model gives them, made from each document's source and number.
_ANSWERS = [
    ("json_major", "concat('{{\"Major Product\": \"', {s}, ' \"}}')"),
    ("json_number", "concat('{{\"result\": ', {i}, '}}')"),
    ("json_other", "concat('{{\"x\": \"', {s}, '\"}}')"),
    ("prefix", "concat('The answer is:  ', {s}, '   x')"),
    ("marked", "concat('<|think|> a <|answer|> final result : ', {s})"),
    ("plain", "concat(' ', {s}, ' ', {i}, ' ')"),
]


def _answers(docs):
    shapes = [F.struct(F.lit(n).alias("shape"), F.expr(e.format(s="source", i="doc_id")).alias("answer")) for n, e in _ANSWERS]
    return docs.select("doc_id", "source", F.explode(F.array(*shapes)).alias("a")).select("doc_id", "source", "a.shape", "a.answer")


_ANSWERS_SQL = "answers AS (" + " UNION ALL ".join(f"SELECT doc_id, source, '{n}' AS shape, {e.format(s='source', i='doc_id')} AS answer FROM documents" for n, e in _ANSWERS) + ")"
_CLEAN_SQL = """CASE WHEN shape = 'json_major' THEN source WHEN shape IN ('json_number', 'json_other') THEN answer
  ELSE trim(regexp_replace(regexp_replace(trim(regexp_replace(answer, '<\\|(think|answer)\\|>', '', 'g')), '^(?i)(final result|answer|the answer is)\\s*:?\\s*', ''), '\\s+', ' ', 'g')) END"""


@query("clean_answer", f"WITH {_ANSWERS_SQL} SELECT doc_id, shape, {_CLEAN_SQL} AS cleaned FROM answers")
def _(spark, d):
    return _answers(_docs(spark, d)).select("doc_id", "shape", T.clean_answer("answer").alias("cleaned"))


_TRUTH_SQL = "CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE concat(source, ' ', doc_id) END"


def _matched(spark, d, strict):
    rows = _answers(_docs(spark, d)).withColumn("truth", F.expr(_TRUTH_SQL))
    return rows.select("doc_id", "shape", T.exact_match("answer", "truth", strict).alias("matched"))


def _match_sql(c: str, truth: str) -> str:
    return f"WITH {_ANSWERS_SQL} SELECT doc_id, shape, {c} = {truth} AS matched FROM (SELECT *, {_CLEAN_SQL} AS c, {_TRUTH_SQL} AS truth FROM answers)"


@query("exact_match_strict", _match_sql("lower(c)", "lower(truth)"))
def _(spark, d):
    return _matched(spark, d, True)


@query("exact_match_lenient", _match_sql("replace(lower(c), ' ', '')", "replace(lower(truth), ' ', '')"))
def _(spark, d):
    return _matched(spark, d, False)


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("extract_markers", f"SELECT doc_id, md5({_STRIP.format('text')}) AS reasoning_md5, source AS answer FROM documents")
def _(spark, d):
    made = _docs(spark, d).select("doc_id", T.marker_parts(F.concat(F.lit("x<|think|>\n"), "text", F.lit("\n<|answer|> "), "source")).alias("p"))
    return made.select("doc_id", F.md5("p.reasoning").alias("reasoning_md5"), F.col("p.answer").alias("answer"))


@query(
    "extract_reasoning_answer",
    f"""WITH t AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'phrase' WHEN 1 THEN 'line' ELSE 'markers' END AS shape, {_STRIP.format('text')} AS body FROM documents)
    SELECT doc_id, shape, md5(body) AS reasoning_md5, source AS answer FROM t""",
)
def _(spark, d):
    shape = F.expr("CASE doc_id % 3 WHEN 0 THEN 'phrase' WHEN 1 THEN 'line' ELSE 'markers' END")
    made = F.when(shape == "phrase", F.concat("text", F.lit("\n\nThe answer is: "), "source", F.lit(" "))).when(shape == "line", F.concat("text", F.lit("\n"), "source", F.lit("\n \n"))).otherwise(F.concat(F.lit("<|think|>"), "text", F.lit("<|answer|>"), "source"))
    parts = _docs(spark, d).select("doc_id", shape.alias("shape"), T.reasoning_and_answer(made).alias("p"))
    return parts.select("doc_id", "shape", F.md5("p.reasoning").alias("reasoning_md5"), F.col("p.answer").alias("answer"))


#: The answer in a reply ``t``, read as task_answer does.
_ANSWER_SQL = rf"""CASE WHEN regexp_matches(t, '\[ANSWER_START\][\s\S]*?\[ANSWER_END\]') THEN {_STRIP.format(r"regexp_extract(t, '\[ANSWER_START\]([\s\S]*?)\[ANSWER_END\]', 1)")}
    WHEN regexp_matches(t, '(?i)answer:') THEN {_STRIP.format(r"regexp_extract(t, '(?i)answer:\s*([^\n]*)', 1)")}
    WHEN regexp_matches(t, '(?i)answer\s+(is\s+)?:') THEN {_STRIP.format(r"regexp_extract(t, '(?i)answer\s+(?:is\s+)?:\s*([^\n]*)', 1)")}
    ELSE {_STRIP.format(r"list_last(string_split(regexp_replace(t, '\s+$', ''), chr(10)))")} END"""
#: The first decimal, else the first integer of a text.
_FIRST_SQL = r"coalesce(nullif(regexp_extract({0}, '(\d+\.\d+)', 1), ''), nullif(regexp_extract({0}, '(\d+)', 1), ''))::DOUBLE"


@query("last_line_answer", f"WITH r AS (SELECT doc_id, text || chr(10) || source AS t FROM documents) SELECT doc_id, {_ANSWER_SQL} AS answer FROM r")
def _(spark, d):
    return _docs(spark, d).select("doc_id", E.task_answer(F.concat("text", F.lit("\n"), "source")).alias("answer"))


@query("extract_number", "SELECT doc_id, coalesce(nullif(regexp_extract(text, '(\\d+\\.\\d+)', 1), ''), nullif(regexp_extract(text, '(\\d+)', 1), ''))::DOUBLE AS number FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.first_number("text").alias("number"))


_REPLY = "CASE doc_id % 5 WHEN 0 THEN concat('Score: ', doc_id % 9, '/5') WHEN 1 THEN 'none' WHEN 2 THEN concat(doc_id, '') WHEN 3 THEN '-2' ELSE '0' END"


@query("judge_score", f"SELECT doc_id, CASE WHEN n = '' THEN 3 ELSE greatest(1, least(5, n::BIGINT)) END::INT AS score FROM (SELECT doc_id, regexp_extract({_REPLY}, '\\d+') AS n FROM documents)")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.judge_score(F.expr(_REPLY)).alias("score"))


_ITEMS = "concat('steps', chr(10), '* ', source, chr(10), ' *  ', lang, ' x ', chr(10), 'end')"


@query("bullets", rf"WITH r AS (SELECT doc_id, {_ITEMS} AS t FROM documents) SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '\*\s*([^\n]+)', 1), lambda x: {_STRIP.format('x')}), chr(10)) AS items FROM r")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.bullets(F.expr(_ITEMS)).alias("items"))


@query("marked_result", f"SELECT doc_id, md5({_STRIP.format('text')}) AS result_md5 FROM documents")
def _(spark, d):
    made = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ok [RESULT_START]\n"), "text", F.lit("[RESULT_END] tail"))).otherwise(F.concat(F.lit(" "), "text"))
    return _docs(spark, d).select("doc_id", F.md5(T.marked_or_all(made, "RESULT")).alias("result_md5"))


@query("binding_point", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND strpos(text, substr(text, 5, 12)) > 0 THEN strpos(text, substr(text, 5, 12)) - 1 ELSE (length(text) * 4) // 5 END::INT AS at FROM documents")
def _(spark, d):
    quoted = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 5, 12)).otherwise("\u0001")
    return _docs(spark, d).select("doc_id", T.binding_point("text", quoted).alias("at"))


@query("traj_id", "SELECT doc_id, substr(md5(concat(lang, '|', text, '|', source)), 1, 16) AS id FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.trajectory_id("lang", "text", "source").alias("id"))


@query("cache_key", "SELECT doc_id, sha256(concat(source, ':', text)) AS key FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.cache_key("source", "text").alias("key"))


@query("truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS short FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.truncated("text").alias("short"))


@query("parse_ratio", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0.0::DOUBLE ELSE round((doc_id % 11)::DOUBLE / (doc_id % 7)::DOUBLE, 6) END AS ratio FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.ratio(F.concat((F.col("doc_id") % 11).cast("string"), F.lit("/"), (F.col("doc_id") % 7).cast("string"))), 6).alias("ratio"))


# ------------------------------------------------------------------ populations

_FIT = "sample_id, id, fitness"


@query("fitness", f"WITH {TRAJ_SQL} SELECT sample_id, id, round(fitness, 6) AS fitness FROM traj WHERE fitness IS NOT NULL")
def _(spark, d):
    return P.where_evaluated(traj(spark, d)).select("sample_id", "id", F.round("fitness", 6).alias("fitness"))


@query("fitness_from_scores", f"WITH {TRAJ_SQL} SELECT id, round((CASE WHEN coalesce(exact_match, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.3::DOUBLE * length_score) + CASE WHEN id % 4 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * (knowledge_score::DOUBLE / 5.0::DOUBLE) END, 6) AS fitness FROM traj")
def _(spark, d):
    know = F.when(F.col("id") % 4 != 0, F.col("knowledge_score"))
    return traj(spark, d).select("id", F.round(T.fitness("exact_match", "length_score", know), 6).alias("fitness"))


_KNN_SQL = f"""{TRAJ_SQL}, pairs AS (
  SELECT a.sample_id, a.id, b.id AS nid, b.pos AS npos, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist
  FROM traj a JOIN traj b ON a.sample_id = b.sample_id AND a.id <> b.id
), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, id ORDER BY dist, npos) AS rank FROM pairs) WHERE rank <= {K})"""
_SCORES_SQL = f"""{_KNN_SQL}, nov AS (SELECT sample_id, id, round(avg(dist), 6) AS novelty FROM knn GROUP BY ALL),
lc AS (SELECT t.sample_id, t.id, round(coalesce(avg(CASE WHEN t.fitness IS NOT NULL AND n.fitness IS NOT NULL THEN greatest(0.0, t.fitness - n.fitness) END), 0.0), 6) AS local_competition
  FROM traj t LEFT JOIN knn k ON k.id = t.id AND k.sample_id = t.sample_id LEFT JOIN traj n ON n.id = k.nid GROUP BY ALL),
scored AS (SELECT t.*, coalesce(nov.novelty, 0.0) AS novelty, lc.local_competition FROM traj t LEFT JOIN nov ON nov.id = t.id LEFT JOIN lc ON lc.id = t.id)"""


@query("knn", f"WITH {_KNN_SQL} SELECT sample_id, id, nid, dist, rank::INT AS rank FROM knn")
def _(spark, d):
    return N.nearest(traj(spark, d), K).select("sample_id", "id", "nid", "dist", "rank")


@query("knn_join", f"WITH {_KNN_SQL} SELECT sample_id, id, nid, dist, rank::INT AS rank FROM knn")
def _(spark, d):
    return N.nearest_join(traj(spark, d), K).select("sample_id", "id", "nid", "dist", "rank")


@query("novelty", f"WITH {_SCORES_SQL} SELECT sample_id, id, novelty FROM scored")
def _(spark, d):
    t = traj(spark, d)
    return N.novelty(N.nearest(t, K), t).select("sample_id", "id", "novelty")


@query("local_competition", f"WITH {_SCORES_SQL} SELECT sample_id, id, local_competition FROM scored")
def _(spark, d):
    t = traj(spark, d)
    return N.local_competition(N.nearest(t, K), t).select("sample_id", "id", "local_competition")


def _front_sql(strict: str) -> str:
    return f"""{_SCORES_SQL}, front AS (SELECT * FROM scored a WHERE NOT EXISTS (SELECT 1 FROM scored b WHERE b.sample_id = a.sample_id AND b.id <> a.id
      AND b.novelty >= a.novelty AND b.local_competition >= a.local_competition {strict}))"""


_STRICT = "AND (b.novelty > a.novelty OR b.local_competition > a.local_competition)"


@query("pareto_reference", f"WITH {_front_sql('')} SELECT sample_id, id, novelty, local_competition FROM front")
def _(spark, d):
    return N.pareto_front(N.scores(traj(spark, d), K)).select("sample_id", "id", "novelty", "local_competition")


@query("pareto_strict", f"WITH {_front_sql(_STRICT)} SELECT sample_id, id, novelty, local_competition FROM front")
def _(spark, d):
    return N.pareto_front(N.scores(traj(spark, d), K), strict=True).select("sample_id", "id", "novelty", "local_competition")


@query("best_n", f"WITH {TRAJ_SQL} SELECT sample_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY fitness DESC, pos) AS rank FROM traj WHERE fitness IS NOT NULL) WHERE rank <= 5")
def _(spark, d):
    return P.best(traj(spark, d), 5).select("sample_id", "id", "rank")


@query("top1", f"WITH {TRAJ_SQL} SELECT sample_id, id, round(fitness, 6) AS fitness FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY fitness DESC, pos) AS rank FROM traj WHERE fitness IS NOT NULL) WHERE rank = 1")
def _(spark, d):
    return P.best(traj(spark, d), 1).select("sample_id", "id", F.round("fitness", 6).alias("fitness"))


_TEXT_ID = "substr(md5(reasoning), 1, 16)"


@query("remove_duplicates", f"WITH {TRAJ_SQL} SELECT sample_id, {_TEXT_ID} AS id, min(pos) AS pos FROM traj GROUP BY ALL")
def _(spark, d):
    rows = traj(spark, d).withColumn("id", F.substring(F.md5("reasoning"), 1, 16))
    return P.without_duplicates(rows).select("sample_id", "id", "pos")


@query("remove_lowest", f"WITH {TRAJ_SQL} SELECT sample_id, id, (nth - 13)::BIGINT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY fitness ASC NULLS FIRST, pos) AS nth FROM traj) WHERE nth > 12")
def _(spark, d):
    return P.without_lowest(traj(spark, d), 12).select("sample_id", "id", "pos")


for _name, _fun, _sql in (("filter_correct", P.where_correct, "exact_match IS TRUE"), ("filter_incorrect", P.where_incorrect, "exact_match IS FALSE"), ("filter_evaluated", P.where_evaluated, "fitness IS NOT NULL"), ("filter_unevaluated", P.where_unevaluated, "fitness IS NULL")):
    query(_name, f"WITH {TRAJ_SQL} SELECT sample_id, id, pos FROM traj WHERE {_sql}")(lambda spark, d, f=_fun: f(traj(spark, d)).select("sample_id", "id", "pos"))


_STATS_SQL = """count(*) AS size, count(fitness) AS evaluated, count(*) FILTER (WHERE exact_match) AS correct,
  coalesce(round(count(*) FILTER (WHERE exact_match)::DOUBLE / nullif(count(fitness), 0), 6), 0.0) AS accuracy, round(avg(fitness), 6) AS avg_fitness, round(max(fitness), 6) AS max_fitness, round(min(fitness), 6) AS min_fitness"""
_ROUNDED = ("accuracy", "avg_fitness", "max_fitness", "min_fitness")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("population_stats", f"WITH {TRAJ_SQL} SELECT sample_id, {_STATS_SQL} FROM traj GROUP BY sample_id")
def _(spark, d):
    return _rounded(P.statistics(traj(spark, d)), *_ROUNDED)


@query("generation_history", f"WITH {_front_sql('')} SELECT sample_id, {_STATS_SQL}, round(avg(novelty), 5) AS avg_novelty, round(avg(local_competition), 5) AS avg_local_competition, (SELECT count(*) FROM front f WHERE f.sample_id = scored.sample_id) AS pareto_size FROM scored GROUP BY sample_id")
def _(spark, d):
    scored = N.scores(traj(spark, d), K)
    out = _rounded(P.history(scored, N.pareto_front(scored)), *_ROUNDED)
    return out.withColumns({n: F.round(n, 5) for n in ("avg_novelty", "avg_local_competition")})


@query(
    "logger_stats",
    f"""WITH {TRAJ_SQL} SELECT sample_id, count(*) AS population_size, round(coalesce(avg(fitness), 0.0), 6) AS avg_fitness, round(coalesce(max(fitness), 0.0), 6) AS max_fitness, round(coalesce(min(fitness), 0.0), 6) AS min_fitness,
    round(coalesce(count(*) FILTER (WHERE exact_match AND fitness IS NOT NULL)::DOUBLE / nullif(count(fitness), 0), 0.0), 6) AS exact_match_rate, round(avg(CASE WHEN fitness IS NOT NULL THEN length(reasoning) END), 6) AS avg_reasoning_length FROM traj GROUP BY sample_id""",
)
def _(spark, d):
    return _rounded(P.log_statistics(traj(spark, d)), "avg_fitness", "max_fitness", "min_fitness", "exact_match_rate")


@query("converged", f"WITH {TRAJ_SQL} SELECT sample_id, coalesce(max(fitness) >= 1.8::DOUBLE, false) AS converged FROM traj GROUP BY sample_id")
def _(spark, d):
    return P.converged(traj(spark, d), 1.8)


@query(
    "run_summary",
    f"""WITH {TRAJ_SQL}, r AS (SELECT CASE WHEN fitness IS NULL THEN 'timeout' WHEN exact_match THEN 'ok' ELSE 'error' END AS status, fitness FROM traj)
    SELECT count(*) FILTER (WHERE status = 'ok') AS successful, count(*) FILTER (WHERE status = 'error') AS failed, count(*) FILTER (WHERE status = 'timeout') AS uncounted, round(avg(fitness) FILTER (WHERE status = 'ok'), 6) AS avg_fitness,
    round(max(fitness) FILTER (WHERE status = 'ok'), 6) AS best_fitness, round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'ok') / count(*), 6) AS success_percent FROM r""",
)
def _(spark, d):
    status = F.when(F.col("fitness").isNull(), "timeout").when(F.col("exact_match"), "ok").otherwise("error")
    return _rounded(P.run_summary(traj(spark, d).select(status.alias("status"), "fitness")), "best_fitness")


_REPLACE_SQL = f"""{TRAJ_SQL}, parents AS (SELECT * FROM traj WHERE id % 2 = 0), kids AS (SELECT * FROM traj WHERE id % 2 = 1),
elites AS (SELECT sample_id, id, fitness, rank - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY fitness DESC, pos) AS rank FROM parents WHERE fitness IS NOT NULL) WHERE rank <= 10),
joined AS (SELECT * FROM elites UNION ALL SELECT sample_id, id, fitness, pos + 1099511627776 FROM kids),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY fitness ASC NULLS FIRST, pos) AS nth, count(*) OVER (PARTITION BY sample_id) - 20 AS cut FROM joined)"""


@query("replace_population", f"WITH {_REPLACE_SQL} SELECT sample_id, id, (CASE WHEN cut > 0 THEN nth - cut - 1 ELSE pos END)::BIGINT AS pos FROM ranked WHERE cut <= 0 OR nth > cut")
def _(spark, d):
    t = traj(spark, d)
    return P.replaced(t.where("id % 2 = 0"), t.where("id % 2 = 1"), 20).select("sample_id", "id", "pos")


# ------------------------------------------------------------------ sampling

_PROBS_SQL = f"""{_SCORES_SQL}, w AS (SELECT sample_id, id, pos, local_competition + 0.1::DOUBLE AS w FROM scored),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY sample_id) AS p FROM w),
c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) = 1 THEN 1.0::DOUBLE ELSE round(sum(p) OVER (PARTITION BY sample_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 9) END AS high FROM p),
ranges AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY sample_id ORDER BY pos), 0.0::DOUBLE) AS low FROM c)"""


@query("sample_probs", f"WITH {_PROBS_SQL} SELECT sample_id, id, round(p, 9) AS p FROM ranges")
def _(spark, d):
    return S.probabilities(N.scores(traj(spark, d), K)).select("sample_id", "id", "p")


@query("sample_with_replacement", f"WITH {_PROBS_SQL}, slots AS (SELECT DISTINCT sample_id, slot::INT AS slot FROM traj, generate_series(0, 39) g(slot)), u AS (SELECT *, {uniform_sql(SEED, 'sample_id', 'slot')} AS u FROM slots) SELECT u.sample_id, slot, id FROM u JOIN ranges r ON r.sample_id = u.sample_id AND u >= low AND u < high")
def _(spark, d):
    return S.with_replacement(N.scores(traj(spark, d), K), 40, SEED)


@query("sample_weighted_no_replacement", f"WITH {TRAJ_SQL} SELECT sample_id, id FROM (SELECT sample_id, id, row_number() OVER (PARTITION BY sample_id ORDER BY round(-ln({uniform_sql(SEED, 'sample_id', 'id')} + 0.000000000001::DOUBLE) / (knowledge_score)::DOUBLE, 9), pos) AS nth FROM traj) WHERE nth <= 15")
def _(spark, d):
    return S.without_replacement(traj(spark, d), 15, SEED, F.col("knowledge_score").cast("double")).select("sample_id", "id")


@query("sample_uniform_no_replacement", f"WITH {TRAJ_SQL} SELECT sample_id, id FROM (SELECT sample_id, id, row_number() OVER (PARTITION BY sample_id ORDER BY {uniform_sql(SEED, 'sample_id', 'id')}, pos) AS nth FROM traj) WHERE nth <= 15")
def _(spark, d):
    return S.without_replacement(traj(spark, d), 15, SEED).select("sample_id", "id")


@query("shuffle", f"WITH {TRAJ_SQL} SELECT sample_id, id, (row_number() OVER (PARTITION BY sample_id ORDER BY {uniform_sql(SEED, 'sample_id', 'id')}, id, pos) - 1)::BIGINT AS pos FROM traj")
def _(spark, d):
    return S.shuffled(traj(spark, d), SEED).select("sample_id", "id", "pos")


@query("mutation_mode", f"WITH {TRAJ_SQL} SELECT id, CASE WHEN u < 0.3::DOUBLE THEN 'add' WHEN u < 0.6::DOUBLE THEN 'delete' ELSE 'innovate' END AS mode FROM (SELECT id, {uniform_sql(SEED, 'sample_id', 'id')} AS u FROM traj)")
def _(spark, d):
    return traj(spark, d).select("id", S.choice(uniform(SEED, "sample_id", "id"), [("add", 0.3), ("delete", 0.3), ("innovate", 0.4)]).alias("mode"))


@query("crossover_routing", f"WITH {TRAJ_SQL} SELECT id, CASE WHEN u < 0.6::DOUBLE AND exact_match IS FALSE THEN 'crossover' ELSE 'mutation' END AS route FROM (SELECT id, exact_match, {uniform_sql(SEED, 'sample_id', 'id')} AS u FROM traj)")
def _(spark, d):
    return traj(spark, d).select("id", S.crossover_route(uniform(SEED, "sample_id", "id"), F.col("exact_match"), 0.6).alias("route"))


@query(
    "parent_pairs",
    f"""WITH {_PROBS_SQL}, slots AS (SELECT DISTINCT sample_id, slot::INT AS slot FROM traj, generate_series(0, 19) g(slot)), u AS (SELECT *, {uniform_sql(SEED, 'sample_id', 'slot')} AS u, {uniform_sql(SEED + 1, 'sample_id', 'slot')} AS v FROM slots),
    t AS (SELECT u.sample_id, slot, v, id AS target_id FROM u JOIN ranges r ON r.sample_id = u.sample_id AND u >= low AND u < high),
    m AS (SELECT sample_id, id, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS nth, count(*) OVER (PARTITION BY sample_id) AS n FROM traj)
    SELECT t.sample_id, slot, target_id, m.id AS provider_id FROM t JOIN m ON m.sample_id = t.sample_id AND m.nth = floor(t.v * m.n)::BIGINT""",
)
def _(spark, d):
    scored = N.scores(traj(spark, d), K)
    return S.parent_pairs(scored, traj(spark, d), 20, SEED)


# ------------------------------------------------------------------ selection with its fallbacks: 1 and 2 have no front, 3 is small

N_PARENTS = 6


def _ranges_sql(rows: str, weight: str, name: str) -> str:
    return f"""w_{name} AS (SELECT sample_id, id, pos, {weight} + 0.1::DOUBLE AS w FROM {rows}),
    p_{name} AS (SELECT *, w / sum(w) OVER (PARTITION BY sample_id) AS p FROM w_{name}),
    c_{name} AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) = 1 THEN 1.0::DOUBLE ELSE round(sum(p) OVER (PARTITION BY sample_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 9) END AS high FROM p_{name}),
    {name} AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY sample_id ORDER BY pos), 0.0::DOUBLE) AS low FROM c_{name})"""


_PARENTS_SQL = f"""{_front_sql("")}, numbered AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS nth FROM scored), pop AS (SELECT * FROM numbered WHERE sample_id <> 3 OR nth <= 4),
    f AS (SELECT * FROM front WHERE sample_id NOT IN (1, 2, 3)), {_ranges_sql("f", "local_competition", "drawn")},
    u AS (SELECT *, {uniform_sql(SEED, "sample_id", "slot")} AS u FROM (SELECT DISTINCT sample_id, slot::INT AS slot FROM f, generate_series(0, {N_PARENTS - 1}) g(slot))),
    chosen AS (
      SELECT u.sample_id, slot, r.id, s.local_competition AS weight FROM u JOIN drawn r ON r.sample_id = u.sample_id AND u >= low AND u < high JOIN scored s ON s.sample_id = r.sample_id AND s.id = r.id
      UNION ALL SELECT sample_id, (nth - 1)::INT, id, NULL FROM pop WHERE sample_id = 3
      UNION ALL SELECT sample_id, (k - 1)::INT, id, local_competition FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {uniform_sql(SEED, "sample_id", "id")}, id, pos) AS k FROM pop WHERE sample_id <> 3 AND sample_id NOT IN (SELECT sample_id FROM f)) WHERE k <= {N_PARENTS})"""


def _selected(spark, d):
    scored = cut(N.scores(traj(spark, d), K))  # read by the front, the draws and the fallbacks
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy("pos"))
    population = scored.withColumn("_nth", nth).where("sample_id <> 3 OR _nth <= 4").drop("_nth")
    front = cut(N.pareto_front(scored).where(~F.col("sample_id").isin(1, 2, 3)))
    return S.parents(population, front, N_PARENTS, SEED), population


@query("select_parents", f"WITH {_PARENTS_SQL} SELECT sample_id, slot, id, round(weight, 6) AS weight FROM chosen")
def _(spark, d):
    return _selected(spark, d)[0].select("sample_id", "slot", "id", F.round("weight", 6).alias("weight"))


@query(
    "offspring_pairs",
    f"""WITH {_PARENTS_SQL}, firsts AS (SELECT sample_id, weight AS first FROM chosen WHERE slot = 0),
    targets AS (SELECT c.sample_id, c.id AS target_id, c.slot::BIGINT AS id, c.slot::BIGINT AS pos, CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE coalesce(weight, 0.0::DOUBLE) END AS weight FROM chosen c JOIN firsts USING (sample_id)),
    {_ranges_sql("targets", "weight", "again")},
    v AS (SELECT *, {uniform_sql(SEED + 5, "sample_id", "slot")} AS u, {uniform_sql(SEED + 6, "sample_id", "slot")} AS v FROM (SELECT DISTINCT c.sample_id, g.k::INT AS slot FROM chosen c, generate_series(0, 11) g(k)) ),
    members AS (SELECT sample_id, id, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS nth, count(*) OVER (PARTITION BY sample_id) AS n FROM pop)
    SELECT v.sample_id, v.slot, t.target_id, m.id AS provider_id FROM v JOIN again r ON r.sample_id = v.sample_id AND u >= low AND u < high JOIN targets t ON t.sample_id = r.sample_id AND t.id = r.id JOIN members m ON m.sample_id = v.sample_id AND m.nth = floor(v.v * m.n)::BIGINT""",
)
def _(spark, d):
    chosen, population = _selected(spark, d)
    return S.offspring_pairs(chosen, population, 12, SEED + 5)


@query("without_row", f"WITH {TRAJ_SQL} SELECT sample_id, id FROM traj WHERE NOT (sample_id = 4 AND id = (SELECT min(id) FROM traj WHERE sample_id = 4))")
def _(spark, d):
    rows = traj(spark, d)
    return P.without_row(rows, 4, rows.where("sample_id = 4").agg(F.min("id")).first()[0]).select("sample_id", "id")


@query("needing_embedding", f"WITH {TRAJ_SQL} SELECT id FROM traj WHERE id % 3 = 0")
def _(spark, d):
    return P.needing_embedding(traj(spark, d).withColumn("embedding", F.when(F.col("id") % 3 != 0, F.col("embedding")))).select("id")


@query("operation_counts", "SELECT source AS generation_method, count(*) AS tried, count(*) FILTER (WHERE n_chars % 3 <> 0) AS successful FROM documents GROUP BY source")
def _(spark, d):
    return P.operation_counts(_docs(spark, d).select(F.col("source").alias("generation_method"), (F.col("n_chars") % 3 == 0).alias("failed")))


@query("combined", "SELECT doc_id, '<|think|>' || chr(10) || source || chr(10) || '<|answer|>' || chr(10) || lang AS output FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.combined("source", "lang").alias("output"))


@query("is_reasoning_model", "SELECT doc_id, regexp_matches(lower(name), 'deepseek|r1|thinking|qwen-235') AS reasoning FROM (SELECT doc_id, concat(source, CASE doc_id % 4 WHEN 0 THEN '-R1' WHEN 1 THEN '-Thinking' ELSE '' END) AS name FROM documents)")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.is_reasoning_model(F.expr("concat(source, CASE doc_id % 4 WHEN 0 THEN '-R1' WHEN 1 THEN '-Thinking' ELSE '' END)")).alias("reasoning"))
