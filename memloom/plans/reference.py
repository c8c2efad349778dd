"""Queries of the memory engine over the given tables, with the SQL that the same results can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import jsonx, text, vectors
from memloom.operators import evals, extract, memory, score, select
from memloom.plans import engine
from memloom.schema import CRITICAL, REVISION_MARKS, TOPIC_STOP_WORDS, TYPES, UNITS, MemoryConfig
from memloom.sources import memory_files, models
from memloom.sources.scratch import scratch_dir
from memloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EVENT_TYPES = {"purchase": "decision", "error": "constraint", "click": "slot", "view": "entity", "signup": "structure"}
MODELS = ["llama-3.3-70b-versatile", "llama-3.1-8b-instant", "llama-guard-3-8b", "qwen-2.5-32b-instruct", "mistral-small-latest", "whisper-large-v3", "gpt-oss-120b", "gemma2-9b-it", "phi-4-mini-instruct", "text-embed-3", "command-r-chat"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def mem(spark: SparkSession, d: str) -> DataFrame:
    return memory.memory_rows(table(spark, d, "patches"))


# --- pieces of SQL ---------------------------------------------------------------------------------------------------


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\p{{L}}+|\\p{{N}}{{1,3}}|[^\\s\\p{{L}}\\p{{N}}]+'))"


def _case(i: int, t: str = "patch_type") -> str:
    return f"CASE {t} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v[i]}'" if isinstance(v[i], str) else str(v[i])) for k, v in TYPES.items()) + " END"


def _topic(p: str) -> str:
    ws, num = f"regexp_extract_all(lower({p}), '[a-z]{{3,}}')", f"regexp_extract_all(lower({p}), '\\d+[.%a-z]*')[1]"
    telling = f"list_filter({ws}, lambda w: NOT list_contains({_list(TOPIC_STOP_WORDS)}, w))[1]"
    return f"CASE WHEN {num} IS NOT NULL THEN coalesce({telling}, 'rule') || '_' || {num} ELSE coalesce({telling}, {ws}[1], 'topic') END"


def _print(x: str) -> str:
    return f"substr(md5(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))), 1, 16)"


def _line(t: str = "patch_type", p: str = "payload") -> str:
    return f"'[' || {_case(0, t)} || '] ' || {p}"


_CRIT = "patch_type IN ('constraint', 'decision')"
MEM = f"""
WITH RECURSIVE c AS (SELECT * FROM patches WHERE conv_id IS NOT NULL AND patch_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, patch_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1)
, m0 AS (SELECT conv_id, row_id, patch_id, coalesce(turn_index, 0) AS turn_index,
    CASE WHEN regexp_replace(lower(trim(patch_type, ' ')), 's+$', '') = 'constrain' THEN 'constraint' ELSE regexp_replace(lower(trim(patch_type, ' ')), 's+$', '') END AS patch_type,
    left(trim(regexp_replace(payload, '\\s+', ' ', 'g')), 200) AS payload, coalesce(dependencies, CAST([] AS VARCHAR[])) AS deps, coalesce(utility, 0.0) AS utility FROM c WHERE payload IS NOT NULL)
, mem AS (SELECT *, {_tokens(_line())} AS token_cost, {_print("payload")} AS fingerprint, patch_type || '::' || ({_topic("payload")}) AS slot_key FROM m0 WHERE patch_type IN {tuple(TYPES)})
"""
_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"


# --- functions -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_tokens('text')} AS n_tokens FROM documents WHERE text IS NOT NULL")
def turn_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.count_tokens(F.col("text")).alias("n_tokens"))


@query(f"SELECT row_id, {_print('payload')} AS fingerprint FROM patches WHERE payload IS NOT NULL")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patches").where("payload IS NOT NULL").select("row_id", text.fingerprint(F.col("payload")).alias("fingerprint"))


@query(f"SELECT row_id, {_topic('payload')} AS topic FROM patches WHERE payload IS NOT NULL")
def topic_keyword(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patches").where("payload IS NOT NULL").select("row_id", text.topic_keyword(F.col("payload")).alias("topic"))


@query(MEM + "SELECT row_id, slot_key FROM mem")
def slot_key(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).select("row_id", "slot_key")


@query(MEM + "SELECT row_id, token_cost FROM mem")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).select("row_id", "token_cost")


@query(MEM + f"SELECT row_id, {_line()} AS line FROM mem")
def render_lines(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).select("row_id", text.prompt_line(F.col("patch_type"), F.col("payload")).alias("line"))


@query("SELECT row_id, CASE WHEN t = 'constrain' THEN 'constraint' WHEN t IN " + str(tuple(TYPES)) + " THEN t ELSE 'unknown' END AS patch_type FROM (SELECT row_id, regexp_replace(lower(trim(patch_type, ' ')), 's+$', '') AS t FROM patches)")
def type_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patches").select("row_id", F.coalesce(text.normalize_type(F.trim("patch_type")), F.lit("unknown")).alias("patch_type"))


@query(MEM + f"SELECT row_id, {_case(0)} AS tag, ({_case(2)})::DOUBLE AS budget_share, ({_case(3)})::DOUBLE AS boost FROM mem")
def type_dim(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).select("row_id", text.tag(F.col("patch_type")).alias("tag"), score.by_type(2).alias("budget_share"), score.by_type(3).alias("boost"))


_SETS = "list_distinct(" + _WORDS.format("lower(payload)") + ") AS n, list_distinct(" + _WORDS.format("lower(lag(payload) OVER w)") + ") AS b"
_CHAIN = "WINDOW w AS (PARTITION BY conv_id, slot_key ORDER BY turn_index, row_id)"


@query(
    MEM + f", s AS (SELECT row_id, payload, lag(payload) OVER w AS base, {_SETS} FROM mem {_CHAIN})"
    ", p AS (SELECT row_id, payload, list_sort(list_filter(n, lambda x: NOT list_contains(b, x))) AS more, list_sort(list_filter(b, lambda x: NOT list_contains(n, x))) AS less FROM s WHERE base IS NOT NULL)"
    " SELECT row_id, coalesce(nullif(concat_ws(' ', CASE WHEN len(more) > 0 THEN '+[' || array_to_string(more, ' ') || ']' END, CASE WHEN len(less) > 0 THEN '-[' || array_to_string(less, ' ') || ']' END), ''), payload) AS delta FROM p"
)
def delta_text(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id", "slot_key").orderBy("turn_index", "row_id")
    return mem(spark, d).withColumn("base", F.lag("payload").over(w)).where("base IS NOT NULL").select("row_id", text.delta_text(F.col("payload"), F.col("base")).alias("delta"))


_UP = "({0} = upper({0}) AND {0} <> lower({0}))"
_FIRST_UP = _UP.format("w[1:1]")
_TRIM = (
    ", s AS (SELECT row_id, payload, " + _WORDS.format("payload") + " AS ws FROM mem)"
    ", o AS (SELECT row_id, payload, ws, list_sort(list_transform(ws, lambda w, i: {'o': -(CASE WHEN regexp_matches(w, '\\d') THEN 2 ELSE 0 END + CASE WHEN contains(w, '%') OR "
    + _UP.format("w") + " THEN 1 ELSE 0 END + CASE WHEN " + _FIRST_UP + " THEN 1 ELSE 0 END), 'i': i, 'w': w}))[1:{K}] AS best FROM s)"
    " SELECT row_id, CASE WHEN len(ws) <= {K} THEN payload ELSE array_to_string(list_transform(list_sort(list_transform(best, lambda e: {'i': e.i, 'w': e.w})), lambda e: e.w), ' ') END AS payload FROM o"
)


@query(MEM + _TRIM.replace("{K}", "5"))
def trim_numeric(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).select("row_id", text.trim_numeric(F.col("payload"), F.lit(5)).alias("payload"))


_LOW = "regexp_replace(lower(w), '[.,;:]+$', '')"
_COUNTS = f"(regexp_matches(w, '\\d') OR contains(w, '%') OR list_contains({_list(UNITS)}, {_LOW}))"


@query(
    MEM + ", s AS (SELECT row_id, payload, " + _WORDS.format("payload") + " AS ws FROM mem)"
    f", k AS (SELECT row_id, payload, ws, list_concat(list_filter(ws, lambda w: NOT {_COUNTS} AND {_FIRST_UP} AND length(w) >= 2)[1:1], list_transform(list_filter(ws, lambda w: {_COUNTS}), lambda w: {_LOW}))[1:4] AS parts FROM s)"
    " SELECT row_id, CASE WHEN len(ws) = 0 THEN payload WHEN len(parts) = 0 THEN ws[1] ELSE array_to_string(parts, ' ') END AS payload FROM k"
)
def ultra_compact(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).select("row_id", text.ultra_compact(F.col("payload")).alias("payload"))


_BARE = "regexp_replace({0}, '[.,;:]+$', '')"


@query(
    MEM + ", s AS (SELECT row_id, " + _WORDS.format("payload") + " AS ws FROM mem), k AS (SELECT row_id, ws, list_transform(ws, lambda w: " + _BARE.format("w") + ") AS bs FROM s)"
    " SELECT row_id, coalesce(" + _BARE.format("list_filter(ws, lambda w: regexp_matches(w, '\\d'))[1]") + ", list_filter(bs, lambda w: length(w) >= 2 AND " + _UP.format("w") + ")[1], list_filter(bs, lambda w: " + _FIRST_UP + ")[1], bs[1], '?') AS word FROM k"
)
def single_token(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).select("row_id", text.single_token(F.col("payload")).alias("word"))


@query(
    MEM + f", s AS (SELECT conv_id, row_id, lag(row_id) OVER w AS before_id, {_SETS} FROM mem WHERE {_CRIT} {_CHAIN})"
    ", j AS (SELECT conv_id, row_id, before_id, len(list_intersect(n, b)) / greatest(len(list_distinct(list_concat(n, b))), 1) AS overlap FROM s WHERE before_id IS NOT NULL)"
    " SELECT conv_id, row_id, before_id, round(overlap, 6) AS overlap FROM j WHERE overlap >= 0.4"
)
def revision_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id", "slot_key").orderBy("turn_index", "row_id")
    rows = mem(spark, d).where(memory.is_critical()).withColumn("before_id", F.lag("row_id").over(w)).withColumn("base", F.lag("payload").over(w)).where("before_id IS NOT NULL")
    return rows.withColumn("overlap", text.jaccard(F.col("payload"), F.col("base"))).where("overlap >= 0.4").select("conv_id", "row_id", "before_id", F.round("overlap", 6).alias("overlap"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 5).alias("cos"))


def _bags(src: str, payload: str, keys: str) -> str:
    return f"SELECT {keys}, ('0x' || substr(md5(w), 1, 7))::BIGINT % 384 AS bucket, count(*)::DOUBLE AS k FROM (SELECT {keys}, UNNEST({_WORDS.format(f'lower({payload})')}) AS w FROM {src}) GROUP BY ALL"


@query(MEM + f", b AS ({_bags('mem', 'payload', 'row_id')}) SELECT row_id, bucket, round(k / sqrt(sum(k * k) OVER (PARTITION BY row_id)), 6) AS weight FROM b")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    bag = vectors.buckets(F.col("payload"))
    times = lambda k: F.size(F.filter("bag", lambda x: x == k)).cast("double")
    rows = mem(spark, d).select("row_id", bag.alias("bag")).withColumn("cells", F.transform(F.array_distinct("bag"), lambda k: F.struct(k.alias("bucket"), times(k).alias("k"))))
    norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["k"] * c["k"]))
    return rows.withColumn("norm", norm).select("row_id", "norm", F.explode("cells").alias("c")).select("row_id", "c.bucket", F.round(F.col("c.k") / F.col("norm"), 6).alias("weight"))


_ASKED = ", asked AS (SELECT conv_id, max(turn_index) AS query_turn, arg_max(payload, turn_index * 1000000000000 + row_id) AS query FROM mem GROUP BY 1)"
_COS = (
    f", pb AS ({_bags('mem', 'payload', 'conv_id, row_id')}), qb AS ({_bags('asked', 'query', 'conv_id')})"
    ", pn AS (SELECT row_id, sqrt(sum(k * k)) AS n FROM pb GROUP BY 1), qn AS (SELECT conv_id, sqrt(sum(k * k)) AS n FROM qb GROUP BY 1)"
    ", dots AS (SELECT p.row_id, sum(p.k * q.k) AS dot FROM pb p JOIN qb q ON q.conv_id = p.conv_id AND q.bucket = p.bucket GROUP BY 1)"
    ", cos AS (SELECT m.row_id, coalesce(dot / nullif(pn.n * qn.n, 0), 0) AS cos FROM mem m LEFT JOIN dots USING (row_id) LEFT JOIN pn USING (row_id) LEFT JOIN qn ON qn.conv_id = m.conv_id)"
)


def asked(m: DataFrame) -> DataFrame:
    """Each conversation's query: the payload of its last row."""
    return m.groupBy("conv_id").agg(F.max("turn_index").alias("query_turn"), F.max_by("payload", F.struct("turn_index", "row_id")).alias("query"))


@query(MEM + _ASKED + _COS + " SELECT row_id, round(cos, 6) AS cos FROM cos")
def query_align(spark: SparkSession, d: str) -> DataFrame:
    m = mem(spark, d)
    q = asked(m).select("conv_id", vectors.bag(F.col("query")).alias("b")).select("conv_id", vectors.weights(F.col("b")).alias("q"), vectors.norm(F.col("b")).alias("q_norm"))
    rows = m.select("conv_id", "row_id", vectors.bag(F.col("payload")).alias("p")).join(q, "conv_id")
    return rows.select("row_id", F.round(vectors.bag_cosine(F.col("p"), F.col("q"), F.col("q_norm")), 6).alias("cos"))


@query(MEM + _ASKED + " SELECT row_id, round(exp(-0.15 * greatest(query_turn - turn_index, 0)), 9) AS recency FROM mem JOIN asked USING (conv_id)")
def recency(spark: SparkSession, d: str) -> DataFrame:
    m = mem(spark, d)
    return m.join(asked(m), "conv_id").select("row_id", F.round(score.recency(F.col("turn_index"), F.col("query_turn")), 9).alias("recency"))


_N_CRIT = f", per AS (SELECT conv_id, count(*) FILTER ({_CRIT})::INT AS n_critical FROM mem GROUP BY 1)"
_FLOOR = "greatest(1, floor({0} * 2.5)::INT + 4)"


@query(MEM + _N_CRIT + f" SELECT conv_id, n_critical, {_FLOOR.format('n_critical')} AS floor_tokens FROM per")
def budget_floor(spark: SparkSession, d: str) -> DataFrame:
    return select.with_budget(mem(spark, d), MemoryConfig()).select("conv_id", "n_critical", "floor_tokens")


@query(MEM + _N_CRIT + f" SELECT conv_id, greatest({_FLOOR.format('greatest(n_critical, 1)')}, 284) AS budget FROM per")
def auto_budget(spark: SparkSession, d: str) -> DataFrame:
    return select.with_budget(mem(spark, d), MemoryConfig(auto_budget=True)).select("conv_id", "budget")


@query(MEM + _N_CRIT + f" SELECT conv_id, n_critical, CASE WHEN n_critical > 0 AND 400 < {_FLOOR.format('n_critical')} THEN 'BUDGET_TOO_SMALL' ELSE 'OK' END AS status FROM per")
def ladder_guard(spark: SparkSession, d: str) -> DataFrame:
    return select.with_budget(mem(spark, d), MemoryConfig()).select("conv_id", "n_critical", "status")


@query("SELECT doc_id, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 4 / 3)::BIGINT AS n_tokens FROM documents WHERE text IS NOT NULL")
def raw_token_est(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.raw_token_estimate(F.col("text")).alias("n_tokens"))


# --- replies ---------------------------------------------------------------------------------------------------------


def replies(spark: SparkSession, d: str) -> DataFrame:
    """A recorded reply per conversation and turn, built from the patches, damaged in a way that the turn decides."""
    clean = F.regexp_replace("payload", r'["\\]', "")
    kind = F.when(F.col("turn_index") % 5 == 3, F.concat(F.initcap("patch_type"), F.lit("s"))).otherwise(F.col("patch_type"))
    item = F.concat(F.lit('{"type": "'), kind, F.lit('", "payload": "'), clean, F.lit('", "patch_id": "'), "patch_id", F.lit('", "dependencies": ["p0_0", 3, null]}'))
    per = mem(spark, d).groupBy("conv_id", "turn_index").agg(F.array_sort(F.collect_list(F.struct("row_id", item.alias("item")))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), ", ")
    t = F.col("turn_index") % 5
    reply = (
        F.when(t == 1, F.concat(F.lit(" Here it is:\n```json\n["), body, F.lit("]\n```\n")))
        .when(t == 2, F.concat(F.lit("Sure: ["), body, F.lit(",] done")))
        .when(t == 3, F.concat(F.lit('{"n": 1, "patches": ['), body, F.lit("]}")))
        .when((t == 4) & (F.col("conv_id") % 7 == 0), F.concat(F.lit("["), body))
        .otherwise(F.concat(F.lit("["), body, F.lit("]")))
    )
    return per.select("conv_id", "turn_index", reply.alias("llm_response"))


_CLEAN = "regexp_replace(payload, '[\"\\\\]', '', 'g')"
_KIND = "CASE WHEN turn_index % 5 = 3 THEN upper(patch_type[1:1]) || patch_type[2:] || 's' ELSE patch_type END"
REPLIES = (
    MEM + f""", body AS (SELECT conv_id, turn_index, string_agg('{{"type": "' || {_KIND} || '", "payload": "' || {_CLEAN} || '", "patch_id": "' || patch_id || '", "dependencies": ["p0_0", 3, null]}}', ', ' ORDER BY row_id) AS b FROM mem GROUP BY 1, 2)
, replies AS (SELECT conv_id, turn_index, CASE turn_index % 5 WHEN 1 THEN ' Here it is:' || chr(10) || '```json' || chr(10) || '[' || b || ']' || chr(10) || '```' || chr(10) WHEN 2 THEN 'Sure: [' || b || ',] done' WHEN 3 THEN '{{"n": 1, "patches": [' || b || ']}}'
    WHEN 4 THEN CASE WHEN conv_id % 7 = 0 THEN '[' || b ELSE '[' || b || ']' END ELSE '[' || b || ']' END AS llm_response FROM body)
"""
)
_BAD = "(turn_index % 5 = 4 AND conv_id % 7 = 0)"


@query(REPLIES + "SELECT conv_id, turn_index, CASE WHEN contains(llm_response, '```') THEN regexp_extract(llm_response, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) ELSE trim(llm_response) END AS t FROM replies")
def json_strip(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("conv_id", "turn_index", jsonx.strip_fences(F.col("llm_response")).alias("t"))


@query(REPLIES + f"SELECT conv_id, turn_index, '[' || b || CASE WHEN turn_index % 5 = 2 THEN ',]' ELSE ']' END AS t FROM body WHERE NOT {_BAD}")
def json_balanced(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("conv_id", "turn_index", jsonx.balanced_array(F.col("llm_response")).alias("t")).where("t IS NOT NULL")


@query(REPLIES + "SELECT conv_id, turn_index, regexp_replace(translate(llm_response, '“”‘’', '\"\"'''''), ',\\s*([\\]}])', '\\1', 'g') AS t FROM replies")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("conv_id", "turn_index", jsonx.repair(F.col("llm_response")).alias("t"))


@query(MEM + f"SELECT conv_id, turn_index, count(*) AS n_items FROM mem WHERE NOT {_BAD} GROUP BY 1, 2")
def json_parse(spark: SparkSession, d: str) -> DataFrame:
    return jsonx.explode_items(replies(spark, d)).where("error IS NULL").groupBy("conv_id", "turn_index").agg(F.count("*").alias("n_items"))


@query(MEM + f"SELECT DISTINCT conv_id, turn_index, 'parse_failure' AS error_type FROM mem WHERE {_BAD}")
def extract_errors(spark: SparkSession, d: str) -> DataFrame:
    return extract.extraction_errors(replies(spark, d))


_ITEMS = (
    MEM + f", i0 AS (SELECT conv_id, turn_index, row_id, patch_type, trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g')) AS payload FROM mem WHERE NOT {_BAD})"
    f", i1 AS (SELECT *, {_print('payload')} AS fingerprint FROM i0)"
    ", i2 AS (SELECT * FROM i1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn_index, fingerprint ORDER BY row_id) = 1)"
)


@query(
    _ITEMS + f" SELECT conv_id, 'p' || turn_index || '_' || (row_number() OVER (PARTITION BY conv_id, turn_index ORDER BY row_id) - 1) AS patch_id, patch_type, payload, fingerprint, patch_type || '::' || ({_topic('payload')}) AS slot_key, {_tokens(_line())} AS token_cost, 'p0_0,3' AS deps FROM i2"
)
def extract_items(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_items(replies(spark, d)).select("conv_id", "patch_id", "patch_type", "payload", "fingerprint", "slot_key", "token_cost", F.array_join("dependencies", ",").alias("deps"))


@query(_ITEMS + f" SELECT (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn_index FROM mem)) AS turns, count(*) AS extracted, (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn_index FROM mem WHERE {_BAD})) AS errors FROM i2")
def batch_stats(spark: SparkSession, d: str) -> DataFrame:
    r = replies(spark, d)
    return r.agg(F.count("*").alias("turns")).crossJoin(extract.extract_items(r).agg(F.count("*").alias("extracted"))).crossJoin(extract.extraction_errors(r).agg(F.count("*").alias("errors")))


# --- filters, joins, windows -----------------------------------------------------------------------------------------


@query(MEM + f"SELECT conv_id, patch_id, patch_type, payload FROM mem WHERE {_CRIT}")
def critical_patches(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).where(memory.is_critical()).select("conv_id", "patch_id", "patch_type", "payload")


@query(MEM + "SELECT conv_id, patch_id, turn_index, patch_type, payload, array_to_string(deps, ',') AS deps, token_cost, fingerprint, slot_key FROM mem")
def all_patches(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).select("conv_id", "patch_id", "turn_index", "patch_type", "payload", F.array_join("dependencies", ",").alias("deps"), "token_cost", "fingerprint", "slot_key")


@query(MEM + f", o AS (SELECT *, sum(greatest(utility, 0)) OVER (PARTITION BY conv_id) AS s FROM mem WHERE NOT {_CRIT}) SELECT row_id FROM o WHERE utility <= 0 OR utility / (CASE WHEN s = 0 THEN 1e-9 ELSE s END) >= 0.01")
def shadow_filter(spark: SparkSession, d: str) -> DataFrame:
    return score.shadow_filter(mem(spark, d)).select("row_id")


@query(MEM + "SELECT row_id FROM mem WHERE " + " OR ".join(f"contains(lower(payload), '{m}')" for m in REVISION_MARKS))
def revision_markers(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).where(text.has_revision_mark(F.col("payload"))).select("row_id")


_EDGES = ", e AS (SELECT DISTINCT conv_id, patch_id, UNNEST(deps) AS dep FROM mem), edges AS (SELECT e.* FROM e JOIN mem m ON m.conv_id = e.conv_id AND m.patch_id = e.dep)"


@query(MEM + _EDGES + " SELECT conv_id, patch_id, dep FROM edges")
def dep_edges(spark: SparkSession, d: str) -> DataFrame:
    return memory.dependency_edges(mem(spark, d))


_DEPS = ", deps_n AS (SELECT conv_id, dep, count(*) AS n FROM (SELECT conv_id, UNNEST(deps) AS dep FROM mem) WHERE dep IS NOT NULL GROUP BY 1, 2)"


@query(MEM + _DEPS + " SELECT m.row_id, coalesce(n, 0) AS n FROM mem m LEFT JOIN deps_n x ON x.conv_id = m.conv_id AND x.dep = m.patch_id")
def dep_counts(spark: SparkSession, d: str) -> DataFrame:
    m = mem(spark, d)
    n = memory.dependent_counts(m).withColumnRenamed("dep", "patch_id")
    return m.join(n, ["conv_id", "patch_id"], "left").select("row_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(MEM + f", held AS (SELECT DISTINCT conv_id, {_print('payload')} AS fp FROM memory_snapshots WHERE payload IS NOT NULL) SELECT row_id FROM mem m WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.conv_id = m.conv_id AND h.fp = m.fingerprint)")
def anti_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "memory_snapshots").where("payload IS NOT NULL").select("conv_id", text.fingerprint(F.col("payload")).alias("fingerprint"))
    return mem(spark, d).join(held, ["conv_id", "fingerprint"], "left_anti").select("row_id")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Events as the turns of a conversation per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in EVENT_TYPES.items() for x in kv)), F.col("event_type"))
    e = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), (F.row_number().over(w) - 1).alias("turn_index"), "event_type", "props", kind.alias("kind"))
    return e.select("conv_id", "turn_index", F.when(F.col("turn_index") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("What about the "), "kind", F.lit(" of "), "props", F.lit("?")).alias("text"))


_KIND_OF = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TYPES.items()) + " END"
TURNS = f"""WITH e AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_index, {_KIND_OF} AS kind, props FROM events)
, turns AS (SELECT conv_id, turn_index, CASE WHEN turn_index % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, 'What about the ' || kind || ' of ' || props || '?' AS text FROM e)
"""


@query(TURNS + "SELECT * FROM turns")
def scan_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d)


@query(TURNS + "SELECT conv_id, turn_index, coalesce(string_agg('[' || role || '] ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn_index ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '') AS context FROM turns")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return extract.recent_turns(turns(spark, d)).select("conv_id", "turn_index", "context")


@query(TURNS + f"SELECT conv_id, turn_index, (sum({_tokens('text')}) OVER (PARTITION BY conv_id ORDER BY turn_index))::BIGINT AS history_tokens FROM turns")
def history_growth(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    return turns(spark, d).select("conv_id", "turn_index", F.sum(text.count_tokens(F.col("text"))).over(w).alias("history_tokens"))


@query(MEM + f", l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index DESC, row_id DESC) AS k FROM mem) SELECT conv_id, string_agg({_line()}, chr(10) ORDER BY turn_index, row_id) AS context FROM l WHERE k <= 8 GROUP BY 1")
def recent_context(spark: SparkSession, d: str) -> DataFrame:
    return extract.recent_context(mem(spark, d))


@query()
def stability(spark: SparkSession, d: str) -> DataFrame:
    return evals.stability(extract.recent_turns(turns(spark, d), 4))


@query(TURNS + "SELECT conv_id, turn_index AS query_no, " + ", ".join(f"round(sum(contains(lower(text), '{t}')::INT * pow(2.0, turn_index)) OVER w / pow(2.0, turn_index + 1), 9) AS ema_{t}" for t in TYPES) + " FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn_index)")
def query_ema(spark: SparkSession, d: str) -> DataFrame:
    q = turns(spark, d).select("conv_id", F.col("turn_index").alias("query_no"), F.col("text").alias("query"))
    return score.query_ema(q).select("conv_id", "query_no", *(F.round(f"ema_{t}", 9).alias(f"ema_{t}") for t in TYPES))


_RAW = " + ".join(f"{v[2]} * (1 + 0.5 * ema_{t})" for t, v in TYPES.items())


@query(
    TURNS + ", ema AS (SELECT conv_id, turn_index AS query_no, " + ", ".join(f"sum(contains(lower(text), '{t}')::INT * pow(2.0, turn_index)) OVER w / pow(2.0, turn_index + 1) AS ema_{t}" for t in TYPES) + " FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn_index))"
    " SELECT conv_id, query_no, " + ", ".join(f"greatest(5, floor(400 * ({v[2]} * (1 + 0.5 * ema_{t})) / ({_RAW}))::INT) AS budget_{t}" for t, v in TYPES.items()) + " FROM ema"
)
def type_budgets(spark: SparkSession, d: str) -> DataFrame:
    q = turns(spark, d).select("conv_id", F.col("turn_index").alias("query_no"), F.col("text").alias("query"))
    return score.type_budgets(score.query_ema(q))


@query(MEM + "SELECT conv_id, row_id, lower(regexp_extract(payload, P, 1)) AS service, lower(regexp_extract(payload, P, 2)) AS slot, regexp_extract(payload, P, 3) AS value FROM mem WHERE patch_type = 'slot' AND regexp_matches(payload, P)".replace("P)", "'^(?:\\[SLOT\\] )?(\\w+)\\.(\\w+) ?= ?(.*)$')").replace("P,", "'^(?:\\[SLOT\\] )?(\\w+)\\.(\\w+) ?= ?(.*)$',"))
def slot_kv(spark: SparkSession, d: str) -> DataFrame:
    return extract.slot_notes(mem(spark, d))


# --- the memory ------------------------------------------------------------------------------------------------------

_T1 = f""", f1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, fingerprint ORDER BY turn_index DESC, row_id) AS k, min({{'t': turn_index, 'r': row_id}}) OVER (PARTITION BY conv_id, fingerprint) AS f FROM mem WHERE NOT {_CRIT})
, t1 AS (SELECT conv_id, row_id, turn_index, utility, slot_key, f.t AS pos_turn, f.r AS pos_row, false AS crit FROM f1 WHERE k = 1 UNION ALL SELECT conv_id, row_id, turn_index, utility, slot_key, turn_index, row_id, true FROM mem WHERE {_CRIT})
"""


@query(MEM + _T1 + "SELECT row_id, pos_turn, pos_row FROM t1")
def t1_dedup(spark: SparkSession, d: str) -> DataFrame:
    return memory.t1_dedup(mem(spark, d)).select("row_id", "pos_turn", "pos_row")


_T2 = ", t2 AS (SELECT row_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, slot_key ORDER BY utility DESC, turn_index DESC, pos_turn, pos_row) AS k FROM t1 WHERE NOT crit) WHERE k = 1 UNION ALL SELECT row_id FROM t1 WHERE crit)"


@query(MEM + _T1 + _T2 + " SELECT row_id FROM t2")
def t2_fusion(spark: SparkSession, d: str) -> DataFrame:
    return memory.t2_fusion(memory.t1_dedup(mem(spark, d))).select("row_id")


@query()
def t3_delta(spark: SparkSession, d: str) -> DataFrame:
    return memory.t3_delta(mem(spark, d)).select("row_id", "payload", "token_cost", "is_delta", "delta_base")


_T4 = """, reach AS (SELECT conv_id, patch_id, 0 AS depth, [patch_id] AS seen FROM mem WHERE len(deps) = 0
  UNION SELECT e.conv_id, e.patch_id, r.depth + 1, list_append(r.seen, e.patch_id) FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.dep = r.patch_id WHERE NOT list_contains(r.seen, e.patch_id))
, depths AS (SELECT conv_id, patch_id, min(depth) AS depth FROM reach GROUP BY 1, 2)
"""


@query(MEM + _EDGES + _T4 + f"SELECT m.row_id, coalesce(x.depth, 0) AS causal_depth FROM mem m LEFT JOIN depths x ON x.conv_id = m.conv_id AND x.patch_id = m.patch_id WHERE {_CRIT} OR coalesce(x.depth, 0) = 0 OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.conv_id = m.conv_id AND e.dep = m.patch_id)")
def t4_prune(spark: SparkSession, d: str) -> DataFrame:
    return memory.t4_prune(mem(spark, d)).select("row_id", "causal_depth")


@query()
def merge_memory(spark: SparkSession, d: str) -> DataFrame:
    return memory.merge_memory(mem(spark, d)).where("kept").select("conv_id", "row_id")


@query()
def superseded(spark: SparkSession, d: str) -> DataFrame:
    return memory.merge_memory(mem(spark, d)).where("superseded_by IS NOT NULL").select("conv_id", "row_id", "superseded_by")


@query(MEM + "SELECT conv_id, count(*) AS n_patches, sum(token_cost)::BIGINT AS patch_tokens FROM mem GROUP BY 1")
def memory_tokens(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).groupBy("conv_id").agg(F.count("*").alias("n_patches"), F.sum("token_cost").alias("patch_tokens"))


@query(MEM + "SELECT conv_id, patch_type, sum(token_cost)::BIGINT AS used FROM mem GROUP BY 1, 2")
def tokens_by_type(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).groupBy("conv_id", "patch_type").agg(F.sum("token_cost").alias("used"))


@query(
    MEM + _ASKED + _COS + _DEPS + ", most AS (SELECT conv_id, max(token_cost) AS mc FROM mem GROUP BY 1), md AS (SELECT conv_id, max(n) AS md FROM deps_n GROUP BY 1)"
    f" SELECT m.row_id, round(0.45 * (cos + {_case(3)}) + 0.20 * coalesce(x.n, 0) / coalesce(md, 1) + 0.15 * exp(-0.15 * greatest(query_turn - turn_index, 0)) - 0.20 * token_cost / greatest(mc, 1), 6) AS utility"
    " FROM mem m JOIN cos USING (row_id) JOIN asked a ON a.conv_id = m.conv_id JOIN most ON most.conv_id = m.conv_id LEFT JOIN md ON md.conv_id = m.conv_id LEFT JOIN deps_n x ON x.conv_id = m.conv_id AND x.dep = m.patch_id"
)
def utility(spark: SparkSession, d: str) -> DataFrame:
    m = mem(spark, d)
    return score.score(m, asked(m)).select("row_id", F.round("utility", 6).alias("utility"))


@query(
    MEM + f", l AS (SELECT conv_id, list({{'o': -utility / greatest(token_cost, 1), 't': turn_index, 'r': row_id, 'c': token_cost::BIGINT}} ORDER BY -utility / greatest(token_cost, 1), turn_index, row_id) AS xs FROM mem WHERE NOT {_CRIT} GROUP BY 1)"
    ", p AS (SELECT conv_id, list_reduce(xs, lambda a, x: CASE WHEN a.room > 0 AND x.c <= a.room THEN {'room': a.room - x.c, 'taken': list_append(a.taken, x.r)} ELSE a END, {'room': 400::BIGINT, 'taken': CAST([] AS BIGINT[])}) AS a FROM l)"
    " SELECT conv_id, UNNEST(a.taken) AS row_id FROM p"
)
def greedy_fill(spark: SparkSession, d: str) -> DataFrame:
    m = mem(spark, d)
    room = m.select("conv_id").distinct().select("conv_id", F.lit(400).alias("budget"), F.lit(0).alias("used"))
    picks = select.greedy_fill(m.where(~memory.is_critical()), room)
    return picks.join(m.select("conv_id", "patch_id", "row_id"), ["conv_id", "patch_id"]).select("conv_id", "row_id")


_MOST = "greatest(2, trunc((400.0 / n_critical - 4) / 1.4)::INT)"


@query(
    MEM + _N_CRIT + f", ok AS (SELECT * FROM per WHERE n_critical > 0 AND 400 >= {_FLOOR.format('n_critical')})"
    f", s AS (SELECT row_id, payload, {_MOST} AS most, " + _WORDS.format("payload") + f" AS ws FROM mem JOIN ok USING (conv_id) WHERE {_CRIT})"
    ", o AS (SELECT row_id, payload, most, ws, list_sort(list_transform(ws, lambda w, i: {'o': -(CASE WHEN regexp_matches(w, '\\d') THEN 2 ELSE 0 END + CASE WHEN contains(w, '%') OR " + _UP.format("w") + " THEN 1 ELSE 0 END + CASE WHEN " + _FIRST_UP + " THEN 1 ELSE 0 END), 'i': i, 'w': w}))[1:most] AS best FROM s)"
    " SELECT row_id, CASE WHEN len(ws) <= most THEN payload ELSE array_to_string(list_transform(list_sort(list_transform(best, lambda e: {'i': e.i, 'w': e.w})), lambda e: e.w), ' ') END AS payload FROM o"
)
def ladder_stage1(spark: SparkSession, d: str) -> DataFrame:
    return select.stage_one(mem(spark, d), MemoryConfig()).select("row_id", "payload")


@query()
def ladder(spark: SparkSession, d: str) -> DataFrame:
    return select.fit_criticals(mem(spark, d), MemoryConfig()).select("conv_id", "pos", "patch_id", "payload", "token_cost", "mode", "status")


@query()
def t6_select(spark: SparkSession, d: str) -> DataFrame:
    return select.select_rows(mem(spark, d)).select("conv_id", "critical", "pos", "patch_id", "payload", "token_cost", "mode")


def _render(spark: SparkSession, d: str, mode: str, whole: bool = False) -> DataFrame:
    """All rows of each conversation in a given mode; unless whole, only the first two critical ones and the first other one."""
    w = Window.partitionBy("conv_id", "critical").orderBy("turn_index", "row_id")
    rows = mem(spark, d).withColumn("critical", memory.is_critical()).withColumn("pos", F.row_number().over(w))
    if not whole:
        rows = rows.where("pos <= IF(critical, 2, 1)")
    return select.render(rows.withColumn("mode", F.lit(mode))).select("conv_id", "context")


_SHOWN = MEM + f", r AS (SELECT *, {_CRIT} AS crit, row_number() OVER (PARTITION BY conv_id, {_CRIT} ORDER BY turn_index, row_id) AS pos FROM mem QUALIFY pos <= CASE WHEN crit THEN 2 ELSE 1 END)"
_MERGED = ", g AS (SELECT conv_id, patch_type, string_agg(payload, '{sep}' ORDER BY pos) AS p FROM r WHERE crit GROUP BY 1, 2)"


@query(_SHOWN + f" SELECT conv_id, string_agg({_line()}, chr(10) ORDER BY NOT crit, pos) AS context FROM r GROUP BY 1")
def render_context(spark: SparkSession, d: str) -> DataFrame:
    return _render(spark, d, "off")


@query(_SHOWN + _MERGED.replace("{sep}", "; ") + f", ls AS (SELECT conv_id, 0 AS part, patch_type, {_line('patch_type', 'p')} AS line FROM g UNION ALL SELECT conv_id, 1, patch_type, {_line()} FROM r WHERE NOT crit) SELECT conv_id, string_agg(line, chr(10) ORDER BY part, patch_type) AS context FROM ls GROUP BY 1")
def render_dense(spark: SparkSession, d: str) -> DataFrame:
    return _render(spark, d, "dense")


@query(
    _SHOWN + _MERGED.replace("{sep}", " ") + ", u AS (SELECT conv_id, string_agg('[' || upper(patch_type[1:1]) || '] ' || p, ' ' ORDER BY patch_type) AS line FROM g GROUP BY 1)"
    f" SELECT i.conv_id, concat_ws(chr(10), coalesce(u.line, ''), (SELECT string_agg({_line()}, chr(10)) FROM r WHERE r.conv_id = i.conv_id AND NOT crit)) AS context FROM (SELECT DISTINCT conv_id FROM r) i LEFT JOIN u USING (conv_id)"
)
def render_ultra(spark: SparkSession, d: str) -> DataFrame:
    return _render(spark, d, "ultra")


_ALL = MEM + f", r AS (SELECT *, {_CRIT} AS crit, row_number() OVER (PARTITION BY conv_id, {_CRIT} ORDER BY turn_index, row_id) AS pos FROM mem)"


@query(_ALL + f" SELECT conv_id, string_agg({_line()}, chr(10) ORDER BY NOT crit, pos) AS context FROM r GROUP BY 1")
def render_context_all(spark: SparkSession, d: str) -> DataFrame:
    return _render(spark, d, "off", whole=True)


@query(_ALL + _MERGED.replace("{sep}", "; ") + f", ls AS (SELECT conv_id, 0 AS part, patch_type, 0 AS pos, {_line('patch_type', 'p')} AS line FROM g UNION ALL SELECT conv_id, 1, '', pos, {_line()} FROM r WHERE NOT crit) SELECT conv_id, string_agg(line, chr(10) ORDER BY part, patch_type, pos) AS context FROM ls GROUP BY 1")
def render_dense_all(spark: SparkSession, d: str) -> DataFrame:
    return _render(spark, d, "dense", whole=True)


@query(
    _ALL + _MERGED.replace("{sep}", " ") + ", u AS (SELECT conv_id, string_agg('[' || upper(patch_type[1:1]) || '] ' || p, ' ' ORDER BY patch_type) AS line FROM g GROUP BY 1)"
    f", o AS (SELECT conv_id, string_agg({_line()}, chr(10) ORDER BY pos) AS lines FROM r WHERE NOT crit GROUP BY 1)"
    " SELECT i.conv_id, concat_ws(chr(10), coalesce(u.line, ''), o.lines) AS context FROM (SELECT DISTINCT conv_id FROM r) i LEFT JOIN u USING (conv_id) LEFT JOIN o USING (conv_id)"
)
def render_ultra_all(spark: SparkSession, d: str) -> DataFrame:
    return _render(spark, d, "ultra", whole=True)


@query()
def compress(spark: SparkSession, d: str) -> DataFrame:
    m = mem(spark, d)
    return engine.compress(m, asked(m))


@query()
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    m = mem(spark, d)
    return engine.stats(m, engine.compress(m))


@query(MEM + _N_CRIT + f" SELECT conv_id, 100.0::DOUBLE AS crr FROM per WHERE n_critical > 0")
def crr(spark: SparkSession, d: str) -> DataFrame:
    m = mem(spark, d)
    return engine.stats(m, engine.compress(m)).where("critical_total > 0").select("conv_id", "crr")


@query()
def trr(spark: SparkSession, d: str) -> DataFrame:
    m = mem(spark, d)
    return engine.stats(m, engine.compress(m)).select("conv_id", F.col("trr_by_conversation").alias("trr"))


# --- evaluation, models, files ---------------------------------------------------------------------------------------

_SR = [f"sr_q_{x}" for x in ("train_departure", "train_arriveby", "attraction_area", "attraction_type", "train_day", "train_destination", "restaurant_name", "restaurant_bookday", "taxi_destination", "taxi_departure")]
_RESULTS = "WITH v AS (SELECT DISTINCT * FROM eval_results WHERE compressed_tokens > 0), l AS (SELECT method, UNNEST([" + ", ".join(_SR) + "]) AS hit FROM v), sr AS (SELECT method, count(*) FILTER (hit) AS sr_correct, count(*) AS sr_total, round(avg(hit::INT), 6) AS sr FROM l WHERE hit IS NOT NULL GROUP BY 1) "


@query(_RESULTS + "SELECT * FROM sr")
def semantic_recall(spark: SparkSession, d: str) -> DataFrame:
    return evals.recall_by_method(table(spark, d, "eval_results"))


@query(
    _RESULTS + ", p AS (SELECT method, count(*) AS n_dialogues, round(avg(raw_tokens), 4) AS mean_raw_tokens, round(avg(compressed_tokens), 4) AS mean_compressed_tokens, round(avg(raw_tokens / compressed_tokens), 4) AS mean_compression_ratio, round(avg(cpi), 5) AS mean_cpi, round(avg(time_s), 4) AS mean_time_s FROM v GROUP BY 1)"
    " SELECT p.*, sr_correct, sr_total, sr FROM p LEFT JOIN sr USING (method)"
)
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evals.summary(table(spark, d, "eval_results"))


@query("SELECT DISTINCT method, dialogue_id, round(n_visible / n_gt_constraints, 4) AS cpi FROM eval_results WHERE n_gt_constraints > 0")
def cpi(spark: SparkSession, d: str) -> DataFrame:
    return evals.visible_share(table(spark, d, "eval_results"))


@query("SELECT method, round(avg(raw_tokens / compressed_tokens), 4) AS ratio FROM (SELECT DISTINCT * FROM eval_results WHERE compressed_tokens > 0) GROUP BY 1")
def compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    return evals.summary(table(spark, d, "eval_results")).select("method", F.col("mean_compression_ratio").alias("ratio"))


_ANY = lambda ps: "(" + " OR ".join(f"contains(lower(model_id), '{p}')" for p in ps) + ")"


@query(
    "WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i})" for i, m in enumerate(MODELS)) + f") t(model_id, pos)) SELECT model_id, pos, " + " + ".join(f"CASE WHEN contains(lower(model_id), '{p}') THEN {s} ELSE 0 END" for p, s in [*models.POINTS, *((x, models.SMALL_POINTS) for x in models.SMALL)]) + f" AS score FROM m WHERE {_ANY(models.CHAT_HINTS)} AND NOT {_ANY(models.CHAT_EXCLUDES)}"
)
def model_rank(spark: SparkSession, d: str) -> DataFrame:
    return models.model_scores(spark.createDataFrame(list(zip(MODELS, range(len(MODELS)), strict=True)), "model_id STRING, pos INT"))


@query(MEM + "SELECT row_id, patch_id, turn_index, patch_type, payload FROM mem")
def patch_json(spark: SparkSession, d: str) -> DataFrame:
    fields = "patch_id STRING, turn_index INT, patch_type STRING, payload STRING"
    return memory_files.patch_to_json(mem(spark, d)).select("row_id", F.from_json("json", fields).alias("p")).select("row_id", "p.*")


def _saved(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    path = f"{scratch_dir(spark)}/memloom-saved-{uuid.uuid4().hex}"
    memory_files.save_memory(mem(spark, d), path)
    return memory_files.load_memory(spark, path)


@query(MEM + "SELECT conv_id, patch_id, turn_index, patch_type, payload, array_to_string(deps, ',') AS deps FROM mem")
def roundtrip_memory(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d).select("conv_id", "patch_id", "turn_index", "patch_type", "payload", F.array_join("dependencies", ",").alias("deps"))


@query()
def load_merge(spark: SparkSession, d: str) -> DataFrame:
    """Saved rows derived anew and merged into an empty memory."""
    rows = _saved(spark, d)
    rows = rows.select("*", text.token_cost(F.col("patch_type"), F.col("payload")).alias("token_cost"), text.fingerprint(F.col("payload")).alias("fingerprint"), text.slot_key(F.col("patch_type"), F.col("payload")).alias("slot_key"))
    return memory.merge_memory(rows).where("kept").select("conv_id", "row_id")


@query()
def memory_stream(spark: SparkSession, d: str) -> DataFrame:
    """The stream of memory rows merged to its end: what it keeps equals merge_memory."""
    import uuid

    from memloom.streaming.memory_stream import COLUMNS, kept_rows, merge_stream

    base = f"{scratch_dir(spark)}/memloom-stream-{uuid.uuid4().hex}"
    rows = mem(spark, d).select(*COLUMNS)
    rows.write.parquet(f"{base}/in")
    stream = merge_stream(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return kept_rows(spark.read.parquet(f"{base}/out"))


assert set(CRITICAL) == {"constraint", "decision"}
