"""Registered queries: evaluation, leaderboards, data quality (AGG-1..8, JON-1..4, RSH-2..6, DQ-1/2, SNK-4).

Stand-in (SURVEY §7): ``events`` is a long (id, tag, value) table. Gold =
every event, value ``floor(value)``; prediction = every non-error event,
value ``round(value)`` — so sets overlap partially and one tag is absent
on the prediction side. Event types map to tags by the fixed table below.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import settings as S
from mailsift.operators import evaluate as E
from mailsift.operators.quality import drop_then_dropna, normalise_gold, validate_gold
from mailsift.plans import sqlkit as K
from mailsift.plans.registry import register
from mailsift.session import read_table

# Fixture definition: event type -> tag.
EVENT_TAG = {"view": "EMAIL", "click": "URL", "signup": "NAME_GIVEN",
             "purchase": "PHONE_MOBILE", "error": "ORGANIZATION"}
GOLD_TAGS = [t for t in S.STANDARD_TAGS if t in EVENT_TAG.values()]
PRED_TAGS = [t for t in GOLD_TAGS if t != "ORGANIZATION"]
EVAL_TAGS = [t for t in S.STANDARD_TAGS if t in PRED_TAGS]
FIXED_DATE = "01/01/2024"
MODEL, DATASET, VERSION = "signature-ner-events", "events", "1.0"


def _tag_expr():
    return F.create_map(*[F.lit(x) for kv in EVENT_TAG.items() for x in kv])[F.col("event_type")]


def gold_long(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("email_id"), _tag_expr().alias("tag"),
                     F.floor("value").cast("bigint").cast("string").alias("value"), "event_id")


def pred_long(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    return ev.select(F.col("user_id").alias("email_id"), _tag_expr().alias("tag"),
                     F.round("value").cast("bigint").cast("string").alias("value"), "event_id")


def gold_wide(spark, sf_dir):
    cells = E.concat_entities(gold_long(spark, sf_dir), "email_id", "event_id", tag_col="tag", name_col="value")
    return E.long_to_wide(cells, "email_id", GOLD_TAGS)


def pred_wide(spark, sf_dir):
    cells = E.concat_entities(pred_long(spark, sf_dir), "email_id", "event_id", tag_col="tag", name_col="value")
    return E.long_to_wide(cells, "email_id", PRED_TAGS)


def performance(spark, sf_dir):
    return E.evaluate_wide(gold_wide(spark, sf_dir), pred_wide(spark, sf_dir), "email_id")


# ------------------------------------------------------------------------------- SQL twins
_TAG_CASE = "CASE event_type " + " ".join(f"WHEN {K.q(k)} THEN {K.q(v)}" for k, v in EVENT_TAG.items()) + " END"
_BASE = f"""
gl AS (SELECT user_id AS email_id, {_TAG_CASE} AS tag, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, event_id FROM events),
pl AS (SELECT user_id AS email_id, {_TAG_CASE} AS tag, CAST(CAST(round(value) AS BIGINT) AS VARCHAR) AS value, event_id
       FROM events WHERE event_type <> 'error')"""


def _cells(src):
    return f"""(SELECT email_id, tag, CASE WHEN count(*) = 1 THEN min(value)
                 ELSE string_agg(value, ' ; ' ORDER BY event_id) END AS entities
          FROM {src} GROUP BY email_id, tag)"""


def _ratios(tp, fp, fn):
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN CAST(100.0 AS DOUBLE) * {tp} / ({tp} + {fp}) ELSE 0.0 END)"
    r = f"(CASE WHEN {tp} + {fn} > 0 THEN CAST(100.0 AS DOUBLE) * {tp} / ({tp} + {fn}) ELSE 0.0 END)"
    return p, r


_PERF = f"""
WITH {_BASE},
gcell AS {_cells('gl')}, pcell AS {_cells('pl')},
gv AS (SELECT email_id, tag, trim(v) AS value FROM (SELECT email_id, tag, unnest(string_split(entities, ' ; ')) AS v FROM gcell) WHERE trim(v) <> ''),
pv AS (SELECT email_id, tag, trim(v) AS value FROM (SELECT email_id, tag, unnest(string_split(entities, ' ; ')) AS v FROM pcell) WHERE trim(v) <> ''),
common AS (SELECT DISTINCT email_id FROM gcell INTERSECT SELECT DISTINCT email_id FROM pcell),
flags AS (SELECT email_id, tag, value, max(g) AS g, max(p) AS p FROM (
            SELECT email_id, tag, value, 1 AS g, 0 AS p FROM gv UNION ALL SELECT email_id, tag, value, 0, 1 FROM pv) u
          WHERE email_id IN (SELECT email_id FROM common) AND {K.in_list('tag', EVAL_TAGS)}
          GROUP BY email_id, tag, value),
cnt AS (SELECT tag, sum(g * p) AS TP, sum((1 - g) * p) AS FP, sum(g * (1 - p)) AS FN FROM flags GROUP BY tag),
tags AS (SELECT unnest({K.str_list(EVAL_TAGS)}) AS tag),
perf0 AS (SELECT t.tag AS Entity, CAST(coalesce(TP, 0) AS BIGINT) AS TP, CAST(coalesce(FP, 0) AS BIGINT) AS FP,
                 CAST(coalesce(FN, 0) AS BIGINT) AS FN FROM tags t LEFT JOIN cnt c ON t.tag = c.tag),
perf1 AS (SELECT *, {_ratios('TP', 'FP', 'FN')[0]} AS PRECISION, {_ratios('TP', 'FP', 'FN')[1]} AS RECALL FROM perf0),
perf AS (SELECT *, CASE WHEN PRECISION + RECALL > 0 THEN CAST(2.0 AS DOUBLE) * PRECISION * RECALL / (PRECISION + RECALL)
                   ELSE 0.0 END AS F1_MEASURE FROM perf1),
gwide AS (SELECT email_id, {', '.join(f"max(CASE WHEN tag = {K.q(t)} THEN entities END) AS {t}" for t in GOLD_TAGS)}
          FROM gcell GROUP BY email_id),
weights AS (SELECT Entity, CAST(n AS DOUBLE) / sum(n) OVER () AS WEIGHT FROM (
            {' UNION ALL '.join(f"SELECT {K.q(t)} AS Entity, count({t}) AS n FROM gwide" for t in GOLD_TAGS)}) w)"""


def _r2(x):
    return f"(round_even(({x}) * 100, 0) / 100)"


def _board(alias=""):
    a = alias
    return (f"CAST({_r2(a + 'PRECISION')} AS VARCHAR) || '/' || CAST({_r2(a + 'RECALL')} AS VARCHAR) || '/' || "
            f"CAST({_r2(a + 'F1_MEASURE')} AS VARCHAR)")


@register("eval_concat_entities", f"WITH {_BASE} SELECT * FROM {_cells('gl')} c")
def eval_concat_entities(spark, sf_dir):
    """AGG-5/AGG-6: per id and tag, values joined by ' ; ' in position order."""
    return E.concat_entities(gold_long(spark, sf_dir), "email_id", "event_id", tag_col="tag", name_col="value")


@register("eval_performance_long", f"""
WITH {_BASE},
common AS (SELECT DISTINCT email_id FROM gl INTERSECT SELECT DISTINCT email_id FROM pl),
flags AS (SELECT email_id, tag, value, max(g) AS g, max(p) AS p FROM (
            SELECT email_id, tag, value, 1 AS g, 0 AS p FROM gl UNION ALL SELECT email_id, tag, value, 0, 1 FROM pl) u
          WHERE email_id IN (SELECT email_id FROM common) AND {K.in_list('tag', EVAL_TAGS)}
          GROUP BY email_id, tag, value),
cnt AS (SELECT tag, sum(g * p) AS TP, sum((1 - g) * p) AS FP, sum(g * (1 - p)) AS FN FROM flags GROUP BY tag),
tags AS (SELECT unnest({K.str_list(EVAL_TAGS)}) AS tag),
perf0 AS (SELECT t.tag AS Entity, CAST(coalesce(TP, 0) AS BIGINT) AS TP, CAST(coalesce(FP, 0) AS BIGINT) AS FP,
                 CAST(coalesce(FN, 0) AS BIGINT) AS FN FROM tags t LEFT JOIN cnt c ON t.tag = c.tag),
perf1 AS (SELECT *, {_ratios('TP', 'FP', 'FN')[0]} AS PRECISION, {_ratios('TP', 'FP', 'FN')[1]} AS RECALL FROM perf0)
SELECT *, CASE WHEN PRECISION + RECALL > 0 THEN CAST(2.0 AS DOUBLE) * PRECISION * RECALL / (PRECISION + RECALL)
          ELSE 0.0 END AS F1_MEASURE FROM perf1""")
def eval_performance_long(spark, sf_dir):
    """AGG-1 + JON-2/3/4 on the long form."""
    return E.evaluate_long(gold_long(spark, sf_dir), pred_long(spark, sf_dir), "email_id", S.STANDARD_TAGS,
                           gold_tags=GOLD_TAGS, pred_tags=PRED_TAGS)


@register("eval_performance_wide", _PERF + "\nSELECT * FROM perf")
def eval_performance_wide(spark, sf_dir):
    """AGG-1 through the wide gold/prediction tables (unpivot, split, strip, set compare)."""
    return performance(spark, sf_dir)


@register("eval_tag_weights", _PERF + "\nSELECT * FROM weights")
def eval_tag_weights(spark, sf_dir):
    """AGG-2: tag weights from non-null gold cells."""
    return E.tag_weights(gold_wide(spark, sf_dir))


@register("eval_weighted_leaderboard", _PERF + f"""
, m AS (SELECT p.*, w.WEIGHT FROM perf p JOIN weights w ON p.Entity = w.Entity)
SELECT {K.q(MODEL)} AS MODEL, {K.q(DATASET)} AS TEST_DATASET,
       CAST(count(*) AS VARCHAR) || '/{len(S.STANDARD_TAGS)}' AS ENTITIES_NUMBER,
       {_r2('sum(PRECISION * WEIGHT)')} AS PRECISION, {_r2('sum(RECALL * WEIGHT)')} AS RECALL,
       {_r2('sum(F1_MEASURE * WEIGHT)')} AS F1_MEASURE, {K.q(VERSION)} AS MODEL_VERSION, {K.q(FIXED_DATE)} AS LAST_UPDATE
FROM m""")
def eval_weighted_leaderboard(spark, sf_dir):
    """AGG-3/AGG-4 + JON-1: weighted averages and the weighted leaderboard row."""
    perf = performance(spark, sf_dir)
    return E.weighted_leaderboard(perf, E.tag_weights(gold_wide(spark, sf_dir)), MODEL, DATASET, VERSION,
                                  F.lit(FIXED_DATE))


@register("eval_results", _PERF.replace(f"gcell AS {_cells('gl')}, pcell AS {_cells('pl')}",
    f"pcell AS {_cells('pl')}, gcell AS (SELECT * FROM {_cells('gl')} c WHERE email_id IN (SELECT email_id FROM pcell))") + f"""
, m AS (SELECT p.*, w.WEIGHT FROM perf p JOIN weights w ON p.Entity = w.Entity),
b AS (SELECT Entity, {_board()} AS v FROM perf)
SELECT {K.q(MODEL + '-ner')} AS MODEL, CAST(count(*) AS VARCHAR) || '/{len(S.STANDARD_TAGS)}' AS ENTITIES_NUMBER, {_r2('sum(PRECISION * WEIGHT)')} AS PRECISION,
       {_r2('sum(RECALL * WEIGHT)')} AS RECALL, {_r2('sum(F1_MEASURE * WEIGHT)')} AS F1_MEASURE,
       coalesce((SELECT v FROM b WHERE Entity = 'EMAIL'), '0.0/0.0/0.0') AS EMAIL, coalesce((SELECT v FROM b WHERE Entity = 'URL'), '0.0/0.0/0.0') AS URL
FROM m""")
def eval_results(spark, sf_dir):
    """RSH-5: gold restricted to the predicted ids, the weighted board and two cells of the full one, named after the endpoint."""
    full, weighted, _ = E.evaluate_results(gold_wide(spark, sf_dir), pred_wide(spark, sf_dir), "email_id", MODEL, DATASET, VERSION,
                                           "http://host/models/ner/predict", F.lit(FIXED_DATE))
    return weighted.select("MODEL", "ENTITIES_NUMBER", "PRECISION", "RECALL", "F1_MEASURE").join(full.select("MODEL", "EMAIL", "URL"), "MODEL")


@register("eval_sort_by_length", """
SELECT conv_id, turn, array_to_string(list(w ORDER BY length(w) DESC, w), ' ') AS words FROM (
  SELECT DISTINCT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations) GROUP BY 1, 2""")
def eval_sort_by_length(spark, sf_dir):
    """SRT-2: the different words of a turn, longest first, ties in code-point order."""
    conv = read_table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return conv.select("conv_id", "turn", F.array_join(E.sort_by_length_desc(F.array_distinct(F.split("text", " ", -1))), " ").alias("words"))


@register("flt_drop_then_dropna", """
SELECT event_id, event_type, CASE WHEN value >= 5 THEN value END AS value, 'dropped' AS form FROM events WHERE value >= 5
UNION ALL SELECT event_id, event_type, value, 'kept' FROM events WHERE value >= 5 AND event_id % 3 > 0""")
def flt_drop_then_dropna(spark, sf_dir):
    """FLT-6: listed columns go only if all exist; then rows with a null in any column go."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") >= 5, F.col("value")).alias("value"),
                                                    F.when(F.col("event_id") % 3 > 0, "x").alias("extra"))
    parts = [drop_then_dropna(ev, columns).drop("extra").withColumn("form", F.lit(form))
             for form, columns in (("dropped", ["extra"]), ("kept", ["extra", "missing"]))]
    return parts[0].unionByName(parts[1])


@register("eval_leaderboard_format", _PERF + f"""
SELECT CAST(list_position({K.str_list(S.LEADERBOARD_ROWS)}, Entity) AS INTEGER) AS position, Entity,
       {_board()} AS LEADER_BOARD_VALUE
FROM perf WHERE {K.in_list('Entity', S.LEADERBOARD_ROWS)}""")
def eval_leaderboard_format(spark, sf_dir):
    """RSH-2 + SRT-1: 'P/R/F1' strings in the fixed report order."""
    return E.format_leaderboard(performance(spark, sf_dir))


_FULL_TAGS = [c for c in S.FULL_LEADERBOARD_COLUMNS if c not in ("MODEL", "TEST_DATASET", "MODEL_VERSION", "LAST_UPDATE")]


@register("eval_full_leaderboard", _PERF + f"""
, b AS (SELECT Entity, {_board()} AS v FROM perf)
SELECT {', '.join(
    (K.q(MODEL) + ' AS MODEL') if c == 'MODEL' else (K.q(DATASET) + ' AS TEST_DATASET') if c == 'TEST_DATASET'
    else (K.q(VERSION) + ' AS MODEL_VERSION') if c == 'MODEL_VERSION' else (K.q(FIXED_DATE) + ' AS LAST_UPDATE')
    if c == 'LAST_UPDATE' else f"coalesce(max(CASE WHEN Entity = {K.q(c)} THEN v END), '0.0/0.0/0.0') AS {c}"
    for c in S.FULL_LEADERBOARD_COLUMNS)}
FROM b""")
def eval_full_leaderboard(spark, sf_dir):
    """RSH-3/RSH-4: one-row pivoted leaderboard; missing tags filled with 0.0/0.0/0.0."""
    return E.full_leaderboard(performance(spark, sf_dir), MODEL, DATASET, VERSION, last_update=F.lit(FIXED_DATE))


@register("eval_first_known", """
SELECT user_id, CASE WHEN count(*) = 1 THEN min(t) ELSE arg_min(t, event_id) FILTER (WHERE t <> 'UNKNOWN') END AS entity
FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'UNKNOWN' ELSE upper(event_type) END AS t FROM events)
GROUP BY user_id""")
def eval_first_known(spark, sf_dir):
    """AGG-7: first value that is not UNKNOWN per group (single row returns itself)."""
    ev = read_table(spark, sf_dir, "events").select(
        "user_id", "event_id",
        F.when(F.col("event_type") == "error", F.lit("UNKNOWN")).otherwise(F.upper("event_type")).alias("entity"))
    return E.first_known(ev, ["user_id"], "event_id")


@register("eval_substring_sieve", """
WITH d AS (SELECT DISTINCT user_id, CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) AS name FROM events)
SELECT a.user_id, a.name FROM d a
WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.user_id = a.user_id AND length(b.name) > length(a.name)
                  AND contains(b.name, a.name))""")
def eval_substring_sieve(spark, sf_dir):
    """AGG-8: per group, drop values contained in a longer value."""
    ev = read_table(spark, sf_dir, "events").select(
        "user_id", F.floor(F.col("value") * 10).cast("bigint").cast("string").alias("name"))
    return E.substring_sieve(ev, ["user_id"])


_NAMES = """SELECT user_id, event_id, CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) AS name, event_id % 50 AS "start", event_id % 50 + 5 AS "end",
  CASE WHEN event_type IN ('error', 'view') THEN 'UNKNOWN' ELSE upper(event_type) END AS entity FROM events"""


@register("eval_regroup_names", f"""
WITH n AS ({_NAMES}),
g AS (SELECT user_id, name, CAST(sum("start") AS BIGINT) AS "start", CAST(sum("end") AS BIGINT) AS "end",
             CASE WHEN count(*) = 1 THEN min(entity) ELSE arg_min(entity, event_id) FILTER (WHERE entity <> 'UNKNOWN') END AS entity
      FROM n GROUP BY user_id, name)
SELECT a.* FROM g a WHERE a.entity IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM g b WHERE b.user_id = a.user_id AND b.entity = a.entity AND length(b.name) > length(a.name) AND contains(b.name, a.name))""")
def eval_regroup_names(spark, sf_dir):
    """AGG-9: names regrouped with summed offsets and their first known tag, then sieved per tag."""
    return E.regroup_names(read_table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.floor(F.col("value") * 10).cast("bigint").cast("string").alias("name"), (F.col("event_id") % 50).alias("start"),
        (F.col("event_id") % 50 + 5).alias("end"),
        F.when(F.col("event_type").isin("error", "view"), "UNKNOWN").otherwise(F.upper("event_type")).alias("entity")), ["user_id"], "event_id")


@register("eval_run_summary", """
SELECT strftime(ts, '%Y-%m') AS api_url, count(*) FILTER (WHERE event_type <> 'error') AS n_predictions,
       count(*) FILTER (WHERE event_type = 'error') AS n_errors
FROM events GROUP BY 1""")
def eval_run_summary(spark, sf_dir):
    """SNK-4: predictions and errors per endpoint (endpoint = month bucket of the stand-in)."""
    ev = read_table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM").alias("api_url"), (F.col("event_type") == "error").alias("is_error"))
    return E.run_summary(ev)


@register("rsh_label_mappings", """
SELECT CAST(row_number() OVER (ORDER BY o, role) - 1 AS INTEGER) AS id, role AS label
FROM (SELECT role, min({'c': conv_id, 't': turn}) AS o FROM conversations GROUP BY role)""")
def rsh_label_mappings(spark, sf_dir):
    """RSH-6: id <-> label by first appearance."""
    return E.label_mappings(read_table(spark, sf_dir, "conversations"), "role", [F.col("conv_id"), F.col("turn")])


# ------------------------------------------------------------------------------- data quality
def _dq_source(spark, sf_dir):
    """Gold-like wide table with one deliberate format violation class per value band."""
    ev = read_table(spark, sf_dir, "events")
    cell = (F.when(F.col("value") < 1, F.lit("nan"))
            .when(F.col("value") < 2, F.lit("[a, b]"))
            .when(F.col("value") < 3, F.lit("   "))
            .when(F.col("value") < 4, F.lit("a , b"))
            .when(F.col("value") < 5, F.lit("a : b"))
            .when(F.col("value") < 6, F.lit("None"))
            .otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" ; "), F.col("user_id").cast("string"), F.lit(" "))))
    return ev.select(F.col("event_id").alias("email_id"), F.col("props").alias("email_body_text"),
                     cell.alias("EMAIL"), F.col("event_type").alias("URL"))


_DQ_CELL = """CASE WHEN value < 1 THEN 'nan' WHEN value < 2 THEN '[a, b]' WHEN value < 3 THEN '   '
  WHEN value < 4 THEN 'a , b' WHEN value < 5 THEN 'a : b' WHEN value < 6 THEN 'None'
  ELSE ' ' || event_type || ' ; ' || CAST(user_id AS VARCHAR) || ' ' END"""
_SENT = K.in_list("{c}", S.NULL_SENTINELS)


def _dq_norm_sql(c):
    x = f"(CASE WHEN {_SENT.format(c=c)} THEN '' ELSE {c} END)"
    x = f"(CASE WHEN starts_with({x}, '[') AND ends_with({x}, ']') THEN array_to_string(string_split(substr({x}, 2, length({x}) - 2), ','), ' ; ') ELSE {x} END)"
    return f"regexp_replace({x}, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')"


@register("dq_normalise", f"""
SELECT event_id AS email_id, CASE WHEN {_SENT.format(c='props')} THEN '' ELSE props END AS email_body_text,
       {_dq_norm_sql('c')} AS EMAIL, {_dq_norm_sql('event_type')} AS URL
FROM (SELECT *, {_DQ_CELL} AS c FROM events)""")
def dq_normalise(spark, sf_dir):
    """DQ-1: sentinels -> '', '[a,b]' -> 'a ; b', strip, blank -> ''."""
    return normalise_gold(_dq_source(spark, sf_dir))


@register("dq_validate", f"""
WITH s AS (SELECT {_DQ_CELL} AS EMAIL, event_type AS URL FROM events),
l AS (SELECT 'EMAIL' AS col, EMAIL AS v FROM s UNION ALL SELECT 'URL', URL FROM s)
SELECT rule, col AS "column", CAST(n AS BIGINT) AS n FROM (
  SELECT col, count(*) FILTER (WHERE {_SENT.format(c='v')}) AS sentinel,
         count(*) FILTER (WHERE starts_with(trim(v), '[') AND ends_with(trim(v), ']')) AS brackets,
         count(*) FILTER (WHERE length(v) > 0 AND regexp_full_match(v, '[\\t\\n\\x0B\\f\\r ]+')) AS whitespace_only,
         count(*) FILTER (WHERE regexp_matches(v, ' , | : ')) AS bad_separator
  FROM l GROUP BY col) UNPIVOT (n FOR rule IN (sentinel, brackets, whitespace_only, bad_separator))""")
def dq_validate(spark, sf_dir):
    """DQ-2: violation counts per rule and column (valid = all zero)."""
    return validate_gold(_dq_source(spark, sf_dir))


@register("flt_strip_empty", """
SELECT event_id, value < 10 AS note_is_null, value < 20 AS meta_is_null,
       '{"type":"' || event_type || '"' ||
       CASE WHEN value < 10 THEN '' ELSE ',"note":"v' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '"' END ||
       CASE WHEN value < 20 THEN '' ELSE ',"meta":{"k":"' || json_extract_string(props, '$.k') || '"' ||
            CASE WHEN value < 30 THEN '' ELSE ',"tag":"' || event_type || '"' END || '}' END || '}' AS json
FROM events""")
def flt_strip_empty(spark, sf_dir):
    """FLT-5: empty members of a nested record removed recursively (empty struct -> NULL)."""
    from mailsift.operators.quality import strip_empty
    ev = read_table(spark, sf_dir, "events")
    v = F.col("value")
    rec = F.struct(
        F.col("event_type").alias("type"),
        F.when(v < 10, F.lit("")).otherwise(F.concat(F.lit("v"), F.floor(v).cast("string"))).alias("note"),
        F.struct(F.when(v < 20, F.lit("")).otherwise(F.get_json_object("props", "$.k")).alias("k"),
                 F.when(v < 30, F.lit("")).otherwise(F.col("event_type")).alias("tag")).alias("meta"))
    x = ev.select("event_id", rec.alias("r"))
    x = x.select("event_id", strip_empty(F.col("r"), x.schema["r"].dataType).alias("s"))
    return x.select("event_id", F.col("s.note").isNull().alias("note_is_null"),
                    F.col("s.meta").isNull().alias("meta_is_null"), F.to_json("s").alias("json"))
