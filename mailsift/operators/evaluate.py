"""Evaluation of predictions against gold tags (AGG-1..9, JON-1..4, RSH-1..5, SRT-1, SNK-4).

Gold and predictions arrive either *wide* (one row per e-mail, one string
column per tag, values joined by " ; ") or *long* ``(id, tag, value)``.
The core works on the long form: one hash aggregation keyed by
``(id, tag, value)`` records whether each value is in the gold set and/or
the predicted set (set semantics per row and tag), then a 25-row aggregation
per tag gives TP/FP/FN. No join of the two big sides is needed; partial
aggregation happens map-side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift import settings as S
from mailsift.functions.text import strip_all
from mailsift.operators.ranks import numbered

# ---------------------------------------------------------------------------- wide <-> long
def unpivot_tags(wide: DataFrame, id_col: str, tags: list[str] | None = None) -> DataFrame:
    """Wide -> ``(id, tag, cell)`` for the tag columns present (RSH, JON-3 input)."""
    tags = [t for t in (tags or S.STANDARD_TAGS) if t in wide.columns]
    if not tags:
        return wide.select(id_col, F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("cell"))
    cols = [F.col(f"`{t}`").cast("string").alias(t) for t in tags]
    return wide.select(F.col(id_col), *cols).unpivot(id_col, tags, "tag", "cell")


def explode_values(cells: DataFrame, id_col: str, cell_col: str = "cell", keep_ids: bool = False) -> DataFrame:
    """Split cells on the multi-value separator, strip, drop blanks -> ``(id, tag, value)``. ``keep_ids``: a cell without a
    value gives one row with a null value, so that its id stays known."""
    parts = F.split(F.coalesce(F.col(cell_col), F.lit("")), S.MULTI_VALUE_SEPARATOR, -1)
    values = F.filter(F.transform(parts, strip_all), lambda v: v != "")
    if keep_ids:
        values = F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(None).cast("string")))
    return cells.select(id_col, "tag", F.explode(values).alias("value"))


def concat_entities(long: DataFrame, id_col: str, order_col: str, tag_col: str = "entity",
                    name_col: str = "name", skip_unknown: bool = True) -> DataFrame:
    """AGG-5/AGG-6: values of one tag per id joined by " ; " in position order.

    One value is stripped; several are joined as they are; null names are dropped; ``UNKNOWN`` is skipped. Rows are dealt by
    ranges of (id, tag, order): a range sorts and joins its own values, and a cell is made of one string for each range that
    it touches, so the values of one (id, tag) are never rows of one array. Ties of the order are taken by value."""
    df = long.where(F.col(name_col).isNotNull())
    if skip_unknown:
        df = df.where(F.col(tag_col) != "UNKNOWN")
    df = df.select(F.col(id_col), F.col(tag_col).alias("tag"), F.col(order_col).alias("_o"), F.col(name_col).alias("_n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartitionByRange(n, id_col, "tag", "_o", "_n").withColumn("_slice", F.spark_partition_id())
    part = df.groupBy(id_col, "tag", "_slice").agg(F.array_sort(F.collect_list(F.struct("_o", "_n"))).alias("_v"))
    part = part.select(id_col, "tag", "_slice", F.size("_v").alias("_k"), F.array_join(F.transform("_v", lambda x: x["_n"]), S.MULTI_VALUE_SEPARATOR).alias("_s"))
    cells = part.groupBy(id_col, "tag").agg(F.sum("_k").alias("_k"), F.array_sort(F.collect_list(F.struct("_slice", "_s"))).alias("_p"))
    joined = F.array_join(F.transform("_p", lambda x: x["_s"]), S.MULTI_VALUE_SEPARATOR)
    return cells.select(id_col, "tag", F.when(F.col("_k") == 1, strip_all(joined)).otherwise(joined).alias("entities"))


def long_to_wide(cells: DataFrame, id_col: str, tags: list[str], value_col: str = "entities") -> DataFrame:
    """Long ``(id, tag, cell)`` -> wide, one column per tag (pivot with explicit values)."""
    return cells.groupBy(id_col).pivot("tag", tags).agg(F.first(value_col))


# ---------------------------------------------------------------------------- core metrics
def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, F.lit(100.0) * num / den).otherwise(F.lit(0.0))


def evaluate_long(gold: DataFrame, pred: DataFrame, id_col: str, tags: list[str],
                  gold_tags: list[str] | None = None, pred_tags: list[str] | None = None,
                  restrict_to_common_ids: bool = True) -> DataFrame:
    """AGG-1 over long ``(id, tag, value)`` tables -> performance table.

    ``gold_tags``/``pred_tags`` are the tag columns each side carries (wide input); the evaluated tags are ``tags`` ∩ both, each
    gets a row even with zero counts. Rows are paired by id on the intersection of ids (JON-2/3); a row with a null value
    only says that its id exists. Each side is read once: one aggregation by (id, tag, value) flags the sides that hold a
    value, and (id) flags the sides that hold an id; both are far smaller than the tables."""
    gset = set(gold_tags) if gold_tags is not None else set(tags)
    pset = set(pred_tags) if pred_tags is not None else set(tags)
    eval_tags = [t for t in tags if t in gset and t in pset]
    g = gold.select(id_col, "tag", "value", F.lit(1).alias("g"), F.lit(0).alias("p"))
    p = pred.select(id_col, "tag", "value", F.lit(0).alias("g"), F.lit(1).alias("p"))
    known = F.col("tag").isin(eval_tags) & F.col("value").isNotNull()
    both = g.unionByName(p).select(id_col, F.when(known, F.col("tag")).alias("tag"), F.when(known, F.col("value")).alias("value"), "g", "p")
    # JON-4 as one aggregation: set membership flags per (id, tag, value); rows without a value keep the id
    flags = both.groupBy(id_col, "tag", "value").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    if restrict_to_common_ids:
        common = flags.groupBy(id_col).agg(F.max("g").alias("_g"), F.max("p").alias("_p")).where("_g + _p = 2").select(id_col)
        flags = flags.where("tag IS NOT NULL").join(common, id_col, "left_semi")
    counts = flags.where("tag IS NOT NULL").groupBy("tag").agg(
        F.sum(F.col("g") * F.col("p")).alias("TP"),
        F.sum((1 - F.col("g")) * F.col("p")).alias("FP"),
        F.sum(F.col("g") * (1 - F.col("p"))).alias("FN"))
    # a row for every tag: zeros are added before the last, tiny aggregation
    zeros = gold.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in eval_tags]).cast("array<string>")).alias("tag"),
                                              *[F.lit(0).cast("long").alias(c) for c in ("TP", "FP", "FN")])
    perf = counts.unionByName(zeros).groupBy(F.col("tag").alias("Entity")).agg(*[F.sum(c).cast("long").alias(c) for c in ("TP", "FP", "FN")])
    return with_ratios(perf)


def with_ratios(perf: DataFrame) -> DataFrame:
    p = _ratio(F.col("TP"), F.col("TP") + F.col("FP"))
    r = _ratio(F.col("TP"), F.col("TP") + F.col("FN"))
    out = perf.withColumn("PRECISION", p).withColumn("RECALL", r)
    f1 = F.when(F.col("PRECISION") + F.col("RECALL") > 0,
                F.lit(2.0) * F.col("PRECISION") * F.col("RECALL") / (F.col("PRECISION") + F.col("RECALL"))
                ).otherwise(F.lit(0.0))
    return out.withColumn("F1_MEASURE", f1)


def evaluate_wide(gold_wide: DataFrame, pred_wide: DataFrame, id_col: str,
                  tags: list[str] | None = None) -> DataFrame:
    """AGG-1 on wide tables (the reference's I/O shape)."""
    tags = tags or S.STANDARD_TAGS
    sides = [explode_values(unpivot_tags(w, id_col, tags), id_col, keep_ids=True) for w in (gold_wide, pred_wide)]
    return evaluate_long(*sides, id_col, tags, gold_tags=[c for c in gold_wide.columns if c in tags],
                         pred_tags=[c for c in pred_wide.columns if c in tags])


# ---------------------------------------------------------------------------- weights, boards
def round2_half_even(c: Column) -> Column:
    return F.rint(c * 100) / 100


def tag_weights(gold_wide: DataFrame, tags: list[str] | None = None, ignore_blank: bool = False) -> DataFrame:
    """AGG-2: non-null count of each present tag / total non-null count -> ``(Entity, WEIGHT)``."""
    present = [t for t in (tags or S.STANDARD_TAGS) if t in gold_wide.columns]

    def counted(t):
        c = F.col(f"`{t}`")
        return c.isNotNull() & (c != "") if ignore_blank else c.isNotNull()

    one = gold_wide.agg(*[F.count_if(counted(t)).alias(t) for t in present])
    long = one.unpivot([], present, "Entity", "n")
    total = F.sum("n").over(Window.partitionBy())  # ≤ 25 rows
    return long.select("Entity", (F.col("n") / total).alias("WEIGHT"))


def weighted_average(perf: DataFrame, weights: DataFrame) -> DataFrame:
    """AGG-3: Σ metric·weight after the inner merge (JON-1), rounded 2 half-even, plus the
    number of merged rows without nulls."""
    m = perf.join(F.broadcast(weights), "Entity", "inner")  # both sides ≤ 25 rows
    return m.agg(
        round2_half_even(F.sum(F.col("PRECISION") * F.col("WEIGHT"))).alias("PRECISION"),
        round2_half_even(F.sum(F.col("RECALL") * F.col("WEIGHT"))).alias("RECALL"),
        round2_half_even(F.sum(F.col("F1_MEASURE") * F.col("WEIGHT"))).alias("F1_MEASURE"),
        F.count_if(F.col("PRECISION").isNotNull() & F.col("RECALL").isNotNull()
                   & F.col("F1_MEASURE").isNotNull() & F.col("WEIGHT").isNotNull()).alias("non_zero_rows"))


def weighted_leaderboard(perf: DataFrame, weights: DataFrame, model: str, dataset: str,
                         version: str, last_update: Column | None = None) -> DataFrame:
    """AGG-4: weighted averages + model/dataset/version and ``n/25`` entity count."""
    avg = weighted_average(perf, weights)
    return avg.select(
        F.lit(model).alias("MODEL"), F.lit(dataset).alias("TEST_DATASET"),
        F.format_string(f"%d/{len(S.STANDARD_TAGS)}", F.col("non_zero_rows")).alias("ENTITIES_NUMBER"),
        "PRECISION", "RECALL", "F1_MEASURE", F.lit(version).alias("MODEL_VERSION"),
        (last_update if last_update is not None else F.date_format(F.current_date(), "dd/MM/yyyy")).alias("LAST_UPDATE"))


def _board_value(perf: DataFrame) -> Column:
    def s(c):
        return F.coalesce(round2_half_even(F.col(c)).cast("string"), F.lit("0.0"))
    return F.concat_ws("/", s("PRECISION"), s("RECALL"), s("F1_MEASURE"))


def format_leaderboard(perf: DataFrame, rows: list[str] | None = None) -> DataFrame:
    """RSH-2 + SRT-1: ``Entity, LEADER_BOARD_VALUE`` for the report rows, with their fixed position."""
    rows = rows or S.LEADERBOARD_ROWS
    order = F.array(*[F.lit(r) for r in rows])
    return (perf.where(F.col("Entity").isin(rows))
            .select(F.array_position(order, F.col("Entity")).cast("int").alias("position"), "Entity",
                    _board_value(perf).alias("LEADER_BOARD_VALUE")))


def full_leaderboard(perf: DataFrame, model: str, dataset: str, version: str,
                     columns: list[str] | None = None, last_update: Column | None = None) -> DataFrame:
    """RSH-4 (and RSH-3 with fill): one row; tag columns are ``P/R/F1``, missing tags ``0.0/0.0/0.0``."""
    columns = columns or S.FULL_LEADERBOARD_COLUMNS
    meta = {"MODEL", "TEST_DATASET", "MODEL_VERSION", "LAST_UPDATE"}
    tag_cols = [c for c in columns if c not in meta]
    vals = perf.where(F.col("Entity").isin(tag_cols)).select("Entity", _board_value(perf).alias("v"))
    row = vals.groupBy().pivot("Entity", tag_cols).agg(F.first("v"))
    fills = {
        "MODEL": F.lit(model), "TEST_DATASET": F.lit(dataset), "MODEL_VERSION": F.lit(version),
        "LAST_UPDATE": last_update if last_update is not None else F.date_format(F.current_date(), "dd/MM/yyyy"),
    }
    return row.select(*[fills[c].alias(c) if c in meta else F.coalesce(F.col(c), F.lit("0.0/0.0/0.0")).alias(c)
                        for c in columns])


def publish_performance(perf: DataFrame) -> DataFrame:
    """Performance table with its published column names."""
    return perf.withColumnRenamed("F1_MEASURE", "F1-MEASURE")


def run_summary(results: DataFrame, endpoint_col: str = "api_url", error_col: str = "is_error") -> DataFrame:
    """SNK-4: per endpoint number of predictions and of errors."""
    return results.groupBy(endpoint_col).agg(
        F.count_if(~F.col(error_col)).alias("n_predictions"), F.count_if(F.col(error_col)).alias("n_errors"))


# ---------------------------------------------------------------------------- small aggregates
def first_known(df: DataFrame, keys: list[str], order_col: str, value_col: str = "entity") -> DataFrame:
    """AGG-7: first value that is not UNKNOWN (a single row returns itself)."""
    agg = df.groupBy(*keys).agg(
        F.min_by(F.when(F.col(value_col) != "UNKNOWN", F.col(value_col)),
                 F.when(F.col(value_col) != "UNKNOWN", F.col(order_col))).alias("_known"),
        F.count(F.lit(1)).alias("_n"), F.min_by(F.col(value_col), F.col(order_col)).alias("_first"))
    return agg.select(*keys, F.when(F.col("_n") == 1, F.col("_first")).otherwise(F.col("_known")).alias(value_col))


GRAM_SIZES = (1, 2, 4, 8, 16, 32)


def _gram_size(n: Column) -> Column:
    """The largest gram size that fits into ``n`` characters, 0 for none."""
    size = F.lit(0)
    for q in GRAM_SIZES:
        size = F.when(n >= q, q).otherwise(size)
    return size


def _grams(value: Column, sizes: Column) -> Column:
    """Distinct ``struct<q, gram>`` of a value for each size of ``sizes``; size 0 has the empty gram."""
    def of(q):
        starts = F.sequence(F.lit(1), F.greatest(F.length(value) - q + 1, F.lit(1)))
        grams = F.array_distinct(F.transform(starts, lambda i: F.call_function("substr", value, i, q)))
        return F.transform(F.when(q == 0, F.array(F.lit(""))).otherwise(grams), lambda g: F.struct(q.alias("q"), g.alias("gram")))
    return F.flatten(F.transform(sizes, of))


def substring_sieve(df: DataFrame, keys: list[str], value_col: str = "name") -> DataFrame:
    """AGG-8: keep values not contained in a longer kept value (duplicates collapse; null values and keys are kept).

    A containment index: a longer value that holds v holds every gram of v, so v is looked up only where its rarest gram of
    the largest size (over half of v's length up to 32) occurs. An anti join ends at the first longer value that
    holds v, so no pairs are made; rows are at most values times characters times gram sizes."""
    every = df.select(*keys, value_col).distinct()
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in [*keys, value_col]])
    d, n = every.where(~missing), F.length(value_col)
    sizes = F.filter(F.array(F.lit(0), *[F.lit(q) for q in GRAM_SIZES]), lambda q: q <= n)
    held = d.select(*keys, F.col(value_col).alias("_v"), F.explode(_grams(F.col(value_col), sizes)).alias("_g"))
    held = held.select(*keys, "_v", "_g.q", "_g.gram")
    counts = held.groupBy(*keys, "q", "gram").agg(F.count(F.lit(1)).alias("_c"))
    own = d.select(*keys, F.col(value_col).alias("_v"), F.explode(_grams(F.col(value_col), F.array(_gram_size(n)))).alias("_g"))
    own = own.select(*keys, "_v", "_g.q", "_g.gram").join(counts, [*keys, "q", "gram"])
    rarest = own.groupBy(*keys, "_v").agg(F.min_by(F.struct("q", "gram"), F.struct("_c", "gram")).alias("_r"))
    rarest = rarest.select(*keys, F.col("_v").alias(value_col), "_r.q", "_r.gram")
    longer = held.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("q").alias("_o_q"), F.col("gram").alias("_o_gram"), F.col("_v").alias("_o_v"))
    cond = [F.col(k) == F.col(f"_o_{k}") for k in keys] + [F.col("q") == F.col("_o_q"), F.col("gram") == F.col("_o_gram"),
                                                              F.length("_o_v") > n, F.contains(F.col("_o_v"), F.col(value_col))]
    kept = rarest.join(longer, reduce(lambda a, b: a & b, cond), "left_anti").select(*keys, value_col)
    return kept.unionByName(every.where(missing))


def regroup_names(df: DataFrame, keys: list[str], order_col: str, tag_col: str = "entity", name_col: str = "name",
                  start_col: str = "start", end_col: str = "end") -> DataFrame:
    """AGG-9: two-level regrouping of extracted names: rows of one name become one with summed offsets and the first tag that
    is not UNKNOWN (a single row keeps its own); then, per tag, names inside a longer name of that tag go (AGG-8). Names whose
    tag stays unknown have none and fall away. ``(keys, tag, name, start, end)``."""
    known = F.when(F.col(tag_col) != "UNKNOWN", F.struct(F.col(order_col).alias("o"), F.col(tag_col).alias("t")))
    by_name = df.groupBy(*keys, name_col).agg(
        F.sum(start_col).alias(start_col), F.sum(end_col).alias(end_col), F.count(F.lit(1)).alias("_n"), F.min(known).alias("_k"), F.min(tag_col).alias("_one"))
    by_name = by_name.withColumn(tag_col, F.when(F.col("_n") == 1, F.col("_one")).otherwise(F.col("_k.t"))).drop("_n", "_k", "_one")
    by_name = by_name.where(F.col(tag_col).isNotNull() & F.col(name_col).isNotNull())
    kept = substring_sieve(by_name, [*keys, tag_col], name_col)
    return by_name.join(kept, [*keys, tag_col, name_col], "left_semi").select(*keys, tag_col, name_col, start_col, end_col)


def label_mappings(labels_df: DataFrame, label_col: str, order: list[Column]) -> DataFrame:
    """RSH-6: ``(id, label)``, ids from 0 by first appearance, ties by label."""
    first = labels_df.groupBy(F.col(label_col).alias("label")).agg(F.min(F.struct(*order)).alias("_o"))
    return numbered(first, [F.col("_o"), F.col("label")], "_no").select((F.col("_no") - 1).cast("int").alias("id"), "label")


def sort_by_length_desc(arr: Column) -> Column:
    """SRT-2: strings ordered by length, longest first (ties keep value order)."""
    return F.array_sort(arr, lambda a, b: F.when(F.length(a) > F.length(b), F.lit(-1))
                        .when(F.length(a) < F.length(b), F.lit(1))
                        .when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0)))


def evaluate_results(gold_wide: DataFrame, pred_wide: DataFrame, id_col: str, model: str, dataset: str,
                     version: str, endpoint_url: str, last_update: Column | None = None):
    """RSH-5: gold rows restricted to predicted ids (JON-2), per-tag metrics (AGG-1), full
    leaderboard (RSH-4) and weighted leaderboard (AGG-4); the model name carries the endpoint's
    model type (FN-1). Returns ``(full_leaderboard, weighted_leaderboard, performance)``."""
    gold = gold_wide.join(pred_wide.select(id_col).distinct(), id_col, "left_semi")
    perf = evaluate_wide(gold, pred_wide, id_col)
    name = f"{model}-{endpoint_url.rstrip('/').split('/')[-2] if endpoint_url.count('/') else endpoint_url}"
    full = full_leaderboard(perf, name, dataset, version, last_update=last_update)
    weighted = weighted_leaderboard(perf, tag_weights(gold), name, dataset, version, last_update)
    return full, weighted, perf
