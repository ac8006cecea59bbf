"""Pattern extractors: e-mail, URL, LinkedIn and phone spans (EXT-1..5, JON-8, FLT-9).

Everything happens inside the row with array higher-order functions, so
extraction is a narrow (map-only) stage that scales with the number of
documents and never shuffles. The long entity table produced here is
``(id, seq, start, end, entity, name, score)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift import settings as S
from mailsift.functions.spans import match_spans
from mailsift.functions.text import replace_all

# The fixed patterns in forms that try each run of their characters once, with the same matches. LinkedIn: a host not led by
# "http" matches from its run's first character or not at all; nothing that a possessive part takes could stand for the part
# after it. Web: the optional "http://" consists of characters of the class after it, letters after the second one of those
# that follow the dot, too; a match never begins inside a run, because the one before it took its whole run.
LINKEDIN_RUNS = (r"(?:(?:https?://)++[a-zA-Z0-9\-]*+\.|(?<![a-zA-Z0-9\-])[a-zA-Z0-9\-]*+\.|[linkedin])[linkedin/~\-]++"
                 r"\.[a-zA-Z0-9/~\-_,&=\?\.;]+[^\.,\s<]")
_WEB = r"a-zA-Z0-9\.\/\?\:@\-_=#"
WEB_RUNS = rf"(?<![{_WEB}])[{_WEB}]+\.[a-zA-Z]{{2}}[{_WEB}\&]*+"


def _has_marker(name: Column) -> Column:
    cond = F.lit(False)
    for m in [*S.URL_REJECT_MARKERS, *S.URL_REJECT_ALSO]:
        cond = cond | name.contains(m)
    return cond


def _tag(spans: Column, entity: str) -> Column:
    return F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit(entity).alias("entity"),
        x["name"].alias("name"), F.lit(1.0).alias("score")))


def linkedin_spans(text: Column) -> Column:
    """EXT-3: LinkedIn matches kept only when they look like a LinkedIn URL; one trailing '>' stripped."""
    # every kept match contains 'linkedin', so texts without it skip the (slow) pattern
    raw = match_spans(text, LINKEDIN_RUNS, guard=F.instr(text, "linkedin") > 0)
    kept = F.filter(raw, lambda x: x["name"].contains("linkedin") & (x["name"] != "linkedin.com")
                    & ~_has_marker(x["name"]))
    return F.transform(kept, lambda x: F.struct(
        x["start"].alias("start"),
        F.when(x["name"].endswith(">"), x["end"] - 1).otherwise(x["end"]).alias("end"),
        F.regexp_replace(x["name"], ">$", "").alias("name")))


def url_spans(text: Column, emails: Column, linkedin: Column) -> Column:
    """EXT-2: web matches that are not a LinkedIn/e-mail match, carry no '@'/'malito';
    one trailing dot stripped (end adjusted) and the listed prefixes removed."""
    # a web match always contains a dot followed by two letters
    raw = match_spans(text, WEB_RUNS, guard=text.rlike(r"\.[a-zA-Z]{2}"))
    lk_names = F.transform(linkedin, lambda x: x["name"])
    em_names = F.transform(emails, lambda x: x["name"])
    kept = F.filter(raw, lambda x: ~F.array_contains(lk_names, x["name"])
                    & ~F.array_contains(em_names, x["name"]) & ~_has_marker(x["name"]))
    bare = F.transform(kept, lambda x: F.struct(
        x["start"].alias("start"),
        F.when(x["name"].endswith("."), x["end"] - 1).otherwise(x["end"]).alias("end"),
        F.regexp_replace(x["name"], r"\.$", "").alias("whole"),
        replace_all(F.regexp_replace(x["name"], r"\.$", "")).alias("name")))
    # a removed prefix moves the start; where a listed text was removed further inside, the span covers the whole match
    return F.transform(bare, lambda x: F.struct(
        F.when(x["whole"].endswith(x["name"]), x["end"] - F.length(x["name"])).otherwise(x["start"]).alias("start"),
        x["end"].alias("end"), x["name"].alias("name")))


def regex_entity_array(text: Column | str) -> Column:
    """EXT-4: all pattern entities of one text, in the order EMAIL, LINKEDIN, URL."""
    text = F.col(text) if isinstance(text, str) else text
    emails = match_spans(text, S.EMAIL_PATTERN, guard=F.instr(text, "@") > 0)
    # bound as lambda variables, so that the patterns run once and not once for each web match
    found = F.transform(F.array(F.struct(emails.alias("em"), linkedin_spans(text).alias("lk"))), lambda b: F.concat(
        _tag(b["em"], "EMAIL"), _tag(b["lk"], "LINKEDIN"), _tag(url_spans(text, b["em"], b["lk"]), "URL")))
    return found[0]


def phone_entity_array(text: Column | str, region: str = "us", entity: str = "PHONE") -> Column:
    """EXT-5 as entity structs (same element type as :func:`regex_entity_array`)."""
    text = F.col(text) if isinstance(text, str) else text
    guard = None if region == "uk" else text.rlike("[0-9]{3}")
    return _tag(match_spans(text, S.PHONE_PATTERNS[region], guard=guard), entity)


def regex_entities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] | None = None) -> DataFrame:
    """Long entity table ``(id, seq, start, end, entity, name, score)`` plus ``keep`` columns."""
    keep = keep or []
    arr = df.select(id_col, *keep, regex_entity_array(F.col(text_col)).alias("_ents"))
    # *_outer: a plain generator makes Spark infer ``size(array) > 0`` and evaluate the whole
    # extraction twice (filter + project); empty rows are dropped after the generator instead
    out = arr.select(id_col, *keep, F.posexplode_outer("_ents").alias("seq", "e")).where(F.col("e").isNotNull())
    return out.select(id_col, *keep, "seq", "e.start", "e.end", "e.entity", "e.name", "e.score")


def allow_list(df: DataFrame, tags: list[str], entity_col: str = "entity") -> DataFrame:
    """FLT-9: keep extractor rows whose tag is in the source's allow-list."""
    return df.where(F.col(entity_col).isin(tags))


def phone_spans(df: DataFrame, regions: list[str], id_col: str = "doc_id", text_col: str = "text",
                keep: list[str] | None = None, fax: bool = False) -> DataFrame:
    """EXT-5: phone (or fax) matches per region: ``(id, region, seq, start, end, name)``."""
    keep = keep or []
    patterns = S.FAX_PATTERNS if fax else S.PHONE_PATTERNS
    # us/ca/chn phones and the fax pattern all need a run of three digits; the uk pattern
    # (ten digits anywhere, blanks allowed between them) gets no guard
    has_digits = F.col(text_col).rlike("[0-9]{3}")
    per_region = F.array(*[
        F.struct(F.lit(r).alias("region"), match_spans(F.col(text_col), patterns[r],
                                                       guard=None if (r == "uk" and not fax) else has_digits).alias("spans"))
        for r in regions])
    rows = df.select(id_col, *keep, F.explode(per_region).alias("r"))
    rows = rows.select(id_col, *keep, F.col("r.region").alias("region"),
                       F.posexplode_outer("r.spans").alias("seq", "s")).where(F.col("s").isNotNull())
    return rows.select(id_col, *keep, "region", "seq", "s.start", "s.end", "s.name")


def entity_counts(entities: DataFrame, by: list[str]) -> DataFrame:
    """AGG-10 (entities per tag and language): partial+final hash aggregate."""
    return entities.groupBy(*by).agg(F.count(F.lit(1)).alias("n_entities"),
                                     F.countDistinct(entities.columns[0]).alias("n_docs"))


def service_counters(events: DataFrame, key_col: str, ts_col: str, score_col: str, error_col: str,
                     order_col: str) -> DataFrame:
    """AGG-10 (re-aimed service metrics): per key the number processed, the number of errors and
    the latest score (by time, ties by ``order_col``) — partial aggregation before the shuffle."""
    return events.groupBy(key_col).agg(
        F.count(F.lit(1)).alias("n_processed"),
        F.count_if(F.col(error_col)).alias("n_errors"),
        F.max_by(score_col, F.struct(F.col(ts_col), F.col(order_col))).alias("latest_score"))
