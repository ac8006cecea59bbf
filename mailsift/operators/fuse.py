"""Fusion of extractor outputs and the post-filter (FUS-1..3, FLT-9, JON-5), inside the row.

A text's model, pattern and gazetteer entities are arrays of ``struct<start,end,entity,name,score>`` of its own row, so
fusion, the language branch and the filter against the text's tokens need neither a join nor a copy of the text for each
entity. The result is an array of ``struct<seq,start,end,entity,name,score>``; ``seq`` is the place after fusion: model
entities by start, pattern entities in their order, locations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift import settings as S

FIELDS = ["start", "end", "entity", "name", "score"]
ENTITY_ARRAY = "array<struct<start:int,end:int,entity:string,name:string,score:double>>"
LOCATION_TAGS = list(S.GAZETTEER_TAG.values())


def _plain(e: Column) -> Column:
    return F.struct(*[e[f].alias(f) for f in FIELDS])


def _by_start(ents: Column) -> Column:
    """Ordered by start, then tag."""
    keyed = F.transform(ents, lambda e: F.struct(e["start"].alias("start"), e["entity"].alias("entity"), _plain(e).alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def with_tags(ents: Column, tags: list[str]) -> Column:
    """FLT-9 on an entity array."""
    return F.filter(ents, lambda e: e["entity"].isin(tags))


def fused(ml: Column, regex: Column, locations: Column, lang: Column) -> Column:
    """FUS-1: allow-listed model entities, allow-listed pattern entities, then places: for English those of the gazetteer
    (``locations``, ordered, blacklist applied) whose name no given, middle or surname or organisation has (JON-5), for other
    languages those of the model."""
    names = F.transform(with_tags(ml, S.NAME_OR_ORG_TAGS), lambda e: e["name"])
    own = F.filter(F.coalesce(locations, F.array().cast(ENTITY_ARRAY)), lambda e: ~F.array_contains(names, e["name"]) & ~e["name"].isin(S.LOCATION_BLACKLIST))
    places = F.when(lang == "en", F.transform(own, _plain)).otherwise(_by_start(with_tags(ml, LOCATION_TAGS)))
    parts = F.concat(_by_start(with_tags(ml, S.FUSION_ML_TAGS)), F.transform(with_tags(regex, S.FUSION_REGEX_TAGS), _plain), places)
    return numbered_entities(parts)


def numbered_entities(ents: Column) -> Column:
    return F.transform(ents, lambda e, i: F.struct(i.alias("seq"), *[e[f].alias(f) for f in FIELDS]))


def post_filtered(ents: Column, text: Column, lang: Column, min_phone_digits_exclusive: int = S.PHONE_MIN_DIGITS_EXCLUSIVE,
                  whole_tags: list[str] | None = None) -> Column:
    """FUS-2: strip one trailing ``, . ; :`` (end - 1); drop names with an inner newline; drop phone/fax with too few digits (of
    any script); for English every piece of the name must be a token of the text (``whole_tags``: only for these tags)."""
    def stripped(e):
        trailing = e["name"].rlike(r"[,.;:]\z")
        return F.struct(e["seq"].alias("seq"), e["start"].alias("start"), F.when(trailing, e["end"] - 1).otherwise(e["end"]).alias("end"),
                        e["entity"].alias("entity"), F.when(trailing, F.regexp_replace(e["name"], r"[,.;:]\z", "")).otherwise(e["name"]).alias("name"),
                        e["score"].alias("score"))

    def fits(tokens):
        def keep(e):
            bare = F.regexp_replace(e["name"], r"^ +| +\z", "")
            inner = F.call_function("substr", bare, F.lit(2), F.length(bare) - 2)
            one_line = (F.length(bare) < 2) | (F.instr(inner, "\n") == 0)
            digits = F.length(F.regexp_replace(e["name"], r"\P{Nd}", ""))
            phone = ~e["entity"].isin(S.PHONE_TAGS) | (digits > min_phone_digits_exclusive)
            whole = F.size(F.array_except(F.split(e["name"], "[ \n:]", -1), tokens)) == 0
            free = (lang != "en") if whole_tags is None else (lang != "en") | ~e["entity"].isin(whole_tags)
            return one_line & phone & (free | whole)
        return keep

    # bound as a lambda variable, so that the text is split once and only where it is needed
    tokens = F.array(F.when((lang == "en") & (F.size(ents) > 0), F.array_distinct(F.split(text, "[ \n,:;]", -1))))
    return F.transform(tokens, lambda tk: F.filter(F.transform(ents, stripped), fits(tk)))[0]


def post_filter(ents: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                min_phone_digits_exclusive: int = S.PHONE_MIN_DIGITS_EXCLUSIVE) -> DataFrame:
    """FUS-2 for an entity table ``(id, seq, start, end, entity, name, score)``: gathered by document and joined once."""
    given = {"seq": F.lit(0), "score": F.lit(1.0)} | {c: F.col(c) for c in ents.columns}
    e = ents.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(*[given[f].alias(f) for f in ["seq", *FIELDS]]))).alias("_ents"))
    j = e.join(texts.select(id_col, text_col, lang_col), id_col)
    kept = j.select(id_col, lang_col, F.explode_outer(post_filtered(F.col("_ents"), F.col(text_col), F.col(lang_col), min_phone_digits_exclusive)).alias("e"))
    return kept.where("e is not null").select(id_col, "e.*", lang_col)


def ner_map(ents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """RSP-5: ``SIGNATURE.<tag>`` -> name, the last duplicate wins (by ``seq``)."""
    last = ents.groupBy(id_col, "entity").agg(F.max_by("name", "seq").alias("name"))
    return last.select(id_col, F.concat(F.lit(f"{S.SIGNATURE_LABEL}."), F.col("entity")).alias("key"),
                       F.col("name").alias("value"))
