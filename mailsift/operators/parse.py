"""The parse pipelines (RSP-6..8, FUS-3, SPN-6) as batch jobs over mail tables.

A mail is a row ``(id, text, lang, metadata?)``. Locating and entity extraction add columns to that row: models run in one
Arrow pass over its windows, pattern entities, fusion, filter, response and sender data are column expressions. Only the
gazetteer join needs the rows of a text together again, on the id. Languages are mapped through the aliases first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.text import clean_mail_text, map_language, newline_count
from mailsift.operators.align import align
from mailsift.operators.extract import regex_entity_array
from mailsift.operators.fuse import ENTITY_ARRAY, FIELDS, fused, post_filtered
from mailsift.operators.gazetteer import gazetteer_hits, location_entities, resolve_locations
from mailsift.operators.response import responses
from mailsift.operators.score import ENTITIES, NER, SEGMENTATION, SIGNATURES, Scorers, predicted_entities, predicted_signature, score_windows
from mailsift import settings as S
from mailsift.session import written

FEW_LINES = 3


def window_signatures(mails: DataFrame, keep: list[str], text_col: str = "text", lang_col: str | None = "lang", scorers: Scorers = SEGMENTATION) -> DataFrame:
    """SPN-3: a row for each window of a text: its start in the text, its text, its signature span and how it was found."""
    x = score_windows(mails.select(*keep, text_col, *([lang_col] if lang_col else [])), scorers, SIGNATURES + ", s int, e int",
                      _spanned, text_col, lang_col, name="_w")
    x = x.select(*keep, text_col, F.explode("_w").alias("w"))
    cut = lambda a, b: F.call_function("substr", F.col(text_col), a + 1, b - a)
    n, start, end = F.col("w.n"), F.col("w.start"), F.col("w.end")
    return x.select(*keep, F.col("w.window").alias("segment_no"),
                    F.when(n == 0, cut(F.col("w.s"), F.col("w.e"))).otherwise(cut(F.col("w.s"), start)).alias("body"),
                    F.when(n == 0, "").otherwise(cut(start, end)).alias("signature"),
                    F.when(n == 0, "no_match").when(n == 1, "perfect_match").otherwise("imperfect_match").alias("tag"),
                    F.when(n == 1, start).alias("start_signature"), F.when(n == 1, end).alias("end_signature"))


def _spanned(text: str, start: int, preds: list[dict]) -> list[tuple]:
    return [(*row, start, start + len(text)) for row in predicted_signature(text, start, preds)]


def locate_signatures(mails: DataFrame, text_col: str = "text", lang_col: str | None = "lang", scorers: Scorers = SEGMENTATION,
                      all_windows: bool = True, out_col: str = "located") -> DataFrame:
    """SPN-5/SPN-6: ``mails`` with ``struct<body, signature, tail, start, end>``: the signature of the last window that has one
    (``all_windows=False``: of the first window), aligned to whole lines of the text; a text with fewer than 3 line breaks keeps
    the raw signature but the aligned offsets. Null texts have an empty signature."""
    x = score_windows(mails, scorers, SIGNATURES, predicted_signature, text_col, lang_col, name="_w")
    hits = F.filter("_w", lambda w: (w["n"] > 0) if all_windows else (w["n"] > 0) & (w["window"] == 0))
    x = x.withColumn("_hit", F.get(F.reverse(hits), 0)).drop("_w")
    raw = F.coalesce(F.call_function("substr", F.col(text_col), F.col("_hit.start") + 1, F.col("_hit.end") - F.col("_hit.start")), F.lit(""))
    x = align(x.withColumn("_raw", raw).drop("_hit"), text_col, "_raw", "_a")
    few = newline_count(text_col) < FEW_LINES
    return x.withColumn(out_col, F.struct(
        F.col("_a.body").alias("body"), F.when(few, F.col("_raw")).otherwise(F.coalesce("_a.signature", F.lit(""))).alias("signature"),
        F.col("_a.tail").alias("tail"), F.col("_a.start").alias("start"), F.col("_a.end").alias("end"))).drop("_a", "_raw")


def block_entities(blocks: DataFrame, gaz: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   scorers: Scorers = NER, out_col: str = "entities", whole_tags: list[str] | None = None) -> DataFrame:
    """FUS-3: ``blocks`` with the array of fused and filtered entities of each text. ``id_col`` must be unique; rows with a
    null id have no gazetteer places. Null and empty texts have no entities."""
    text, lang = F.col(text_col), F.col(lang_col)
    x = score_windows(blocks, scorers, ENTITIES, predicted_entities, text_col, lang_col, name="_ml")
    x = x.withColumn("_rx", F.coalesce(regex_entity_array(text), F.array().cast(ENTITY_ARRAY)))
    english = blocks.where((lang == "en") & (F.length(text) > 0)).select(id_col, text_col)
    locs = location_entities(resolve_locations(gazetteer_hits(english, gaz, id_col, text_col), id_col), id_col)
    kinds = F.array(*[F.lit(S.GAZETTEER_TAG[k]) for k in ("country", "state", "city")])
    order = F.struct(F.array_position(kinds, F.col("entity")).alias("k"), "country_pos", *FIELDS)
    locs = locs.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(order)), lambda e: F.struct(*[e[f].alias(f) for f in FIELDS])).alias("_loc"))
    x = x.join(locs, id_col, "left")
    x = x.withColumn("_all", fused(F.col("_ml"), F.col("_rx"), F.col("_loc"), lang))
    return x.withColumn(out_col, post_filtered(F.col("_all"), text, lang, whole_tags=whole_tags)).drop("_ml", "_rx", "_loc", "_all")


def parse_signatures(blocks: DataFrame, gaz: DataFrame, id_col: str = "doc_id", block_col: str = "text", lang_col: str = "lang",
                     meta_col: str | None = None, scorers: Scorers = NER) -> DataFrame:
    """RSP-7: signature blocks are cleaned, their entities extracted; one response for each row, NO_SIGNATURE_BLOCK where
    nothing is left."""
    meta = [F.col(meta_col).alias("_meta")] if meta_col else []
    x = written(blocks.select(id_col, clean_mail_text(F.coalesce(F.col(block_col), F.lit(""))).alias("text"),
                              map_language(F.coalesce(F.col(lang_col), F.lit("en"))).alias("lang"), *meta), "blocks")
    found = block_entities(x, gaz, id_col, scorers=scorers)
    return responses(found, id_col, "text", "entities", "_meta" if meta_col else None)


def parse_bodies(mails: DataFrame, gaz: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 meta_col: str | None = None, segmentation: Scorers = SEGMENTATION, ner: Scorers = NER, all_windows: bool = True) -> DataFrame:
    """RSP-6: signature located in the body as it came, cleaned, entities extracted; one response for each mail."""
    lang = map_language(F.coalesce(F.col(lang_col), F.lit("en")))
    meta = [F.col(meta_col).alias("_meta")] if meta_col else []
    x = locate_signatures(mails.select(id_col, F.col(text_col).alias("text"), lang.alias("lang"), *meta), scorers=segmentation, all_windows=all_windows)
    x = x.select(id_col, F.col("located.signature").alias("text"), "lang", *["_meta"] * bool(meta_col))
    return parse_signatures(x, gaz, id_col, meta_col="_meta" if meta_col else None, scorers=ner)


def clean_and_locate(mails: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """RSP-8, first form: the body is cleaned, then its signature located."""
    x = mails.withColumn(text_col, clean_mail_text(F.coalesce(F.col(text_col), F.lit("")))).withColumn(lang_col, map_language(F.coalesce(F.col(lang_col), F.lit("en"))))
    return locate_signatures(x, text_col, lang_col, **options)


def clean_and_extract(mails: DataFrame, gaz: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      scorers: Scorers = NER) -> DataFrame:
    """RSP-8, second form: the cleaned text is the signature; ``(id, text, lang, entities)``, the raw list."""
    x = written(mails.select(id_col, clean_mail_text(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
                             map_language(F.coalesce(F.col(lang_col), F.lit("en"))).alias("lang")), "cleaned")
    return block_entities(x, gaz, id_col, scorers=scorers)
