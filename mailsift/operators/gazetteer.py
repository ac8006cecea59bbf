"""Gazetteer location finder (SRC-8, EXT-6..12, JON-6, JON-7).

Matching is an equi-join on whole surfaces. A surface has a shape: its number of word runs and of the other characters
before the first and after the last one. Each text gives its word n-grams of the shapes that the gazetteer has, with their
offsets, in one Arrow pass (``gaz_locations`` at sf0.1 took 23.5 s with array functions and 8.4 s so), and these are joined with the surfaces; no
pattern is run for a candidate and no text is joined back. A gazetteer within Spark's broadcast threshold is joined on the
map side, so the n-grams are never shuffled.

A match needs a non-word character or the text's edge on both sides, which holds for n-grams of maximal word runs. Word
characters are ``[\\p{L}\\p{N}_]``. Whether a match stands next to a number, an ordinal or a single letter is known from the
words around it before the join.

Resolution is one exchange on the document: everything else are windows over (document, country) and below, whose rows are
then together, so they only sort. Nothing is counted or written while a plan is built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift import settings as S
from mailsift.operators.segment import word_runs

COUNTRY = "struct<name:string,aliases:array<string>,states:array<struct<name:string,aliases:array<string>,cities:array<string>>>>"


# ----------------------------------------------------------------------------- loading
def load_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: a JSON file with one list of ``{country:{name,aliases,states:[{name,aliases,cities}]}}``; a country's
    number is its place in the list."""
    return explode_gazetteer(parsed_gazetteer(spark.read.text(path, wholetext=True)))


def parsed_gazetteer(lists: DataFrame, json_col: str = "value") -> DataFrame:
    """Nested countries ``(_pos, country)`` of rows that hold a JSON list each."""
    parsed = F.from_json(F.col(json_col), f"array<struct<country:{COUNTRY}>>")
    return lists.select(F.posexplode(parsed).alias("_pos", "c")).select("_pos", "c.country")


def explode_gazetteer(nested: DataFrame, pos_col: str = "_pos") -> DataFrame:
    """Nested countries -> ``(country_pos, kind, state_pos, item_pos, surface)``; non-string / empty surfaces and surfaces
    without a word character are dropped (Q40). ``pos_col`` numbers the countries in their order."""
    c = nested.select(F.col(pos_col).cast("int").alias("country_pos"), "country")
    no = F.array().cast("array<string>")
    countries = c.select("country_pos", F.lit("country").alias("kind"), F.lit(None).cast("int").alias("state_pos"),
                         F.posexplode(F.concat(F.array("country.name"), F.coalesce("country.aliases", no)))
                         .alias("item_pos", "surface"))
    st = c.select("country_pos", F.posexplode_outer("country.states").alias("state_pos", "st"))
    states = st.select("country_pos", F.lit("state").alias("kind"), "state_pos",
                       F.posexplode(F.concat(F.array("st.name"), F.coalesce("st.aliases", no)))
                       .alias("item_pos", "surface"))
    cities = st.select("country_pos", F.lit("city").alias("kind"), "state_pos",
                       F.posexplode(F.coalesce("st.cities", no)).alias("item_pos", "surface"))
    g = countries.unionByName(states).unionByName(cities)
    g = g.select("country_pos", "kind", F.col("state_pos").cast("int").alias("state_pos"),
                 F.col("item_pos").cast("int").alias("item_pos"), "surface")
    return g.where(F.col("surface").isNotNull() & (F.length("surface") > 0) & F.col("surface").rlike(r"[\p{L}\p{N}_]"))


# ----------------------------------------------------------------------------- matching
def surface_shape(surface: Column) -> Column:
    """``struct<n, lead, tail>``: word runs, other characters before the first and after the last one."""
    pieces = F.split(surface, S.WORD_PATTERN, -1)
    return F.struct((F.size(pieces) - 1).alias("n"), F.length(F.get(pieces, 0)).alias("lead"),
                    F.length(F.element_at(pieces, -1)).alias("tail"))


_NEAR = re.compile("(?:[0-9]+|[0-9]+(?:st|nd|rd|th)|[a-zA-Z])").fullmatch  # EXT-10: a number, an ordinal or a single letter
_BLANK = re.compile("[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").fullmatch
GRAMS_KEPT = 100_000


def surface_grams(text: str, shapes: list[tuple[int, int, int]]) -> Iterator[tuple[dict[str, int], set[str]]]:
    """The whole-word pieces of a text, for each of the shapes (words, lead, tail): the different ones with their first start,
    and those that are adjacent somewhere."""
    starts, ends = word_runs(text)
    places, last = list(zip(starts, ends)), len(starts) - 1
    near = [i for i, (s, e) in enumerate(places) if (e - s == 1 or text[s] in "0123456789") and _NEAR(text, s, e)]
    for n, lead, tail in shapes:
        spans = list(zip(starts, ends[n - 1:]))
        if lead or tail:  # the characters taken on both sides lie in the gaps and leave a non-word character or the text's edge
            spans = [(s - lead, e + tail) if not (lead and s - lead < (places[i - 1][1] + 1 if i else 0) or
                                                  tail and e + tail > (places[i + n][0] - 1 if i + n <= last else len(text))) else None
                     for i, (s, e) in enumerate(spans)]
        first = {text[x[0]:x[1]]: x[0] for x in reversed(spans) if x}
        beside = set()
        for k in near:
            after, before = k + 1, k - n   # the pieces that begin after this word and that end before it
            if after < len(spans) and spans[after] and _BLANK(text, places[k][1], spans[after][0]):
                beside.add(text[slice(*spans[after])])
            if before >= 0 and spans[before] and _BLANK(text, spans[before][1], places[k][0]):
                beside.add(text[slice(*spans[before])])
        yield first, beside


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, text and shapes to (id, surface, start, adjacent)."""
    at, grams = [], []

    def rows(batch):
        names, starts, beside = zip(*grams)
        columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(beside, pa.bool_())]
        at.clear()
        grams.clear()
        return pa.RecordBatch.from_arrays(columns, names=["id", "surface", "start", "adjacent"])

    for batch in batches:
        for low in range(0, batch.num_rows, 100):
            part = batch.slice(low, 100)
            for i, (text, shapes) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                shapes = [(x["n"], x["lead"], x["tail"]) for x in shapes or ()]
                for first, beside in surface_grams(text, shapes):
                    at.extend([i] * len(first))
                    grams.extend((x, start, x in beside) for x, start in first.items())
                    if len(grams) >= GRAMS_KEPT:
                        yield rows(part)
            if grams:
                yield rows(part)


def gazetteer_hits(docs: DataFrame, gaz: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """EXT-6/JON-7/EXT-11: ``(id, country_pos, kind, state_pos, item_pos, surface, start, adjacent)`` for every gazetteer row
    whose surface occurs as a whole word; start = first occurrence; adjacent = a city that somewhere stands next to a
    number, an ordinal or a single letter."""
    shapes = gaz.agg(F.collect_set(surface_shape(F.col("surface")))).scalar()  # a handful, read while the query runs
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), shapes.alias("shapes")).where(F.length("t") > 0)
    schema = T.StructType([texts.schema["id"], *T.StructType.fromDDL("surface string, start int, adjacent boolean").fields])
    hits = texts.mapInArrow(_gram_rows, schema).withColumnRenamed("id", id_col).join(gaz, "surface")
    return hits.groupBy(id_col, "country_pos", "kind", "state_pos", "item_pos", "surface").agg(
        F.min("start").alias("start"), F.max((F.col("kind") == "city") & F.col("adjacent")).alias("adjacent"))


def resolve_locations(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """EXT-7..12: per document and country, cities -> states -> country with verification, contained-city and adjacency
    rules, then the country choice. Returns ``(id, country_pos, kind, surface, rank, start, end, n_keys)`` for kept
    countries; ``rank`` orders the rows of a kind.

    A surface found in the text is a hit for each gazetteer row that lists it, so the hits alone say which states list a
    found city and which states a found surface names."""
    k = [id_col, "country_pos"]
    h = hits.repartition(id_col)
    city, state, country = (F.col("kind") == x for x in ("city", "state", "country"))
    at = F.struct(F.col("state_pos").alias("s"), F.col("item_pos").alias("i"))
    none = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("i"))
    by_country, by_state = Window.partitionBy(*k), Window.partitionBy(*k, "state_pos")
    by_surface = Window.partitionBy(*k, "kind", "surface")
    # EXT-7: cities in gazetteer order, a surface at its first place
    h = h.withColumn("place", F.min(at).over(by_surface))
    # EXT-8: with a found city, only states that list one, ordered by it
    h = h.withColumn("first_city", F.min(F.when(city, F.col("place"))).over(by_state)).withColumn("has_city", F.max(city).over(by_country))
    valid = state & (~F.col("has_city") | F.col("first_city").isNotNull())
    key = F.when(valid, F.struct(F.coalesce(F.when(F.col("has_city"), F.col("first_city")), none).alias("a"), at.alias("b")))
    h = h.withColumn("state_rank", F.min(key).over(by_surface))
    found = state & F.col("state_rank").isNotNull()
    h = h.withColumn("matched", F.max(found).over(by_state)).withColumn("has_state", F.max(found).over(by_country))
    first = F.row_number().over(by_surface.orderBy("state_pos", "item_pos")) == 1
    h = h.withColumn("first", first)
    # EXT-9: country names count once a state matched; verified cities lie in a matched state
    verified = city & F.col("has_state") & F.col("matched")
    keep = verified | (city & ~F.col("has_state") & F.col("first")) | (found & F.col("first")) | (country & F.col("has_state"))
    h = h.where(keep)
    rank = (F.when(city, F.struct(F.when(F.col("has_state"), F.struct(F.col("state_pos").alias("s"), F.lit(-1).alias("i"))).otherwise(none).alias("a"),
                                  F.col("place").alias("b")))
            .when(state, F.col("state_rank")).otherwise(F.struct(none.alias("a"), F.struct(F.lit(-1).alias("s"), F.col("item_pos").alias("i")).alias("b"))))
    # EXT-10 (JON-6): no city inside another found city's name, none next to a number, an ordinal or a letter
    h = h.withColumn("rank", rank).withColumn("cities", F.collect_set(F.when(city, F.col("surface"))).over(by_country))
    inside = F.exists("cities", lambda o: (o != F.col("surface")) & F.contains(o, F.col("surface")))
    h = h.where(~city | (~inside & ~F.col("adjacent")))
    # EXT-12: the first country with the most kinds, unless all have as many
    h = h.withColumn("n_keys", F.size(F.collect_set("kind").over(by_country)).cast("long"))
    w = Window.partitionBy(id_col)
    h = h.withColumn("most", F.max("n_keys").over(w)).withColumn("least", F.min("n_keys").over(w))
    h = h.withColumn("chosen", F.min(F.when(F.col("n_keys") == F.col("most"), F.col("country_pos"))).over(w))
    out = h.where((F.col("least") == F.col("most")) | (F.col("country_pos") == F.col("chosen")))
    return out.select(*k, "kind", "surface", "rank", "start", (F.col("start") + F.length("surface")).cast("int").alias("end"), "n_keys")


def location_entities(locs: DataFrame, id_col: str = "doc_id", exclude: DataFrame | None = None) -> DataFrame:
    """FUS-1 (English branch): per kept country and kind the first location with its own span and
    score 1.0, mapped to the response tag; blacklisted names and names already found as
    person/organisation (``exclude``: ``(id, name)``) are dropped."""
    w = Window.partitionBy(id_col, "country_pos", "kind").orderBy("rank", "surface")
    first = locs.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    tag = F.create_map(*[F.lit(x) for kv in S.GAZETTEER_TAG.items() for x in kv])[F.col("kind")]
    ents = first.select(id_col, "country_pos", F.col("start"), F.col("end"), tag.alias("entity"),
                        F.col("surface").alias("name"), F.lit(1.0).alias("score"))
    ents = ents.where(~F.col("name").isin(S.LOCATION_BLACKLIST))
    if exclude is not None:
        ents = ents.join(exclude.select(id_col, "name").distinct(), [id_col, "name"], "left_anti")  # JON-5
    return ents
