"""Registered queries: gazetteer locations and their fusion (SRC-8, EXT-6..12, JON-5..7, FUS-1).

The reference's country file is not part of the snapshot, so a small
gazetteer of our own is used: its surfaces are word runs that occur in the
``documents`` table, arranged to exercise every rule (a city inside a longer
city, one city in two states, alias-only states, a country without cities,
a blacklisted name, and a city next to a number).
"""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from mailsift import settings as S
from mailsift.operators.gazetteer import explode_gazetteer, gazetteer_hits, load_gazetteer, location_entities, parsed_gazetteer, resolve_locations
from mailsift.plans import sqlkit as K
from mailsift.plans.registry import register
from mailsift.session import read_table
from mailsift.sources.readers import read_text_table
from mailsift.sources.writers import scratch_path

# Fixture gazetteer: (country, aliases, [(state, aliases, cities)]).
GAZETTEER = [
    ("Orre", ["Orre Orre"], [
        ("Thsterhe", ["Thst"], ["Ofrehalyon", "Reatonsh", "Eaea"]),
        ("Reatonsh", [], ["Oneaen", "Eaea", "Code"]),
    ]),
    ("General", ["Apache"], [
        ("Public", ["License", "Version"], ["Public License", "License", "NC"]),
        ("Thtionnd", [], ["Apache License"]),
    ]),
    ("Atlynd", ["Stte"], [
        ("Thshea", [], []),
    ]),
]


def gazetteer_df(spark):
    # from a literal, so that Spark knows that it is small (rows of a Python list have no known size)
    countries = [{"country": {"name": c, "aliases": a, "states": [{"name": s, "aliases": sa, "cities": cs} for s, sa, cs in st]}} for c, a, st in GAZETTEER]
    return explode_gazetteer(parsed_gazetteer(spark.range(1).select(F.lit(json.dumps(countries)).alias("value"))))


def _gaz_values() -> str:
    rows = []
    for cp, (c, a, st) in enumerate(GAZETTEER):
        for ip, s in enumerate([c] + a):
            rows.append((cp, "country", "NULL", ip, s))
        for sp, (sn, sa, cs) in enumerate(st):
            for ip, s in enumerate([sn] + sa):
                rows.append((cp, "state", sp, ip, s))
            for ip, s in enumerate(cs):
                rows.append((cp, "city", sp, ip, s))
    vals = ", ".join(f"({cp}, '{k}', CAST({sp} AS INTEGER), {ip}, {K.q(s)})" for cp, k, sp, ip, s in rows)
    return f"(SELECT * FROM (VALUES {vals}) v(country_pos, kind, state_pos, item_pos, surface))"


NW = r"[^\p{L}\p{N}_]"
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _pat(s):
    return f"('(?s)^(.*?(?:^|{NW}))\\Q' || {s} || '\\E(?:{NW}|$)')"


def _adj(s):
    q = f"'\\Q' || {s} || '\\E'"
    b, e = f"(?:^|{NW})", f"(?:{NW}|$)"
    parts = []
    for r in [r"[0-9]+", r"[0-9]+(?:st|nd|rd|th)", r"[a-zA-Z]"]:
        parts.append(f"regexp_matches(d.text, '{b}{r}{WS}+' || {q} || '{e}|{b}' || {q} || '{WS}+{r}{e}')")
    return " OR ".join(parts)


def hits_sql(src: str = "documents") -> str:
    return f"""
gaz AS {_gaz_values()},
hits AS (SELECT d.doc_id, g.country_pos, g.kind, g.state_pos, g.item_pos, g.surface,
                CAST(length(regexp_extract(d.text, {_pat('g.surface')}, 1)) AS INTEGER) AS "start",
                (g.kind = 'city' AND ({_adj('g.surface')})) AS adjacent
         FROM {src} d CROSS JOIN gaz g WHERE contains(d.text, g.surface) AND regexp_matches(d.text, {_pat('g.surface')}))"""


_HITS = hits_sql()


def locs_sql(src: str = "documents") -> str:
    """CTE chain ending in ``out``: resolved locations for the texts of ``src`` (doc_id, text)."""
    return f"""{hits_sql(src)},
C AS (SELECT doc_id, country_pos, surface, min({{'s': state_pos, 'i': item_pos}}) AS crank, min("start") AS "start",
             bool_or(adjacent) AS adjacent FROM hits WHERE kind = 'city' GROUP BY doc_id, country_pos, surface),
has_city AS (SELECT DISTINCT doc_id, country_pos FROM C),
g_city AS (SELECT country_pos, state_pos AS sp, surface AS city FROM gaz WHERE kind = 'city'),
g_state AS (SELECT country_pos, state_pos AS sp, item_pos AS ip, surface AS ss FROM gaz WHERE kind = 'state'),
states_of_c AS (SELECT C.doc_id, C.country_pos, g.sp, min(C.crank) AS first_city FROM C
                JOIN g_city g ON C.country_pos = g.country_pos AND C.surface = g.city GROUP BY C.doc_id, C.country_pos, g.sp),
sh AS (SELECT h.doc_id, h.country_pos, h.state_pos AS sp, h.item_pos AS ip, h.surface, h."start", hc.doc_id AS hc, s.first_city
       FROM hits h LEFT JOIN has_city hc ON h.doc_id = hc.doc_id AND h.country_pos = hc.country_pos
       LEFT JOIN states_of_c s ON h.doc_id = s.doc_id AND h.country_pos = s.country_pos AND h.state_pos = s.sp
       WHERE h.kind = 'state' AND (hc.doc_id IS NULL OR s.first_city IS NOT NULL)),
S_ AS (SELECT doc_id, country_pos, surface, min({{'a': coalesce(first_city, {{'s': -1, 'i': -1}}), 'b': {{'s': sp, 'i': ip}}}}) AS rank,
              min("start") AS "start" FROM sh GROUP BY doc_id, country_pos, surface),
ms AS (SELECT DISTINCT S_.doc_id, S_.country_pos, g.sp FROM S_ JOIN g_state g ON S_.country_pos = g.country_pos AND S_.surface = g.ss),
has_state AS (SELECT DISTINCT doc_id, country_pos FROM ms),
verified AS (SELECT ms.doc_id, ms.country_pos, C.surface, {{'a': {{'s': ms.sp, 'i': -1}}, 'b': C.crank}} AS rank, C."start", C.adjacent
             FROM ms JOIN g_city g ON ms.country_pos = g.country_pos AND ms.sp = g.sp
             JOIN C ON C.doc_id = ms.doc_id AND C.country_pos = ms.country_pos AND C.surface = g.city),
unverified AS (SELECT C.doc_id, C.country_pos, C.surface, {{'a': {{'s': -1, 'i': -1}}, 'b': C.crank}} AS rank, C."start", C.adjacent
               FROM C WHERE NOT EXISTS (SELECT 1 FROM has_state hs WHERE hs.doc_id = C.doc_id AND hs.country_pos = C.country_pos)),
cities0 AS (SELECT * FROM verified UNION ALL SELECT * FROM unverified),
cities AS (SELECT * FROM cities0 c WHERE NOT EXISTS (SELECT 1 FROM cities0 o WHERE o.doc_id = c.doc_id AND o.country_pos = c.country_pos
                                                    AND o.surface <> c.surface AND contains(o.surface, c.surface))
           AND NOT c.adjacent),
ch AS (SELECT h.doc_id, h.country_pos, h.surface, {{'a': {{'s': -1, 'i': -1}}, 'b': {{'s': -1, 'i': h.item_pos}}}} AS rank, h."start"
       FROM hits h JOIN has_state hs ON h.doc_id = hs.doc_id AND h.country_pos = hs.country_pos WHERE h.kind = 'country'),
locs AS (SELECT doc_id, country_pos, surface, rank, "start", 'city' AS kind FROM cities
         UNION ALL SELECT doc_id, country_pos, surface, rank, "start", 'state' FROM S_
         UNION ALL SELECT doc_id, country_pos, surface, rank, "start", 'country' FROM ch),
nk AS (SELECT doc_id, country_pos, count(DISTINCT kind) AS n_keys FROM locs GROUP BY doc_id, country_pos),
nk1 AS (SELECT *, max(n_keys) OVER (PARTITION BY doc_id) AS mx, min(n_keys) OVER (PARTITION BY doc_id) AS mn FROM nk),
nk2 AS (SELECT *, min(CASE WHEN n_keys = mx THEN country_pos END) OVER (PARTITION BY doc_id) AS fst FROM nk1),
keep AS (SELECT doc_id, country_pos, n_keys FROM nk2 WHERE mn = mx OR country_pos = fst),
out AS (SELECT l.doc_id, l.country_pos, l.kind, l.surface, l.rank, l."start",
               CAST(l."start" + length(l.surface) AS INTEGER) AS "end", k.n_keys
        FROM locs l JOIN keep k ON l.doc_id = k.doc_id AND l.country_pos = k.country_pos)"""


_LOCS = "WITH " + locs_sql()


@register("gaz_hits", f"WITH {_HITS} SELECT doc_id, country_pos, kind, state_pos, item_pos, surface, \"start\", adjacent FROM hits")
def gaz_hits(spark, sf_dir):
    """EXT-6/JON-7/EXT-11: whole-word gazetteer hits with first-occurrence offsets."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    return gazetteer_hits(docs, gazetteer_df(spark))


_RANK = ", ".join(f"rank.{a}.{b} AS rank_{a}_{b}" for a in "ab" for b in "si")


def _ranked(locs):
    return locs.select(*[c for c in locs.columns if c != "rank"], *[F.col(f"rank.{a}.{b}").alias(f"rank_{a}_{b}") for a in "ab" for b in "si"])


@register("gaz_locations", _LOCS + f"\nSELECT doc_id, country_pos, kind, surface, \"start\", \"end\", n_keys, {_RANK} FROM out")
def gaz_locations(spark, sf_dir):
    """EXT-7..12/JON-6: verified cities, states, countries per document and the country choice."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    return _ranked(resolve_locations(gazetteer_hits(docs, gazetteer_df(spark))))


@register("fus_location_entities", _LOCS + f"""
, first AS (SELECT *, row_number() OVER (PARTITION BY doc_id, country_pos, kind ORDER BY rank, surface) AS r FROM out)
SELECT doc_id, country_pos, "start", "end",
       CASE kind WHEN 'city' THEN 'ADDRESS_CITY' WHEN 'state' THEN 'ADDRESS_COUNTRY_DIVISION' ELSE 'ADDRESS_COUNTRY' END AS entity,
       surface AS name, CAST(1.0 AS DOUBLE) AS score
FROM first WHERE r = 1 AND NOT {K.in_list('surface', S.LOCATION_BLACKLIST)}""")
def fus_location_entities(spark, sf_dir):
    """FUS-1 (English locations): first location per kind with its span, blacklist removed."""
    docs = read_text_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    return location_entities(resolve_locations(gazetteer_hits(docs, gazetteer_df(spark))))


@register("src_gazetteer_file", """
WITH c AS (SELECT r_regionkey AS country_pos, r_name FROM region),
st AS (SELECT n.n_regionkey AS country_pos, n.n_nationkey, n.n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS sp FROM nation n),
ci AS (SELECT st.country_pos, st.sp, row_number() OVER (PARTITION BY st.n_nationkey ORDER BY s_suppkey) - 1 AS ip, s_name FROM st JOIN supplier ON s_nationkey = n_nationkey)
SELECT CAST(country_pos AS INTEGER) AS country_pos, 'country' AS kind, CAST(NULL AS INTEGER) AS state_pos, 0 AS item_pos, r_name AS surface FROM c
UNION ALL SELECT country_pos, 'country', NULL, 1, 'The ' || r_name FROM c
UNION ALL SELECT country_pos, 'state', sp, 0, n_name FROM st UNION ALL SELECT country_pos, 'state', sp, 1, lower(n_name) FROM st
UNION ALL SELECT country_pos, 'city', sp, ip, s_name FROM ci""")
def src_gazetteer_file(spark, sf_dir):
    """SRC-8: a gazetteer file (one JSON list: regions, their nations, their suppliers as cities) written and loaded."""
    t = {n: read_table(spark, sf_dir, n) for n in ("region", "nation", "supplier")}
    cities = t["supplier"].groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("c"))
    states = t["nation"].join(cities, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_regionkey", "n_nationkey", F.struct(
        F.col("n_name").alias("name"), F.array(F.lower("n_name")).alias("aliases"), F.transform("c", lambda x: x["s_name"]).alias("cities")).alias("s"))
    states = states.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "s"))).alias("st"))
    country = F.struct(F.struct(F.col("r_name").alias("name"), F.array(F.concat(F.lit("The "), F.col("r_name"))).alias("aliases"),
                                F.transform("st", lambda x: x["s"]).alias("states")).alias("country"))
    whole = t["region"].join(states, F.col("r_regionkey") == F.col("n_regionkey"), "left").agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", country.alias("c")))), lambda x: x["c"])).alias("value"))
    path = os.path.join(scratch_path(spark, "gazetteer"), "countries.json")
    whole.coalesce(1).write.text(path)
    return load_gazetteer(spark, path)
