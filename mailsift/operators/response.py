"""Nested response construction and flattening (RSP-1..5, RSP-9, RSH-1, SRC-5..7).

Entities of one document are gathered once into an ordered array
(``collect_list`` + ``array_sort`` on ``seq``); every response field is a
``filter``/``transform`` of that array, so the shape is built inside the row.
Sender reconciliation works on the envelope arrays of the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift import settings as S

ADDR = "struct<address:string,displayName:string>"
METADATA_DDL = (f"struct<senderEmailAddress:{ADDR}, fromEmailAddresses:array<{ADDR}>, "
                f"replyToEmailAddresses:array<{ADDR}>, toEmailAddresses:array<{ADDR}>, "
                f"ccEmailAddresses:array<{ADDR}>, bccEmailAddresses:array<{ADDR}>, subject:string, "
                f"messageId:string, sentDate:long, receivedByEmailAddress:string, "
                f"inReplyToMessageIds:array<string>, referenceMessageIds:array<string>>")
SENDER_DATA = "array<struct<address:string,name:string,confidenceScore:int,sourceTypes:array<string>>>"
BODY_REQUEST_DDL = (f"emailMetadata {METADATA_DDL}, emailBody struct<htmlBody:string,textBody:string>, "
                    f"responseDataTypes array<string>, preferredBodyType string, maxSignatures int")


def _of(ents: Column, tag: str) -> Column:
    return F.filter(ents, lambda e: e["entity"] == tag)


def _entity_list(ents: Column, entity_tag: str, value_name: str, **consts) -> Column:
    """RSP-2: list of typed structs for one tag, NULL when the tag has no entity."""
    arr = F.transform(_of(ents, entity_tag), lambda e: F.struct(
        e["name"].cast("string").alias(value_name), *[F.lit(v).cast("string").alias(k) for k, v in consts.items()]))
    return F.when(F.size(arr) > 0, arr)


def _first_name(ents: Column, tag: str) -> Column:
    return F.coalesce(F.get(_of(ents, tag), 0)["name"], F.lit(""))


def _phones(ents: Column) -> Column:
    """RSP-3: mobile, office, home, fax in that order with ``phoneType``; NULL when none."""
    kinds = [("PHONE_MOBILE", "MOBILE"), ("PHONE_OFFICE", "OFFICE"), ("PHONE_HOME", "HOME"), ("PHONE_FAX", "FAX")]
    def phone(kind):
        return lambda e: F.struct(
            e["name"].alias("number"), F.lit(None).cast("string").alias("phoneTag"), F.lit(kind).alias("phoneType"),
            F.lit(None).cast("string").alias("extension"), F.lit(None).cast("string").alias("extensionTag"),
            F.lit(None).cast("string").alias("wholeNumber"))
    parts = [F.transform(_of(ents, t), phone(k)) for t, k in kinds]
    allp = F.concat(*parts)
    return F.when(F.size(allp) > 0, allp)


def signature_fields(ents: Column, linkedin: bool = False) -> Column:
    """The fields of a signature. ``linkedin`` adds LinkedIn addresses to the web sites, tagged so; else they are left out."""
    sites = _entity_list(ents, "URL", "url", tag=None, wholeUrl=None)
    if linkedin:
        none = F.array().cast("array<struct<url:string,tag:string,wholeUrl:string>>")
        both = F.concat(F.coalesce(sites, none), F.coalesce(_entity_list(ents, "LINKEDIN", "url", tag="LINKEDIN", wholeUrl=None), none))
        sites = F.when(F.size(both) > 0, both)
    names = F.array(F.struct(
        F.lit("").alias("wholeName"), _first_name(ents, "NAME_PREFIX").alias("prefix"),
        _first_name(ents, "NAME_GIVEN").alias("given"), _first_name(ents, "NAME_MIDDLE").alias("middle"),
        _first_name(ents, "NAME_SURNAME").alias("surname"), _first_name(ents, "NAME_SUFFIX").alias("suffix")))
    return F.struct(
        names.alias("names"),
        _entity_list(ents, "JOB_TITLE", "title").alias("jobTitles"),
        _entity_list(ents, "ORGANIZATION", "name").alias("organizations"),
        _entity_list(ents, "ADDRESS_STREET", "line").alias("addresses"),
        _entity_list(ents, "ADDRESS_CITY", "name").alias("cities"),
        _entity_list(ents, "ADDRESS_COUNTRY_DIVISION", "name").alias("countryDivisions"),
        _entity_list(ents, "ADDRESS_POSTAL_CODE", "code").alias("postalCodes"),
        _entity_list(ents, "ADDRESS_COUNTRY", "name").alias("countries"),
        _entity_list(ents, "EMAIL", "address", tag=None, wholeEmail=None).alias("emails"),
        _phones(ents).alias("phoneNumbers"),
        sites.alias("webSites"))


def sender_data(meta: Column, ents: Column) -> Column:
    """RSP-4: sender, from, reply-to and signature e-mails in that order, grouped by address in
    first-seen order; source types kept in order (duplicates too); name = first non-empty
    display name; only addresses seen as SENDER or FROM are kept; confidence 5."""
    def tagged(arr, kind):
        return F.transform(F.coalesce(arr, F.array().cast(f"array<{ADDR}>")), lambda a: F.struct(
            a["address"].alias("address"), F.coalesce(a["displayName"], F.lit("")).alias("name"), F.lit(kind).alias("t")))
    sender = F.when(meta["senderEmailAddress"]["address"].isNotNull(), F.array(meta["senderEmailAddress"])) \
              .otherwise(F.array().cast(f"array<{ADDR}>"))
    sig = F.transform(_of(ents, "EMAIL"), lambda e: F.struct(e["name"].alias("address"), F.lit("").alias("displayName")))
    allv = F.concat(tagged(sender, "SENDER"), tagged(meta["fromEmailAddresses"], "FROM"),
                    tagged(meta["replyToEmailAddresses"], "REPLY_TO"), tagged(sig, "SIGNATURE_EMAIL_ADDRESS"))
    allv = F.filter(allv, lambda x: x["address"].isNotNull() & (x["address"] != ""))
    addrs = F.array_distinct(F.transform(allv, lambda x: x["address"]))
    grouped = F.transform(addrs, lambda a: F.struct(
        a.alias("address"),
        F.coalesce(F.get(F.filter(F.filter(allv, lambda x: x["address"] == a), lambda x: x["name"] != ""), 0)["name"],
                   F.lit("")).alias("name"),
        F.lit(S.SENDER_CONFIDENCE).alias("confidenceScore"),
        F.transform(F.filter(allv, lambda x: x["address"] == a), lambda x: x["t"]).alias("sourceTypes")))
    kept = F.filter(grouped, lambda g: F.array_contains(g["sourceTypes"], "SENDER") | F.array_contains(g["sourceTypes"], "FROM"))
    return F.when(meta.isNotNull(), kept)


def responses(blocks: DataFrame, id_col: str = "doc_id", block_col: str = "block", entities_col: str = "entities",
              meta_col: str | None = None, linkedin: bool = False) -> DataFrame:
    """RSP-1: one response for each row: ``(id, parseStatusType, signatureBlock, signatureFields, senderEmailData)``; an empty
    block gives NO_SIGNATURE_BLOCK and NULL payload. ``entities_col`` is the row's ordered entity array."""
    e = F.col(entities_col)
    empty = F.coalesce(F.length(block_col), F.lit(0)) == 0
    sender = F.when(~empty, sender_data(F.col(meta_col), e)) if meta_col else F.lit(None).cast(SENDER_DATA)
    return blocks.select(
        id_col,
        F.when(empty, F.lit(S.PARSE_NO_SIGNATURE)).otherwise(F.lit(S.PARSE_SUCCESS)).alias("parseStatusType"),
        F.when(~empty, F.struct(F.col(block_col).alias("block"))).alias("signatureBlock"),
        F.when(~empty, signature_fields(e, linkedin)).alias("signatureFields"), sender.alias("senderEmailData"))


def build_responses(ents: DataFrame, blocks: DataFrame, id_col: str = "doc_id", block_col: str = "block",
                    meta_col: str | None = None) -> DataFrame:
    """RSP-1 from an entity table ``(id, seq, entity, name)``: gathered by id, in the order of ``seq``."""
    g = ents.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "entity", "name"))).alias("_e"))
    j = blocks.select(id_col, block_col, *([meta_col] if meta_col else [])).join(g, id_col, "left")
    none = F.array().cast("array<struct<seq:int,entity:string,name:string>>")
    return responses(j.withColumn("_e", F.coalesce("_e", none)), id_col, block_col, "_e", meta_col)


# ------------------------------------------------------------------------------ flatten back
#: (tag, list field, value field, phone type): the sixteen tags of the evaluation, then the fields that it leaves out.
RESPONSE_TAGS = [
    ("NAME_GIVEN", "names", "given", None), ("NAME_SURNAME", "names", "surname", None),
    ("NAME_PREFIX", "names", "prefix", None), ("NAME_SUFFIX", "names", "suffix", None),
    ("NAME_MIDDLE", "names", "middle", None), ("JOB_TITLE", "jobTitles", "title", None),
    ("ORGANIZATION", "organizations", "name", None), ("EMAIL", "emails", "address", None),
    ("PHONE_MOBILE", "phoneNumbers", "number", "MOBILE"), ("PHONE_FAX", "phoneNumbers", "number", "FAX"),
    ("PHONE_OFFICE", "phoneNumbers", "number", "OFFICE"), ("ADDRESS_CITY", "cities", "name", None),
    ("ADDRESS_POSTAL_CODE", "postalCodes", "code", None), ("ADDRESS_STREET", "addresses", "line", None),
    ("ADDRESS_COUNTRY", "countries", "name", None), ("URL", "webSites", "url", None),
    ("PHONE_HOME", "phoneNumbers", "number", "HOME"), ("ADDRESS_COUNTRY_DIVISION", "countryDivisions", "name", None),
]
EVALUATED_TAGS = RESPONSE_TAGS[:16]


def _is_type(ptype):
    return lambda x: x["phoneType"] == ptype


def _value_of(field):
    return lambda x: F.coalesce(x[field].cast("string"), F.lit(""))


def response_to_long(resp: DataFrame, id_col: str = "doc_id", fields_col: str = "signatureFields",
                     tags=RESPONSE_TAGS) -> DataFrame:
    """RSH-1: response -> ``(id, tag_no, pos, entity, name)``; one row per value, a tag without values
    gives one row with ''; a NULL payload gives no rows."""
    f = F.col(fields_col)
    per_tag = []
    for i, (tag, lst, val, ptype) in enumerate(tags):
        arr = f[lst]
        if ptype:
            arr = F.filter(arr, _is_type(ptype))
        vals = F.transform(arr, _value_of(val))
        vals = F.coalesce(vals, F.array().cast("array<string>"))
        vals = F.when(F.size(vals) > 0, vals).otherwise(F.array(F.lit("")))
        per_tag.append(F.struct(F.lit(i).alias("t"), F.lit(tag).alias("entity"), vals.alias("names")))
    x = resp.where(f.isNotNull()).select(id_col, F.explode(F.array(*per_tag)).alias("p"))
    x = x.select(id_col, "p.t", "p.entity", F.posexplode("p.names").alias("k", "name"))
    return x.select(id_col, F.col("t").alias("tag_no"), F.col("k").alias("pos"), "entity", "name")


def sender_to_long(resp: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """RSP-4 flattened: ``(id, pos, address, name, confidenceScore, source_types)``, types joined by commas."""
    x = resp.select(id_col, F.posexplode("senderEmailData").alias("pos", "s"))
    return x.select(id_col, "pos", "s.address", "s.name", "s.confidenceScore", F.array_join("s.sourceTypes", ",").alias("source_types"))


# ------------------------------------------------------------------------------ envelopes
def body_request(text: Column, meta: Column) -> Column:
    """RSP-9: body request envelope as JSON text."""
    return F.to_json(F.struct(meta.alias("emailMetadata"),
                              F.struct(F.lit("").alias("htmlBody"), text.alias("textBody")).alias("emailBody"),
                              F.array(*[F.lit(x) for x in ["EMAIL_METADATA", "SIGNATURE_BLOCK", "SIGNATURE_FIELDS"]]).alias("responseDataTypes"),
                              F.lit("TEXT_ONLY").alias("preferredBodyType"), F.lit(5).alias("maxSignatures")))


def signature_request(block: Column, meta: Column) -> Column:
    return F.to_json(F.struct(meta.alias("emailMetadata"), block.alias("signatureBlock")))


def parse_body_requests(js: Column) -> Column:
    """SRC-5/SRC-7: envelope JSON (object or list) -> array of (textBody, metadata)."""
    as_list = F.when(F.ltrim(js).startswith("["), js).otherwise(F.concat(F.lit("["), js, F.lit("]")))
    parsed = F.from_json(as_list, f"array<struct<{BODY_REQUEST_DDL}>>")
    return F.transform(parsed, lambda r: F.struct(r["emailBody"]["textBody"].alias("textBody"),
                                                  r["emailMetadata"].alias("emailMetadata")))


def signature_of_request(js: Column) -> Column:
    """SRC-6: signature block of a signature request; '' when missing."""
    return F.coalesce(F.get_json_object(js, "$.signatureBlock"), F.lit(""))
