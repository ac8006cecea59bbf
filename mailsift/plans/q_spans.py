"""Registered queries: span merging and gaps (SPN-1/2, WIN-1..3, SEG-10) on ``events``.

Stand-in: per (user, event type) the event is a span from ``ts`` (epoch
seconds) lasting ``floor(value*60)`` seconds, ordered by (start, event_id).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators.spans import last_island, merge_spans, merge_spans_skewsafe, next_gap_skewsafe
from mailsift.plans.registry import register
from mailsift.session import read_table

GAP = 14_400
SIG_GAP = 3_600


def event_spans(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    # ts is TIMESTAMP_NTZ: seconds since the epoch without any session-zone conversion
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return ev.select("user_id", "event_type", "event_id", s.alias("start"),
                     (s + F.floor(F.col("value") * 60).cast("bigint")).alias("end"))


_E = """e AS (SELECT user_id, event_type, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s,
       CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) AS en FROM events)"""


def _islands_sql(keys, gap, cmp):
    k = ", ".join(keys)
    return f"""WITH {_E},
f AS (SELECT *, CASE WHEN lag(en) OVER w IS NULL OR NOT (s - lag(en) OVER w {cmp} {gap}) THEN 1 ELSE 0 END AS nw
      FROM e WINDOW w AS (PARTITION BY {k} ORDER BY s, event_id)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY {k} ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM f),
m AS (SELECT {k}, CAST(isl AS INTEGER) AS island, arg_min(s, (s, event_id)) AS "start", arg_max(en, (s, event_id)) AS "end",
             count(*) AS n FROM g GROUP BY {k}, isl)"""


@register("spn_merge_events", _islands_sql(["user_id", "event_type"], GAP, "<")
          + '\nSELECT user_id, event_type, "start", "end", n FROM m')
def spn_merge_events(spark, sf_dir):
    """SPN-1/WIN-3: merge consecutive spans with gap < 4 h per user and type (window form)."""
    m = merge_spans(event_spans(spark, sf_dir), ["user_id", "event_type"], ["start", "event_id"], gap=GAP)
    return m.select("user_id", "event_type", "start", "end", "n")


@register("spn_merge_events_skewsafe", _islands_sql(["user_id", "event_type"], GAP, "<")
          + '\nSELECT user_id, event_type, "start", "end", n FROM m')
def spn_merge_events_skewsafe(spark, sf_dir):
    """SPN-1 in the skew-safe physical form (range-partitioned, boundary stitching)."""
    return merge_spans_skewsafe(event_spans(spark, sf_dir), ["user_id", "event_type"], ["start", "event_id"], gap=GAP)


@register("spn_signature_pieces", _islands_sql(["user_id"], SIG_GAP, "<=") + """
SELECT user_id, "start", "end", n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY island DESC) AS r FROM m)
WHERE r = 1""")
def spn_signature_pieces(spark, sf_dir):
    """SPN-2: pieces split where the gap exceeds the minimum; the last piece per group."""
    return last_island(event_spans(spark, sf_dir), ["user_id"], ["start", "event_id"], gap=SIG_GAP, inclusive=True)


@register("seg_merge_window_hits", _islands_sql(["user_id"], SIG_GAP, "<") + """
SELECT user_id, "start", "end", n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY island DESC) AS r FROM m)
WHERE r = 1""")
def seg_merge_window_hits(spark, sf_dir):
    """SEG-10: walk back from the last hit while the gap to the next hit is below the minimum."""
    return last_island(event_spans(spark, sf_dir), ["user_id"], ["start", "event_id"], gap=SIG_GAP, inclusive=False)


@register("win_next_gap", f"""WITH {_E}
SELECT event_id, CAST(coalesce(lead(s) OVER w - en, 0) AS BIGINT) AS diff,
       CAST(coalesce(lead(s) OVER w - en, en) AS BIGINT) AS diff_fill_end
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)""")
def win_next_gap(spark, sf_dir):
    """WIN-1/WIN-2: next start minus own end, filled with 0 or with the own end."""
    sp = event_spans(spark, sf_dir)
    g = next_gap_skewsafe(sp, ["user_id"], ["start", "event_id"])
    gap = F.col("next_start") - F.col("end")
    return g.select("event_id", F.coalesce(gap, F.lit(0)).alias("diff"), F.coalesce(gap, F.col("end")).alias("diff_fill_end"))
