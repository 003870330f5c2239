"""Queries of what is let through, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertext.functions.text import display_name
from undertext.operators import gates
from undertext.plans import queries as base
from undertext.plans.queries import INVISIBLE, escaped, q


def request_gate(spark, sf_dir):
    """Four documents in a row are one request."""
    found = base.zero_width_verdicts(spark, sf_dir)
    return gates.requests(found.select(F.floor(F.col("doc_id") / 4).alias("request_id"), F.col("doc_id").alias("seq"), "verdict"))


def gate_config_in_force(spark, sf_dir):
    """A user's purchases switch interception on or off; clicks ask for it."""
    events = base._t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts", "event_type", (F.col("value") > 50).alias("on"))
    found = gates.in_force(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"))
    return found.select(F.col("id").alias("event_id"), "active")


def site_settings(spark, sf_dir):
    """Each user's map of event types, on by default; signups and purchases store a value."""
    events = base._t(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("host"), "ts", F.col("event_id").alias("id"), (F.col("value") > 50).alias("on"))
    return gates.overlaid(events.select("owner", "host").distinct().withColumn("on", F.lit(True)), events.where("host in ('signup', 'purchase')"))


def threat_list(spark, sf_dir):
    """A document's threats in order, as one text."""
    items = F.array_sort(F.collect_list(F.struct("line_no", "col", "codepoint")))
    shown_ = F.array_join(F.transform(items, lambda t: F.concat_ws(":", t.getField("line_no").cast("string"), t.getField("col").cast("string"), t.getField("codepoint"))), " ")
    return base.zero_width_threats(spark, sf_dir).groupBy("doc_id").agg(shown_.alias("threats"))


def threat_differences(spark, sf_dir):
    """The expected threats lack those of every tenth document and hold those of every fifteenth twice."""
    actual = base.zero_width_threats(spark, sf_dir).select("doc_id", "line_no", "codepoint")
    return gates.differences(actual.where("doc_id % 10 <> 0").unionByName(actual.where("doc_id % 15 = 0")), actual)


def display_names(spark, sf_dir):
    """File names, of which every third holds an invisible code point, as they are shown."""
    point = F.when(F.col("doc_id") % 3 == 0, F.substring(F.lit(INVISIBLE), (F.col("doc_id") % 17 + 1).cast("int"), F.lit(1))).otherwise("")
    name = F.concat(F.lit("re"), point, base._pick(base.NAMES))
    return base._t(spark, sf_dir, "documents").select("doc_id", display_name(name).alias("name"), F.length(name).cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (request_gate, gate_config_in_force, site_settings, threat_list, threat_differences, display_names)}

_T = f"(SELECT doc_id, line_no, codepoint FROM {base._Z})"
_P = f"'re' || CASE WHEN doc_id % 3 = 0 THEN substr({q(INVISIBLE)}, CAST(doc_id % 17 + 1 AS INT), 1) ELSE '' END || {base._NAME}"
_K = "doc_id, line_no, codepoint"
_G = f"(SELECT * FROM {_T} WHERE doc_id % 10 <> 0 UNION ALL SELECT * FROM {_T} WHERE doc_id % 15 = 0)"

SQL = {
    "request_gate": f"SELECT request_id, f IS NOT NULL AS blocked, f AS first_blocked, count(*) FILTER (f IS NULL OR doc_id < f) AS n_passed FROM (SELECT doc_id // 4 AS request_id, doc_id, min(CASE WHEN verdict = 'infected' THEN doc_id END) OVER (PARTITION BY doc_id // 4) AS f FROM ({base._V})) GROUP BY ALL",
    "gate_config_in_force": "SELECT c.event_id, coalesce(arg_max(p.value > 50, (p.ts, p.event_id)), true) AS active FROM events c LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts <= c.ts WHERE c.event_type = 'click' GROUP BY 1",
    "site_settings": "SELECT user_id AS owner, event_type AS host, coalesce(arg_max(value > 50, (ts, event_id)) FILTER (event_type IN ('signup', 'purchase')), true) AS \"on\" FROM events GROUP BY 1, 2",
    "threat_list": f"SELECT doc_id, string_agg(line_no || ':' || col || ':' || codepoint, ' ' ORDER BY line_no, col) AS threats FROM {base._Z} GROUP BY 1",
    "threat_differences": f"SELECT {_K}, coalesce(g.n, 0) AS n_golden, coalesce(a.n, 0) AS n_actual FROM (SELECT {_K}, count(*) AS n FROM {_G} GROUP BY ALL) g FULL JOIN (SELECT {_K}, count(*) AS n FROM {_T} GROUP BY ALL) a USING ({_K}) WHERE coalesce(g.n, 0) <> coalesce(a.n, 0)",
    "display_names": f"SELECT doc_id, regexp_replace(name, {q(f'[{escaped(INVISIBLE, True)}]')}, '', 'g') AS name, length(name) AS n_chars FROM (SELECT doc_id, {_P} AS name FROM documents)",
}
