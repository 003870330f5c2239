"""Site tables: host names, defaults and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertext.functions.text import trimmed

# What a host name is, the surfaces that are always watched, and those that are offered.
HOST = r"^([a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"

STATIC = ("chatgpt.com", "chat.openai.com", "claude.ai")
OFFERED = ("gemini.google.com", "copilot.microsoft.com", "perplexity.ai")


def normal_host(text: Column) -> Column:
    """The bare lower-case host of a host or url, null where it is not one."""
    raw = F.lower(trimmed(text))
    host = F.when(raw.contains("://"), F.regexp_extract(raw, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)).otherwise(raw)
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"/.*$", "")
    return F.when(bare.rlike(HOST) & (F.length(bare) <= 253), bare)


def active(hosts: DataFrame, enabled: DataFrame, paused: bool = False) -> DataFrame:
    """hosts with active: on unless the host's row in enabled (host, on) says no, and never while paused."""
    setting = enabled.select(F.col("host").alias("h"), "on")
    return hosts.join(setting, F.col("host") == F.col("h"), "left").select("host", (F.coalesce("on", F.lit(True)) & F.lit(not paused)).alias("active"))


def unlisted(candidates: DataFrame, *lists: DataFrame) -> DataFrame:
    """Distinct candidate hosts in none of the lists."""
    out = candidates.where("host is not null").select("host").distinct()
    for known in lists:
        out = out.join(known.select("host"), "host", "left_anti")
    return out


def file_type(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit("txt")
    for ext in ("md", "pdf", "docx", "pptx"):
        out = F.when(low.endswith(f".{ext}"), ext).otherwise(out)
    return out


def origin(host: Column) -> Column:
    """The pattern of a host's pages."""
    return F.concat(F.lit("https://"), host, F.lit("/*"))


def script_name(host: Column) -> Column:
    """A host as part of a name: whatever is no ASCII letter, digit or dot becomes a low line."""
    return F.regexp_replace(host, "[^a-zA-Z0-9.]", "_")


def known_sites(custom: DataFrame) -> DataFrame:
    """(host, builtin, rank, place) of all sites in their order: static, offered, and custom ones (host, place). A custom host that is listed already stands twice, as in the lists."""
    rows = [(h, True, 0, i) for i, h in enumerate(STATIC)] + [(h, False, 1, i) for i, h in enumerate(OFFERED)]
    fixed = custom.sparkSession.createDataFrame(rows, "host string, builtin boolean, rank int, place long")
    return fixed.unionByName(custom.select("host", F.lit(False).alias("builtin"), F.lit(2).alias("rank"), F.col("place").cast("long").alias("place")))


def is_builtin(host: Column) -> Column:
    return F.coalesce(host.isin(*STATIC), F.lit(False))


def to_register(sites: DataFrame, granted: DataFrame) -> DataFrame:
    """Of sites (of known_sites), those not built in that a permission was granted for (granted: origin), with origin and script, once each."""
    asked = sites.where("not builtin").select("host").distinct().withColumn("origin", origin(F.col("host")))
    return asked.join(granted.select(F.col("origin").alias("o")), F.col("origin") == F.col("o"), "left_semi").withColumn("script", script_name(F.col("host")))


def gate_state(stored: DataFrame) -> tuple[bool, dict[str, bool]]:
    """Whether all is paused, and hosts' settings, from rows (key, value as JSON) of the settings store; off and none where they are missing or unreadable. The two rows come to the driver."""
    found = {r.key: r.value for r in stored.where("key in ('paused', 'sites')").groupBy("key").agg(F.max("value").alias("value")).collect()}
    row = stored.sparkSession.createDataFrame([(found.get("sites"),)], "v string").select(F.from_json("v", "map<string,boolean>").alias("m")).first()
    return found.get("paused") == "true", dict(row.m or {})


def upserted(settings: Column, host: Column, on: Column) -> Column:
    """A map of settings with one host's set, whether it was there or not; a null map is empty, and a null host sets nothing."""
    known = F.coalesce(settings, F.create_map().cast("map<string,boolean>"))
    return F.when(host.isNull(), known).otherwise(F.map_concat(F.map_filter(known, lambda k, _: k != host), F.map_from_arrays(F.array(F.coalesce(host, F.lit(""))), F.array(on))))


def after_changes(changes: DataFrame) -> DataFrame:
    """(owner, host, place) of the custom sites that owners have after changes (owner, host, ts, id, action add or remove), place being the id of the change that put it there.

    Adding what is there changes nothing; what was removed and added again stands where it was added last. Of equal
    times the larger id is later.
    """
    when = F.struct("ts", "id")
    last = changes.where("action = 'remove' and host is not null").groupBy(F.col("owner").alias("o"), F.col("host").alias("h")).agg(F.max(when).alias("gone"))
    added = changes.where("action = 'add' and host is not null").join(last, F.col("owner").eqNullSafe(F.col("o")) & (F.col("host") == F.col("h")), "left").where(F.col("gone").isNull() | (when > F.col("gone")))
    return added.groupBy("owner", "host").agg(F.min_by("id", when).alias("place"))
