"""URL filtering against dated lists: every capture meets the entries active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Guarded, pick, stored

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
SECTION = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"
# intervals and captures meet within periods of so many seconds
PERIOD = 64 * 86_400
# of entries with one date the strongest holds
STRENGTH = {"block": 3, "allow": 2, "remove": 1}
ADDED = ("host", "blocked", "entry", "action")


def host_of(url: Column) -> Column:
    """Host in lower case without a last dot; null where there is none."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, HOST, 1), r"\.$", ""))
    return F.when(host != "", host)


def section_of(url: Column) -> Column:
    """``host/first path part``; null where either is missing."""
    part = F.regexp_extract(url, SECTION, 1)
    return F.when(part != "", F.concat(host_of(url), F.lit("/"), part))


def path_parts(path: Column) -> Column:
    """Parts of a path that are not empty; none for a null path."""
    return F.coalesce(F.filter(F.split(path, "/"), lambda p: p != ""), F.array().cast("array<string>"))


def plain_entry(entry: Column) -> Column:
    """An entry as captures are named: host in lower case without a last dot, then the path's parts.

    A scheme, user, port, query or fragment is left out. Null where no host is left.
    """
    rest = F.regexp_replace(F.trim(entry), SCHEME, "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#:]*)", 1), r"\.$", ""))
    return F.when(host != "", F.array_join(F.concat(F.array(host), path_parts(F.regexp_extract(rest, r"^[^/?#]*/([^?#]*)", 1))), "/"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(entry, action, since, until) from dated changes (entry, action, listed_at in seconds).

    An entry holds from its date until the entry's next change, the last one without end;
    ``remove`` ends the one before. Of changes at one time the strongest counts: block, allow,
    remove. Entries are taken as ``plain_entry`` writes them, so forms of one name are one entry.
    Changes with a null entry or date, one without a host, or an unknown action, are none.
    """
    known = pick(entries, "entry", "action", "listed_at").withColumn("entry", plain_entry(F.col("entry"))).filter(
        F.col("entry").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin(*STRENGTH)
    )
    strength = F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair])
    single = known.groupBy("entry", "listed_at").agg(F.max_by("action", F.element_at(strength, F.col("action"))).alias("action"))
    order = W.partitionBy("entry").orderBy("listed_at")
    return (
        single.withColumn("until", F.lead("listed_at").over(order))
        .filter("action <> 'remove'")
        .select("entry", "action", F.col("listed_at").alias("since"), "until")
    )


def capture_keys(url: Column, labels: int, parts: int) -> Column:
    """What a list may name a capture by: its host and the host's parents, each alone and with the beginnings of its path.

    Only names of up to ``labels`` parts and paths of up to ``parts`` are made, the most that any entry has.
    """
    named = F.split(host_of(url), r"\.")
    most = F.least(F.size(named), F.lit(labels))
    names = F.when(most > 0, F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(named, -n, n), ".")))
    path = path_parts(F.regexp_extract(url, PATH, 1))
    ends = F.transform(
        F.sequence(F.lit(0), F.least(F.size(path), F.lit(parts))), lambda n: F.array_join(F.concat(F.array(F.lit("")), F.slice(path, F.lit(1), n)), "/")
    )
    keys = F.flatten(F.transform(names, lambda name: F.transform(ends, lambda end: F.concat(name, end))))
    return F.coalesce(keys, F.array().cast("array<string>"))


def active_entries(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """(row, entry, action) of every interval that covers a capture: (row, url, fetched_at).

    An as-of join: name and period are equal, and the capture lies in the interval. Intervals are
    cut at period ends, so a capture meets only what its own period holds, and a name with a long
    history is no long list for any one capture.
    """
    reach = captures.agg(F.min("fetched_at").alias("low"), F.max("fetched_at").alias("high"))
    labels, parts = intervals.agg(
        F.max(F.size(F.split(F.regexp_extract("entry", "^[^/]*", 0), r"\."))), F.max(F.size(F.split("entry", "/")) - 1)
    ).first()
    low, high = reach.first()
    period = lambda t: F.floor(t / PERIOD).cast("long")
    first = F.greatest(F.col("since"), F.lit(low).cast("long"))
    last = F.least(F.coalesce(F.col("until") - 1, F.lit(high).cast("long")), F.lit(high).cast("long"))
    cut = (
        intervals.filter(first <= last)
        .withColumn("period", F.explode(F.sequence(period(first), period(last))))
        .select(F.col("entry").alias("name"), "action", "since", "until", F.col("period").alias("_period"))
    )
    named = captures.filter("fetched_at is not null").select(
        "row", "fetched_at", period(F.col("fetched_at")).alias("period"), F.explode(capture_keys(F.col("url"), labels or 0, parts or 0)).alias("key")
    )
    covers = (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    return named.join(cut, (F.col("key") == F.col("name")) & (F.col("period") == F.col("_period")) & covers).select(
        "row", F.col("key").alias("entry"), "action"
    )


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched_at in seconds, more) with host, blocked, entry and action.

    The most special active entry decides: the longest name, by code point among equals. A
    capture without url, host or time, or without an active entry, is not blocked and has no
    entry. Every row is judged by itself, equal rows alike; columns of the added names are replaced.
    """
    guard = Guarded(captures, ("url", "fetched_at"), ADDED)
    rows = stored(guard.work.withColumn("row", F.monotonically_increasing_id()), "captures")
    found = active_entries(rows.select("row", "url", "fetched_at"), stored(validity_intervals(entries), "intervals"))
    best = found.groupBy(F.col("row").alias("_row")).agg(
        F.max(F.struct(F.length("entry").alias("n"), "entry", "action")).alias("best")
    )
    joined = rows.join(best, F.col("row") == F.col("_row"), "left")
    return guard.restore(
        joined, host_of(F.col("url")).alias("host"), F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
        F.col("best.entry").alias("entry"), F.col("best.action").alias("action"),
    )
