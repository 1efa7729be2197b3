"""Temporal URL filtering: dated list entries as validity intervals, an as-of join per capture (no Python code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Largest list, in interval rows, that is sent whole to every executor; longer ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and a trailing dot; empty if there is none."""
    rest = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.rtrim(rest, F.lit("."))


def url_path(url: Column) -> Column:
    """Lower-case path of a URL up to the query or fragment; ``/`` if there is none."""
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def validity(entries: DataFrame) -> DataFrame:
    """Turn dated events (kind, entry, action, at) into intervals [valid_from, valid_to).

    ``add`` opens an interval and the next ``remove`` of the same entry closes it; repeated adds or removes
    change nothing, a remove at the instant of an add wins, an entry that is never removed stays valid.
    Events without entry, kind or date are ignored.
    """
    events = entries.where("entry IS NOT NULL AND kind IS NOT NULL AND at IS NOT NULL")
    state = events.groupBy("kind", F.lower("entry").alias("entry"), "at").agg(
        F.bool_and(F.col("action") == "add").alias("on")
    )
    by_entry = Window.partitionBy("kind", "entry").orderBy("at")
    changes = state.withColumn("was", F.coalesce(F.lag("on").over(by_entry), F.lit(False))).where("on <> was")
    closed = changes.withColumn("valid_to", F.lead("at").over(by_entry))
    return closed.where("on").select("kind", "entry", F.col("at").alias("valid_from"), "valid_to")


def url_keys(url: Column) -> Column:
    """The (kind, key) pairs under which a list can name a URL: its host, every domain above, every path prefix."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.when(
        F.size(steps) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(steps)),
            lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    pair = lambda kind: lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("entry"))
    return F.when(
        host != "",
        F.concat(
            F.array(F.struct(F.lit("host").alias("kind"), host.alias("entry"))),
            F.transform(domains, pair("domain")),
            F.transform(prefixes, pair("prefix")),
        ),
    )


def filter_urls(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Judge every capture (page_id, url, fetched_at) by the entries valid at its fetch time.

    Returns page_id, url, fetched_at, blocked, n_active (entries that match and are valid then) and, of the
    entry that came into force last (ties: smaller kind, then entry), kind, entry, valid_from and valid_to.
    The list is one row an entry with its intervals in order of time; the as-of join meets each key of a capture with
    that row and picks the last interval that began by the fetch time, which must not have ended. A null or hostless
    url and a null fetch time match nothing and are kept, as are repeated rows, one result each; an empty list blocks
    nothing. The list is broadcast while its counted intervals are within ``broadcast_rows``; beyond that both sides
    are shuffled by key, and the captures of a hot key are split by adaptive execution, as both sides are plain scans.
    """
    intervals = stored(validity(entries))
    spans = intervals.groupBy("kind", "entry").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to"))).alias("spans"))
    rows = stored(captures.select("page_id", "url", "fetched_at").withColumn("_row", F.monotonically_increasing_id()))
    keyed = rows.select("_row", "fetched_at", F.explode(F.array_distinct(url_keys(F.col("url")))).alias("k"))
    keyed = keyed.select("_row", "fetched_at", "k.kind", "k.entry")
    short = intervals.limit(broadcast_rows + 1).count() <= broadcast_rows
    hits = keyed.join(F.broadcast(spans) if short else stored(spans).hint("shuffle_hash"), ["kind", "entry"])
    begun = F.filter("spans", lambda s: s["valid_from"] <= F.col("fetched_at"))
    asof = hits.select("_row", "fetched_at", "kind", "entry", F.get(begun, F.size(begun) - 1).alias("s")).select("_row", "fetched_at", "kind", "entry", "s.*")
    active = asof.where("valid_from IS NOT NULL AND (valid_to IS NULL OR fetched_at < valid_to)")
    last = F.struct((-F.unix_micros("valid_from")).alias("order"), "kind", "entry", "valid_from", "valid_to")
    verdicts = active.groupBy("_row").agg(F.count("*").alias("n_active"), F.min(last).alias("hit"))
    return rows.join(verdicts, "_row", "left").select(
        "page_id",
        "url",
        "fetched_at",
        F.col("hit").isNotNull().alias("blocked"),
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.col("hit.kind").alias("kind"),
        F.col("hit.entry").alias("entry"),
        F.col("hit.valid_from").alias("valid_from"),
        F.col("hit.valid_to").alias("valid_to"),
    )
