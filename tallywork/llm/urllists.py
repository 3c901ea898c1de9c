"""URL filters: dated lists joined to captures as of their fetch time, in DataFrame operations only.

A list is a table of dated events that add or remove an entry, a host (with all below it) or a host and path prefix.
Events become validity intervals: from an addition to the next removal. A capture is looked up under its host, each
parent domain down to a single label, and each with its leading path segments, as long as the longest entries of the lists are; what is active
at its fetch time applies.

URLs and entries are compared in one form: scheme, user, port, query and fragment left out, the host in small letters
without a last dot, path segments decoded from per-cent escapes, empty ones left out, "." and ".." walked, white space
around it dropped. Hosts in other scripts are compared as written: Unicode and Punycode forms of one name differ. The case of a path matters. A slash
or per-cent sign that was escaped stays escaped, so it parts no segments; a segment of broken escapes stays as it is.

Intervals are cut at month ends, from the month of the first fetch to that of the last, and joined on (entry, month), so
an entry with a long history doesn't meet all captures of its host. A hot host is one key of a join between two stored
tables, which adaptive execution splits.

A null or odd url has no host and matches nothing; a null fetch time matches nothing either. Repeated captures are
looked up one by one, repeated events count once; of events of one day the removal wins, of several matches the first by
list and entry is named. A very long URL has no more keys than the longest entry. With no captures or no events the result
is empty, or free of matches. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import stored

SCHEME = r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?"
HOST = rf"^{SCHEME}(\[[^\]/?#]*\]|[^/:?#]*)"
PATH = rf"^{SCHEME}[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in small letters without a last dot, or nothing."""
    return F.regexp_replace(F.regexp_extract(F.lower(bare(url)), HOST, 1), r"\.$", "")


def bare(url: Column) -> Column:
    """A URL without white space around it, nothing for null."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def segments(path: Column) -> Column:
    """The segments of a path, decoded; escaped slashes and per-cent signs stay escaped."""

    def plain(s: Column) -> Column:
        decoded = F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
        return F.replace(F.replace(decoded, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))

    def walked(done: Column, s: Column) -> Column:
        return F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s))

    plain_ = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), plain)
    return F.when(F.exists(plain_, lambda s: s.isin(".", "..")), F.aggregate(plain_, F.array().cast("array<string>"), walked)).otherwise(plain_)


def path_of(url: Column) -> Column:
    return segments(F.regexp_extract(bare(url), f"(?i){PATH}", 1))


def entry_of(text: Column) -> Column:
    """An entry, with or without a scheme, in the form in which URLs are looked up; null without a host."""
    url = F.when(F.lower(text).rlike(f"^{SCHEME}"), text).otherwise(F.concat(F.lit("list://"), text))
    host = host_of(url)
    return F.when(host != "", F.array_join(F.concat(F.array(host), path_of(url)), "/"))


def longest(events: DataFrame) -> tuple[int, int]:
    """Most labels of a host and most path segments in any entry."""
    host, path = F.substring_index("entry", "/", 1), F.size(F.split("entry", "/")) - 1
    labels, steps = events.where("entry is not null").agg(F.max(F.size(F.split(host, r"\."))), F.max(path)).first()
    return max(labels or 0, 1), steps or 0


def entries_of(host: Column, path: Column, most_labels: int, most_segments: int) -> Column:
    """What a capture is looked up under: each suffix of its host, alone and with leading path segments, up to the longest entry."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most_labels))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    tails = F.transform(F.sequence(F.lit(0), F.least(F.size(path), F.lit(most_segments))), lambda k: F.when(k == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(path, 1, F.greatest(k, F.lit(1))), "/"))))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(tails, lambda t: F.concat(h, t)))))


def intervals(events: DataFrame) -> DataFrame:
    """list, entry, valid_from, valid_to (exclusive, null: still valid) of events (list, entry, day, action: add or remove)."""
    one = events.where("entry is not null and day is not null").groupBy("list", "entry", "day").agg(F.max("action").alias("action"))  # remove sorts after add
    by_day = Window.partitionBy("list", "entry").orderBy("day")
    changes = one.withColumn("was", F.lag("action").over(by_day)).where("action = 'add' and (was is null or was = 'remove') or action = 'remove' and was = 'add'")
    return changes.withColumn("valid_to", F.lead("day").over(by_day)).where("action = 'add'").select("list", "entry", F.col("day").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) with n_matches, the first match by name as list and entry, and blocked."""
    url = F.col("url").cast("string")
    known = captures.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("fetched").cast("date").alias("fetched"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = stored(known.withColumn("row", F.monotonically_increasing_id()), "captures")
    events = stored(events.select("list", entry_of(F.col("entry").cast("string")).alias("entry"), "day", "action"), "events")
    first, last = known.agg(F.min("fetched"), F.max("fetched")).first()
    begin = F.greatest(F.col("valid_from"), F.lit(first).cast("date"))
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))
    months = F.sequence(F.trunc("begin", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))
    cut = intervals(events).withColumn("begin", begin).withColumn("end", end).where("end >= begin").select("list", "entry", "valid_from", "valid_to", F.explode(months).alias("month"))
    cut = stored(cut, "intervals")
    looked = known.where("host != ''").select("row", "fetched", F.explode(entries_of(F.col("host"), F.col("path"), *longest(events))).alias("key"), F.trunc("fetched", "month").alias("in_month"))
    active = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    met = looked.join(cut, (F.col("key") == F.col("entry")) & (F.col("in_month") == F.col("month")) & active)
    per = met.groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("n_matches"), F.min(F.struct("list", "entry")).alias("match"))
    return known.join(per, F.col("row") == F.col("_row"), "left").select(
        "page_id", "url", "fetched", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.col("match.list").alias("list"), F.col("match.entry").alias("entry"), F.col("match").isNotNull().alias("blocked")
    )
