"""URL filters by dated lists: each capture is judged by the entries that were active when it was fetched.

Entries are events: a pattern is added to a list or removed from it at a date. They become validity
intervals. A capture's host suffixes and path prefixes meet the patterns in an as-of equi-join on
pattern and period, so that a pattern with many captures, or with a long history, is dealt out by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved

#: Days of one period of the join.
PERIOD = 30


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, from_day, until_day): half-open intervals; until_day is null while it lasts.

    ``entries`` has list_name, pattern, action ("add" or "remove") and effective (date). Repeated adds
    go on, removes of what isn't listed do nothing, an add and a remove of one day leave it removed.
    Rows with a null in any of the four are left out.
    """
    day = entries.where("list_name is not null and pattern is not null and effective is not null and action in ('add', 'remove')")
    day = day.groupBy(
        "list_name", F.lower("pattern").alias("pattern"), F.col("effective").cast("date").alias("from_day")
    ).agg(F.min(F.col("action") == "add").alias("added"))
    by = Window.partitionBy("list_name", "pattern").orderBy("from_day")
    changes = day.withColumn("before", F.lag("added", 1, False).over(by)).where("added != before")
    return changes.withColumn("until_day", F.lead("from_day").over(by)).where("added").select(
        "list_name", "pattern", "from_day", "until_day"
    )


def url_keys(labels: list[int], parts: list[int], url: str = "url"):
    """Patterns that can cover a URL: suffixes of its host of so many labels, and its host with so many parts of its path.

    What no list has isn't built: a long URL gives no more than there are lengths of patterns.
    """
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)", 1)
    names, steps = F.split(host, r"\."), F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    some = lambda sizes, of: F.filter(F.lit(sorted(sizes)).cast("array<int>"), lambda n: n <= F.size(of))
    suffixes = F.transform(some(labels, names), lambda n: F.array_join(F.slice(names, F.size(names) - n + 1, n), "."))
    prefixes = F.transform(some(parts, steps), lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), n), "/")))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, entries: DataFrame, allow: str = "allow") -> DataFrame:
    """capture_id, url, fetched, ``n_active`` (entries active at that date), ``lists`` and ``blocked``.

    Captures have capture_id, url and fetched (date). A capture is blocked if an entry of any list but
    ``allow`` is active for it and none of ``allow`` is. Null or unreadable URLs and null dates match
    nothing and are not blocked; every row comes back once, repeated rows each for itself.
    """
    rows = captures.select(F.col("capture_id"), "url", F.col("fetched").cast("date").alias("fetched"))
    valid = intervals(entries)
    period = lambda d: F.floor(F.unix_date(d) / PERIOD)
    low, high = (F.lit(d).cast("date") for d in rows.agg(F.min("fetched"), F.max("fetched")).first())
    cut = valid.where((F.col("from_day") <= high) & (F.col("until_day").isNull() | (F.col("until_day") > low)))
    first, last = F.greatest("from_day", low), F.least(F.coalesce(F.date_sub("until_day", 1), high), high)
    dealt = cut.withColumn("period", F.explode(F.sequence(period(first), period(last))))
    # equal captures are judged once, which also gathers the copies of a hot URL before the join
    asked = rows.where("fetched is not null and url is not null").select("url", "fetched").distinct()
    # suffixes that no list names (a top-level domain has most of the captures) go before anything is dealt out by
    # them; the names are written first, so that Spark can broadcast a small table or split a frequent suffix
    listed = saved(dealt.select("pattern").distinct())
    count = lambda c: F.length("pattern") - F.length(F.replace("pattern", F.lit(c), F.lit("")))
    is_path = F.col("pattern").contains("/")
    # how long patterns are: no more numbers than the longest of them has characters
    labels, parts = listed.agg(F.collect_set(F.when(~is_path, count(".") + 1)), F.collect_set(F.when(is_path, count("/")))).first()
    keys = asked.select("url", "fetched", F.explode(url_keys(labels, parts)).alias("pattern"), period(F.col("fetched")).alias("period"))
    met = keys.join(listed, "pattern", "left_semi").join(dealt, ["pattern", "period"]).where(
        "from_day <= fetched and (until_day is null or fetched < until_day)"
    )
    verdict = met.groupBy("url", "fetched").agg(F.count("*").alias("n_active"), F.array_sort(F.collect_set("list_name")).alias("lists"))
    out = rows.join(verdict, ["url", "fetched"], "left")
    lists = F.coalesce("lists", F.array().cast("array<string>"))
    blocked = (F.size(F.array_remove(lists, allow)) > 0) & ~F.array_contains(lists, allow)
    return out.select(
        "capture_id", "url", "fetched", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), lists.alias("lists"),
        blocked.alias("blocked")
    )
