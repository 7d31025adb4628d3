"""Tables that are kept: upserts, the trading calendar, a cache with expiry, recently viewed codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.values import in_trading_hours, last_complete_day

BAR_KEYS = ("code", "ktype", "ts")
#: Days that kinds of metadata stay valid.
TTL_DAYS = {"codes": 1, "xdxr": 7, "finance": 7, "company": 30, "block": 1}
DAILY = (4, 9)


def last_wins(rows: DataFrame, keys: tuple[str, ...], order: Column) -> DataFrame:
    """One row a key: the one that order puts last."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = BAR_KEYS, order: Column | None = None) -> DataFrame:
    """existing with incoming rows in place of those with the same keys. Of incoming rows with one key the last
    by order counts; without an order the keys must be distinct."""
    fresh = last_wins(incoming, keys, order) if order is not None else incoming
    return existing.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh.select(*existing.columns))


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """existing with those incoming rows whose keys it lacks."""
    return existing.unionByName(incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))


def refresh_action(latest: Column, now: Column) -> Column:
    """all: nothing is stored. stored: it is up to date and trading is over. today: the running day's bar is
    stored and changes. since: whatever came after the latest day."""
    trading = in_trading_hours(now)
    return F.when(latest.isNull(), "all").when((latest >= last_complete_day(now)) & ~trading, "stored").when((latest == F.to_date(now)) & trading, "today").otherwise("since")


def calendar(index_bars: DataFrame) -> DataFrame:
    """Trading days, from the bars of an index."""
    return index_bars.select(F.to_date("ts").alias("date")).distinct()


def calendar_range(days: DataFrame, first: str, last: str, newest_first: bool = False) -> DataFrame:
    out = days.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return out.orderBy(F.col("date").desc() if newest_first else "date")


def newest_first(days: DataFrame) -> DataFrame:
    """date and nth, 1 for the newest day. Years are counted by themselves, so that no task sorts all days."""
    years = days.groupBy(F.year("date").alias("year")).count()
    later = years.alias("a").join(F.broadcast(years.alias("b")), F.col("a.year") < F.col("b.year"), "left").groupBy("a.year").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("later"))
    within = days.withColumns({"year": F.year("date"), "place": F.row_number().over(Window.partitionBy(F.year("date")).orderBy(F.desc("date")))})
    return within.join(F.broadcast(later), "year").select("date", (F.col("later") + F.col("place")).alias("nth"))


def calendar_year(days: DataFrame, year: int) -> DataFrame:
    return days.where(F.year("date") == year)


def next_days(days: DataFrame, dates: DataFrame) -> DataFrame:
    """The first trading day after each date (column date), null past the end. Both sides meet in one window
    per year and the start of the next, so no task holds the whole calendar."""
    both = days.select("date", F.lit(1).alias("open"), F.explode(F.array(F.year("date"), F.year("date") - 1)).alias("year")).union(dates.select("date", F.lit(0), F.year("date")))
    w = Window.partitionBy("year").orderBy(F.unix_date("date")).rangeBetween(1, Window.unboundedFollowing)
    return both.withColumn("next", F.min(F.when(F.col("open") == 1, F.col("date"))).over(w)).where("open = 0").select("date", "next")


def trading_rows(rows: DataFrame, days: DataFrame) -> DataFrame:
    """rows whose ts falls on a trading day."""
    return rows.withColumn("_d", F.to_date("ts")).join(days.select(F.col("date").alias("_d")), "_d", "left_semi").drop("_d")


def valid_entries(cache: DataFrame, now: Column) -> DataFrame:
    """Entries that have not expired; 0 never does. At its very second an entry is expired."""
    return cache.where((F.col("expires_at") == 0) | (F.col("expires_at") > now))


def put_entries(cache: DataFrame, entries: DataFrame, now: Column, ttl_days: dict[str, int] = TTL_DAYS) -> DataFrame:
    """cache with entries (bucket, key, value) that expire by their bucket's time; a bucket without one keeps
    them."""
    ttl = F.create_map(*[F.lit(x) for k, d in ttl_days.items() for x in (k, d * 86400)])
    fresh = entries.select("bucket", "key", "value", now.cast("long").alias("created_at"), F.coalesce(now.cast("long") + ttl[F.col("bucket")], F.lit(0)).cast("long").alias("expires_at"))
    return upsert(cache, fresh, ("bucket", "key"), F.col("value"))


def without_expired(cache: DataFrame, now: Column, bucket: str | None = None, key: str | None = None) -> DataFrame:
    """cache after a purge, and after the deletion of a key or of a whole bucket if named."""
    out = valid_entries(cache, now)
    if bucket is None:
        return out
    named = (F.col("bucket") == bucket) & ((F.col("key") == key) if key is not None else F.lit(True))
    return out.where(~named)


def cache_file(key: Column) -> Column:
    """The name that a file cache gives a key."""
    return F.substring(F.sha2(key, 256), 1, 32)


def typed_entries(cache: DataFrame, bucket: str, schema: str, now: Column) -> DataFrame:
    """key and value of a kind's valid entries, read from their JSON as the kind's schema."""
    own = valid_entries(cache, now).where(F.col("bucket") == bucket)
    return own.select("key", F.from_json("value", schema).alias("value"), "expires_at")


def recent(history: DataFrame, n: int) -> DataFrame:
    """The n codes viewed last, newest first; of one time, by code."""
    return history.orderBy(F.desc("analyzed_at"), "code").limit(n)


def unviewed(history: DataFrame, codes: DataFrame) -> DataFrame:
    """history without the codes."""
    return history.join(codes.select("code"), "code", "left_anti")


def viewed(history: DataFrame, codes: DataFrame) -> DataFrame:
    """history (code, analyzed_at) with codes' new times."""
    return upsert(history, codes, ("code",), F.col("analyzed_at"))
