"""Groups of addresses, ``(ip, leader)``, and the sessions of their members.

What a group holds stays rows, one per session or member: no group, however large, becomes one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.operators.scratch import kept


def sizes(groups: DataFrame) -> DataFrame:
    """``(leader, members)``, the leader included."""
    return groups.groupBy("leader").agg(F.count("*").alias("members"))


def loners(groups: DataFrame) -> DataFrame:
    """``(ip)`` of addresses alone in their group."""
    return groups.join(sizes(groups).where("members = 1"), "leader", "left_semi").select("ip")


def grouped(groups: DataFrame) -> DataFrame:
    """``(ip, leader)`` of groups of two and more."""
    return groups.join(sizes(groups).where("members > 1"), "leader", "left_semi").select("ip", "leader")


def sessions_of(sessions: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Sessions, with their ``ip`` and ``cluster``, that are retained edges, with the leader of their group.

    Sessions of addresses without a group or of pruned behaviours are left out; null addresses or clusters too.
    """
    return sessions.join(edges.select("ip", "cluster").distinct(), ["ip", "cluster"], "left_semi").join(groups.select("ip", "leader"), "ip")


def retained(sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """Sessions of the behaviours that ``edges`` hold.

    Of addresses that ``edges`` hold as well, these are just the retained sessions, if ``edges`` are what ``prune`` leaves of the sessions' own: it takes out
    whole behaviours and whole addresses. So neither sessions nor edges are shuffled by both; behaviours are written first, as they may be few.
    """
    return sessions.join(kept(edges.select("cluster").distinct()), "cluster", "left_semi")


def rollup(found: DataFrame) -> DataFrame:
    """One row per group of ``sessions_of``: sessions and distinct addresses, clusters, protocols and countries, first and last time."""
    distinct = [F.countDistinct(c).alias(n) for c, n in (("ip", "ips"), ("cluster", "clusters"), ("proto", "protocols"), ("country", "countries"))]
    return found.groupBy("leader").agg(F.count("*").alias("sessions"), *distinct, F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def size_histograms(rolled: DataFrame) -> DataFrame:
    """``(kind, size, groups)``: how many groups have so many addresses or clusters."""
    each = rolled.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("size")) for c in ("ips", "clusters")))).alias("x"))
    return each.groupBy("x.kind", "x.size").agg(F.count("*").alias("groups"))


def statistics(found: DataFrame) -> DataFrame:
    """One row per group of ``sessions_of``: distinct countries, protocols and clusters in order, how many, sessions, and the country of most addresses (ties by name).

    An unknown country is one called None, in the set, the numbers and as the main one.  Sets hold what is distinct: countries, protocols and
    behaviours are few beside sessions and addresses, which are counted.
    """
    found = found.withColumn("country", F.coalesce("country", F.lit("None")))
    sets = [F.array_sort(F.collect_set(c)).alias(f"{n}_set") for c, n in (("country", "country"), ("proto", "proto"), ("cluster", "cluster"))]
    one = found.groupBy("leader").agg(F.count("*").alias("sessions"), F.countDistinct("ip").alias("ip_num"), *sets)
    sized = one.select("*", *(F.size(f"{n}_set").cast("long").alias(f"unique_{m}_num") for n, m in (("country", "country"), ("proto", "protocols"), ("cluster", "cluster"))))
    by_country = found.select("leader", "ip", "country").distinct().groupBy("leader", "country").agg(F.count("*").alias("n"))
    main = by_country.groupBy("leader").agg(F.min_by("country", F.struct(-F.col("n"), "country")).alias("main_country"))
    return sized.join(main, "leader", "left")


def shares(found: DataFrame, column: str) -> DataFrame:
    """``(leader, value, n, portion)``: addresses of each country, or sessions of any other column, in each group, and their share of the group's.

    Null values are one called None.  What the reference figures keep in a map for each group are rows here.
    """
    rows = found.select("leader", "ip", F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value"))
    counted = (rows.distinct() if column == "country" else rows).groupBy("leader", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("portion", F.col("n") / F.sum("n").over(Window.partitionBy("leader")))


def in_parts(rows: DataFrame, keys: list[str], name: str, value: str, most: int = 100_000) -> DataFrame:
    """``(*keys, part, entries)``: maps from ``name`` to its list of ``value`` for each key, in numbered parts of at most ``most`` values.

    All values of a name are in one part as far as they fit; lists are in order.  A part is made of some names by their hash, names with more values than
    fit are dealt by name and value, so no part waits for a whole group.  Rows with a null name are left out, as maps can't hold them; null values stay.
    """
    known = rows.where(F.col(name).isNotNull()).select(*keys, name, value)
    by_name = known.groupBy(*keys, name).agg(F.count("*").alias("_of_name"))
    totals = by_name.groupBy(*keys).agg(F.sum("_of_name").alias("_of_key"))
    same = lambda left, columns: [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    found = known.alias("l").join(by_name.alias("r"), same("l", [*keys, name])).select("l.*", "r._of_name")
    found = found.alias("l").join(totals.alias("r"), same("l", keys)).select("l.*", "r._of_key")
    # Twice as many shares as would do, so that most shares fit one part.
    share = F.ceil(F.col("_of_key") * 2 / most)
    salt = F.pmod(F.when(F.col("_of_name") > most, F.xxhash64(name, value)).otherwise(F.xxhash64(name)), share)
    place = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(name, value)) - 1
    parts = found.withColumn("_salt", salt).withColumn("_sub", F.floor(place / most)).withColumn("part", F.col("_salt") * (1 << 32) + F.col("_sub"))
    lists = parts.groupBy(*keys, "part", name).agg(F.sort_array(F.collect_list(value)).alias("_values"), (F.count("*") - F.count(value)).alias("_nulls"))
    padded = F.concat(F.array_repeat(F.lit(None).cast(rows.schema[value].dataType), F.col("_nulls").cast("int")), "_values")
    return lists.groupBy(*keys, "part").agg(F.map_from_entries(F.collect_list(F.struct(F.col(name), padded))).alias("entries"))


def from_parts(parts: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """The rows of ``in_parts`` again."""
    return parts.select(*keys, F.explode("entries").alias(name, "_values")).select(*keys, name, F.explode("_values").alias(value))


def case_sessions(cases: DataFrame, sessions: DataFrame) -> DataFrame:
    """``(date, proto, session_time, days_on, ...)``: the sessions of listed cases ``(date, proto, session_time)``.

    A case is looked up among its day's sessions of its protocol (columns ``date, proto, session_time`` and more); what isn't found there, on the
    next day.  Cases found on neither day are left out; a case listed twice counts once; of several sessions at one time all are given.
    """
    more = [c for c in sessions.columns if c not in ("date", "proto", "session_time")]
    keys = ["date", "proto", "session_time"]
    wanted = cases.select(*keys).distinct()
    today = wanted.join(sessions.select(*keys, *more), keys).select(*keys, F.lit(0).alias("days_on"), *more)
    left = wanted.join(sessions.select(*keys).distinct(), keys, "left_anti").withColumn("_next", F.date_add("date", 1))
    tomorrow = left.join(sessions.select(F.col("date").alias("_next"), "proto", "session_time", *more), ["_next", "proto", "session_time"])
    return today.unionByName(tomorrow.select(*keys, F.lit(1).alias("days_on"), *more))


def ordered_lists(found: DataFrame, keys: list[str], columns: list[str], span: float = 3600.0) -> DataFrame:
    """``(*keys, span, times, *columns)``: lists of times and of each column in the order of time (ties by the column's own value), of equal length.

    A list holds one span of time, an hour unless said otherwise, so that none grows with all days; in the order of spans they are the whole.  Null values stay in their places.
    """
    lists = [F.transform(F.array_sort(F.collect_list(F.struct(F.col("time"), F.col(c).alias("_value")))), lambda x: x["_value"]).alias(c) for c in columns]
    timed = found.where("time is not null").withColumn("span", F.floor(F.col("time") / span))
    return timed.groupBy(*keys, "span").agg(F.sort_array(F.collect_list("time")).alias("times"), *lists)


def members(sessions: DataFrame) -> DataFrame:
    """``(cluster, ip, country, sessions, first_time, last_time)``: who takes part in each cluster, from where and when."""
    return sessions.groupBy("cluster", "ip", "country").agg(F.count("*").alias("sessions"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def manifest(sessions: DataFrame) -> DataFrame:
    """``(proto, rank, cluster, sessions, name)``: clusters of each protocol by size (ties by name) and what their list of times is called."""
    counted = sessions.groupBy("proto", "cluster").agg(F.count("*").alias("sessions"))
    rank = F.row_number().over(Window.partitionBy("proto").orderBy(F.desc("sessions"), "cluster"))
    return counted.withColumn("rank", rank).withColumn("name", F.concat(F.lit("timelist_"), "proto", F.lit("_large#"), F.col("rank").cast("string"), F.lit("_clusterID#"), "cluster"))


def times_of(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(cluster, time)`` of the sessions of wanted clusters (column ``cluster``), one row each."""
    return sessions.join(wanted.select("cluster").distinct(), "cluster", "left_semi").select("cluster", "time")


def with_intention(rows: DataFrame, known: DataFrame, key: str = "cluster", default: str = "probing") -> DataFrame:
    """Rows with the intention of their ``key`` from ``known``, ``(intention, clusters array)``; others have the default.

    Of several intentions of one cluster the first in order of text counts, so no row is doubled.
    """
    one = known.select("intention", F.explode("clusters").alias(key)).groupBy(key).agg(F.min("intention").alias("intention"))
    return rows.join(one, key, "left").withColumn("intention", F.coalesce("intention", F.lit(default)))


def with_total(edges: DataFrame, name: str = "stat") -> DataFrame:
    """``(cluster, ips)``: addresses of each behaviour, and one row of all edges under ``name``."""
    counted = edges.select("ip", "cluster").distinct().rollup("cluster").agg(F.grouping("cluster").alias("_all"), F.count("*").alias("ips"))
    return counted.select(F.when(F.col("_all") == 1, F.lit(name)).otherwise(F.col("cluster")).alias("cluster"), "ips")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order, as when later days overwrite earlier ones; nulls come first."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def hours_of_largest(sessions: DataFrame, first: int = 1, last: int = 10) -> DataFrame:
    """``(rank, cluster, hour, n)``: sessions of the clusters of some ranks by size in every hour since the epoch, zeros included.

    Hours go from the one before the first session of all to the last.  Ties of size go by name.
    """
    binned = sessions.groupBy("cluster", F.floor(F.col("time") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    largest = binned.groupBy("cluster").agg(F.sum("n").alias("size")).orderBy(F.desc("size"), "cluster").limit(last)
    ranked = largest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "cluster"))).where(F.col("rank") >= first).select("cluster", "rank")
    span = binned.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a is not null").select(F.explode(F.sequence(F.col("a") - 1, F.col("b"))).alias("hour"))
    return span.crossJoin(ranked).join(binned, ["cluster", "hour"], "left").select("rank", "cluster", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def alias(name: Column, names: dict[str, str]) -> Column:
    """A name's alias; names without one stay, nulls too."""
    if not names:
        return name
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[name], name)


def month_day(day: Column, month: str = "01") -> Column:
    """``MMdd`` of a day of one or two figures in the given month; longer texts stay."""
    return F.when(F.length(day) <= 2, F.concat(F.lit(month), F.lpad(day, 2, "0"))).otherwise(day)
