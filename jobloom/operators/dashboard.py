"""Derived figures of the dashboard, as operators on the summary frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom import rules as R


def half_up(c: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(c + 0.5)


def tiers(c: Column, steps: Sequence[tuple], floor) -> Column:
    out = None
    for least, value in steps:
        hit = c >= least
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(floor)


# ---- trends, sources, places ------------------------------------------------------------

def filter_trends(trends: DataFrame, category: str = "all", text: str = "") -> DataFrame:
    out = trends if category == "all" else trends.filter(F.col("category") == category)
    return out.filter(F.contains(F.lower("name"), F.lit(text.lower()))) if text else out


def source_share(coverage: DataFrame, total: DataFrame) -> DataFrame:
    """Share of every source; a source without merged postings shows its raw ones."""
    count = F.when(F.col("unified_count") != 0, F.col("unified_count")).otherwise(F.col("raw_count"))
    share = half_up(F.col("postings") / F.when(F.col("total") > 0, F.col("total")).otherwise(1) * 1000) / 10
    return (coverage.withColumn("postings", count).join(F.broadcast(total.select("total")), F.lit(True))  # one-row side
            .select("source", "postings", share.alias("percentage")))


def whole_source_share(coverage: DataFrame, total: DataFrame) -> DataFrame:
    """Merged postings of every source and their share of all in whole percent; 0 where there are none."""
    share = F.when(F.col("total") > 0, half_up(F.col("unified_count") / F.col("total") * 100)).otherwise(0)
    return (coverage.join(F.broadcast(total.select("total")), F.lit(True))  # one-row side
            .select("source", F.col("unified_count").alias("postings"), share.cast("bigint").alias("percentage")))


def heat_tier(percent: str | Column) -> Column:
    return tiers(F.col(percent) if isinstance(percent, str) else percent, R.HEAT_TIERS, R.HEAT_FLOOR)


def size_tier(count: str | Column) -> Column:
    return tiers(F.col(count) if isinstance(count, str) else count, R.SIZE_TIERS, R.SIZE_FLOOR).cast("bigint")


CATCH_ALL = (R.REMOTE_LOCATION, R.UNKNOWN_LOCATION)


def top_provinces(provinces: DataFrame, n: int = 10, without: Sequence[str] = CATCH_ALL) -> DataFrame:
    return provinces.filter(~F.col("province").isin(list(without))).orderBy(F.desc("postings"), "province").limit(n)


def geo_nodes(spark: SparkSession, rows=R.GEO_NODES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows],
                                 "name string, region string, lat double, lng double, aliases array<string>")


def geo_enrich(nodes: DataFrame, provinces: DataFrame) -> DataFrame:
    """Every map node with its province's figures, found by name, else by its first alias
    that is known, else zeros."""
    names = F.concat(F.array(F.lower("name")), F.coalesce("aliases", F.array().cast("array<string>")))
    keyed = nodes.select("name", F.posexplode(names).alias("_at", "_key"))
    figures = provinces.groupBy(F.lower(F.trim("province")).alias("_key")).agg(
        F.sum("postings").alias("postings"), F.sum("companies").alias("companies"), F.sum("percentage").alias("percentage"))
    hit = keyed.join(figures, "_key").groupBy("name").agg(
        F.min_by(F.struct("postings", "companies", "percentage"), "_at").alias("_f"))
    zero = lambda c, t: F.coalesce(F.col(f"_f.{c}"), F.lit(0)).cast(t).alias(c)
    return nodes.join(hit, "name", "left").select(
        "name", "region", "lat", "lng", zero("postings", "bigint"), zero("companies", "bigint"), zero("percentage", "double"))


def region_filter(nodes: DataFrame, region: str = "all") -> DataFrame:
    return nodes if region == "all" else nodes.filter(F.col("region") == region)


def region_rollup(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("region").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("postings").alias("postings"), F.sum("companies").alias("companies"))


# ---- roles ------------------------------------------------------------------------------

def role_table(df: DataFrame, role: Column, pay: Column, tech: Column | None = None) -> DataFrame:
    """Least, average and greatest pay and the number of postings per role.

    ``tech`` collects the role's distinct technologies, a bounded vocabulary.
    """
    figures = [F.min("pay").alias("min_pay"), F.round(F.avg("pay"), 4).alias("avg_pay"), F.max("pay").alias("max_pay"),
               F.count("pay").alias("postings")]
    base = df.select(role.alias("role"), pay.alias("pay"), *([tech.alias("tech")] if tech is not None else []))
    out = base.groupBy("role").agg(*figures)
    if tech is None:
        return out
    techs = base.filter(F.col("tech").isNotNull()).select("role", "tech").distinct().groupBy("role").agg(
        F.array_sort(F.collect_list("tech")).alias("techs"))
    return out.join(techs, "role", "left")


def _one_decimal(c: Column) -> Column:
    return F.round(c, 1)


def role_bands(roles: DataFrame) -> DataFrame:
    """Pay bands of the four seniorities from a role's least, average and greatest pay."""
    low, avg, high = F.col("min_pay"), F.col("avg_pay"), F.col("max_pay")
    pay = {"min": low, "avg": avg, "max": high}
    edges = {band: [half_up(pay[of] * factor) for of, factor in pair] for band, pair in R.BAND_EDGES.items()}
    out = roles.withColumns({f"{b}_{e}": v for b, pair in edges.items() for e, v in zip(("min", "max"), pair)})
    mean = lambda b: _one_decimal((F.col(f"{b}_min") + F.col(f"{b}_max")) / 2)
    return out.withColumns({"fresher_avg": mean("fresher"), "middle_avg": _one_decimal(avg),
                            "senior_avg": mean("senior"), "lead_avg": mean("lead")})


def role_bands_overview(roles: DataFrame) -> DataFrame:
    """The overview's variant: another lead band and averages straight from the figures."""
    low, avg, high = F.col("min_pay"), F.col("avg_pay"), F.col("max_pay")
    values = {
        "fresher_min": low * 0.7, "fresher_max": low * 1.1, "fresher_avg": low * 0.9,
        "middle_min": avg * 0.75, "middle_max": avg * 1.15, "middle_avg": avg * 0.95,
        "senior_min": avg * 1.15, "senior_max": high * 0.95, "senior_avg": high * 0.7,
        "lead_min": high * 0.9, "lead_max": high * 1.3, "lead_avg": high * 1.1}
    return roles.select("role", *[half_up(v).alias(k) for k, v in values.items()])


def role_level_split(roles: DataFrame, levels: Sequence[str]) -> DataFrame:
    """A role's postings spread over the five levels, with the band of each level."""
    bands = role_bands(roles)
    total = F.when(F.coalesce(F.col("postings"), F.lit(0)) == 0, R.ROLE_COUNT_FOR_LEVELS).otherwise(F.col("postings"))
    avg = F.col("avg_pay")
    limits = [("fresher_min", "fresher_max", "fresher_avg"), None, ("middle_min", "middle_max", "middle_avg"),
              ("senior_min", "senior_max", "senior_avg"), ("lead_min", "lead_max", "lead_avg")]
    cells = []
    for i, (level, (share, least)) in enumerate(zip(levels, R.LEVEL_SPLIT)):
        lo, hi, mean = ((half_up(avg * 0.6), half_up(avg * 0.85), half_up(avg * 0.72).cast("double")) if limits[i] is None
                        else tuple(F.col(x) for x in limits[i]))
        cells.append(F.struct(
            F.lit(level).alias("level"), F.greatest(F.lit(least), half_up(total * share)).cast("bigint").alias("postings"),
            lo.alias("band_min"), hi.alias("band_max"), mean.alias("band_avg")))
    return bands.select("role", F.inline(F.array(*cells)))


def city_scale(roles: DataFrame, cities=R.CITY_SPLIT) -> DataFrame:
    """A role's pay and postings per city, by the city's multiplier and share."""
    total = F.when(F.coalesce(F.col("postings"), F.lit(0)) == 0, R.ROLE_COUNT_FOR_CITIES).otherwise(F.col("postings"))
    cells = [F.struct(
        F.lit(city).alias("city"), (half_up(F.col("avg_pay") * factor * 10) / 10).alias("avg_pay"),
        half_up(F.col("min_pay") * factor).alias("min_pay"), half_up(F.col("max_pay") * factor).alias("max_pay"),
        F.greatest(F.lit(1), half_up(total * share)).cast("bigint").alias("postings")) for city, factor, share in cities]
    return roles.select("role", F.inline(F.array(*cells)))


def search_roles(roles: DataFrame, text: str) -> DataFrame:
    """Roles whose name, or the name of one of whose technologies, contains the text."""
    q = text.lower().strip()
    if not q:
        return roles
    hit = lambda c: F.contains(F.lower(c), F.lit(q))
    named = hit(F.col("role"))
    if "short_name" in roles.columns:
        named = named | hit(F.col("short_name"))
    return roles.filter(named | F.coalesce(F.exists("techs", hit), F.lit(False)))


def percent_of_max(df: DataFrame, value: str, per: Sequence[str] = (), floor: float = R.BAR_FLOOR) -> DataFrame:
    """Bar length of every value against the greatest of its group, or of all rows.

    The greatest is aggregated and joined back, so no group is sorted in one task.
    """
    if per:
        top = df.groupBy(*per).agg(F.max(value).alias("_top"))
        joined = df.join(top, list(per))
    else:
        joined = df.join(F.broadcast(df.agg(F.max(value).alias("_top"))), F.lit(True))  # one-row side
    bar = half_up(F.col(value) / F.greatest(F.col("_top"), F.lit(floor)) * 100)
    return joined.withColumn("bar", F.least(F.lit(100), bar).cast("bigint")).drop("_top")


def percent_of_fixed(value: str, most: float = R.LEVEL_BAR_MAX) -> Column:
    return F.least(F.lit(100), half_up(F.col(value) / most * 100)).cast("bigint")


# ---- tracked postings -------------------------------------------------------------------

TRACKER_KEYS = ["user_id", "job_url"]


def tracker_aggregates() -> list[Column]:
    """Aggregates that fold tracker events into the latest state.

    Only extremes by time, so partial results combine in any order and the same fold runs
    on a batch and on a stream.
    """
    at = F.struct("ts", "event_id")
    removed = F.col("status") == R.TRACKER_REMOVED
    noted = F.coalesce(F.col("notes"), F.lit("")) != ""
    return [
        F.max_by("status", at).alias("status"),
        F.max(F.when(removed, at)).alias("_removed"),
        F.max(F.when(noted & ~removed, F.struct("ts", "event_id", "notes"))).alias("_note"),
    ]


def tracker_state(events: DataFrame) -> DataFrame:
    """Latest state per user and posting: last status, last non-empty note and the time of
    the first save since the posting was last removed."""
    folded = events.groupBy(*TRACKER_KEYS).agg(*tracker_aggregates())
    live = folded.filter(F.col("status") != R.TRACKER_REMOVED)
    at = F.struct("e.ts", "e.event_id")
    since = (
        events.alias("e").join(live.alias("f"), TRACKER_KEYS)
        .filter(F.col("f._removed").isNull() | (at > F.col("f._removed")))
        .groupBy(*TRACKER_KEYS).agg(F.min("e.ts").alias("saved_at")))
    current = F.col("_removed").isNull() | (F.struct("_note.ts", "_note.event_id") > F.col("_removed"))
    return live.join(since, TRACKER_KEYS).select(
        *TRACKER_KEYS, "status", "saved_at", F.coalesce(F.when(current, F.col("_note.notes")), F.lit("")).alias("notes"))


def tracker_fold(events: DataFrame) -> DataFrame:
    """The same state from one aggregation, for streams: every key has a row, a removed posting too.

    The times of a key's events are kept, as a late removal moves the time of the first save; they are
    one user's changes of one posting.
    """
    folded = events.groupBy(*TRACKER_KEYS).agg(*tracker_aggregates(), F.collect_set(F.struct("ts", "event_id")).alias("_times"))
    since = F.filter("_times", lambda t: F.col("_removed").isNull() | (t > F.col("_removed")))
    current = F.col("_removed").isNull() | (F.struct("_note.ts", "_note.event_id") > F.col("_removed"))
    return folded.select(*TRACKER_KEYS, "status", F.array_min(since)["ts"].alias("saved_at"),
                         F.coalesce(F.when(current, F.col("_note.notes")), F.lit("")).alias("notes"))


def newest_saved(state: DataFrame, n: int) -> DataFrame:
    return state.orderBy(F.desc("saved_at"), *TRACKER_KEYS).limit(n)


def tracker_counts(state: DataFrame, states: Sequence[str] = R.TRACKER_STATES) -> DataFrame:
    """Tracked postings in all and per state, every state shown."""
    one = state.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    cells = [F.struct(F.lit(s).alias("status"), F.col(s).alias("postings")) for s in ("all", *states)]
    return one.select(F.inline(F.array(*cells)))


def tracker_filter(state: DataFrame, status: str = "all") -> DataFrame:
    return state if status == "all" else state.filter(F.col("status") == status)


