"""Reports on offsets, snapshots and migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import lsn_to_long, readable_size, safe_offset
from millrace.operators.transforms import glob_filter, has_write_alias


def actor_summary(actors: DataFrame, roles: DataFrame, movies: DataFrame, genres: DataFrame, movie_directors: DataFrame, directors: DataFrame, size: int = 0) -> DataFrame:
    """(id, name, num_movies, avg_rank, unique_genres, uniq_directors, updated_at) of every actor with a role. Directors count by
    their names.

    Roles are combined to one row for each actor and movie; the movie's own tables are combined to one row each, with
    its genres and directors in sets, which are bounded by the movie. So the large table is shuffled by movie once and by actor once, before a row for each genre
    and director is made of it. A movie's rank weighs as often as the plain join of all tables would hold it. size: about the bytes of
    these rows; a task gets about 64 MB of them.
    """
    acted = roles.groupBy("actor_id", "movie_id").agg(F.count("*").alias("roles"), F.max("created_at").alias("updated"))
    # One id stands for all directors of a name: ids are counted, not texts.
    same = directors.groupBy("name").agg(F.min("id").alias("one"), F.collect_set("id").alias("ids")).select(F.explode("ids").alias("director_id"), "one")
    kinds = genres.groupBy("movie_id").agg(F.count("*").alias("g"), F.collect_set("genre").alias("genres"))
    led = movie_directors.join(same, "director_id", "left").groupBy("movie_id").agg(F.count("*").alias("d"), F.collect_set("one").alias("directors"))
    info = movies.select(F.col("id").alias("movie_id"), "rank", F.lit(True).alias("known")).join(kinds, "movie_id", "full").join(led, "movie_id", "full")
    facts = acted.join(info, "movie_id", "left").withColumn("w", F.col("roles") * F.coalesce("g", F.lit(1)) * F.coalesce("d", F.lit(1)))
    # Each movie gives a row of measures and a row for each genre and director.
    none = F.lit(None)
    row = lambda kind, genre, director: F.struct(F.lit(kind).alias("kind"), genre.cast(genres.schema["genre"].dataType).alias("genre"), director.cast(directors.schema["id"].dataType).alias("director"))
    parts = F.concat(
        F.array(row(0, none, none)), F.transform(F.coalesce("genres", F.array()), lambda x: row(1, x, none)), F.transform(F.coalesce("directors", F.array()), lambda x: row(2, none, x))
    )
    own_task = max(int(roles.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))
    dealt = facts.select("actor_id", "known", "rank", "w", "updated", "genres", "directors").repartition(own_task, "actor_id")
    each = dealt.select("actor_id", "known", "rank", "w", "updated", F.explode(parts).alias("p")).select("actor_id", "p.*", "known", "rank", "w", "updated")
    own = F.col("kind") == 0
    measured = F.when(own & F.col("rank").isNotNull(), F.col("w"))
    distinct = each.groupBy("actor_id", "kind", "genre", "director").agg(
        F.count(F.when(own & F.col("known"), 1)).alias("movies"), F.sum(F.col("rank") * measured).alias("total"), F.sum(measured).alias("weight"), F.max("updated").alias("updated")
    )
    summed = distinct.groupBy("actor_id").agg(
        F.sum("movies").alias("num_movies"), (F.sum("total") / F.sum("weight")).alias("avg_rank"), F.count(F.when(F.col("kind") == 1, 1)).alias("unique_genres"), F.count(F.when(F.col("kind") == 2, 1)).alias("uniq_directors"), F.max("updated").alias("updated_at")
    )
    names = actors.select(F.col("id").alias("actor_id"), F.concat_ws(" ", "first_name", "last_name").alias("name"))
    return names.join(summed, "actor_id").select(F.col("actor_id").alias("id"), "name", "num_movies", "avg_rank", "unique_genres", "uniq_directors", "updated_at")


def throughput(first: DataFrame, second: DataFrame, interval: int, avg_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(per group: messages, rate, bytes; totals) from two samples of group offsets.

    Offsets that aren't numbers are left out, as are negative deltas and groups without progress. Without a message size
    bytes are null.
    """
    keys = ["group", "topic", "partition"]
    pick = lambda df, name: df.select(*keys, safe_offset("current_offset").alias(name)).where(F.col(name).isNotNull())
    delta = pick(first, "o1").join(pick(second, "o2"), keys).withColumn("delta", F.col("o2") - F.col("o1")).where(F.col("delta") >= 0)
    size = F.lit(avg_bytes) if avg_bytes > 0 else F.lit(None).cast("int")
    by_group = delta.groupBy("group").agg(F.sum("delta").alias("messages")).where(F.col("messages") > 0)
    by_group = by_group.withColumn("rate", F.col("messages") / interval).withColumn("bytes_rate", F.col("rate") * size)
    total = by_group.agg(F.sum("messages").alias("messages"), F.sum("rate").alias("rate"), F.sum("bytes_rate").alias("bytes_rate"))
    return by_group, total


#: The severities of a snapshot comparison.
SAME, GROWING, WRITTEN, DIFFERENT, CHANGED, MISSING = 0, 1, 2, 3, 4, 5


def compare_snapshots(a: DataFrame, b: DataFrame, key: str = "index") -> DataFrame:
    """a's keys with the severity of what differs in b; the first case that holds counts.

    Columns of both: key, aliases, policy, has_write_alias, document_count; of a also document_count_delta.
    """
    right = b.select(F.col(key), F.lit(True).alias("_there"), *(F.col(c).alias(f"{c}_b") for c in ("aliases", "policy", "has_write_alias", "document_count")))
    joined = a.join(right, key, "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"{c}_b"))
    counts = differs("document_count")
    severity = (
        F.when(F.col("_there").isNull(), MISSING)
        .when(differs("aliases") | differs("policy") | differs("has_write_alias"), CHANGED)
        .when(counts & F.coalesce("document_count_delta", F.lit(False)), GROWING)
        .when(counts & F.coalesce("has_write_alias", F.lit(False)), WRITTEN)
        .when(counts, DIFFERENT)
        .otherwise(SAME)
    )
    return joined.select(key, "document_count", "document_count_b", severity.alias("severity"))


def severity_summary(report: DataFrame) -> DataFrame:
    """One row: the number of keys of each severity, all of them, and those with an issue."""
    count = lambda s: F.coalesce(F.sum((F.col("severity") == s).cast("long")), F.lit(0)).alias(f"severity_{s}")
    return report.agg(*(count(s) for s in range(6)), F.count("*").alias("total"), F.coalesce(F.sum((F.col("severity") > 0).cast("long")), F.lit(0)).alias("issues"))


def index_stats(first: DataFrame, second: DataFrame, patterns: list[str]) -> DataFrame:
    """Statistics of the indices that match, from two passes: both counts, whether they differ, and whether an alias is written."""
    chosen = glob_filter(first, "index", patterns)
    again = second.select("index", F.col("document_count").alias("document_count2"))
    out = chosen.join(again, "index", "left")
    return out.withColumn("document_count_delta", ~F.col("document_count").eqNullSafe(F.col("document_count2"))).withColumn("has_write_alias", has_write_alias("aliases"))


#: The messages of an offset-sync report.
SYNCED = "Target has offset sync."
EMPTY = "Source partition is empty therefore offset not expected to be synced."
EXPECTED = "Source partition not empty therefore offset expected to be synced."
NO_PARTITION = "Target consumer group missing the topic partition."
NO_GROUP = "Target missing the consumer group."


def offset_sync_report(source: DataFrame, target: DataFrame, include_ok: bool = False, include_inactive: bool = False) -> DataFrame:
    """Consumer groups of a source and a target cluster side by side, with a verdict and its message.

    source: group, group_state, topic, partition, source_offset, source_end (end of the source's log); target: group, topic, partition,
    target_offset (null: none), target_lag. By default only rows of active groups that aren't ok.
    """
    keys = ["group", "topic", "partition"]
    t = target.select(*keys, "target_offset", "target_lag", F.lit(True).alias("_row"))
    groups = target.select("group", F.lit(True).alias("_group")).distinct()
    j = source.join(t, keys, "full").join(groups, "group", "left")
    empty = F.coalesce("source_end", F.lit(0)) == 0
    by_source = F.when(empty, EMPTY).otherwise(EXPECTED)
    message = (
        F.when(F.col("target_offset").isNotNull(), SYNCED)
        .when(F.col("_group").isNull(), NO_GROUP)
        .when(F.col("_row").isNull(), F.concat(F.lit(NO_PARTITION + " "), by_source))
        .otherwise(by_source)
    )
    ok = F.col("target_offset").isNotNull() | (F.col("_group").isNotNull() & empty)
    lag = (F.col("source_offset") - F.col("target_offset")).alias("target_lag_to_source")
    out = j.select(*keys, "group_state", "source_offset", lag, "target_offset", "target_lag", ok.alias("is_ok"), message.alias("message"))
    if not include_ok:
        out = out.where(~F.col("is_ok"))
    return out if include_inactive else out.where(~F.col("group_state").isin("Empty", "Dead"))


def pivot_with_totals(df: DataFrame, rows: str, cols: list[str], values: list[str], total: str = "Total") -> DataFrame:
    """Counts of rows by a row label and a combined column label, 0 where there are none, with a total column and a total
    row. values: the column labels, joined by '/'."""
    label = F.concat_ws("/", *(F.col(c).cast("string") for c in cols))
    counted = df.select(F.col(rows).alias("_row"), label.alias("_label"))
    cells = [F.sum((F.col("_label") == v).cast("long")).alias(v) for v in values]
    out = counted.rollup("_row").agg(*cells, F.count("*").alias(total), F.grouping("_row").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, total).otherwise(F.col("_row")).alias(rows), *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values), total)


def offset_sync_summary(report: DataFrame, states: tuple[str, ...] = ("Empty", "Stable")) -> DataFrame:
    return pivot_with_totals(report, "message", ["group_state", "is_ok"], [f"{s}/{ok}" for s in states for ok in ("false", "true")])


def completeness(expected: DataFrame, received: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdict row, missing keys, extra keys) of two key sets."""
    e, r = expected.select(key).distinct(), received.select(key).distinct()
    missing, extra = e.join(r, key, "left_anti"), r.join(e, key, "left_anti")
    both = e.select(F.lit(1).alias("e"), F.lit(0).alias("r"), F.col(key)).unionByName(r.select(F.lit(0).alias("e"), F.lit(1).alias("r"), F.col(key)))
    per_key = both.groupBy(key).agg(F.max("e").alias("e"), F.max("r").alias("r"))
    total = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    verdict = per_key.agg(total(F.col("e"), "expected"), total(F.col("r"), "received"), total(F.col("e") > F.col("r"), "missing"), total(F.col("r") > F.col("e"), "extra"))
    return verdict.withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0)), missing, extra


def reconcile_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: both counts and whether they are equal."""
    sides = a.agg(F.count("*").alias("n")).withColumn("side", F.lit("a")).unionByName(b.agg(F.count("*").alias("n")).withColumn("side", F.lit("b")))
    out = sides.agg(F.max(F.when(F.col("side") == "a", F.col("n"))).alias("count_a"), F.max(F.when(F.col("side") == "b", F.col("n"))).alias("count_b"))
    return out.withColumn("equal", F.col("count_a") == F.col("count_b"))


#: Names that a patch never touches, by section.
UNTOUCHABLE_FLAGS = ("reserved", "static", "hidden")


def plan_patch(source: DataFrame, target: DataFrame, key: list[str], value: list[str], untouchable: list[str] = (), flags: tuple[str, ...] = UNTOUCHABLE_FLAGS, keep_member: tuple[str, str] | None = None) -> DataFrame:
    """What to do at the target for each source entry: add, replace, skip (equal) or untouchable.

    Entries that either side flags, or whose name (the last key column) is listed, are untouchable. keep_member: (array column, member that has to
    stay in it). Only the value columns are compared and written; others are never migrated.
    """
    name = key[-1]
    flag = lambda df: [F.col(f) for f in flags if f in df.columns]
    fixed = lambda df: F.coalesce(F.greatest(*flag(df), F.lit(False)), F.lit(False)) if flag(df) else F.lit(False)
    s = source.select(*key, *value, fixed(source).alias("_fs"))
    if keep_member:
        column, member = keep_member
        s = s.withColumn(column, F.array_union(F.coalesce(F.col(column), F.array().cast("array<string>")), F.array(F.lit(member))))
    t = target.select(*key, F.lit(True).alias("_there"), F.struct(*value).alias("_old"), fixed(target).alias("_ft"))
    j = s.join(t, key, "left")
    closed = F.col("_fs") | F.coalesce("_ft", F.lit(False)) | F.col(name).isin(*untouchable) if untouchable else F.col("_fs") | F.coalesce("_ft", F.lit(False))
    action = F.when(closed, "untouchable").when(F.col("_there").isNull(), "add").when(F.struct(*value).eqNullSafe(F.col("_old")), "skip").otherwise("replace")
    return j.select(*key, *value, action.alias("action"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Number of rows of each value, largest first."""
    return df.groupBy(col).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc(col))


def facet(hits: DataFrame, col: str, size: int = 10) -> DataFrame:
    """The largest buckets of a column over the hits of a query."""
    return value_counts(hits.where(F.col(col).isNotNull()), col).limit(size)


def slot_lag(df: DataFrame, current: Column | str) -> DataFrame:
    """Bytes that each replication slot is behind the current log position."""
    now = lsn_to_long(current)
    return df.groupBy("slot_name").agg(F.sum(now - lsn_to_long("restart_lsn")).alias("lag"))


def policy_counts(df: DataFrame, policy: str = "policy") -> DataFrame:
    """Indices per policy; those without one are counted under null and flagged."""
    return df.groupBy(policy).agg(F.count("*").alias("indices")).withColumn("unassigned", F.col(policy).isNull())


def trig_load(series: DataFrame, col: str = "id") -> DataFrame:
    """Sum of sin + cos of degrees."""
    return series.agg(F.sum(F.sin(F.radians(col)) + F.cos(F.radians(col))).alias("total"))


def table_sizes(files: DataFrame) -> DataFrame:
    """Per table: compressed and raw bytes, ratio, rows and parts, largest first. files: table, part, compressed, raw, rows."""
    out = files.groupBy("table").agg(F.sum("compressed").alias("compressed_bytes"), F.sum("raw").alias("raw_bytes"), F.sum("rows").alias("rows"), F.count("*").alias("parts"))
    return out.select("table", "compressed_bytes", readable_size("compressed_bytes").alias("compressed"), readable_size("raw_bytes").alias("uncompressed"), F.round(F.col("raw_bytes") / F.col("compressed_bytes"), 2).alias("ratio"), "rows", "parts").orderBy(F.desc("compressed_bytes"))


def nullable_report(df: DataFrame, name: str) -> DataFrame:
    """Nulls of each column of a table, in one pass."""
    nulls = df.agg(*(F.coalesce(F.sum(F.col(f"`{c}`").isNull().cast("long")), F.lit(0)).alias(c) for c in df.columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns)))
    return nulls.select(F.lit(name).alias("table"), pairs.alias("x")).select("table", "x.*")
