"""Change data capture: envelopes, typed rows, latest versions, and applying changes to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalars
from millrace.operators.transforms import flatten, unwrap_payload

#: Operations: create, snapshot read, update, delete.
OPS = ("c", "r", "u", "d")


def envelope_schema(row: T.StructType) -> T.StructType:
    source = T.StructType([T.StructField("schema", T.StringType()), T.StructField("table", T.StringType()), T.StructField("sequence", T.StringType()), T.StructField("lsn", T.LongType())])
    return T.StructType([T.StructField("before", row), T.StructField("after", row), T.StructField("source", source), T.StructField("op", T.StringType()), T.StructField("ts_ms", T.LongType())])


def read_cdc(df: DataFrame, row: T.StructType, nested: bool = True, value: str = "value") -> DataFrame:
    """Decodes JSON envelopes, with or without a payload wrapper; nested=False gives dotted columns. Tombstones are dropped."""
    text = unwrap_payload(df.withColumn(value, F.col(value).cast("string")).where(F.col(value).isNotNull()), value)
    kept = [c for c in df.columns if c != value]
    out = text.withColumn("_e", F.from_json(value, envelope_schema(row))).where(F.col("_e.op").isNotNull()).select(*kept, "_e.*")
    return out if nested else flatten(out)


def cdc_ops(df: DataFrame, ops: tuple[str, ...] = OPS) -> DataFrame:
    return df.where(F.col("op").isin(*ops))


def cdc_image(df: DataFrame, cols: list[str], before: str = "before", after: str = "after") -> list[Column]:
    """The row that a change is about: before a deletion, after any other change."""
    return [F.when(F.col("op") == "d", F.col(f"{before}.{c}")).otherwise(F.col(f"{after}.{c}")).alias(c) for c in cols]


def latest_per_key(df: DataFrame, keys: list[str], version: list[str] | str, deleted: Column | str | None = None) -> DataFrame:
    """The row of the highest version of each key; keys whose last row is deleted are left out.

    An aggregation with map-side combine, so a key with many versions doesn't fill a task.
    """
    versions = [version] if isinstance(version, str) else version
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*versions)).alias("_r"))
    out = latest.select("_r.*")
    if deleted is None:
        return out
    return out.where(~F.coalesce(F.col(deleted) if isinstance(deleted, str) else deleted, F.lit(False)))


def cdc_view(changes: DataFrame, region: int, keys: list[str], cols: list[str], version: list[str]) -> DataFrame:
    """The current rows of one region from a change history: its changes only, last version, deletions gone."""
    rows = cdc_ops(changes).select(*cdc_image(changes, cols), "op", *version).where(F.col("region") == region)
    return latest_per_key(rows, keys, version, F.col("op") == "d").select(*cols)


#: Field kinds of a cast configuration and the functions that turn wire values into typed ones.
CASTS = {
    "date_fields": scalars.from_days,
    "time_fields": scalars.time_of_day,
    "datetime_milli_fields": scalars.from_millis,
    "datetime_micro_fields": scalars.from_micros,
    "timestamp_fields": scalars.parse_iso,
    "binary_fields": F.unbase64,
    "set_fields": lambda c: F.split(c, ","),
}


def cast_cdc(df: DataFrame, config: dict[str, list[str]], prefix: str = "") -> DataFrame:
    """Casts columns by their kind in the table's configuration; names without a column are ignored."""
    have = set(df.columns)
    new = {}
    for kind, cast in CASTS.items():
        for name in config.get(kind, []):
            if f"{prefix}{name}" in have:
                new[f"{prefix}{name}"] = cast(F.col(f"`{prefix}{name}`"))
    return df.withColumns(new)


def key_events(changes: DataFrame, cols: list[str], keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """(the keys, _row, _version): what a set of changes (before struct, after struct, order columns) does to each key; _row is null for a deletion.

    Before and after: update; no before: insert; no after: delete; neither: nothing. A change of the key deletes the
    old row and adds the new one. Without keys a row is identified by all its columns. Several changes of
    a key end with the last one. _version is its place in the order, so that later sets can be told from earlier ones.
    """
    keys = keys or cols
    order = order or ["ts_ms"]
    before, after = F.col("before"), F.col("after")
    row = F.struct(*(after[c].alias(c) for c in cols))
    gone = F.when(before.isNotNull(), F.struct(*(before[k].alias(k) for k in keys)))
    come = F.when(after.isNotNull(), F.struct(*(after[k].alias(k) for k in keys)))
    kind = T.StructType([changes.schema["after"].dataType[c] for c in cols])
    event = lambda key, row, step: F.struct(key.alias("key"), row.alias("row"), F.lit(step).alias("step"))
    events = F.filter(F.array(event(gone, F.lit(None).cast(kind), 0), event(come, row, 1)), lambda e: e["key"].isNotNull())
    steps = changes.where(before.isNotNull() | after.isNotNull()).select(*order, F.explode(events).alias("e"))
    version = F.struct(*order, F.col("e.step").alias("step"))
    return steps.groupBy(*(F.col(f"e.key.{k}").alias(k) for k in keys)).agg(F.max_by("e.row", version).alias("_row"), F.max(version).alias("_version"))


def apply_cdc(target: DataFrame, changes: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The target table after the changes (see key_events), which all come after what the target holds. Applying a batch
    twice gives the same table. Each change gives at most two key events; both tables are shuffled once by key."""
    cols = target.columns
    keys = keys or cols
    touched = key_events(changes, cols, keys, order).select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_row")
    on = [target[k].eqNullSafe(touched[f"_k_{k}"]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    kept = target.join(touched, condition, "left_anti").select(*cols)
    added = touched.where(F.col("_row").isNotNull()).select(*(F.col(f"_row.{c}").alias(c) for c in cols))
    return kept.unionByName(added)


def first_versions(table: DataFrame, keys: list[str], events: DataFrame) -> DataFrame:
    """The rows of a table from before all changes as key events, with a version that is older than any of events'."""
    row = F.struct(*table.columns).cast(events.schema["_row"].dataType)
    oldest = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema["_version"].dataType.fields))
    return table.select(*keys, row.alias("_row"), oldest.alias("_version"))


def merge_versions(state: DataFrame | None, events: DataFrame, keys: list[str]) -> DataFrame:
    """The newest key event of each key. Deletions stay as rows, so that an older change that comes late doesn't bring a key back."""
    both = events if state is None else state.unionByName(events)
    return both.groupBy(*keys).agg(F.max_by("_row", "_version").alias("_row"), F.max("_version").alias("_version"))


def current_rows(state: DataFrame) -> DataFrame:
    """The table that the newest key events describe."""
    return state.where(F.col("_row").isNotNull()).select("_row.*")
