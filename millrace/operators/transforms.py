"""Projections, filters and routing of log records."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def expand(df: DataFrame, struct: str) -> DataFrame:
    """The fields of a struct as columns."""
    return df.select(f"{struct}.*")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> Iterable[Column]:
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))

    return df.select(*leaves(df.schema, ()))


def last(df: DataFrame, ts: str, interval: str, now: Column | None = None) -> DataFrame:
    """Rows of the last interval before now."""
    now = F.current_timestamp() if now is None else now
    return df.where(F.col(ts) > now - F.expr(f"interval {interval}"))


def select_topics(df: DataFrame, include: list[str], exclude: list[str], col: str = "topic") -> DataFrame:
    """Rows whose topic matches one of the include patterns as a whole and none of the exclude patterns."""
    whole = lambda patterns: "^(?:" + "|".join(patterns) + ")$"
    out = df.where(F.col(col).rlike(whole(include)))
    return out.where(~F.col(col).rlike(whole(exclude))) if exclude else out


def glob_regex(pattern: str) -> str:
    """A shell wildcard (*, ?, [..], [!..]) as an anchored regular expression."""
    out = []
    for token in re.findall(r"\[!?\]?[^\]]*\]|.", pattern, re.S):
        if token == "*":
            out.append(".*")
        elif token == "?":
            out.append(".")
        elif len(token) > 1:
            body = token[1:-1].replace("\\", "\\\\")
            out.append("[^" + body[1:] + "]" if body.startswith("!") else "[" + body + "]")
        else:
            out.append(re.escape(token))
    return "(?s)^" + "".join(out) + "$"


def glob_filter(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Rows whose name matches any of the wildcards, each row once."""
    if not patterns:
        return df.where(F.lit(False))
    return df.where(F.col(col).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)))


def has_public_route(components: str) -> Column:
    """Whether any component has the public route; null where there are no components."""
    return F.exists(F.col(components), lambda c: c["route"] == "public")


def services_with_public_route(df: DataFrame, components: str = "components") -> DataFrame:
    return df.where(F.coalesce(has_public_route(components), F.lit(False)))


def has_write_alias(aliases: str) -> Column:
    """Whether any alias in a map of alias to settings is the write index."""
    return F.coalesce(F.exists(F.map_values(F.col(aliases)), lambda a: F.coalesce(a["is_write_index"], F.lit(False))), F.lit(False))


def unsupported_versions(df: DataFrame, col: str = "version") -> DataFrame:
    """Rows whose first three version digits are over 136 and under 700, or over 710."""
    v = F.substring(col, 1, 3).try_cast("int")
    return df.where(((v > 136) & (v < 700)) | (v > 710))


def track(df: DataFrame, col: str, keywords: list[str]) -> DataFrame:
    """Rows whose text holds any of the keywords, whatever their case."""
    return df.where(F.col(col).rlike("(?i)" + "|".join(re.escape(k) for k in keywords)))


def tenant_view(df: DataFrame, region: int, name: str | None = None, col: str = "region") -> DataFrame:
    """The rows of one tenant; published as a view where a name is given."""
    out = df.where(F.col(col) == region)
    if name:
        out.createOrReplaceTempView(name)
    return out


def key_to_value(df: DataFrame, names: dict[str, str], key: str = "key") -> DataFrame:
    """Copies fields of a JSON key into columns under new names."""
    return df.withColumns({new: F.get_json_object(F.col(key).cast("string"), f"$.{old}") for old, new in names.items()})


def route_regex(df: DataFrame, pattern: str, replacement: str, col: str = "topic") -> DataFrame:
    """Renames topics that match the pattern as a whole; others stay."""
    whole = F.col(col).rlike(f"^(?:{pattern})$")
    return df.withColumn(col, F.when(whole, F.regexp_replace(F.col(col), f"^(?:{pattern})$", replacement)).otherwise(F.col(col)))


def route_timestamp(df: DataFrame, fmt: str = "yyyy_MM_dd", col: str = "topic", ts: str = "timestamp") -> DataFrame:
    """Appends the day to the topic: a daily index name."""
    return df.withColumn(col, F.concat_ws("-", F.col(col), F.date_format(F.col(ts), fmt)))


def rekey(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """Rows of one key value in one partition."""
    return df.repartition(partitions, col) if partitions else df.repartition(col)


def unwrap_payload(df: DataFrame, value: str = "value") -> DataFrame:
    """The payload of an envelope where it has one, or else the record itself."""
    return df.withColumn(value, F.coalesce(F.get_json_object(value, "$.payload"), F.col(value)))


def drop_tombstones(df: DataFrame, value: str = "value") -> DataFrame:
    """Without records whose value is null, empty or the JSON null."""
    text = F.trim(F.col(value).cast("string"))
    return df.where(F.col(value).isNotNull() & ~text.isin("", "null"))


def to_vector_record(df: DataFrame, now: Column | None = None) -> DataFrame:
    """(id, timestamp, message, category, value, raw_data) from a message in a JSON column `value`.

    A missing id is a stable hash of the record, a missing timestamp is now; category and value come from `data`.
    """
    now = F.current_timestamp().cast("string") if now is None else now
    get = lambda path: F.get_json_object("value", path)
    return df.select(
        F.coalesce(get("$.id").try_cast("long"), F.xxhash64("value")).alias("id"),
        F.coalesce(get("$.timestamp"), now).alias("timestamp"),
        F.coalesce(get("$.message"), F.lit("")).alias("message"),
        get("$.data.category").alias("category"),
        get("$.data.value").try_cast("long").alias("value"),
        F.col("value").alias("raw_data"),
    )


def align_schema(df: DataFrame, required: T.StructType) -> DataFrame:
    """Adds the required columns that are missing, as nulls."""
    have = set(df.columns)
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in required.fields if f.name not in have})


def union_logs(*logs: DataFrame) -> DataFrame:
    """Several topics as one log; columns that one of them lacks are null."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out
