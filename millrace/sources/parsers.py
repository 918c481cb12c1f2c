"""Text formats to columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def registry_header(value: Column) -> Column:
    """struct<magic, schema_id, body> of a registry-framed record: a zero byte, a big-endian 32-bit schema id, the body."""
    return F.struct(
        F.conv(F.hex(value.substr(F.lit(1), F.lit(1))), 16, 10).cast("int").alias("magic"),
        F.conv(F.hex(value.substr(F.lit(2), F.lit(4))), 16, 10).cast("long").alias("schema_id"),
        value.substr(F.lit(6), F.octet_length(value)).alias("body"),
    )


def decode_json(df: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """The JSON of a column as a struct of the same name; null where it doesn't parse."""
    return df.withColumn(col, F.from_json(F.col(col).cast("string"), schema))


def decode_registry_avro(df: DataFrame, avro_schema: str, col: str = "value") -> DataFrame:
    """Decodes registry-framed Avro; a wrong magic byte raises. Needs Spark's Avro package."""
    from pyspark.sql.avro.functions import from_avro

    require_class(df.sparkSession, "org.apache.spark.sql.avro.AvroDataToCatalyst", "decoding Avro", "spark-avro")
    head = registry_header(F.col(col))
    checked = F.when(head["magic"] == 0, head["body"]).otherwise(F.raise_error("not a registry-framed record"))
    return df.withColumn(col, from_avro(checked, avro_schema))


def require_class(spark, name: str, what: str, package: str) -> None:
    """Says which package is missing instead of failing within a query."""
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    try:
        loader.loadClass(name)
    except Exception as error:
        raise RuntimeError(f"{what} needs {package} on Spark's class path") from error


def parse_ragged(df: DataFrame, cols: list[str], sep: str = ";", min_fields: int = 2, col: str = "value", key: str = "session_id") -> DataFrame:
    """Lines of a separated file: fewer than min_fields fields are a comment and skipped, missing last fields are null, and each row gets a
    generated key."""
    parts = df.withColumn("_p", F.split(F.col(col), "\\Q" + sep + "\\E", -1))
    fields = [F.when(F.trim(F.get("_p", F.lit(i))) != "", F.trim(F.get("_p", F.lit(i)))).alias(c) for i, c in enumerate(cols)]
    return parts.where(F.size("_p") >= min_fields).select(F.expr("uuid()").alias(key), *fields)


#: The grammar of line protocol. Names and tag values escape commas, blanks and equals signs; texts stand in quotes.
_PLAIN = r"(?:[^,= \\]|\\.)[^,= \\]*+(?:\\.[^,= \\]*+)*+"
_NAME = r"(?:[^, \\]|\\.)[^, \\]*+(?:\\.[^, \\]*+)*+"
_TEXT = r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
_FIELD = rf"{_PLAIN}=(?:{_TEXT}|[^, \"]++)"


def _pairs(text: Column, pattern: str, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """A map of all matches of (key)...(value); of a repeated key the last one counts."""
    found = F.arrays_zip(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), key).alias("k"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), value).alias("v"))
    keys = F.array_distinct(F.transform(found, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(found, lambda e: e["k"] == k), -1)["v"]))


def _unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([,= \\\"])", "$1")


def parse_line_protocol(df: DataFrame, col: str = "value") -> DataFrame:
    """`name[,tag=v...] field=v[,...] [ts]` to (measurement, tags, fields, texts, ts in ns); other lines are dropped.
    fields: numbers, and 1 and 0 for true and false; texts: fields in quotes."""
    line = F.trim(F.col(col))
    pattern = rf"^({_NAME})((?:,{_PLAIN}={_PLAIN})*+) ({_FIELD}(?:,{_FIELD})*+)(?: (-?[0-9]+))?$"
    group = lambda i: F.regexp_extract(line, pattern, i)
    tags = _pairs(group(2), rf"({_PLAIN})=({_PLAIN})", _unescaped, _unescaped)
    values = _pairs(group(3), rf"({_PLAIN})=({_TEXT}|[^, \"]++)", _unescaped, lambda v: v)
    quoted = lambda k, v: v.startswith('"')
    number = lambda k, v: F.when(v.rlike("^(?:t|T|true|True|TRUE)$"), 1.0).when(v.rlike("^(?:f|F|false|False|FALSE)$"), 0.0).otherwise(F.regexp_replace(v, "[iu]$", "").try_cast("double"))
    fields = F.transform_values(F.map_filter(values, lambda k, v: ~quoted(k, v)), number)
    texts = F.transform_values(F.map_filter(values, quoted), lambda k, v: F.regexp_replace(F.regexp_replace(v, '^"|"$', ""), r"\\([\\\"])", "$1"))
    return df.where(line.rlike(pattern)).select(_unescaped(group(1)).alias("measurement"), tags.alias("tags"), fields.alias("fields"), texts.alias("texts"), group(4).try_cast("long").alias("ts"))


def parse_exposition(df: DataFrame, col: str = "value") -> DataFrame:
    """`name{label="v",...} value` to (name, labels, value); comments are dropped. Label values may hold commas, braces and escaped quotes."""
    line = F.trim(F.col(col))
    label = r"([A-Za-z_][A-Za-z0-9_]*+)=\"([^\"\\]*+(?:\\.[^\"\\]*+)*+)\""
    bare = label.replace("([A-Z", "(?:[A-Z").replace("=\\\"([^", "=\\\"(?:[^")
    pattern = rf"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{{((?:{bare},?)*+)\}})? +([^ ]+)(?: +[0-9]+)?$"
    group = lambda i: F.regexp_extract(line, pattern, i)
    value = lambda v: F.regexp_replace(F.regexp_replace(v, r"\\n", "\n"), r"\\([\\\"])", "$1")
    return df.where(line.rlike(pattern)).select(group(1).alias("name"), _pairs(group(2), label, lambda k: k, value).alias("labels"), group(3).try_cast("double").alias("value"))


def parse_group_describe(df: DataFrame, col: str = "value") -> DataFrame:
    """Lines of a consumer-group description: GROUP TOPIC PARTITION CURRENT-OFFSET LOG-END-OFFSET LAG; headers are skipped."""
    parts = F.split(F.trim(F.col(col)), "\\s+")
    names = ["group", "topic", "partition", "current_offset", "log_end_offset", "lag"]
    rows = df.select(parts.alias("_p")).where((F.size("_p") >= 6) & (F.get("_p", F.lit(0)) != "GROUP"))
    return rows.select(*(F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names))).withColumn("partition", F.col("partition").try_cast("int")).where(F.col("partition").isNotNull())


def parse_perf_metrics(df: DataFrame, prefix: str = "", col: str = "value") -> DataFrame:
    """`name:{labels}:value` to (metric, value): the prefix before the name, NaN as 0."""
    line = F.trim(F.col(col))
    pattern = "^([^:{]+?)\\s*:\\s*(?:\\{[^}]*\\}\\s*:)?\\s*([^:\\s]+)$"
    value = F.regexp_extract(line, pattern, 2)
    number = F.when(F.lower(value) == "nan", 0.0).otherwise(value.try_cast("double"))
    return df.where(line.rlike(pattern)).select(F.concat(F.lit(prefix), F.trim(F.regexp_extract(line, pattern, 1))).alias("metric"), number.alias("value"))
