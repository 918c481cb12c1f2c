"""Scalar functions: column in, column out, all evaluated by Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_millis(c: Column | str) -> Column:
    """Epoch milliseconds to a timestamp."""
    return F.timestamp_millis(as_col(c))


def from_micros(c: Column | str) -> Column:
    """Epoch microseconds to a timestamp."""
    return F.timestamp_micros(as_col(c))


def from_days(c: Column | str) -> Column:
    """Days since 1970-01-01 to a date."""
    return F.date_from_unix_date(as_col(c).cast("int"))


def date_text(c: Column | str) -> Column:
    """A date as yyyy-MM-dd, without the sign that Spark puts before years of five digits."""
    return F.regexp_replace(as_col(c).cast("string"), "^\\+", "")


def time_of_day(c: Column | str) -> Column:
    """Milliseconds since midnight to HH:mm:ss; the fraction is dropped."""
    s = F.floor(as_col(c) / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def parse_iso(c: Column | str) -> Column:
    """ISO text with or without a fraction of a second to a timestamp; null if neither fits."""
    c = as_col(c)
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]'Z'")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def stamp(df: DataFrame, name: str = "now") -> DataFrame:
    """Adds the processing time, for streams that use it as event time."""
    return df.withColumn(name, F.current_timestamp())


def lsn_to_long(c: Column | str) -> Column:
    """Log position 'hi/lo' in hexadecimal to a number."""
    c = as_col(c)
    half = lambda i: F.conv(F.split_part(c, F.lit("/"), F.lit(i)), 16, 10).cast("long")
    return half(1) * F.lit(1 << 32) + half(2)


def safe_offset(c: Column | str) -> Column:
    """A number if the text is digits only, else null ('-' stands for no offset)."""
    c = as_col(c)
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long"))


#: Units of sizes.
SIZE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]


def readable_size(c: Column | str, units: list[str] = SIZE_UNITS) -> Column:
    """Bytes as '1.50 KiB': two digits and the largest of the units that leaves at least 1."""
    c = as_col(c).cast("double")
    out = F.format_string("%.2f B", c)
    for i, unit in enumerate(units[1:], 1):
        out = F.when(c >= 1024.0**i, F.format_string(f"%.2f {unit}", c / 1024.0**i)).otherwise(out)
    return out


def truncated(c: Column | str) -> Column:
    """Decimal text to the whole number before its point."""
    return F.split_part(as_col(c).cast("string"), F.lit("."), F.lit(1)).cast("long")


def trailing_number(c: Column | str) -> Column:
    """The digits at the end of a name, as text ('' if there are none)."""
    return F.regexp_extract(as_col(c), "([0-9]*)$", 1)


def last_node_number(c: Column | str) -> Column:
    """The trailing number of the last name in a blank-separated list."""
    return trailing_number(F.element_at(F.split(F.trim(as_col(c)), "\\s+"), -1))


def ceil_cents(c: Column | str) -> Column:
    return F.ceil(as_col(c) * 100) / 100


def _json_text(c: Column, kind: T.DataType) -> Column:
    """A value as JSON text with the names of all levels in order, and blanks after ':' and ','."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}": '), _json_text(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _json_text(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(_json_text(e["key"].cast("string"), T.StringType()), F.lit(": "), _json_text(e["value"], kind.valueType))
        keys = F.array_sort(F.map_keys(c))
        text = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: entry(F.struct(k.alias("key"), F.element_at(c, k).alias("value")))), ", "), F.lit("}"))
    else:
        text = F.regexp_replace(F.to_json(F.struct(c.alias("x"))), '^\\{"x":|\\}$', "")
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


def canonical_json(df: DataFrame, cols: list[str]) -> Column:
    """JSON of the columns in the order of their names, at every level."""
    return _json_text(F.struct(*cols), T.StructType([df.schema[c] for c in cols]))


def word_count(c: Column | str) -> Column:
    """The number of names in a blank-separated list."""
    return F.size(F.array_remove(F.split(F.trim(as_col(c)), "\\s+"), ""))


def hash_vector(c: Column | str, dim: int = 128) -> Column:
    """SHA-256 of a text, its bytes scaled to [-1, 1] and repeated to dim floats."""
    digest = F.sha2(as_col(c), 256)
    byte = lambda i: F.conv(digest.substr(F.lit(2) * (i % 32) + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (byte(i) / 127.5 - 1.0).cast("float"))


def aes_encrypt_col(c: Column | str, key_bytes: bytes) -> Column:
    """AES-128-CBC with PKCS7 padding, base64, the key as initial vector and no vector in the output: kept to read and write data in
    that format. A fixed vector shows which plain texts are equal; use random_aes_encrypt for new data."""
    k = F.lit(key_bytes)
    sealed = F.aes_encrypt(as_col(c), k, F.lit("CBC"), F.lit("PKCS"), k)
    # Spark puts the 16 bytes of the vector before the cipher text.
    return F.base64(sealed.substr(F.lit(17), F.octet_length(sealed)))


def aes_decrypt_col(c: Column | str, key_bytes: bytes) -> Column:
    """Inverse of aes_encrypt_col."""
    k = F.lit(key_bytes)
    return F.aes_decrypt(F.concat(k, F.unbase64(as_col(c))), k, F.lit("CBC"), F.lit("PKCS")).cast("string")


def random_aes_encrypt(c: Column | str, key_bytes: bytes) -> Column:
    """AES-128-CBC with a random vector, which is the first 16 bytes of the output."""
    return F.base64(F.aes_encrypt(as_col(c), F.lit(key_bytes), F.lit("CBC"), F.lit("PKCS")))
