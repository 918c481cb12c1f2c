"""Sources: logs, files, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.parsers import require_class

#: The columns of a log record, as Spark's Kafka source has them.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("headers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
    ]
)


def read_log(spark: SparkSession, topics: list[str], path: str | None = None, servers: str | None = None, start: str = "earliest", streaming: bool = True, schema: T.StructType = LOG_SCHEMA, max_files: int | None = None) -> DataFrame:
    """Records of the topics with all their metadata.

    With servers: Kafka, from start. With path: a Parquet log that write_log made, of the same columns.
    """
    if servers:
        require_class(spark, "org.apache.spark.sql.kafka010.KafkaSourceProvider", "reading Kafka", "spark-sql-kafka")
        reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", start)
        return reader.option("includeHeaders", "true").load()
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.parquet(path)
    return rows.where(F.col("topic").isin(*topics)) if topics else rows


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, driver: str | None = None, **options: str) -> DataFrame:
    """A relational table; with a column and bounds, in that many parallel ranges. driver: the class of the JDBC driver, which has to be on the class path."""
    if driver:
        require_class(spark, driver, "reading JDBC", "the database's driver")
        options = options | {"driver": driver}
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def copy_schema(spark: SparkSession, tables: dict[str, DataFrame], dest: str, order_by: str | None = None) -> DataFrame:
    """Copies tables to sorted Parquet files under dest, several at a time: (table, rows, nullable_cols) of each."""
    from concurrent.futures import ThreadPoolExecutor

    def copy(item: tuple[str, DataFrame]) -> None:
        name, df = item
        df.sortWithinPartitions(order_by or df.columns[0]).write.mode("overwrite").parquet(f"{dest}/{name}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(copy, tables.items()))
    report = None
    for name, df in tables.items():
        nullable = [f.name for f in df.schema.fields if f.nullable]
        row = spark.read.schema(df.schema).parquet(f"{dest}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.array(*(F.lit(c) for c in nullable)).cast("array<string>").alias("nullable_cols"))
        report = row if report is None else report.unionByName(row)
    return report


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "\t", header: bool = True) -> DataFrame:
    """Separated files, compressed ones too, with or without a header line."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def read_table(spark: SparkSession, name: str, limit: int | None = None) -> DataFrame:
    """A catalogue table, the first rows of it where a limit is given."""
    rows = spark.table(name)
    return rows.limit(limit) if limit else rows


def read_keyed(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """Some columns of a wide table."""
    return spark.read.parquet(path).select(*cols)


def series(spark: SparkSession, a: int, b: int) -> DataFrame:
    """The whole numbers a..b."""
    return spark.range(a, b + 1)


def read_archive(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Archived log objects: gzipped JSON lines."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def parquet_files(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(table, part, compressed, raw, rows) of each Parquet file, for table_sizes. Only footers are read, several at a time, through
    Hadoop's file systems, so any store that Spark reads will do and no file is loaded."""
    from concurrent.futures import ThreadPoolExecutor

    parquet, of = spark._jvm.org.apache.parquet.hadoop, spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()

    def footer(item: tuple[str, str]) -> tuple[str, str, int, int, int]:
        name, part = item
        file = parquet.util.HadoopInputFile.fromPath(of(part), conf)
        reader = parquet.ParquetFileReader.open(file)
        try:
            blocks = list(reader.getFooter().getBlocks())
            return name, part, file.getLength(), sum(b.getTotalByteSize() for b in blocks), sum(b.getRowCount() for b in blocks)
        finally:
            reader.close()

    parts = [(name, part) for name, path in tables.items() for part in spark.read.parquet(path).inputFiles()]
    with ThreadPoolExecutor(8) as pool:
        return spark.createDataFrame(list(pool.map(footer, parts)), "table string, part string, compressed long, raw long, rows long")
