"""JSON-lines interchange: tolerant and strict scans, append and tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.text import strip
from passagemill.sources import schema as S


def path_exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped non-blank lines; no rows if the path does not exist."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "value string")
    lines = spark.read.text(path).select(strip(F.col("value")).alias("value"))
    return lines.where(F.col("value") != "")


def parse_objects(lines: DataFrame, schema: T.StructType, strict: bool = False) -> DataFrame:
    """One row per line that holds a JSON object; other lines drop or, if strict, raise.

    Fields are read leniently: a field of another type than declared is null.
    """
    if strict:
        checked = F.when(is_object(F.col("value")), F.col("value")).otherwise(
            F.raise_error(F.lit("broken JSONL line encountered"))
        )
        lines = lines.select(checked.alias("value"))
    else:
        lines = lines.where(is_object(F.col("value")))
    return lines.select(F.from_json("value", schema).alias("row"), "value").select("row.*", "value")


def json_value(line: Column) -> Column:
    """The one JSON value on a line as VARIANT, else null.

    Read as the only element of an array: on its own, the parser would stop
    after a first value and accept a line with two records glued together.
    """
    elements = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))).cast("array<variant>")
    return F.when(F.size(elements) == 1, F.get(elements, F.lit(0)))


def is_value(line: Column) -> Column:
    """Whether a line holds exactly one JSON value; repeated keys and bare ``NaN`` are allowed.

    Read as the elements of an array, see ``json_value``; VARIANT would refuse both.
    """
    elements = F.from_json(
        F.concat(F.lit("["), line, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"}
    )
    return F.coalesce(F.size(elements) == 1, F.lit(False))


def is_object(line: Column) -> Column:
    return F.coalesce(strip(line).startswith("{"), F.lit(False)) & is_value(line)


def read_objects(
    spark: SparkSession, path: str, schema: T.StructType, strict: bool = False
) -> DataFrame:
    return parse_objects(read_lines(spark, path), schema, strict).drop("value")


def parse_values(lines: DataFrame) -> DataFrame:
    """Lines holding any JSON value: as VARIANT and as ``json`` text; other lines drop.

    VARIANT is null where it cannot hold the value (repeated keys, bare ``NaN``).
    """
    return lines.where(is_value(F.col("value"))).select(
        json_value(F.col("value")).alias("value"), F.col("value").alias("json")
    )


def parse_chunks(lines: DataFrame) -> DataFrame:
    """Strict chunk records: all required keys, no unknown key; null extra is empty."""
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    known = F.array(*[F.lit(k) for k in S.CHUNK_COLUMNS])
    required = F.array(*[F.lit(k) for k in S.CHUNK_REQUIRED])
    rows = parse_objects(lines, S.CHUNK)
    fits = (F.size(F.array_except(keys, known)) == 0) & (
        F.size(F.array_except(required, keys)) == 0
    )
    empty = F.create_map().cast("map<string,string>")
    return (
        rows.where(fits)
        .withColumn("extra", F.coalesce("extra", empty))
        .select(*S.CHUNK_COLUMNS)
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return parse_chunks(read_lines(spark, path))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of an evaluation set.  The id comes from the content; equal lines are
    numbered, so every line stays a rule of its own."""
    rules = read_objects(spark, path, S.RULE)
    content = F.sha1(F.to_json(F.struct(*S.RULE.fieldNames())))
    same = Window.partitionBy("_content").orderBy("_content")
    return (
        rules.withColumn("_content", content)
        .withColumn("query_id", F.concat_ws("-", "_content", F.row_number().over(same)))
        .select("query_id", *S.RULE.fieldNames())
    )


def append_objects(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def overwrite_objects(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def tail(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """Last ``n`` rows in log order (``order`` is newest first); all rows if n is unset."""
    return df.orderBy(*order).limit(n) if n and n > 0 else df
