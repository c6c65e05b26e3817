"""Scoring requests: JSON bodies with optional fields, from files or from a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate import params as P
from tollgate.functions.scalars import key_hash

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

#: Read as text: numbers and numeric text look alike, and what is not a number can be told from what is missing.
REQUEST = T.StructType([T.StructField(name, T.StringType()) for name in P.REQUEST_DEFAULTS])
FIELDS = tuple(P.REQUEST_DEFAULTS)
#: Parts that made bodies are dealt into, for each core of the session.
PARTS_PER_CORE = 4


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")


def stream_events(spark: SparkSession, folder: str, pattern: str = "events.parquet",
                  files_per_batch: int | None = None) -> DataFrame:
    """The event files of a folder as a stream."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def request_bodies(events: DataFrame) -> DataFrame:
    """A JSON body per event: each field from a byte of the event's hash, about one in five left out, some unknown names."""
    # Two hashes give a byte for each of the 30 fields, and one more. Each step is a projection of its own: a hash or
    # byte that is used more than once is then computed once.
    digits = F.concat(key_hash("event_id", "a"), key_hash("event_id", "b"))
    # A file of few row groups would leave all this, and the parsing, to a few tasks, so the rows are dealt out first.
    spread = events.select("event_id", "ts").repartition(PARTS_PER_CORE * events.sparkSession.sparkContext.defaultParallelism)
    hashed = spread.select("event_id", "ts", digits.alias("__digits"))
    level = lambda i: F.conv(F.substring("__digits", 2 * i + 1, 2), 16, 10).cast("int").alias(f"__{i}")
    levels = hashed.select("event_id", "ts", *[level(i) for i in range(len(FIELDS) + 1)])
    known = [
        F.when(F.col(f"__{i}") >= 51, F.concat(
            F.lit(f'"{name}":'), (F.lit(default) * (F.lit(0.5) + F.col(f"__{i}") / F.lit(256.0))).cast("string")))
        for i, (name, default) in enumerate(P.REQUEST_DEFAULTS.items())
    ]
    unknown = F.when(F.col(f"__{len(FIELDS)}") < 32, F.lit('"age":72.0'))
    body = F.concat(F.lit("{"), F.concat_ws(",", *known, unknown), F.lit("}"))
    return levels.select("event_id", "ts", body.alias("body"))


def parse_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """The 30 fields in model order with defaults for those left out, the names in the body that no field has, and
    whether the request is valid.

    A body must be a JSON object, and a field that is there must be a number or text that reads as one: null, other types
    and other text are a problem. The fields of an invalid request are null, so nothing can score it by mistake.
    """
    kept = [c for c in requests.columns if c != body]
    read = requests.select(*kept, F.from_json(F.col(body), REQUEST).alias("__parsed"), F.json_object_keys(F.col(body)).alias("__names"))
    numbers = read.select(*kept, "__names", *[F.col("__parsed")[name].try_cast("double").alias(name) for name in FIELDS])
    absent = F.array_compact(F.array(*[F.when(F.isnull(name), F.lit(name)) for name in FIELDS]))
    wrong = numbers.withColumn("__wrong", F.array_intersect("__names", absent))
    problem = F.when(F.col("__names").isNull(), F.lit("body is not a JSON object")).when(
        F.size("__wrong") > 0, F.concat(F.lit("not a number: "), F.array_join("__wrong", ", "))).when(
        F.size(F.array_distinct("__names")) < F.size("__names"), F.lit("a name is given twice"))
    checked = wrong.withColumn("problem", problem)
    known = F.array(*[F.lit(name) for name in FIELDS])
    value = lambda name, default: F.when(F.col("problem").isNull(), F.coalesce(name, F.lit(default)))
    return checked.select(
        *kept,
        *[value(name, default).alias(name) for name, default in P.REQUEST_DEFAULTS.items()],
        F.array_except("__names", known).alias("unknown_fields"),
        F.col("problem").isNull().alias("valid"), "problem",
    )


def _rows_where(parsed: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """The rows for which a computed condition holds. A plain filter would be pushed below the parsing and repeat all of it;
    a generator that makes one row or none stays where it is. It is a filter of an array, which Spark does not fuse with the projections
    around it: all in one are a method too long for the JVM to compile."""
    return parsed.select(F.inline(F.filter(F.array(F.struct(*columns)), lambda _: condition)))


def valid_requests(parsed: DataFrame) -> DataFrame:
    return _rows_where(parsed, F.col("valid"), [c for c in parsed.columns if c not in ("valid", "problem")])


def rejected_requests(parsed: DataFrame) -> DataFrame:
    """What cannot be scored: the request's own columns and the problem."""
    return _rows_where(parsed, ~F.col("valid"), [c for c in parsed.columns if c not in (*FIELDS, "unknown_fields", "valid")])
