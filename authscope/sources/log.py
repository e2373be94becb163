"""Readers: raw logs, labels, the partitioned lake, streams, and the adapter of the `events` table."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authscope.functions import expressions as X

AUTH_SCHEMA = (
    "time int not null, src_user string, dst_user string, src_computer string, dst_computer string, "
    "auth_type string, logon_type string, auth_orientation string, outcome string"
)
LABEL_SCHEMA = "time int not null, user string, src_computer string, dst_computer string"
MESSAGE_SCHEMA = (
    "time int, event_ts timestamp, src_user string, dst_user string, src_computer string, dst_computer string, "
    "auth_type string, logon_type string, auth_orientation string, outcome string, produce_ts_ms long"
)
STRINGS = ("src_user", "dst_user", "src_computer", "dst_computer", "auth_type", "logon_type", "auth_orientation", "outcome")
DEFAULT_BAND = [0, 1, 2, 3, 4, 5]


def _has_header(path: str) -> bool:
    return "sample" in PurePosixPath(path).name


def read_auth(spark: SparkSession, path: str) -> DataFrame:
    """Raw events from CSV, gzip or not. Lines that don't fit the schema are dropped."""
    return spark.read.schema(AUTH_SCHEMA).option("header", _has_header(path)).option("mode", "DROPMALFORMED").csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label events from CSV or, by extension or as a folder, Parquet."""
    name = PurePosixPath(path).name
    if ".csv" in name or name.endswith((".txt", ".gz")):
        return spark.read.schema(LABEL_SCHEMA).option("header", _has_header(path)).csv(path)
    return spark.read.parquet(path).select("time", "user", "src_computer", "dst_computer")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines; a truncated compressed file gives the lines before its break."""
    return spark.read.option("ignoreCorruptFiles", True).text(path)


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    """The date-partitioned lake; columns of differing files are united by name."""
    return spark.read.option("mergeSchema", True).parquet(path)


def register(spark: SparkSession, **tables: DataFrame | str) -> None:
    """Temporary views for ad-hoc SQL, from frames or Parquet paths."""
    for name, df in tables.items():
        (read_lake(spark, df) if isinstance(df, str) else df).createOrReplaceTempView(name)


def read_band(spark: SparkSession, path: str) -> list[int]:
    """The measured off-hours band of a JSON artifact; the default where there is none, an empty band stays empty."""
    try:
        text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return list(DEFAULT_BAND)
    found = json.loads(text)
    return list(found.get("band", found.get("off_hours", {}).get("band", DEFAULT_BAND)))


def read_budgets(spark: SparkSession, path: str) -> DataFrame:
    """(detector, alerts) of a detector evaluation written as CSV; without alerts there is no budget."""
    found = spark.read.option("header", True).csv(path)
    return found.select("detector", F.col("alerts_raised").cast("double").cast("long").alias("alerts")).filter("alerts > 0")


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Events out of JSON messages; what lacks an event time or a user goes."""
    parsed = messages.select(F.from_json(F.col(value).cast("string"), MESSAGE_SCHEMA).alias("m")).select("m.*")
    return parsed.filter("event_ts is not null and src_user is not null")


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from a folder of JSON files."""
    found = spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return found.filter("event_ts is not null and src_user is not null")


def stream_topic(spark: SparkSession, servers: str, topic: str, offsets: str = "earliest", per_trigger: int = 200_000) -> DataFrame:
    """Events from a broker's topic; the session needs the connector's jar."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": offsets, "maxOffsetsPerTrigger": str(per_trigger), "failOnDataLoss": "false"}
    return decode(spark.readStream.format("kafka").options(**options).load())


#: `events` as an authentication log; {secs} is the engine's seconds since 1970 of ts.
ADAPTER = r"""
select event_id, cast({secs} - 1704067200 as int) as time,
  concat('U', cast(user_id as varchar(20)), case when user_id % 5 = 0 then '$' else '' end, '@DOM', cast(user_id % 3 as varchar(20))) as src_user,
  concat('U', cast((user_id * 7) % 50 as varchar(20)), '@DOM1') as dst_user,
  concat('C', cast(100 + user_id % 40 as varchar(20))) as src_computer,
  concat('C', regexp_extract(props, '([0-9]+)', 1)) as dst_computer,
  case event_type when 'click' then 'Kerberos' when 'view' then 'NTLM' when 'purchase' then 'Negotiate'
    when 'error' then 'MICROSOFT_AUTH_V1' else '?' end as auth_type,
  case event_id % 9 when 0 then 'Network' when 1 then 'Service' when 2 then 'Unlock' when 3 then 'Interactive' when 4 then 'Batch'
    when 5 then 'NewCredentials' when 6 then 'NetworkCleartext' when 7 then '?' else 'Remote' end as logon_type,
  case event_id % 8 when 0 then 'LogOn' when 1 then 'LogOff' when 2 then 'TGS' when 3 then 'TGT' when 4 then 'AuthMap'
    when 5 then 'ScreenLock' when 6 then 'ScreenUnlock' else '?' end as auth_orientation,
  case event_type when 'error' then 'Fail' when 'signup' then '?' else 'Success' end as outcome,
  (event_type = 'error' and event_id % 97 = 0) as is_labelled
from {events}
"""


def adapted(events: DataFrame) -> DataFrame:
    """The driver's events in the raw log's shape, with is_labelled."""
    return events.sparkSession.sql(ADAPTER.format(secs="unix_seconds(cast(ts as timestamp))", events="{events}"), events=events)


def labels_of(raw: DataFrame) -> DataFrame:
    return raw.filter("is_labelled").select("time", F.col("src_user").alias("user"), "src_computer", "dst_computer")


def derive(raw: DataFrame) -> DataFrame:
    """Typed and derived lake columns of raw events, in one projection over the scan."""
    clean = raw.select(*[c for c in raw.columns if c not in STRINGS], *[X.missing_to_null(c) for c in STRINGS])
    day = X.day_of(F.col("time"))
    return clean.withColumns({
        "day_index": day, "hour_of_day": X.hour_of(F.col("time")), "event_date": X.date_of(day), "event_ts": X.timestamp_of(F.col("time")),
        "is_success": F.col("outcome") == "Success", "is_failure": F.col("outcome") == "Fail",
        "src_user_name": X.name_part(F.col("src_user"), 0), "src_domain": X.name_part(F.col("src_user"), 1), "src_is_machine": X.is_machine(F.col("src_user")),
    })


def derive_labels(labels: DataFrame) -> DataFrame:
    day = X.day_of(F.col("time"))
    return labels.withColumns({"day_index": day, "event_date": X.date_of(day), "hour_of_day": X.hour_of(F.col("time"))})


def profile(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row about raw lines: rows, unparseable ones, first and last second, whole days between."""
    seconds = F.split(F.col(column), ",").getItem(0).try_cast("int") if hasattr(F.col(column), "try_cast") else F.expr(f"try_cast(split({column}, ',')[0] as int)")
    return lines.select(seconds.alias("t")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("t").isNull()).alias("unparseable"), F.min("t").alias("min_time"), F.max("t").alias("max_time"),
        F.round((F.max("t") - F.min("t")) / 86400.0, 1).alias("span_days"),
    )
