"""Items, traces, prices and evaluation sets in JSON files, and configuration."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import constants as C

ITEM = "id string, content string, metadata map<string,string>, timestamp timestamp, speaker string, turn_id string"
TRACE = (
    "timestamp timestamp, event_type string, adapter_name string, operation_id string, query string, content string, success boolean,"
    " error_message string, items_count int, latency_ms double, tokens_processed int, operation_details map<string,string>"
)
TELEMETRY = "ts double, op string, adapter string, predicted_cents int, predicted_ms double, observed_ms double, observed_cents int, meta string, error string"
PRICES = (
    "struct<write:double,read:double,index_maint:double,gc_maint:double,storage_month:double,base_cents:int,per_token_micros:int,"
    "per_k_cents:double,per_logN_cents:double,p50_ms:double,p95_ms:double>"
)
CHAPTERS = (
    "chapters array<struct<chapter_id:string,events:array<struct<content:string,date:string,entities:array<string>,location:string>>>>,"
    " qa_pairs array<struct<question:string,answer:array<string>,question_type:string>>"
)
HAYSTACK = (
    "question_id string, question_type string, question string, answer string,"
    " haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, haystack_dates array<string>"
)
LABELED = (
    "success boolean, turn_id string, turn_data struct<content:string,speaker:string,context:string,metadata:map<string,string>>,"
    " label struct<routing_class:int,confidence:double,reasoning:string,detected_entities:array<string>>, api_cost_usd double"
)


def read_items(spark: SparkSession, folder: str, today: str | None = None, days: int = 30) -> DataFrame:
    """Items below YYYY/MM/DD/<session>.jsonl; blank and malformed lines are skipped. Adds day and session_id.

    With `today`, only the folders of the last `days` days are listed and read; days
    without a folder are skipped, and without any the result is empty.
    """
    if today is None:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
        paths = [folder]
    else:
        last = date.fromisoformat(today)
        wanted = [f"{folder}/{last - timedelta(days=back):%Y/%m/%d}" for back in range(days)]
        lines, paths = spark.read, [f"{p}/*.jsonl" for p in wanted if _exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], ITEM + ", day date, session_id string")
    rows = lines.schema(ITEM).option("mode", "DROPMALFORMED").json(paths).where("id is not null")
    path = F.input_file_name()
    day = F.to_date(F.regexp_extract(path, r"(\d{4}/\d{2}/\d{2})/[^/]+$", 1), "yyyy/MM/dd")
    return rows.withColumns({"day": day, "session_id": F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)})


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def read_appended(spark: SparkSession, folder: str) -> DataFrame:
    """What append_items has written: items with day and session_id, both partitions, so that filters on them prune folders."""
    rows = spark.read.schema(ITEM + ", day date, session_id string").option("mode", "DROPMALFORMED").json(folder)
    return rows.where("id is not null")


def recent_items(items: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Items of the last `days` days with days_back. On a table partitioned by day this prunes partitions."""
    now = F.lit(today).cast("date")
    return items.where((F.col("day") > F.date_sub(now, days)) & (F.col("day") <= now)).withColumn("days_back", F.datediff(now, "day"))


def file_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """n_files and n_lines below a folder; all lines count, also blank and malformed ones, and so do empty files."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.jsonl"}
    lines = spark.read.options(**options).text(folder)
    # Spark has listed the files already; empty ones have no row to count them by.
    return lines.agg(F.lit(len(lines.inputFiles())).cast("long").alias("n_files"), F.count(F.lit(1)).alias("n_lines"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace events; lines that don't parse are left out."""
    rows = spark.read.schema(TRACE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and event_type is not null").drop("_bad")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).option("mode", "DROPMALFORMED").json(path)


def read_pricebook(spark: SparkSession, path: str) -> DataFrame:
    """A pricebook file as (backend, op, model, coefficients): its keys are backend|op or backend|op|model=name."""
    book = spark.read.schema(f"entries map<string,{PRICES}>").option("multiLine", "true").json(path)
    rows = book.select(F.explode("entries").alias("key", "p"))
    parts = F.split("key", r"\|")
    model = F.regexp_replace(F.get(parts, 2), "^model=", "")
    return rows.select(F.get(parts, 0).alias("backend"), F.get(parts, 1).alias("op"), model.alias("model"), "p.*").withColumnRenamed("per_logN_cents", "per_logn_cents")


def read_chapters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An episodic set: (chapter_id, position, content, date, entities, location) and (question, answer, question_type)."""
    book = spark.read.schema(CHAPTERS).option("multiLine", "true").json(path)
    chapters = book.select(F.explode("chapters").alias("c"))
    events = chapters.select("c.chapter_id", F.posexplode("c.events").alias("position", "e")).select("chapter_id", "position", "e.*")
    return events, book.select(F.explode("qa_pairs").alias("q")).select("q.*")


def read_haystacks(spark: SparkSession, path: str) -> DataFrame:
    """A long-chat set, one row per message, with its session's date by position (null beyond the list)."""
    rows = spark.read.schema(HAYSTACK).option("multiLine", "true").json(path)
    sessions = rows.select("question_id", "haystack_dates", F.posexplode("haystack_sessions").alias("session", "messages"))
    messages = sessions.select("question_id", "session", F.get("haystack_dates", F.col("session")).alias("date"), F.posexplode("messages").alias("turn", "m"))
    return messages.select("question_id", "session", "date", "turn", "m.*")


def read_labeled(spark: SparkSession, path: str) -> DataFrame:
    """Labeled samples of one or more files, failed ones left out."""
    rows = spark.read.schema(LABELED).option("multiLine", "true").json(path).where("success")
    return rows.select("turn_id", "turn_data.*", "label.*", "api_cost_usd")


def expand(value, environment: Mapping[str, str] | None = None):
    """`value` with ${NAME:default} replaced from the environment, in all of a nested configuration."""
    env = os.environ if environment is None else environment
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), value)
    return value


def overridden(settings: dict, prefix: str, environment: Mapping[str, str] | None = None) -> dict:
    """Settings with those that the environment sets (prefix and name in capitals) in their place."""
    env = os.environ if environment is None else environment
    return {k: env.get(f"{prefix}{k.upper()}", v) for k, v in settings.items()}


def backends(spark: SparkSession, config: dict) -> DataFrame:
    """(name, kind, params) of a backend configuration: a list `adapters` or a map `instances`; disabled ones go, and
    kinds that `aliases` names are replaced.

    An entry of the list without a name raises ValueError.
    """
    entries = config.get("adapters") or [{"name": k, **v} for k, v in (config.get("instances") or {}).items()]
    rows = []
    for entry in entries:
        if not entry.get("name"):
            raise ValueError("a backend needs a name")
        if entry.get("enabled", True) and not entry.get("disabled", False):
            kind = entry.get("type", entry["name"])
            rows.append((entry["name"], (config.get("aliases") or {}).get(kind, kind), {k: str(v) for k, v in (entry.get("params") or {}).items()}))
    return spark.createDataFrame(rows, "name string, kind string, params map<string,string>")


def read_cost_config(text: str | None) -> dict:
    """A cost configuration in YAML, with ${NAME:default} filled in; none at all gives an empty one."""
    import yaml

    return expand(yaml.safe_load(text) or {}) if text else {}


def cost_coefficients(spark: SparkSession, config: dict) -> DataFrame:
    """(backend, op, write, read, index_maint, gc_maint, storage_month) from the configuration's storage, retrieval and
    maintenance prices; what it doesn't name has the default."""
    storage, retrieval = config.get("storage") or {}, config.get("retrieval") or {}
    upkeep = (config.get("processing") or {}).get("maintenance") or {}
    rows = []
    for backend in sorted({*storage, *retrieval}):
        kept, read = storage.get(backend) or {}, retrieval.get(backend) or {}
        prices = [
            kept.get("write", C.WRITE),
            read.get("read", C.READ),
            upkeep.get("index", C.INDEX),
            upkeep.get("gc", C.GC),
            kept.get("month", C.STORAGE_MONTH),
        ]
        rows += [(backend, op, *map(float, prices)) for op in ("store", "retrieve")]
    kind = "backend string, op string, write double, read double, index_maint double, gc_maint double, storage_month double"
    return spark.createDataFrame(rows, kind)


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with their items, as append_vectors writes them in one table: neither is there without the other."""
    return spark.read.parquet(folder)


def read_training(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows as export_training writes them in JSON: text, label, action, context_features."""
    kind = "text string, label int, action string, context_features array<double>"
    return spark.read.schema(kind).json(f"{folder}/json").where("text is not null")


def read_golden(spark: SparkSession, folder: str, stratum: str | None = None) -> DataFrame:
    """Frozen golden items; a stratum is a partition, so that asking for one reads only it."""
    rows = spark.read.schema("id string, content string, query string, meta map<string,string>, stratum string").json(f"{folder}/items")
    return rows if stratum is None else rows.where(F.col("stratum") == stratum)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV set with a header; rows that don't fit the schema are left out."""
    return spark.read.schema(schema).option("header", "true").option("mode", "DROPMALFORMED").csv(path)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
