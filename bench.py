"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2


def workload(spark):
    """The investigation workload: six shapes over generated alert and process events."""
    from pyspark.sql import functions as F

    from trailspark.engine import Engine

    n = F.col("id")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    when = F.when(n >= 49_000, F.lit("2026-07-28T10:00:00Z")).otherwise(F.lit("2026-07-20T10:00:00Z"))
    host = F.concat(F.lit("host-"), (n % 100).cast("string"))
    src = F.when(n % 257 == 0, F.lit("10.10.1.9")).otherwise(F.concat(F.lit("10.0."), (n % 200).cast("string"), F.lit(".7")))
    name = F.when(n % 509 == 0, F.lit("TLS Heartbeat request")).otherwise(F.lit("ET SCAN probe"))
    alert = F.to_json(F.struct(F.struct((n % 900).alias("signature_id"), name.alias("signature")).alias("alert"), F.lit("alert").alias("event_type"), host.alias("host"), src.alias("src_ip")))
    process = F.concat(F.lit('{"Event":{"System":{"Computer":'), quoted(host), F.lit(',"EventID":1}}}'))
    base = spark.range(50_000).select(when.cast("timestamp").cast("timestamp_ntz").alias("TimeGenerated"), F.lit("suricata").alias("Source"), alert.alias("RawData"), F.get_json_object(alert, "$.src_ip").alias("src_ip"), F.get_json_object(alert, "$.event_type").alias("event_type"), F.get_json_object(alert, "$.alert").alias("alert"), F.get_json_object(alert, "$.host").alias("host"))
    sysmon = spark.range(10_000).select(F.lit("2026-07-27T00:00:00Z").cast("timestamp").cast("timestamp_ntz").alias("TimeGenerated"), F.lit("sysmon").alias("Source"), process.alias("RawData"), F.get_json_object(process, "$.Event").alias("Event"))
    import datetime as dt
    import tempfile

    folder = tempfile.mkdtemp(prefix="bench-")
    base.write.parquet(f"{folder}/suricata")
    sysmon.write.parquet(f"{folder}/sysmon")
    e = Engine(spark, now=dt.datetime(2026, 7, 28, 12, tzinfo=dt.timezone.utc))
    suricata, process_ = spark.read.parquet(f"{folder}/suricata"), spark.read.parquet(f"{folder}/sysmon")
    e.register("Suricata", suricata, {"RawData", "alert"})
    e.register("Sysmon", process_, {"RawData", "Event"})
    e.register("Events", suricata.unionByName(process_, allowMissingColumns=True), {"RawData", "alert", "Event"})
    return e, {
        "w1_equality": 'Suricata | where src_ip == "10.10.1.9" | take 100',
        "w2_has": 'Suricata | where alert.signature has "Heartbeat" | take 100',
        "w3_count_by": "Suricata | summarize c=count() by event_type",
        "w4_search": 'Events | search "10.10.1.9" | take 100',
        "w5_time_range": "Suricata | where TimeGenerated > ago(1d) | order by TimeGenerated desc | take 100",
        "w6_join": "Sysmon | extend host=tostring(Event.System.Computer) | join kind=inner (Suricata) on host | take 100",
    }


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from trailspark import queries

    times: dict[str, float] = {}

    def timed(name, run):
        best = float("inf")
        for _ in range(RUNS):
            began = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 4)

    e, shapes = workload(spark)
    for name, text in shapes.items():
        timed(name, lambda text=text: e.query(text, None))
    tables = queries.engine(spark, SF_DIR)
    for name in ("where", "summarize", "join_inner", "join_fullouter", "lookup", "top", "search", "has", "dynamic_path", "mv_apply", "make_set", "top_customers"):
        timed(name, lambda name=name: tables.compile(queries.KQL[name][0]).df.write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
