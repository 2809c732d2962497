"""Reports: small, already aggregated tables as text."""

from __future__ import annotations

import os
import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.functions import text


def markdown(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of an aggregated result of at most ``most`` rows; numbers and nulls in report form."""
    kinds = dict(df.dtypes)
    shown = df.select(*(text.report_number(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in df.columns))
    rows = shown.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; aggregate first")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows])


def hit_lines(hits: DataFrame) -> DataFrame:
    """``line`` per hit for a terminal, in order of ``rank``."""
    span = F.concat(text.timecode(F.col("t_start")), F.lit("-"), text.timecode(F.col("t_end")))
    return hits.orderBy("rank").select(F.format_string("%2d. %.3f  %s  %s (%s)  %s", "rank", "score", "video_name", text.timecode(F.col("t")), span, F.coalesce("label", "kind")).alias("line"))


def hit_json(hits: DataFrame) -> DataFrame:
    """``line``: each hit as a JSON object."""
    return hits.select(F.to_json(F.struct(*[c for c in hits.columns if c != "emb"])).alias("line"))


def unit_summary(layers: DataFrame, unit: str = "compute_unit") -> DataFrame:
    """Per compute unit (``?`` if unknown): layers, milliseconds and mebibytes, from ``us`` and ``bytes``."""
    return layers.groupBy(F.coalesce(unit, F.lit("?")).alias(unit)).agg(F.count("*").alias("layers"), F.round(F.sum("us") / 1000, 3).alias("ms"), F.round(F.sum("bytes") / (1 << 20), 3).alias("mib"))


def machine(spark: SparkSession) -> dict[str, str]:
    """What figures were measured on: processor, cores, system and versions of the driver's machine, the cluster's master and its slots."""
    model = platform.processor() or "unknown"
    if os.path.exists("/proc/cpuinfo"):
        with open("/proc/cpuinfo", encoding="utf-8", errors="replace") as f:
            model = next((line.partition(":")[2].strip() for line in f if line.startswith("model name")), model)
    context = spark.sparkContext
    return {
        "processor": model, "cores": str(os.cpu_count()), "system": f"{platform.system()} {platform.release()} ({platform.machine()})", "python": platform.python_version(),
        "spark": spark.version, "master": context.master, "slots": str(context.defaultParallelism),
    }


def machine_label(facts: dict[str, str]) -> str:
    """``machine`` on one line."""
    return "{processor}, {cores} cores, {system}, Spark {spark} on {master} with {slots} slots".format(**facts)
