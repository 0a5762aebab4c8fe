"""A profile's tables in a folder, and the configuration of profiles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONED = {"cell_index": ["tile"], "schedule": ["day"]}
PROFILE_TYPES = {"driving": ["car"], "walking": ["foot"], "cycling": ["bike"], "transit": ["foot"]}
METRICS = {"time": "fastest", "fastest": "fastest", "distance": "shortest", "shortest": "shortest"}


def store(table: DataFrame, folder: str, name: str) -> None:
    writer = table.write.mode("overwrite")
    if set(cols := PARTITIONED.get(name, [])) <= set(table.columns) and cols:
        writer = writer.partitionBy(*cols)
    writer.parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Only the given columns are read."""
    df = spark.read.parquet(f"{folder}/{name}")
    return df.select(*columns) if columns else df


def remove(spark: SparkSession, folder: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_config(text: str) -> dict[str, dict]:
    """Profiles of a YAML text by name; an unknown type, vehicle or metric is an error."""
    import yaml

    out = {}
    for name, p in (yaml.safe_load(text).get("profiles") or {}).items():
        if p.get("type") not in PROFILE_TYPES:
            raise ValueError(f"profile {name}: unknown type {p.get('type')!r}")
        if p.get("vehicle", PROFILE_TYPES[p["type"]][0]) not in PROFILE_TYPES[p["type"]]:
            raise ValueError(f"profile {name}: unknown vehicle {p.get('vehicle')!r}")
        if p.get("metric", "time") not in METRICS:
            raise ValueError(f"profile {name}: unknown metric {p.get('metric')!r}")
        out[name] = p | {"metric": METRICS[p.get("metric", "time")]}
    return out


def find_profile(profiles: dict[str, dict], kind: str, vehicle: str | None = None, metric: str = "time") -> str:
    for name, p in profiles.items():
        if p["type"] == kind and (vehicle is None or p.get("vehicle", vehicle) == vehicle) and p["metric"] == METRICS[metric]:
            return name
    raise KeyError(f"no profile {kind}, {vehicle}, {metric}")


def store_meta(spark: SparkSession, folder: str, name: str, meta: dict) -> None:
    """A profile's description as one JSON text beside its tables; a newer one replaces it."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta/{name}")


def load_meta(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The descriptions of all profiles of a folder by name; a row a profile comes to the driver."""
    rows = spark.read.text(f"{folder}/meta/*").select("value", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("name")).collect()
    return {r["name"]: json.loads(r["value"]) for r in rows}


def load_profile(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The named tables of a folder."""
    return {n: load(spark, folder, n) for n in names}
