"""Day tables that grow by streaming runs and stay one file a day.

A run adds parts, one folder a day and batch. ``compact`` merges the parts of each day with what the day had before into a new
file and then publishes a manifest: the list of current files and the last batch they hold. Publishing is a rename of one small file, so a
reader sees the old version or the new one, never a mixture; files of old versions stay until ``vacuum``, so a reader that began
before still answers. Days without new parts keep their file.

    path/parts/<day>=2024-05-01/batch=17/...     path/base/version=4/<day>=2024-05-01/...     path/manifest/4.json
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.sources.files import Files
from barspark.sources.sinks import write_partitions

EMPTY = {"version": 0, "batch": -1, "days": {}}


def write_parts(batch: DataFrame, path: str, number: int, day: str = "date") -> None:
    """The rows of one micro-batch; a batch that is run again overwrites its own parts only."""
    write_partitions(batch.withColumn("batch", F.lit(number)), f"{path}/parts", [day, "batch"])


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """All published versions, oldest first."""
    files = Files(spark, path)
    found = sorted(int(n.removesuffix(".json")) for n in files.names(f"{path}/manifest") if n.endswith(".json"))
    return [json.loads(files.read(f"{path}/manifest/{v}.json")) for v in found]


def _parts(spark: SparkSession, path: str, after: int) -> DataFrame | None:
    """Parts of batches that no version holds yet; days and batches are pruned by folder."""
    if not Files(spark, path).names(f"{path}/parts"):
        return None
    return spark.read.parquet(f"{path}/parts").where(F.col("batch") > after).drop("batch")


def _current(spark: SparkSession, path: str, days: dict[str, str]) -> DataFrame | None:
    if not days:
        return None
    return spark.read.option("basePath", f"{path}/base").parquet(*[f"{path}/base/{d}" for d in sorted(days.values())]).drop("version")


def merged_days(spark: SparkSession, path: str, by: list[str], merge: list[Column]) -> DataFrame:
    """The table as of now: the current files, and the parts that came since, merged by key."""
    now = (manifests(spark, path) or [EMPTY])[-1]
    old, new = _current(spark, path, now["days"]), _parts(spark, path, now["batch"])
    rows = [x for x in (old, new) if x is not None]
    if not rows:
        raise FileNotFoundError(path)
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return both.groupBy(*by).agg(*merge)


def compact(spark: SparkSession, path: str, by: list[str], merge: list[Column], day: str = "date") -> dict:
    """Merge what has come since the last version into one file a day and publish that as the next version. ``merge`` must give
    the columns it reads, so that merged rows can be merged again. Run it between streaming runs; returns the manifest."""
    now = (manifests(spark, path) or [EMPTY])[-1]
    new = _parts(spark, path, now["batch"])
    if new is None or new.isEmpty():
        return now
    last = spark.read.parquet(f"{path}/parts").agg(F.max("batch")).first()[0]
    touched = sorted(str(r[0]) for r in new.select(day).distinct().collect())
    old = _current(spark, path, {d: p for d, p in now["days"].items() if d in set(touched)})
    both = new if old is None else old.unionByName(new)
    version = now["version"] + 1
    write_partitions(both.groupBy(*by).agg(*merge), f"{path}/base/version={version}", [day])
    days = now["days"] | {d: f"version={version}/{day}={d}" for d in touched}
    manifest = {"version": version, "batch": last, "days": days}
    Files(spark, path).publish(json.dumps(manifest), f"{path}/manifest/{version}.json")
    return manifest


def vacuum(spark: SparkSession, path: str, keep: int = 1, day: str = "date") -> int:
    """Delete parts and files that neither the last version nor the ``keep`` versions before it need; readers of those go on."""
    kept = manifests(spark, path)[-keep - 1:]
    if not kept:
        return 0
    files, gone = Files(spark, path), 0
    needed = {p for m in kept for p in m["days"].values()}
    for v in files.names(f"{path}/base"):
        inside = [n for n in files.names(f"{path}/base/{v}") if n.startswith(f"{day}=")]
        for n in inside:
            if f"{v}/{n}" not in needed:
                files.delete(f"{path}/base/{v}/{n}")
                gone += 1
        if not any(f"{v}/{n}" in needed for n in inside):
            files.delete(f"{path}/base/{v}")
    for d in files.names(f"{path}/parts"):
        batches = [n for n in files.names(f"{path}/parts/{d}") if n.startswith("batch=")]
        old = [n for n in batches if int(n.removeprefix("batch=")) <= kept[0]["batch"]]
        for n in old:
            files.delete(f"{path}/parts/{d}/{n}")
            gone += 1
        if batches and len(old) == len(batches):
            files.delete(f"{path}/parts/{d}")
    for n in files.names(f"{path}/manifest"):
        if n.endswith(".json") and int(n.removesuffix(".json")) < kept[0]["version"]:
            files.delete(f"{path}/manifest/{n}")
    return gone
