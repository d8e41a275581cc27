"""Writers and keyed table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame | None, incoming: DataFrame, key: list[str], load_order: Column | None = None) -> DataFrame:
    """Insert or replace by primary key; the incoming row wins, and among incoming duplicates the latest load.

    The survivor is picked by an aggregate (``max_by``), so duplicates of a hot key collapse on the map side.
    """
    seq = load_order if load_order is not None else F.lit(0)
    new = incoming.withColumn("__seq", F.struct(F.lit(1).alias("a"), seq.cast("long").alias("b")))
    if current is not None:
        old = current.withColumn("__seq", F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b")))
        new = old.unionByName(new)
    rest = [c for c in incoming.columns if c not in key]
    g = new.groupBy(*key).agg(F.max_by(F.struct(*rest), "__seq").alias("r"))
    return g.select(*[F.col(c) if c in key else F.col(f"r.{c}") for c in incoming.columns])


def replace_keys(current: DataFrame, stage: DataFrame, key: list[str], keys: DataFrame | None = None) -> DataFrame:
    """Delete every row whose key is staged, then append the stage. ``keys`` names the staged keys where some of them
    have no row in the stage, so that they lose their rows too."""
    gone = (stage if keys is None else keys).select(*key).distinct()
    return current.join(gone, key, "left_anti").unionByName(stage)


def reload_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_partitions(df: DataFrame, path: str, by: list[str], sort: list[str] | None = None, files_per_key: int = 1) -> None:
    """Overwrite only the partitions present in ``df``. Rows of one partition value are spread over ``files_per_key``
    tasks by a hash of the sort columns (else of the plain columns), so a hot day or ticker is not written by one."""
    plain = [c for c, t in df.dtypes if c not in by and not t.startswith(("map", "array", "struct", "variant"))]
    spread = sort or plain
    salt = F.pmod(F.xxhash64(*spread), F.lit(files_per_key)) if files_per_key > 1 and spread else F.lit(0)
    x = df.withColumn("__salt", salt).repartition(*by, "__salt").drop("__salt")
    if sort:
        x = x.sortWithinPartitions(*by, *sort)
    x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_day_files(df: DataFrame, path: str, day: str = "date") -> None:
    """A parquet file per day, named by the day and without the day column (``2024-05-01.parquet``). A day is written by
    one task; the renames are one per day."""
    parts = f"{path}/_parts"
    write_partitions(df, parts, [day])
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(parts)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for d in files.listStatus(folder):
        name = d.getPath().getName()
        if name.startswith(f"{day}="):
            (part,) = [f.getPath() for f in files.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")]
            files.rename(part, hadoop.Path(f"{path}/{name.removeprefix(f'{day}=')}.parquet"))
    files.delete(folder, True)


def write_json_texts(texts: DataFrame, path: str) -> None:
    """A file ``<stem>.json`` for each row of (stem, body), written by the tasks and put in place by a rename."""

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(path)
        where.create_dir(base, recursive=True)
        n = 0
        for batch in batches:
            for stem, body in zip(batch["stem"].to_pylist(), batch["body"].to_pylist()):
                part = f"{base}/.{uuid.uuid4().hex}"
                with where.open_output_stream(part, compression=None) as out:
                    out.write(body.encode())
                where.move(part, f"{base}/{stem}.json")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    texts.select("stem", "body").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def missing_days(spark: SparkSession, source: DataFrame, path: str, day: str = "date", force: bool = False) -> DataFrame:
    """Source rows whose day has no output partition yet. Partitions are listed, not read; there is one a day.

    A day counts as done once it has any output: what arrives later for it takes ``force``, or the streaming day build.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if force or not files.exists(folder):
        return source
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    days = [(n.removeprefix(f"{day}="),) for n in names if n.startswith(f"{day}=")]
    done = spark.createDataFrame(days, f"{day} string").select(F.col(day).cast(dict(source.dtypes)[day]))
    return source.join(F.broadcast(done), day, "left_anti")  # as many rows as days


def build_days(spark: SparkSession, source: DataFrame, path: str, build, day: str = "date", force: bool = False) -> None:
    """Incremental build: ``build`` runs on the days not done yet, and their partitions are written atomically."""
    write_partitions(build(missing_days(spark, source, path, day, force)), path, [day])


def shard(trades: DataFrame, keys: DataFrame, path: str, columns: list[str], by: tuple[str, str] = ("ticker", "date"),
          files_per_key: int = 8) -> None:
    """Write only the listed (ticker, date) groups, narrow, one folder each."""
    x = trades.join(keys.select(*by), list(by), "left_semi").select(*by, *columns)
    write_partitions(x, path, list(by), files_per_key=files_per_key)


def write_sorted(df: DataFrame, path: str, order: list[str], partitions: int | None = None) -> None:
    """Range-partition and sort so that row-group statistics skip on the leading columns."""
    x = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    x.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_trips_csv(trips: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed column order, header, empty text for NULL."""
    trips.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def write_universe_json(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").json(path)


def write_cells_csv(df: DataFrame, path: str, cell: list[str]) -> None:
    """One folder of CSV per grid cell."""
    df.write.mode("overwrite").option("header", "true").partitionBy(*cell).csv(path)


# ----- warehouse lookups -----


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def date_range(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def history(df: DataFrame, key: str, value, date: str, start=None, end=None, descending: bool = False) -> DataFrame:
    """Rows of one key in date order, optionally inside a date range; filters are plain comparisons and push down."""
    x = df.filter(F.col(key) == F.lit(value))
    if start is not None:
        x = x.filter(F.col(date) >= F.lit(start))
    if end is not None:
        x = x.filter(F.col(date) <= F.lit(end))
    return x.orderBy(F.desc(date) if descending else F.asc(date))


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (a QUALIFY row_number() = 1), by an aggregate that combines on the map side."""
    rest = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return g.select(*key, *[F.col(f"r.{c}") for c in rest])


def nth_recent(df: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == n).drop("rn")
