"""Sinks: ordered feature files, monthly partitions, history with replacement, live tables, logs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.reports import first_per_key, latest_per_key
from barloom.session import written_table

# fixed values: leading quote columns and trailing metadata columns of a feature file
LEADING = ("bidPrice", "bidSize", "askPrice", "askSize", "lastPrice", "lastSize", "volume")
TRAILING = ("symbol", "timestamp", "date")

HISTORY_KEYS = ["symbol_price", "ts_event_price"]
#: Rows of one day that a task writes into one file; a larger day is dealt to several tasks.
FILE_ROWS = 2_000_000


def ordered_columns(columns: list[str]) -> list[str]:
    first = [c for c in LEADING if c in columns]
    last = [c for c in TRAILING if c in columns]
    return first + [c for c in columns if c not in first and c not in last] + last


def save_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    out = df.select(*ordered_columns(df.columns)).write.mode("overwrite")
    if fmt == "csv":
        out = out.option("header", True)
    out.format(fmt).save(path)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, from the file system's listing; none is an empty list."""
    fs, p = _file_system(spark, pattern)
    return [str(f.getPath().toString()) for f in (fs.globStatus(p) or [])]


def partitions(spark: SparkSession, path: str, *names: str) -> list[tuple[str, ...]]:
    """Values of the partition columns that a dataset holds, read from its folder names alone."""
    plain = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    found = list_paths(spark, "/".join([path.rstrip("/"), *[f"{n}=*" for n in names]]))
    return [tuple(plain(part.split("=", 1)[1]) for part in f.split("/")[-len(names):]) for f in found]


def rename_parts(spark: SparkSession, path: str, column: str, folder: str, shape: str) -> None:
    """Move the folders of a partitioned write to ``folder``, named by their value: legacy readers know file names only."""
    for (value,) in partitions(spark, path, column):
        fs, source = _file_system(spark, f"{path.rstrip('/')}/{column}={value}")
        _, target = _file_system(spark, f"{folder.rstrip('/')}/{shape.format(value)}")
        fs.mkdirs(target.getParent())
        fs.rename(source, target)


def save_schema(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """Keep the union of all written schemas beside the data, where readers find it without opening files.

    A writer adds a file with the schema it has written and changes no other, so writers at the same time lose nothing;
    the file gets its name when it is complete.
    """
    known = load_schema(spark, path)
    merged = _united([known, schema] if known else [schema])
    if known is None or len(merged.fields) > len(known.fields):
        name = uuid.uuid4().hex
        fs, part = _file_system(spark, f"{path.rstrip('/')}/_being-written-{name}")
        out = fs.create(part, True)
        out.write(bytearray(schema.json().encode()))
        out.close()
        _, done = _file_system(spark, f"{path.rstrip('/')}/_schema-{name}")
        if not fs.rename(part, done):
            raise OSError(f"{part} could not be renamed to {done}")
    return merged


def _united(schemas: list[T.StructType]) -> T.StructType:
    fields: dict[str, T.StructField] = {}
    for f in (f for s in schemas for f in s.fields):
        known = fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
        if known.dataType != f.dataType:
            raise ValueError(f"column {f.name} is stored as {known.dataType.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType(list(fields.values()))


def load_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The union of the schemas beside the data, oldest first; None where there are none."""
    fs, p = _file_system(spark, f"{path.rstrip('/')}/_schema*")
    files = sorted(fs.globStatus(p) or [], key=lambda f: (f.getModificationTime(), f.getPath().toString()))
    schemas = []
    for f in files:
        stream = fs.open(f.getPath())
        schemas.append(T.StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
        stream.close()
    return _united(schemas) if schemas else None


def write_monthly(df: DataFrame, path: str, ts: str = "timestamp", overwrite: bool = False) -> None:
    """Write by (symbol, ym). Months already stored are skipped, or replaced when ``overwrite``.

    Stored months come from the folder listing. Rows are spread by (symbol, day) before the write, so a symbol
    holding most rows of a month is written by several tasks, each adding few files.
    """
    spark = df.sparkSession
    rows = df.withColumn("ym", F.date_format(ts, "yyyy-MM"))
    stored = partitions(spark, path, "symbol", "ym") if not overwrite and path_exists(spark, path) else []
    if stored:
        rows = rows.join(spark.createDataFrame(stored, "symbol string, ym string"), ["symbol", "ym"], "left_anti")
    rows = rows.select(*df.columns, "ym").repartition("symbol", F.to_date(ts))
    (
        rows.write.mode("overwrite" if overwrite else "append")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("symbol", "ym")
        .parquet(path)
    )
    save_schema(spark, path, rows.schema)


def merge_monthly(parts: list[DataFrame], path: str, order: str = "timestamp") -> DataFrame:
    """One dataset sorted by (symbol, time) across files; returns rows per symbol."""
    from barloom.sources.bars import concat_tables

    merged = concat_tables(parts)
    merged.repartitionByRange("symbol", order).sortWithinPartitions("symbol", order).write.mode("overwrite").parquet(path)
    stored = merged.sparkSession.read.parquet(path)
    return stored.groupBy("symbol").agg(F.count("*").alias("records"))


def by_day(rows: DataFrame, day: str, keys: list[str], file_rows: int | None = None) -> DataFrame:
    """The rows dealt for a write in folders by ``day``: a day gets a part, so a task and a file, per ``file_rows`` rows.

    ``rows`` should be a written table, as its days are counted first. The hash of the keys tells the part, so a symbol
    that holds most rows of a day is spread too. Rows without a day are a day of their own.
    """
    name = F.coalesce(F.col(day).cast("string"), F.lit(""))
    counted = rows.groupBy(name.alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()  # days of the calendar
    parts = {r["day"]: -(-r["n"] // (file_rows or FILE_ROWS)) for r in counted}
    large = {d: n for d, n in parts.items() if n > 1}
    if not large:
        return rows.repartition(day)
    known = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])
    part = F.pmod(F.xxhash64(*keys), F.coalesce(known[name], F.lit(1)))
    tasks = max(sum(parts.values()), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.withColumn("_part", part).repartition(tasks, day, "_part").drop("_part")


def load_history(new: DataFrame, path: str, source: str, order: str) -> DataFrame:
    """Store the first record per (symbol, time) under ``data_source = source``, replacing that source.

    Folders are (data_source, simulation_date): a date filter prunes, and a reload writes the source's dates anew
    and removes those it no longer has.
    """
    spark = new.sparkSession
    rows = first_per_key(new, HISTORY_KEYS, order).drop(order)
    rows = written_table(rows.withColumns({"simulation_date": F.to_date("ts_event_price"), "data_source": F.lit(source)}), "history")
    (
        by_day(rows, "simulation_date", HISTORY_KEYS).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("data_source", "simulation_date")
        .parquet(path)
    )
    no_day = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a time
    now = {str(r[0] or no_day) for r in rows.select("simulation_date").distinct().collect()}  # days of the calendar
    for found, day in partitions(spark, path, "data_source", "simulation_date"):
        if found == source and day not in now:
            fs, p = _file_system(spark, f"{path.rstrip('/')}/data_source={source}/simulation_date={day}")
            fs.delete(p, True)
    return spark.read.parquet(path)


def store_keyed(changes: DataFrame, path: str, keys: list[str], order: str, ts: str, latest: bool = True) -> DataFrame:
    """Merge rows into a dataset of one row per key, in folders by the date of ``ts``; returns the dataset.

    The row with the largest ``order`` wins, stored or new; without ``latest`` a stored row stays, and of new ones
    the first comes in. The keys hold ``ts``, so only the folders of the changes' dates are read and written.
    """
    spark = changes.sparkSession
    rows = changes.withColumn("trade_date", F.to_date(ts))
    if path_exists(spark, path):
        days = [r[0] for r in rows.select("trade_date").distinct().collect()]  # days of the calendar
        old = spark.read.schema(load_schema(spark, path)).parquet(path).filter(F.col("trade_date").isin(days))
        if latest:
            rows = upsert(old, rows, keys, order)
        else:
            rows = old.unionByName(insert_new(old, rows, keys, order), allowMissingColumns=True)
    else:
        rows = latest_per_key(rows, keys, order) if latest else first_per_key(rows, keys, order)
    rows = written_table(rows, "keyed")
    (
        by_day(rows, "trade_date", keys).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path)
    )
    return spark.read.schema(save_schema(spark, path, rows.schema)).parquet(path)


def upsert(target: DataFrame | None, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row per key over the stored and the new rows."""
    rows = changes if target is None else target.unionByName(changes, allowMissingColumns=True)
    return latest_per_key(rows, keys, order)


def insert_new(target: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New rows whose key is not stored yet; the first of equal new keys wins."""
    return first_per_key(changes, keys, order).join(target.select(*keys), keys, "left_anti")


def append_row(spark: SparkSession, row: dict, schema: str, path: str) -> None:
    """Append one record to a log table."""
    spark.createDataFrame([row], schema).write.mode("append").parquet(path)


def save_splits(df: DataFrame, features: list[str], path: str) -> None:
    """Split rows partitioned by ``split`` and the fixed-feature rank table next to them."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    ranks = df.sparkSession.createDataFrame(
        [(f, i, 1.0) for i, f in enumerate(features, start=1)], "Feature string, Rank int, Score double"
    )
    ranks.write.mode("overwrite").parquet(f"{path}/ranks")


def truncate_dataset(spark: SparkSession, path: str) -> int:
    """Empty a dataset, keeping its schema; returns the number of rows it held."""
    stored = spark.read.parquet(path)
    rows = stored.count()
    spark.createDataFrame([], stored.schema).write.mode("overwrite").parquet(path)
    return rows


# fixed values: columns of the run log and of the model index
RUN_LOG_SCHEMA = (
    "Run_Id long, Date_Start timestamp, Model_Description string, Training_File string, Test_File string, "
    "Fast_Mode boolean, Num_Features int, Num_Samples long, Duration_Seconds double, Status string, "
    "Error_Message string, Best_Model string, Test_AUC double, Test_Accuracy double, Test_Precision double, "
    "Test_Recall double, Test_F1 double, Best_Threshold double, Best_Precision double, Best_Signals long, "
    "Best_Expected_Value double, Top_Feature_1 string, Top_Feature_2 string, Top_Feature_3 string, "
    "Low_Impact_Features string, Model_Performance_Notes string"
)

MODEL_INDEX_SCHEMA = (
    "model_id string, description string, date_created timestamp, artifact_path string, best_model string, "
    "test_auc double, test_f1 double, best_precision double, best_signals long, best_threshold double, "
    "top_feature_1 string, top_feature_2 string, top_feature_3 string"
)
