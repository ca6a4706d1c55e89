"""Partitioned table scans, contracts, fingerprints and versioned sinks (family A)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_partitioned(spark: SparkSession, root: str, dataset: str, seasons: list[int] | None = None) -> DataFrame:
    """One dataset stored as root/dataset/season=N; columns by name, absent ones NULL. Seasons prune partitions."""
    df = spark.read.option("mergeSchema", True).parquet(f"{root}/{dataset}")
    return df if seasons is None else df.where(F.col("season").isin(seasons))


def scan_pruned(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns only; an absent one is an error before anything is read."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def scan_required_or_skip(frames: dict[int, DataFrame], required: list[str]) -> DataFrame | None:
    """Union of the seasons whose schema holds every required column, with the season from the path."""
    held = [df.select(*required).withColumn("season", F.lit(s)) for s, df in sorted(frames.items()) if set(required) <= set(df.columns)]
    out = None
    for df in held:
        out = df if out is None else out.unionByName(df)
    return out


def scan_csv_typed(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """All-text CSV, then casts; booleans are the text "true"."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, header=True, schema=schema)
    cast = lambda c, t: F.col(c) == "true" if t == "boolean" else F.expr(f"try_cast(`{c}` as {t})")
    return df.select(*(cast(c, t).alias(c) for c, t in columns.items()))


def schema_contract(sources: dict[str, tuple[DataFrame, list[str]]], season: str = "season") -> DataFrame:
    """source, row_count, columns, missing, seasons, status of each source; one aggregate a source."""
    out = None
    for name, (df, required) in sources.items():
        missing = [c for c in required if c not in df.columns]
        n_seasons = F.count_distinct(season) if season in df.columns else F.lit(0).cast("long")
        row = df.agg(F.count(F.lit(1)).alias("row_count"), n_seasons.alias("seasons")).select(
            F.lit(name).alias("source"), "row_count", F.lit("|".join(sorted(df.columns))).alias("columns"), F.lit("|".join(missing)).alias("missing"), "seasons",
            F.when(F.lit(bool(missing)), "missing_columns").when(F.col("row_count") == 0, "empty").otherwise("ok").alias("status"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def coverage_expectation(seasons: DataFrame, starts: DataFrame) -> DataFrame:
    """dataset x season with expected_available and a reason for the gap. Both sides are dimension tables."""
    grid = seasons.crossJoin(starts)
    ok = F.col("season") >= F.col("first_season")
    return grid.select("dataset", "season", ok.alias("expected_available"), F.when(~ok, "before_first_season").alias("gap_reason"))


def coverage_status(grid: DataFrame, counts: DataFrame) -> DataFrame:
    """ingested / ingested_empty / expected_gap / missing of each dataset and season."""
    out = grid.join(counts, ["dataset", "season"], "left")
    n = F.coalesce("row_count", F.lit(0))
    status = F.when(n > 0, "ingested").when(F.col("row_count") == 0, "ingested_empty").when(~F.col("expected_available"), "expected_gap").otherwise("missing")
    return out.select("dataset", "season", n.alias("row_count"), status.alias("status"))


def lineage_stamp(df: DataFrame, **versions: str) -> DataFrame:
    """The version columns first, as literals."""
    return df.select(*(F.lit(v).alias(k) for k, v in versions.items()), *df.columns)


def canonical_text(c: Column, kind: str) -> Column:
    """A value as text that other engines write alike: numbers with a fraction to 6 places, times to microseconds, NULL as a mark."""
    if kind in ("double", "float"):
        c = c.cast("decimal(38,6)")
    elif kind.startswith("timestamp"):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.coalesce(c.cast("string"), F.lit("~"))


def frame_fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and a digest that depend neither on row nor on column order: the sum of 60 bits of each row's md5."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    text = F.concat_ws("|", *(canonical_text(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in fields))
    row = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("s"))
    return sums.select("row_count", F.sha2(F.concat_ws("|", F.lit(",".join(f.name for f in fields)), "row_count", "s"), 256).alias("fingerprint"))


def content_version(inputs: DataFrame, parameters: dict) -> DataFrame:
    """One row: an id from the sorted digests of the inputs (source, fingerprint) and the parameters."""
    text = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "source", "fingerprint"))), ";")
    return inputs.agg(F.substring(F.sha2(F.concat_ws("|", text, F.lit(json.dumps(parameters, sort_keys=True))), 256), 1, 16).alias("version"))


def manifest_frame(sources: dict[str, tuple[DataFrame, list[str]]], version: str) -> DataFrame:
    """One row a source: version, rows, columns, schema as JSON, required and missing columns as JSON."""
    out = None
    for name, (df, required) in sources.items():
        schema = json.dumps([[f.name, f.dataType.simpleString()] for f in sorted(df.schema.fields, key=lambda f: f.name)])
        missing = [c for c in required if c not in df.columns]
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(version).alias("version"), F.lit(name).alias("source"), "row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(schema).alias("schema_json"), F.lit(json.dumps(required)).alias("required_json"), F.lit(json.dumps(missing)).alias("missing_json"))
        out = row if out is None else out.unionByName(row)
    return out


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


class PublicationError(RuntimeError):
    pass


def _pointers(spark: SparkSession, root: str) -> list[dict]:
    fs, path = _fs(spark, root)
    if not fs.exists(path(f"{root}/publications")):
        return []
    files = [f.getPath().toString() for f in fs.listStatus(path(f"{root}/publications")) if f.getPath().getName().endswith(".json")]
    return [json.loads(r[0]) for r in spark.read.text(files, wholetext=True).collect()] if files else []  # a row a version


def publications(spark: SparkSession, root: str) -> DataFrame:
    """version, sequence, data (folder), table, row_count, fingerprint: a row a published version and table."""
    rows = [(p["version"], p["sequence"], p["data"], t["table"], t["row_count"], t["fingerprint"]) for p in _pointers(spark, root) for t in p["tables"]]
    return spark.createDataFrame(rows, "version string, sequence long, data string, table string, row_count long, fingerprint string")


def _prints(tables: dict[str, DataFrame]) -> list[dict]:
    return [{"table": name, **frame_fingerprint(df).select("row_count", "fingerprint").first().asDict()} for name, df in sorted(tables.items())]


def verify(spark: SparkSession, root: str, version: str) -> dict:
    """The version's pointer, after its tables' rows and fingerprints were found as it says; an error where they are not."""
    pointer = next((p for p in _pointers(spark, root) if p["version"] == version), None)
    if pointer is None:
        raise PublicationError(f"{version} is not published")
    try:
        held = _prints({t["table"]: spark.read.parquet(f"{pointer['data']}/{t['table']}") for t in pointer["tables"]})
    except Exception as gone:
        raise PublicationError(f"{version} can't be read: {type(gone).__name__}") from gone
    if held != pointer["tables"]:
        raise PublicationError(f"{version} is not what was published: {held} instead of {pointer['tables']}")
    return pointer


def versioned_sink(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Publish all tables together as a version: "published", or "reused" where the version is there with the same content.

    Data goes to a folder of its own name and is read back for its fingerprints. The pointer file publications/<version>.json, made only if it is
    absent, is the commit: before it nothing of the version can be seen, and of two builders one makes it. Where the version is there, it is verified,
    and other content is an error. A build that fails or comes second removes its own folder and no other."""
    spark = next(iter(tables.values())).sparkSession
    fs, path = _fs(spark, root)
    data, file = f"{root}/data/{uuid.uuid4().hex}", path(f"{root}/publications/{version}.json")
    committed = False
    try:
        if not fs.exists(file):
            for name, df in tables.items():
                df.write.option("compression", "zstd").parquet(f"{data}/{name}")
            written = _prints({name: spark.read.parquet(f"{data}/{name}") for name in tables})
            sequence = 1 + max((p["sequence"] for p in _pointers(spark, root)), default=0)
            text = json.dumps({"version": version, "sequence": sequence, "data": data, "tables": written})
            try:
                out = fs.create(file, False)
            except Exception as e:
                if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                    raise
            else:
                out.write(bytearray(text.encode()))
                out.close()
                committed = True
                return "published"
        else:
            written = _prints(tables)
        if verify(spark, root, version)["tables"] != written:
            raise PublicationError(f"{version} is published with other content")
        return "reused"
    finally:
        if not committed:
            fs.delete(path(data), True)


def read_published(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """The table of a version, or of the one published last, by its pointer, with the column version."""
    held = [p for p in _pointers(spark, root) if version in (None, p["version"])]
    if not held:
        raise PublicationError(f"{version or 'no version'} is not published")
    pointer = max(held, key=lambda p: (p["sequence"], p["version"]))
    return spark.read.parquet(f"{pointer['data']}/{table}").withColumn("version", F.lit(pointer["version"]))


def context_normalise(df: DataFrame, id_columns: list[str], team_columns: list[str], aliases: DataFrame, pattern: str) -> DataFrame:
    """df plus entity_id (the first present id column that holds a value of the pattern) and team (canonical, by the
    small alias table); mapped tells whether the team was known."""
    ids = [F.col(c) for c in id_columns if c in df.columns]
    teams = [F.col(c) for c in team_columns if c in df.columns]
    entity = F.coalesce(*(F.when(c.rlike(pattern), c) for c in ids)) if ids else F.lit(None).cast("string")
    team = F.coalesce(*teams) if teams else F.lit(None).cast("string")
    out = df.withColumn("entity_id", entity).withColumn("_code", team)
    out = out.join(aliases.select(F.col("alias").alias("_code"), F.col("canonical").alias("team")), "_code", "left")
    return out.withColumn("mapped", F.col("team").isNotNull() | F.col("_code").isNull()).drop("_code")


def season_incremental(df: DataFrame, done: DataFrame, path: str) -> DataFrame:
    """Write the seasons that `done` does not hold, each to its own partition, and read all back."""
    new = df.join(done.select("season").distinct(), "season", "left_anti")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)
    return df.sparkSession.read.parquet(path)
