"""The partitioned store: immutable writes, manifests, a catalog, scans and SQL.

Everything goes through Spark's file systems, so the root may be any path that
Spark reads.  Directories are Hive partitions; a scan prunes them and the columns.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources import schemas


@dataclass(frozen=True)
class Partition:
    dataset: str
    source: str
    asset_class: str
    date: str
    version: str

    def __post_init__(self):
        if bad := [v for v in asdict(self).values() if not v or "/" in v or "\\" in v or v.startswith(".")]:
            raise ValueError(f"no partition value: {bad}")

    def path(self, root: str) -> str:
        return f"{root}/data/" + "/".join(f"{k}={v}" for k, v in asdict(self).items())


def fingerprint(df: DataFrame) -> str:
    """Of the rows, whatever their order, and of the schema."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}-{row.h}-{df.schema.simpleString()}"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def write(self, df: DataFrame, schema: str, part: Partition) -> dict:
        """Writing the same again changes nothing; other content under the same name is an error."""
        df = schemas.validate(df, schema)
        path, mark = part.path(self.root), fingerprint(df)
        held = self.manifest(part)
        if held is not None:
            if held["fingerprint"] != mark or held["schema"] != schema:
                raise FileExistsError(path)
            return held
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(staged)
        fs, to = self._fs(path)
        fs.mkdirs(to.getParent())
        if not fs.rename(self._fs(staged)[1], to):
            raise OSError(f"{staged} could not be moved to {path}")
        entry = asdict(part) | {"schema": schema, "fingerprint": mark, "rows": int(mark.split("-")[0]), "columns": df.columns}
        line = self.spark.createDataFrame([(json.dumps(entry),)], "entry string")
        line.coalesce(1).write.mode("append").text(f"{self.root}/catalog")
        return entry

    def catalog(self, dataset: str | None = None) -> DataFrame:
        """The latest entry of each partition."""
        if not self.exists(f"{self.root}/catalog"):
            return self.spark.createDataFrame([], "dataset string, source string, asset_class string, date string, version string, schema string, fingerprint string, rows long, columns array<string>")
        kind = "dataset string, source string, asset_class string, date string, version string, schema string, fingerprint string, rows long, columns array<string>"
        t = self.spark.read.text(f"{self.root}/catalog").select(F.from_json("value", kind).alias("e"), F.col("_metadata.file_modification_time").alias("at")).select("e.*", "at")
        keys = ["dataset", "source", "asset_class", "date", "version"]
        t = t.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("at").desc()))).filter("_n = 1").drop("_n", "at")
        return (t.filter(F.col("dataset") == dataset) if dataset else t).orderBy(*keys)

    def manifest(self, part: Partition) -> dict | None:
        cond = F.lit(True)
        for k, v in asdict(part).items():
            cond = cond & (F.col(k) == v)
        row = self.catalog().filter(cond).first()
        return row.asDict() if row else None

    def scan(self, schema: str, columns: list[str] | None = None, part: Partition | None = None) -> DataFrame:
        """All partitions of the dataset of that name, or one, checked against its manifest's schema."""
        st = schemas.project(schemas.schema(schema), columns)
        if part is not None:
            held = self.manifest(part)
            if held is None or held["schema"] != schema:
                raise ValueError(f"{part} holds no {schema}")
            return self.spark.read.schema(schemas.schema(schema)).parquet(part.path(self.root)).select(*st.names)
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(f"{self.root}/data/dataset={schema}").select(*st.names)

    def query(self, sql: str, **views: DataFrame) -> DataFrame:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(sql)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: parquet, csv, json (whole or by lines), orc, and feather through Arrow."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind in ("feather", "arrow"):
        import pyarrow.feather as feather

        return spark.createDataFrame(feather.read_table(path))
    raise ValueError(f"no reader for {path}")
