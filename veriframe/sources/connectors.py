"""Sources and sinks: files, catalog tables and databases behind one small interface."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.errors import SourceError
from veriframe.functions.ruletext import first_line
from veriframe.operators.frames import view
from veriframe.sources.jdbc import jdbc_options

log = logging.getLogger(__name__)

# File formats and write modes that are accepted.
FILE_FORMATS = ("parquet", "csv", "json")
WRITE_MODES = ("overwrite", "append", "error", "ignore")


class Source(ABC):
    """A place tables are read from and results are written to."""

    def __init__(self, config: Mapping, spark: SparkSession):
        self.config = dict(config)
        self.spark = spark

    @abstractmethod
    def _table(self, table: str, schema: str | None) -> DataFrame: ...

    def _query(self, query: str) -> DataFrame:
        raise SourceError(f"{type(self).__name__} cannot run a query; name a table")

    @abstractmethod
    def _save(self, df: DataFrame, destination: str, mode: str, partition_by: list[str]) -> None: ...

    def read_data(
        self,
        query: str | None = None,
        table: str | None = None,
        schema: str | None = None,
        filters: Mapping | None = None,
        columns: Sequence[str] | None = None,
        limit: int | None = None,
    ) -> DataFrame:
        """A lazy view of a query (which wins) or a table: filtered, then projected, then limited."""
        if query:
            df = self._query(query)
        elif table:
            df = self._table(table, schema)
        else:
            raise SourceError("name a query or a table")
        return view(df, filters, columns, limit)

    def write_results(
        self,
        df: DataFrame,
        destination: str,
        mode: str = "overwrite",
        partition_by: Sequence[str] | None = None,
    ) -> None:
        if mode not in WRITE_MODES:
            raise SourceError(f"unknown write mode: {mode}")
        self._save(df, destination, mode, list(partition_by or []))

    def get_schema(self, table: str, schema: str | None = None) -> dict[str, str]:
        """Column names and their Spark types; no rows are read."""
        return {f.name: f.dataType.simpleString() for f in self._table(table, schema).schema}

    def probe(self) -> dict:
        """Whether the source can be reached, and why not: {ok, error}."""
        try:
            self._probe()
        except Exception as e:
            return {"ok": False, "error": first_line(e)}
        return {"ok": True, "error": None}

    def test_connection(self) -> bool:
        return self.probe()["ok"]

    def _probe(self) -> None:
        self.spark.sql("SELECT 1").first()

    def _require(self, *names: str) -> None:
        missing = [n for n in names if not self.config.get(n)]
        if missing:
            raise SourceError(f"missing in the source configuration: {', '.join(missing)}")


class FileSource(Source):
    """Parquet, CSV or JSON-lines files below a bucket or any other root folder."""

    def __init__(self, config: Mapping, spark: SparkSession):
        super().__init__(config, spark)
        if not self.config.get("root"):
            self._require("bucket")
        self.root = self.config.get("root") or f"s3a://{self.config['bucket']}"
        self.format = self.config.get("format") or "parquet"
        if self.format not in FILE_FORMATS:
            raise SourceError(f"unsupported file format: {self.format}")

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table.lstrip('/')}"

    def _options(self) -> dict[str, str]:
        """Access settings of this source only; they never reach the session."""
        settings = {
            "fs.s3a.access.key": self.config.get("access_key_id"),
            "fs.s3a.secret.key": self.config.get("secret_access_key"),
            "fs.s3a.endpoint.region": self.config.get("region"),
        }
        return {k: v for k, v in settings.items() if v} if self.root.startswith("s3a:") else {}

    def read_stream(self, table: str, files_per_batch: int | None = None) -> DataFrame:
        """New files of a table as a stream, with the types the table has now."""
        reader = self.spark.readStream.format(self.format).options(**self._options())
        if self.format == "csv":
            reader = reader.option("header", True)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.schema(self._table(table).schema).load(self.path(table))

    def list_files(self, table: str) -> DataFrame:
        """(path, file_path, modified) of the table's files; a listing, no content is read."""
        found = self.spark.read.format("binaryFile").options(**self._options()).option("recursiveFileLookup", True).load(self.path(table))
        return found.select("path", "_metadata.file_path", F.col("_metadata.file_modification_time").alias("modified"))

    def read_files(self, table: str, paths: Sequence[str]) -> DataFrame:
        """Some files of a table, with the types the table has now, and _file_path and _file_modified of each row's file."""
        whole = self._table(table)
        reader = self.spark.read.format(self.format).options(**self._options()).schema(whole.schema)
        if self.format == "csv":
            reader = reader.option("header", True)
        if not any(path.endswith(self.path(table)) for path in paths):
            reader = reader.option("basePath", self.path(table))
        df = reader.load(list(paths))
        of_file = df.metadataColumn("_metadata")
        return df.select("*", of_file["file_path"].alias("_file_path"), of_file["file_modification_time"].alias("_file_modified"))

    def _table(self, table: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.format(self.format).options(**self._options())
        if self.format == "csv":
            reader = reader.option("header", True)
        # A declared schema saves the extra pass over the files that inference needs.
        declared = self.config.get("table_schema")
        if declared:
            reader = reader.schema(declared)
        elif self.format == "csv":
            reader = reader.option("inferSchema", True)
        return reader.load(self.path(table))

    def _save(self, df, destination, mode, partition_by):
        writer = df.write.format(self.format).mode(mode).options(**self._options())
        if self.format == "csv":
            writer = writer.option("header", True)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(self.path(destination))

    def _probe(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(conf).exists(path):
            raise SourceError(f"no such folder: {self.root}")


class CatalogSource(Source):
    """Tables of a catalog the session knows, by `catalog.schema.table`, or any SQL query."""

    def __init__(self, config: Mapping, spark: SparkSession):
        super().__init__(config, spark)
        self._require("server_hostname", "http_path", "access_token")
        self.catalog = self.config.get("catalog") or "hive_metastore"
        self.schema = self.config.get("schema") or "default"

    def name(self, table: str, schema: str | None = None) -> str:
        return f"{self.catalog}.{schema or self.schema}.{table}"

    def _table(self, table, schema=None):
        return self.spark.table(self.name(table, schema))

    def _query(self, query):
        return self.spark.sql(query)

    def _save(self, df, destination, mode, partition_by):
        writer = df.write.mode(mode)
        if self.config.get("path"):
            writer = writer.option("path", f"{self.config['path'].rstrip('/')}/{destination}")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(destination if "." in destination else self.name(destination))


class JdbcSource(Source):
    """Tables and queries of a database, read in parallel when a partition column is named."""

    def __init__(self, config: Mapping, spark: SparkSession, kind: str):
        super().__init__(config, spark)
        self.kind = kind
        self.options, self.schema = jdbc_options(kind, self.config)

    def _reader(self, **options):
        return self.spark.read.format("jdbc").options(**self.options, **options)

    def partition_options(self, table: str) -> dict[str, str]:
        """Options that split the read into ranges of one column; bounds are looked up if not given."""
        column = self.config.get("partition_column")
        if not column:
            return {}
        low, high = self.config.get("lower_bound"), self.config.get("upper_bound")
        if low is None or high is None:
            bounds = f"SELECT min({column}) AS low, max({column}) AS high FROM {table}"
            low, high = self._reader(query=bounds).load().first()
        if low is None:
            return {}
        return {
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(self.config.get("num_partitions") or 64),
        }

    def full_name(self, table: str, schema: str | None = None) -> str:
        schema = schema or self.schema
        return f"{schema}.{table}" if schema else table

    def _table(self, table, schema=None):
        name = self.full_name(table, schema)
        return self._reader(dbtable=name, **self.partition_options(name)).load()

    def _query(self, query):
        """The rows of a query; it must return `partition_column` if the source names one."""
        inner = f"({query}) q"
        ranges = self.partition_options(inner)
        if ranges:
            return self._reader(dbtable=inner, **ranges).load()
        return self._reader(query=query).load()

    def write_options(self, destination: str, partition_by: Sequence[str]) -> dict[str, str]:
        options = {**self.options, "dbtable": destination}
        if self.kind == "redshift":
            self._require("s3_temp_dir")
            options["tempdir"] = self.config["s3_temp_dir"]
            if partition_by:
                options["distkey"] = partition_by[0]
        return options

    def _save(self, df, destination, mode, partition_by):
        if partition_by and self.kind != "redshift":
            log.warning("%s tables are not written in partitions; ignoring %s", self.kind, partition_by)
        options = self.write_options(destination, partition_by)
        df.write.format("jdbc").mode(mode).options(**options).save()

    def _probe(self):
        dual = " FROM dual" if self.kind == "oracle" else ""
        self._reader(query=f"SELECT 1 AS test{dual}").load().first()


class FormatSource(Source):
    """Any other Spark format, such as a Python data source registered with the session."""

    def __init__(self, config: Mapping, spark: SparkSession):
        super().__init__(config, spark)
        self._require("format")

    def _table(self, table, schema=None):
        reader = self.spark.read.format(self.config["format"])
        return reader.options(**self.config.get("options", {})).option("table", table).load()

    def _save(self, df, destination, mode, partition_by):
        writer = df.write.format(self.config["format"]).mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.options(**self.config.get("options", {})).save(destination)


def _jdbc(kind):
    return lambda config, spark: JdbcSource(config, spark, kind)


_SOURCES = {
    "databricks": CatalogSource,
    "s3": FileSource,
    "format": FormatSource,
    **{k: _jdbc(k) for k in
       ("sqlserver", "teradata", "redshift", "aurora_postgresql", "mysql", "oracle")},
}


def supported_sources() -> list[str]:
    return sorted(_SOURCES)


def create_source(source_type: str, config: Mapping, spark: SparkSession) -> Source:
    """The source of the given type (any letter case)."""
    build = _SOURCES.get(source_type.lower())
    if build is None:
        raise SourceError(
            f"unsupported source type: {source_type}; supported: {', '.join(supported_sources())}"
        )
    return build(config, spark)


def register_source(source_type: str, build) -> None:
    """Add or replace a source type; `build(config, spark)` returns a `Source`."""
    _SOURCES[source_type.lower()] = build


def describe(df: DataFrame) -> DataFrame:
    """The schema as rows (column_name, data_type)."""
    pairs = [F.struct(F.lit(f.name), F.lit(f.dataType.simpleString())) for f in df.schema]
    one = df.sparkSession.range(1)
    return one.select(F.inline(F.array(*pairs)).alias("column_name", "data_type"))
