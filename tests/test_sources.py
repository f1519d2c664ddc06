import pytest
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veriframe.errors import SourceError
from veriframe.operators.frames import apply_filters, view
from veriframe.sources.connectors import (
    CatalogSource, FileSource, JdbcSource, Source, create_source, describe, register_source,
    supported_sources,
)
from veriframe.sources.jdbc import PRESETS, jdbc_options

DB = {"database": "d", "username": "u", "password": "p"}


def test_dispatch(spark):
    source = create_source("S3", {"bucket": "test-bucket", "region": "us-east-1"}, spark)
    assert isinstance(source, FileSource) and source.path("/users/part") == "s3a://test-bucket/users/part"
    assert source.format == "parquet"
    assert isinstance(create_source("redshift", {"host": "h", **DB}, spark), JdbcSource)
    with pytest.raises(SourceError, match="aurora_postgresql"):
        create_source("unsupported", {}, spark)
    assert set(PRESETS) < set(supported_sources())


@pytest.mark.parametrize("kind,config", [
    ("s3", {}), ("s3", {"bucket": "b", "format": "xml"}), ("redshift", {"host": "h"}),
    ("databricks", {"server_hostname": "h"}), ("sqlserver", {"host": "h", **DB}),
])
def test_incomplete_configuration(spark, kind, config):
    with pytest.raises(SourceError):
        create_source(kind, config, spark)


@pytest.mark.parametrize("kind,config,url,schema,driver", [
    ("sqlserver", {"server": "h"}, "jdbc:sqlserver://h:1433;database=d;encrypt=true;trustServerCertificate=false",
     "dbo", None),
    ("sqlserver", {"server": "h", "port": 1, "encrypt": False, "trust_server_certificate": True, "schema": "s"},
     "jdbc:sqlserver://h:1;database=d;encrypt=false;trustServerCertificate=true", "s", None),
    ("teradata", {"host": "h"}, "jdbc:teradata://h/DATABASE=d,LOGMECH=LDAP", "d", "com.teradata.jdbc.TeraDriver"),
    ("redshift", {"host": "h"}, "jdbc:redshift://h:5439/d", "public", "com.amazon.redshift.jdbc.Driver"),
    ("aurora_postgresql", {"host": "h"}, "jdbc:postgresql://h:5432/d?sslmode=require", "public",
     "org.postgresql.Driver"),
    ("mysql", {"host": "h"}, "jdbc:mysql://h:3306/d", None, "com.mysql.cj.jdbc.Driver"),
    ("oracle", {"host": "h"}, "jdbc:oracle:thin:@//h:1521/d", None, "oracle.jdbc.OracleDriver"),
])
def test_jdbc_presets(kind, config, url, schema, driver):
    options, default = jdbc_options(kind, {**DB, **config})
    assert (options["url"], default, options.get("driver")) == (url, schema, driver)
    assert (options["user"], options["password"]) == ("u", "p")


def test_jdbc_partitions_and_write_options(spark):
    config = {"host": "h", **DB, "partition_column": "id", "lower_bound": 1, "upper_bound": 9, "num_partitions": 3}
    source = create_source("aurora_postgresql", config, spark)
    assert source.full_name("t") == "public.t" and source.full_name("t", "s") == "s.t"
    assert source.partition_options("public.t") == {
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "9", "numPartitions": "3"}
    plain = create_source("redshift", {"host": "h", **DB}, spark)
    assert plain.partition_options("public.t") == {}
    with pytest.raises(SourceError, match="s3_temp_dir"):
        plain.write_options("t", [])
    staged = create_source("redshift", {"host": "h", **DB, "s3_temp_dir": "s3a://tmp/x"}, spark)
    options = staged.write_options("t", ["k", "l"])
    assert options["tempdir"] == "s3a://tmp/x" and options["distkey"] == "k" and options["dbtable"] == "t"
    assert not plain.test_connection()


def test_jdbc_query_in_ranges(spark, monkeypatch):
    asked = []

    class Reader:
        def load(self):
            return "rows"

    monkeypatch.setattr(JdbcSource, "_reader", lambda self, **options: asked.append(options) or Reader())
    config = {"host": "h", **DB, "partition_column": "id", "lower_bound": 1, "upper_bound": 9, "num_partitions": 3}
    assert create_source("mysql", config, spark)._query("SELECT id FROM t") == "rows"
    create_source("mysql", {"host": "h", **DB}, spark)._query("SELECT id FROM t")
    assert asked == [
        {"dbtable": "(SELECT id FROM t) q", "partitionColumn": "id", "lowerBound": "1", "upperBound": "9", "numPartitions": "3"},
        {"query": "SELECT id FROM t"}]


def test_teradata_port_reaches_the_url():
    options, _ = jdbc_options("teradata", {"host": "h", **DB, "port": 1026})
    assert options["url"] == "jdbc:teradata://h/DATABASE=d,LOGMECH=LDAP,DBS_PORT=1026"


def test_filters_and_projection(users):
    assert apply_filters(users, {"age": {"gte": 30}}).count() == 2
    assert apply_filters(users, {"age": {"gt": 25, "lt": 35}, "name": ["Jane Smith", "Alice Brown"]}).count() == 2
    assert apply_filters(users, {"email": "invalid-email"}).count() == 1
    assert apply_filters(users, {"email": {"lte": "zzz"}}).count() == 3
    assert view(users, columns=["email", "name"]).columns == ["email", "name"]
    assert view(users, {"age": {"gte": 30}}, ["name"], 1).collect()[0].asDict().keys() == {"name"}
    with pytest.raises(ValueError):
        apply_filters(users, {"age": {"above": 30}})


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_files_there_and_back(spark, users, tmp_path, fmt):
    source = create_source("s3", {"root": str(tmp_path), "format": fmt}, spark)
    source.write_results(users, "users", partition_by=["age"])
    back = source.read_data(table="users", filters={"age": 30}, columns=["email", "age"])
    assert [tuple(r) for r in back.collect()] == [("user2@example.com", 30)]
    types = source.get_schema("users")
    assert types["email"] == "string" and types["age"] == "int"
    source.write_results(users, "users", mode="ignore", partition_by=["age"])
    source.write_results(users, "users", mode="append", partition_by=["age"])
    assert source.read_data(table="users").count() == 8
    assert source.test_connection()
    with pytest.raises(SourceError):
        source.write_results(users, "users", mode="merge")
    with pytest.raises(SourceError):
        source.read_data()
    with pytest.raises(SourceError):
        source.read_data(query="SELECT 1")


def test_declared_schema(spark, users, tmp_path):
    create_source("s3", {"root": str(tmp_path), "format": "csv"}, spark).write_results(users, "u")
    declared = {"root": str(tmp_path), "format": "csv", "table_schema": "email string, name string, age bigint"}
    df = create_source("s3", declared, spark).read_data(table="u")
    assert dict(df.dtypes) == {"email": "string", "name": "string", "age": "bigint"}
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in users.collect()}


def test_missing_folder_is_not_reachable(spark, tmp_path):
    source = create_source("s3", {"root": str(tmp_path / "nothing")}, spark)
    assert not source.test_connection() and "no such folder" in source.probe()["error"]


def test_catalog(spark, users):
    config = {"server_hostname": "h", "http_path": "/", "access_token": "t", "catalog": "spark_catalog"}
    source = create_source("databricks", config, spark)
    assert isinstance(source, CatalogSource) and source.name("t") == "spark_catalog.default.t"
    assert create_source("databricks", {**config, "catalog": None}, spark).name("t") == "hive_metastore.default.t"
    source.write_results(users, "checked_users", partition_by=["age"])
    assert source.read_data(table="checked_users", filters={"age": {"gte": 30}}).count() == 2
    by_query = source.read_data(query="SELECT * FROM checked_users WHERE age < 30", table="ignored")
    assert by_query.count() == 2
    assert source.get_schema("checked_users")["age"] == "bigint"
    assert source.test_connection()
    spark.sql("DROP TABLE checked_users")


class Numbers(DataSource):
    """A Python data source that makes rows in several partitions."""

    @classmethod
    def name(cls):
        return "numbers"

    def schema(self):
        return "n bigint, source_table string"

    def reader(self, schema):
        return NumbersReader(int(self.options["upto"]), self.options["table"])


class NumbersReader(DataSourceReader):
    def __init__(self, upto, table):
        self.upto, self.table = upto, table

    def partitions(self):
        return [InputPartition(start) for start in range(0, self.upto, 10)]

    def read(self, partition):
        for n in range(partition.value, min(partition.value + 10, self.upto)):
            yield n, self.table


def test_custom_sources(spark, users):
    spark.dataSource.register(Numbers)
    source = create_source("format", {"format": "numbers", "options": {"upto": "25"}}, spark)
    assert source.read_data(table="t", filters={"n": {"gte": 5}}).count() == 20

    class Fixed(Source):
        def _table(self, table, schema=None):
            return users

        def _save(self, df, destination, mode, partition_by):
            raise NotImplementedError

    register_source("Fixed", Fixed)
    assert create_source("fixed", {}, spark).read_data(table="any").count() == 4
    assert {r.column_name: r.data_type for r in describe(users).collect()} == {
        "email": "string", "name": "string", "age": "bigint"}


def test_rows_written_by_rule_are_not_sorted(spark):
    spark.sql("CREATE TABLE by_rule (x BIGINT, rule_id STRING) USING parquet PARTITIONED BY (rule_id)")
    try:
        plan = spark.sql("EXPLAIN INSERT INTO by_rule SELECT id, concat('r', id % 20) FROM range(100)").first()[0]
        assert "InsertIntoHadoopFsRelationCommand" in plan and "Sort" not in plan
        spark.sql("INSERT INTO by_rule SELECT id, concat('r', id % 20) FROM range(0, 100, 1, 1)")  # more rules than open files
        assert spark.table("by_rule").distinct().count() == 100
    finally:
        spark.sql("DROP TABLE by_rule")
