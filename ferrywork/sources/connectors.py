"""Named connectors as Spark reader and writer options."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Connector:
    """A Spark data source and its default options."""

    format: str
    options: dict = field(default_factory=dict)
    url: str = ""
    port: int | None = None


# Driver classes, URL forms and default ports.
CONNECTORS: dict[str, Connector] = {
    "mysql": Connector("jdbc", {"driver": "com.mysql.cj.jdbc.Driver", "rewriteBatchedStatements": "true"}, "jdbc:mysql://{host}:{port}/{database}", 3306),
    "mariadb": Connector("jdbc", {"driver": "org.mariadb.jdbc.Driver", "rewriteBatchedStatements": "true"}, "jdbc:mariadb://{host}:{port}/{database}", 3306),
    "postgresql": Connector("jdbc", {"driver": "org.postgresql.Driver", "reWriteBatchedInserts": "true"}, "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "clickhouse": Connector("jdbc", {"driver": "com.clickhouse.jdbc.ClickHouseDriver"}, "jdbc:clickhouse://{host}:{port}/{database}", 8123),
    "mongodb": Connector("mongodb", {}, "mongodb://{host}:{port}", 27017),
    "parquet": Connector("parquet"),
    "orc": Connector("orc"),
    "json": Connector("json"),
    "csv": Connector("csv", {"header": "true"}),
}


def register_connector(name: str, connector: Connector) -> None:
    CONNECTORS[name] = connector


def list_connectors() -> list[str]:
    return sorted(CONNECTORS)


def get_connector(name: str) -> Connector:
    if name not in CONNECTORS:
        raise ValueError(f"unknown connector {name!r}; available: {', '.join(list_connectors())}")
    return CONNECTORS[name]


def connector_options(name: str, config: dict) -> dict:
    """Reader/writer options for one connection config.

    ``config`` holds host, port, database, user, password, ssl, and anything
    else is passed on as it is. Port 9000 of ClickHouse is its native protocol;
    the driver speaks HTTP, so 8123 is used in its place.
    """
    connector = get_connector(name)
    known = {k: config[k] for k in ("user", "password") if config.get(k) is not None}
    rest = {k: v for k, v in config.items() if k not in ("host", "port", "database", "user", "password", "ssl", "type")}
    options = {**connector.options, **known, **{k: str(v) for k, v in rest.items()}}
    if connector.url and "url" not in options:
        port = config.get("port") or connector.port
        if name == "clickhouse" and port == 9000:
            port = 8123
        url = connector.url.format(host=config["host"], port=port, database=config.get("database", ""))
        options["connection.uri" if connector.format == "mongodb" else "url"] = url
    if config.get("ssl"):
        options["ssl"] = "true"
    return options


def read_table(
    spark: SparkSession,
    name: str,
    config: dict,
    table: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Lazy frame over one source table.

    For JDBC give a numeric, date or timestamp ``partition_column``: the read is
    then split into ``partitions`` range queries between ``bounds``, which are
    looked up where they are not given. Without a column one task reads it all,
    which suits small tables only. Filters and columns are pushed to the
    database by Spark.
    """
    connector = get_connector(name)
    reader = spark.read.format(connector.format).options(**connector_options(name, config))
    if connector.format == "jdbc":
        reader = reader.option("dbtable", table).option("fetchsize", fetch_size)
        if partition_column:
            low, high = bounds or column_bounds(jdbc_reader(spark, name, config), table, partition_column)
            if low is None:
                return reader.load()
            reader = reader.options(
                partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)
            )
        return reader.load()
    if connector.format == "mongodb":
        return reader.option("collection", table).load()
    return reader.load(table)


def column_bounds(query, table: str, column: str) -> tuple:
    """Least and greatest value of a column; ``query`` maps SQL to a frame."""
    row = query(f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}").first()
    return tuple(row)


def jdbc_reader(spark: SparkSession, name: str, config: dict):
    """``query -> frame`` for catalogue queries against a JDBC source."""
    options = connector_options(name, config)
    return lambda query: spark.read.format("jdbc").options(**options).option("query", query).load()


def write_table(df: DataFrame, name: str, config: dict, table: str, mode: str = "append", batch_size: int = 10_000, max_connections: int = 32) -> None:
    """Append or overwrite one destination table.

    JDBC writes are capped at ``max_connections`` tasks, so a wide job does not
    swamp the database.
    """
    connector = get_connector(name)
    writer_options = connector_options(name, config)
    if connector.format == "jdbc":
        df.write.format("jdbc").options(**writer_options).option("dbtable", table).option("batchsize", batch_size).option(
            "numPartitions", max_connections
        ).mode(mode).save()
    elif connector.format == "mongodb":
        df.write.format("mongodb").options(**writer_options).option("collection", table).mode(mode).save()
    else:
        df.write.format(connector.format).options(**writer_options).mode(mode).save(table)
