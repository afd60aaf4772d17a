"""Where tables go: a SQLite file, a JDBC database, catalog tables or a folder of Parquet files, chosen by the URL.

A load is staged first and committed last: SQLite in one transaction; the others by appends that follow the staging of
every table (so that only a failure between appends leaves a part). Names are quoted. Tables of SQLite and JDBC
databases have foreign keys to the tables they refer to (of JDBC ones, not to themselves).
"""

from __future__ import annotations

import logging
import re
from decimal import Decimal
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabloom.errors import DatabaseError
from tabloom.operators.relate import TableModel

statements = logging.getLogger("tabloom.sql")


def open_sink(spark: SparkSession, url: str, **options: str) -> "Sink":
    """``sqlite:///file`` (also with a driver name, as in sqlite+x), ``jdbc:...``, ``postgresql://...``, ``mysql://...``,
    ``catalog:<schema>`` or ``parquet:<folder>``."""
    kind, _, rest = url.partition(":")
    base = kind.split("+")[0]
    if base == "sqlite":
        return SqliteSink(spark, re.sub(r"^//(?:/)?", "", rest) or ":memory:")
    if base in ("postgresql", "postgres", "mysql"):
        return JdbcSink(spark, _jdbc(base, rest), **options)
    if base == "jdbc":
        return JdbcSink(spark, url, **options)
    if base == "catalog":
        return CatalogSink(spark, rest or "default")
    if base == "parquet":
        return ParquetSink(spark, rest)
    raise DatabaseError(f"can't use the database URL {url!r}")


def _jdbc(base: str, rest: str) -> str:
    m = re.fullmatch(r"//(?:([^:@/]*)(?::([^@/]*))?@)?([^/]+)/(.+)", rest)
    if not m:
        raise DatabaseError("the database URL needs a host and a database name")
    # Credentials are escaped in the one form and in the other.
    user = "".join(f"{'&' if i or '?' in m[4] else '?'}{k}={quote(unquote(v), safe='')}" for i, (k, v) in enumerate((k, v) for k, v in (("user", m[1]), ("password", m[2])) if v))
    return f"jdbc:{'mysql' if base == 'mysql' else 'postgresql'}://{m[3]}/{m[4]}{user}"


class Sink:
    """A set of tables. ``read`` is None for a table that isn't there."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def exists(self, table: str) -> bool:
        raise NotImplementedError

    def create(self, model: TableModel, keys: dict[str, str] | None = None) -> None:
        """``keys``: the key column of each table that others may refer to."""
        raise NotImplementedError

    def read(self, model: TableModel, columns: list[str]) -> DataFrame | None:
        raise NotImplementedError

    def append(self, tables: dict[str, DataFrame], models: dict[str, TableModel]) -> None:
        raise NotImplementedError

    def close(self) -> None:
        """Lets go of what is open."""

    def create_all(self, models: dict[str, TableModel]) -> None:
        """Creates the tables that aren't there, those that others refer to first."""
        keys, left = {m.name: m.primary_key[0] for m in models.values() if len(m.primary_key) == 1}, dict(models)
        while left:
            ready = [n for n, m in left.items() if not any(t in left and t != n for t in m.references.values())] or list(left)
            for name in ready:
                m = left.pop(name)
                if not self.exists(m.name):
                    self.create(m, keys)

    def verify(self, names: list[str]) -> None:
        missing = sorted(n for n in names if not self.exists(n))
        if missing:
            raise DatabaseError(f"Missing tables: {missing}; --create-tables makes them")


def _sql_type(kind: T.DataType, text: str) -> str:
    if isinstance(kind, T.VarcharType):
        return f"VARCHAR({kind.length})"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    names = {T.LongType: "BIGINT", T.DoubleType: "DOUBLE PRECISION", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP"}
    return names.get(type(kind), text)


def quoted(name: str, mark: str = '"') -> str:
    """An identifier, so that words like order and names with spaces will do."""
    return mark + name.replace(mark, 2 * mark) + mark


def ddl(model: TableModel, keys: dict[str, str] | None = None, mark: str = '"') -> str:
    """CREATE TABLE with the primary key, and references to the key columns in ``keys`` (table: column)."""
    q = lambda name: quoted(name, mark)
    parts = [f"{q(f.name)} {_sql_type(f.dataType, 'VARCHAR(255)')}{'' if f.nullable else ' NOT NULL'}" for f in model.schema]
    parts.append(f"PRIMARY KEY ({', '.join(map(q, model.primary_key))})")
    parts += [f"FOREIGN KEY ({q(c)}) REFERENCES {q(t)} ({q(keys[t])})" for c, t in model.references.items() if keys and t in keys]
    return f"CREATE TABLE {q(model.name)} ({', '.join(parts)})"


class SqliteSink(Sink):
    """A SQLite file on the driver. Rows stream through the driver into one transaction; it's meant for small loads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        import sqlite3

        super().__init__(spark)
        try:
            self.db = sqlite3.connect(path)
        except sqlite3.Error as e:
            raise DatabaseError(f"can't open {path}: {e}") from e

    def exists(self, table: str) -> bool:
        return bool(self.db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", [table]).fetchone())

    def create(self, model: TableModel, keys: dict[str, str] | None = None) -> None:
        sql = ddl(model, keys)
        statements.info(sql)
        self.db.execute(sql)
        self.db.commit()

    def read(self, model: TableModel, columns: list[str]) -> DataFrame | None:
        if not self.exists(model.name):
            return None
        sql = f"SELECT {', '.join(map(quoted, columns))} FROM {quoted(model.name)}"
        statements.info(sql)
        rows = self.db.execute(sql).fetchall()
        schema = T.StructType([T.StructField(c, T.LongType() if isinstance(model.schema[c].dataType, T.LongType) else T.StringType()) for c in columns])
        made = self.spark.createDataFrame([tuple(x if x is None or isinstance(f.dataType, T.LongType) else str(x) for x, f in zip(r, schema, strict=True)) for r in rows], schema)
        return made.select(*[made[c].try_cast(_plain(model.schema[c].dataType)).alias(c) for c in columns])

    def append(self, tables: dict[str, DataFrame], models: dict[str, TableModel]) -> None:
        import sqlite3

        try:
            with self.db:
                for name, df in tables.items():
                    sql = f"INSERT INTO {quoted(name)} ({', '.join(map(quoted, df.columns))}) VALUES ({', '.join('?' * len(df.columns))})"
                    statements.info(sql)
                    self.db.executemany(sql, (tuple(str(x) if isinstance(x, Decimal) or hasattr(x, "isoformat") else x for x in r) for r in df.toLocalIterator()))
        except sqlite3.Error as e:
            raise DatabaseError(f"the load failed and was undone: {e}") from e

    def close(self) -> None:
        self.db.close()


def _plain(kind: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(kind, T.VarcharType) else kind


class JdbcSink(Sink):
    """Any database with a JDBC driver on the classpath."""

    def __init__(self, spark: SparkSession, url: str, **options: str) -> None:
        super().__init__(spark)
        self.url, self.options = url, {"batchsize": "5000", **options}
        if ":derby:" in url:
            self.options.setdefault("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver")

    def _connect(self):
        jvm = self.spark._jvm
        try:
            if "driver" in self.options:
                jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
            return jvm.java.sql.DriverManager.getConnection(self.url)
        except Exception as e:
            raise DatabaseError(f"can't connect to {self.url.split('?')[0]}: {str(e).splitlines()[0]}") from e

    def _frame(self, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=table, **self.options).load()

    @property
    def mark(self) -> str:
        return "`" if self.url.startswith("jdbc:mysql:") else '"'

    def exists(self, table: str) -> bool:
        """Whether the connection's own schema has the table."""
        connection = self._connect()
        try:
            found = connection.getMetaData().getTables(connection.getCatalog(), connection.getSchema(), None, None)
            while found.next():
                if found.getString("TABLE_NAME").lower() == table.lower():
                    return True
            return False
        finally:
            connection.close()

    def create(self, model: TableModel, keys: dict[str, str] | None = None) -> None:
        connection = self._connect()
        try:
            # Tasks append side by side, so that a row may come before the row of its own table that it refers to.
            sql = ddl(model, {t: c for t, c in (keys or {}).items() if t != model.name}, self.mark)
            statements.info(sql)
            connection.createStatement().executeUpdate(sql)
        except Exception as e:
            raise DatabaseError(f"can't create {model.name}: {str(e).splitlines()[0]}") from e
        finally:
            connection.close()

    def read(self, model: TableModel, columns: list[str]) -> DataFrame | None:
        if not self.exists(model.name):
            return None
        found = self._frame(quoted(model.name, self.mark))
        by = {c.lower(): c for c in found.columns}
        return found.select(*[found[by[c.lower()]].alias(c) for c in columns])

    def append(self, tables: dict[str, DataFrame], models: dict[str, TableModel]) -> None:
        try:
            for name, df in tables.items():
                df.write.format("jdbc").mode("append").options(url=self.url, dbtable=quoted(name, self.mark), **self.options).save()
        except Exception as e:
            raise DatabaseError(f"the load failed: {str(e).splitlines()[0]}") from e


class CatalogSink(Sink):
    """Parquet tables of a catalog schema."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        super().__init__(spark)
        self.schema = schema

    def _name(self, table: str) -> str:
        return f"`{self.schema}`.`{table}`"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self._name(table))

    def create(self, model: TableModel, keys: dict[str, str] | None = None) -> None:
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{self.schema}`")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in model.schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(model.name)} ({columns}) USING parquet")

    def read(self, model: TableModel, columns: list[str]) -> DataFrame | None:
        return self.spark.table(self._name(model.name)).select(*columns) if self.exists(model.name) else None

    def append(self, tables: dict[str, DataFrame], models: dict[str, TableModel]) -> None:
        try:
            for name, df in tables.items():
                df.write.mode("append").insertInto(self._name(name))
        except Exception as e:
            raise DatabaseError(f"the load failed: {str(e).splitlines()[0]}") from e


class ParquetSink(Sink):
    """A folder for each table."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark)
        self.folder = folder.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def exists(self, table: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def create(self, model: TableModel, keys: dict[str, str] | None = None) -> None:
        schema = T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in model.schema])
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(self._path(model.name))

    def read(self, model: TableModel, columns: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(self._path(model.name)).select(*columns) if self.exists(model.name) else None

    def append(self, tables: dict[str, DataFrame], models: dict[str, TableModel]) -> None:
        try:
            for name, df in tables.items():
                df.write.mode("append").parquet(self._path(name))
        except Exception as e:
            raise DatabaseError(f"the load failed: {str(e).splitlines()[0]}") from e
