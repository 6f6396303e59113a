"""Queries that run over a folder of tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.session import materialize

_SCHEMAS: dict[tuple[str, str], T.StructType] = {}
_STORED: dict[tuple[str, str, str], DataFrame] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Named SQL views the oracles may use: name -> select text; those computed once, however often they are named.
VIEWS: dict[str, str] = {}
SHARED: set[str] = set()


class Tables:
    """The given tables by name, read lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        """The schema is read from the footers once per session; later reads only list files."""
        path = f"{self.folder}/{name}.parquet"
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    def stored(self, name: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
        """A derived table that loads leave behind and read queries start from.

        The first query of a session that needs it runs the load and writes it to the shared folder.
        """
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            _STORED[key] = materialize(build(self), name)
        return _STORED[key]


def presentable(df: DataFrame) -> DataFrame:
    """Types every engine prints alike: dates as text, doubles to six decimals, counts as bigint."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def view(name: str, text: str, shared: bool = False) -> None:
    VIEWS[name] = text.strip()
    if shared:
        SHARED.add(name)


def fingerprint_sql(source: str, columns: list[str]) -> str:
    """SQL of vintage.fingerprint over the rows of a view."""
    row = " || ".join(f"coalesce(length(({c})::varchar) || ':' || ({c})::varchar, '-')" for c in columns)
    sums = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint), 0) as p{i}" for i in range(4))
    return f"""
      select n as rows, sha256(n || '-' || p0 || '-' || p1 || '-' || p2 || '-' || p3) as digest
      from (select count(*) as n, {sums} from (select md5({row}) as h from {source}))
    """


def with_views(body: str) -> str:
    """Prefixes the views that a statement uses, each after the ones it depends on."""
    ordered: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b[a-z_][a-z0-9_]*\b", text):
            if name in VIEWS and name not in ordered and name not in pending:
                pending.append(name)
                add(VIEWS[name])
                pending.remove(name)
                ordered.append(name)

    pending: list[str] = []
    add(body)
    if not ordered:
        return body
    head = ",\n".join(f"{name} as {'materialized ' if name in SHARED else ''}({VIEWS[name]})" for name in ordered)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


def query(name: str, oracle: str | None = None, rounds: str = "") -> Callable:
    """Registers fn(tables) under a name, with the SQL of the same result.

    `rounds` names the double columns, which both sides round to six decimals.
    """

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: presentable(fn(Tables(spark, folder)))
        if oracle is not None:
            rounded = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in rounds.split())
            body = f"select * replace ({rounded}) from ({oracle.strip()})" if rounded else oracle
            ORACLES[name] = with_views(body)
        return fn

    return register
