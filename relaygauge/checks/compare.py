"""Compare a query with its SQL on the same Parquet tables, row by row."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

from pyspark.sql import SparkSession

from relaygauge.checks.oracles import ORACLES
from relaygauge.checks.queries import QUERIES


def _plain(value):
    """Whole numbers alike, whatever type an engine sums them in."""
    return int(value) if isinstance(value, Decimal) and value == value.to_integral_value() else value


def _rows(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark: SparkSession, name: str, folder: str) -> tuple[int, str | None]:
    """(rows, what differs from the SQL or None); for small folders, as it collects both."""
    import duckdb

    frame = QUERIES[name](spark, folder)
    mine = _rows(frame.columns, frame.collect())
    if name not in ORACLES:
        return sum(mine.values()), None
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    cursor = connection.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return sum(mine.values()), f"columns {sorted(frame.columns)} and {sorted(names)}"
    theirs = _rows(names, cursor.fetchall())
    if mine == theirs:
        return sum(mine.values()), None
    only_mine, only_theirs = mine - theirs, theirs - mine
    return sum(mine.values()), (
        f"{sum(mine.values())} and {sum(theirs.values())} rows, "
        f"spark only {list(only_mine)[:2]}, sql only {list(only_theirs)[:2]}"
    )
