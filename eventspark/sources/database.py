"""Keyed writes to a database table: bounded batches, retried, one connection
for each partition.

``connect`` makes a DB-API connection; it runs in the tasks, so it must be
picklable (a function of a module that the executors have). Every batch is one
transaction. A batch that fails is rolled back and tried again on a new
connection, after a pause that doubles; after ``retries`` tries the task fails
and Spark runs it again. Rows are keyed: inserting a known key does nothing, or
replaces the row, so neither a retried batch nor a repeated task nor a repeated
micro-batch adds anything twice.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

#: Rows of a batch, tries of a batch, and the pause before the second one (seconds).
BATCH_ROWS, RETRIES, PAUSE = 500, 3, 1.0


def insert_statement(table: str, columns: list[str], keys: list[str], replace: bool = False, mark: str = "%s") -> str:
    """``INSERT`` that ignores known keys, or replaces all other columns."""
    values = ", ".join([mark] * len(columns))
    rest = [c for c in columns if c not in keys]
    then = "DO UPDATE SET " + ", ".join(f"{c} = EXCLUDED.{c}" for c in rest) if replace and rest else "DO NOTHING"
    return f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({values}) ON CONFLICT ({', '.join(keys)}) {then}"


def batches(rows: Iterable, most: int) -> Iterator[list[tuple]]:
    it = iter(rows)
    while part := [tuple(r) for r in itertools.islice(it, most)]:
        yield part


def write_partition(rows: Iterable, connect: Callable, statement: str, batch_rows: int = BATCH_ROWS, retries: int = RETRIES, pause: float = PAUSE) -> int:
    """Write the rows of one partition; returns how many batches it took."""
    connection, n = None, 0
    try:
        for part in batches(rows, batch_rows):
            for attempt in range(retries):
                try:
                    if connection is None:
                        connection = connect()
                    cursor = connection.cursor()
                    cursor.executemany(statement, part)
                    connection.commit()
                    break
                except Exception:
                    connection = _drop(connection)
                    if attempt == retries - 1:
                        raise
                    time.sleep(pause * 2 ** attempt)
            n += 1
    finally:
        _drop(connection)
    return n


def _drop(connection) -> None:
    """Roll back and close what may be broken already."""
    for step in ("rollback", "close"):
        try:
            getattr(connection, step)()
        except Exception:  # noqa: BLE001 - the connection may be gone
            pass


def database_sink(connect: Callable, table: str, keys: list[str], replace: bool = False, mark: str = "%s", batch_rows: int = BATCH_ROWS,
                  retries: int = RETRIES, pause: float = PAUSE, connections: int | None = None) -> Callable[[DataFrame], None]:
    """Writes a DataFrame into ``table``. ``connections`` bounds how many
    partitions, and so connections, there are at once."""
    def write(df: DataFrame) -> None:
        out = df.coalesce(connections) if connections else df
        statement = insert_statement(table, df.columns, keys, replace, mark)
        out.foreachPartition(lambda rows: write_partition(rows, connect, statement, batch_rows, retries, pause) and None)
    return write
