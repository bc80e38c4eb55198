"""Keyset pages: bounded, in a fixed order, with a cursor that names the last row returned."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BYTES = 16 * 1024 * 1024
LIMITS = {"store": 256, "history": 64, "reports": 32, "fields": 128}


@dataclass(frozen=True)
class Cursor:
    """Where a page ended, for one endpoint and scope only."""

    endpoint: str
    scope: str
    key: tuple
    version: int = 1

    def encode(self) -> str:
        return json.dumps({"version": self.version, "endpoint": self.endpoint, "payload": {"scope": self.scope, "key": list(self.key)}}, separators=(",", ":"))

    @staticmethod
    def decode(text: str, endpoint: str, scope: str, keys: int) -> Cursor:
        """The cursor in ``text``; an error unless version, endpoint, scope and number of keys fit and no integer is negative."""
        if len(text.encode()) > 16 * 1024:
            raise ValueError("cursor too long")
        try:
            got = json.loads(text)
            cursor = Cursor(got["endpoint"], got["payload"]["scope"], tuple(got["payload"]["key"]), got["version"])
        except (KeyError, TypeError, json.JSONDecodeError) as e:
            raise ValueError("not a cursor") from e
        if (cursor.version, cursor.endpoint, cursor.scope, len(cursor.key)) != (1, endpoint, scope, keys):
            raise ValueError("cursor of another page")
        if any(isinstance(k, int) and k < 0 for k in cursor.key):
            raise ValueError("negative key")
        return cursor


def after(keys: list[tuple[str, bool]], values: tuple) -> Column:
    """Rows past ``values`` in the order of ``keys`` (name, ascending)."""
    def past(k: int) -> Column:
        name, ascending = keys[k]
        step = F.col(name) > F.lit(values[k]) if ascending else F.col(name) < F.lit(values[k])
        return reduce(lambda c, j: c & (F.col(keys[j][0]) == F.lit(values[j])), range(k), step)

    return reduce(lambda a, b: a | b, (past(k) for k in range(len(keys))))


def page(df: DataFrame, keys: list[tuple[str, bool]], limit: int, values: tuple | None = None, kind: str = "store") -> DataFrame:
    """At most ``limit`` + 1 rows in order; the one too many tells that more follow. Top-k, not a full sort."""
    if not 1 <= limit <= LIMITS[kind]:
        raise ValueError(f"limit must be from 1 to {LIMITS[kind]}")
    rows = df if values is None else df.filter(after(keys, values))
    return rows.orderBy(*(F.col(k).asc() if up else F.col(k).desc() for k, up in keys)).limit(limit + 1)


def fetch(df: DataFrame, keys: list[tuple[str, bool]], limit: int, endpoint: str, scope: str, cursor: str | None = None, kind: str = "store") -> tuple[list, str | None]:
    """The rows of a page and the cursor of the next, or None if nothing follows."""
    values = None if cursor is None else Cursor.decode(cursor, endpoint, scope, len(keys)).key
    rows = page(df, keys, limit, values, kind).collect()
    more, rows = len(rows) > limit, rows[:limit]
    return rows, Cursor(endpoint, scope, tuple(rows[-1][k] for k, _ in keys)).encode() if more else None


class Pages:
    """What a client holds of a listing: each page it accepts takes the place of the last."""

    def __init__(self, limit: int):
        self.limit, self.rows, self.cursor, self._seen = limit, [], None, set()

    def replace(self, rows: list, cursor: str | None) -> None:
        """An error, with nothing replaced, if a page has too many rows, names a cursor already seen, or is empty but says that more follow."""
        if len(rows) > self.limit:
            raise ValueError("page exceeds its limit")
        if cursor is not None and (cursor in self._seen or not rows):
            raise ValueError("cursor does not advance")
        self._seen.add(cursor)
        self.rows, self.cursor = rows, cursor


def page_bytes(rows: DataFrame, *columns: str) -> DataFrame:
    """Bytes of a page before it is read, and whether they fit the budget."""
    total = F.coalesce(F.sum(reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(c), F.lit(0)) for c in columns))), F.lit(0))
    return rows.agg(total.cast("bigint").alias("bytes"), (total <= PAGE_BYTES).alias("fits"))
