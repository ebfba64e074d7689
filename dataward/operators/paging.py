"""Order, offset pages and keyset pages, with cursors that can be signed or encrypted."""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from operator import and_, or_
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadRequestError

# Bounds of pages and limits.
MAX_PAGE, MAX_PAGE_LIMIT, DEFAULT_LIMIT, MAX_OFFSET_LIMIT, LARGEST_OFFSET = 1_000_000, 10_000, 20, 100, 2**53 - 1

Order = Sequence[tuple[str, str]]


def sort_columns(order: Order) -> list[Column]:
    """Nulls come last in either direction."""
    return [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in order]


def ordered(df: DataFrame, order: Order, tie_break: Sequence[str] = ()) -> DataFrame:
    """df by order, then by the tie-break columns, so that limits cut at the same row each time."""
    full = [*order, *((c, "asc") for c in tie_break if c not in {c for c, _ in order})]
    return df.orderBy(*sort_columns(full)) if full else df


def apply_offset(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Limits are held to 1..100, offsets to 0 and above."""
    if offset is not None:
        df = df.offset(max(0, offset))
    return df.limit(min(MAX_OFFSET_LIMIT, max(1, limit))) if limit is not None else df


@dataclass
class Page:
    data: DataFrame
    page: int
    limit: int
    total: int
    total_pages: int
    has_next: bool
    has_prev: bool


def paginate(df: DataFrame, page: int | None = 1, limit: int | None = DEFAULT_LIMIT, order: Order = (), tie_break: Sequence[str] = (), total: DataFrame | None = None) -> Page:
    """A numbered page of df with counts. A limit of 0 gives an empty page and no pages."""
    number = lambda x, default: default if x is None or (isinstance(x, float) and math.isnan(x)) else int(x)
    page = min(MAX_PAGE, max(1, number(page, 1)))
    limit = number(limit, DEFAULT_LIMIT)
    limit = 0 if limit == 0 else min(MAX_PAGE_LIMIT, max(1, limit))
    skip = (page - 1) * limit
    if skip > LARGEST_OFFSET:
        raise BadRequestError("the page lies beyond the largest offset")
    rows = (total if total is not None else df).count()
    pages = -(-rows // limit) if limit else 0
    data = ordered(df, order, tie_break)
    while skip:  # Spark's offsets are 32-bit
        data, skip = data.offset(min(skip, 2**31 - 1)), skip - min(skip, 2**31 - 1)
    return Page(data.limit(limit), page, limit, rows, pages, page < pages, page > 1)


def _plain(x: Any) -> Any:
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    return float(x) if isinstance(x, Decimal) else x


def _b64(text: str) -> str:
    return base64.b64encode(quote(text, safe="-_.!~*'()").encode()).decode()


def _unb64(text: str) -> str:
    return unquote(base64.b64decode(text, validate=True).decode())


def encode_cursor(order: Order, row: Mapping[str, Any]) -> str:
    """One non-null column goes as column:value, anything else as an object."""
    values = {c: _plain(row[c]) for c, _ in order}
    if len(values) == 1:
        (column, value), *_ = values.items()
        if value is not None:
            return f"{_b64(column)}:{_b64(json.dumps(value))}"
    return _b64(json.dumps(values))


def decode_cursor(cursor: str) -> dict[str, Any]:
    try:
        if ":" in cursor:
            column, value = cursor.split(":", 1)
            return {_unb64(column): json.loads(_unb64(value))}
        found = json.loads(_unb64(cursor))
    except (binascii.Error, ValueError) as e:
        raise BadRequestError("malformed cursor") from e
    if not isinstance(found, dict):
        raise BadRequestError("malformed cursor")
    return found


@dataclass(frozen=True)
class CursorSecurity:
    """Signs cursors, and encrypts them first if asked to (AES-256-GCM, by Spark's own function)."""

    secret: str
    algorithm: str = "sha256"
    encrypt: bool = False

    def __post_init__(self) -> None:
        if len(self.secret) < 32:
            raise BadRequestError("the secret needs 32 characters at least")
        if self.algorithm not in ("sha256", "sha384", "sha512"):
            raise BadRequestError(f"unknown algorithm {self.algorithm}")

    def _signature(self, text: str) -> str:
        return hmac.new(self.secret.encode(), text.encode(), getattr(hashlib, self.algorithm)).hexdigest()

    def _key(self) -> str:
        return hmac.new(self.secret.encode(), b"aes-key-derivation", hashlib.sha256).hexdigest()

    def seal(self, spark: SparkSession, cursor: str) -> str:
        if self.encrypt:
            row = spark.range(1).select(F.hex(F.aes_encrypt(F.lit(cursor), F.unhex(F.lit(self._key())), F.lit("GCM"))).alias("x"))
            cursor = row.first()["x"].lower()
        return f"{cursor}.{self._signature(cursor)}"

    def open(self, spark: SparkSession, sealed: str) -> str:
        cursor, _, signature = sealed.rpartition(".")
        if not cursor or not hmac.compare_digest(signature, self._signature(cursor)):
            raise BadRequestError("the cursor's signature does not hold")
        if not self.encrypt:
            return cursor
        row = spark.range(1).select(F.aes_decrypt(F.unhex(F.lit(cursor)), F.unhex(F.lit(self._key())), F.lit("GCM")).cast("string").alias("x"))
        return row.first()["x"]


def after(order: Order, values: Mapping[str, Any], types: Mapping[str, str] | None = None) -> Column:
    """Rows that come after `values` in order: an OR of equal beginnings and one step beyond.

    Columns of the order must not be null: comparison with null is unknown, so such rows are left out.
    """
    if missing := [c for c, _ in order if c not in values]:
        raise BadRequestError(f"the cursor lacks {', '.join(missing)}")
    lit = lambda c: F.lit(values[c]).cast(types[c]) if types else F.lit(values[c])
    branches = []
    for i, (column, direction) in enumerate(order):
        step = F.col(column) < lit(column) if direction == "desc" else F.col(column) > lit(column)
        branches.append(reduce(and_, [F.col(c) == lit(c) for c, _ in order[:i]], step))
    return reduce(or_, branches)


@dataclass
class CursorPage:
    data: list[Any]
    limit: int
    has_next: bool
    has_prev: bool
    next_cursor: str | None
    columns: list[str] = field(default_factory=list)


def keyset(df: DataFrame, order: Order, cursor_values: Mapping[str, Any] | None, limit: int) -> DataFrame:
    """The limit + 1 rows of df that follow the cursor; the last one only shows that there are more."""
    if cursor_values is not None:
        df = df.filter(after(order, cursor_values, dict(df.dtypes)))
    return df.orderBy(*sort_columns(order)).limit(limit + 1)


def paginate_cursor(df: DataFrame, order: Order, cursor: str | None = None, limit: int | None = DEFAULT_LIMIT, security: CursorSecurity | None = None) -> CursorPage:
    limit = DEFAULT_LIMIT if limit is None else limit
    limit = 0 if limit == 0 else min(MAX_PAGE_LIMIT, max(1, limit))
    if limit == 0:
        return CursorPage([], 0, False, bool(cursor), None, df.columns)
    spark = df.sparkSession
    values = decode_cursor(security.open(spark, cursor) if security else cursor) if cursor else None
    rows = keyset(df, order, values, limit).collect()  # limit + 1 rows at most
    data, more = rows[:limit], len(rows) > limit
    following = encode_cursor(order, data[-1].asDict()) if more else None
    if following and security:
        following = security.seal(spark, following)
    return CursorPage(data, limit, more, bool(cursor), following, df.columns)


def paginate_cursor_simple(df: DataFrame, cursor: str | None = None, limit: int | None = DEFAULT_LIMIT, key: str = "id") -> CursorPage:
    return paginate_cursor(df, [(key, "asc")], cursor, limit)
