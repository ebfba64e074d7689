"""Filter objects compiled into one Column.

A filter is a mapping of columns to values or to operator objects such as {"$gte": 3}, with "$and" and
"$or" for lists of filters. An empty "$in" matches nothing; an empty "$nin", "$or" or "$and" leaves no
condition; malformed operands of "$between", "$isNull" and "$isNotNull" are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadRequestError


class _Undefined:
    def __repr__(self) -> str:
        return "UNDEFINED"


#: A value that was not given; conditions on it are left out.
UNDEFINED = _Undefined()


class InvalidOperatorError(BadRequestError):
    code = "INVALID_OPERATOR"


def _is_list(x: Any) -> bool:
    return isinstance(x, Collection) and not isinstance(x, (str, bytes, Mapping))


def _null_flag(c: Column, flag: Any, null: bool) -> Column | None:
    if not isinstance(flag, bool):
        return None
    return c.isNull() if flag == null else c.isNotNull()


OPERATORS: dict[str, Callable[[Column, Any], Column | None]] = {
    "$eq": lambda c, v: c.isNull() if v is None else c == F.lit(v),
    "$ne": lambda c, v: c.isNotNull() if v is None else c != F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)) if _is_list(v) and len(v) else F.lit(False),
    "$nin": lambda c, v: ~c.isin(list(v)) if _is_list(v) and len(v) else None,
    "$like": lambda c, v: c.like(v),
    "$ilike": lambda c, v: c.ilike(v),
    "$contains": lambda c, v: c.contains(v),
    "$startsWith": lambda c, v: c.startswith(v),
    "$endsWith": lambda c, v: c.endswith(v),
    "$isNull": lambda c, v: _null_flag(c, v, True),
    "$isNotNull": lambda c, v: _null_flag(c, v, False),
    "$between": lambda c, v: c.between(F.lit(v[0]), F.lit(v[1])) if _is_list(v) and len(v) == 2 else None,
}
LOGICAL = {"$and": and_, "$or": or_}


def is_operator_object(value: Any) -> bool:
    return isinstance(value, Mapping) and any(str(k).startswith("$") for k in value)


def has_operators(where: Mapping[str, Any]) -> bool:
    return any(k in LOGICAL or is_operator_object(v) for k, v in where.items())


def validate_operators(where: Mapping[str, Any]) -> None:
    """Raises for unknown operators and for "$and" or "$or" without a list."""
    for key, value in where.items():
        if key in LOGICAL:
            if not _is_list(value):
                raise InvalidOperatorError(f"{key} takes a list of filters")
            for part in value:
                validate_operators(part)
        elif key.startswith("$"):
            raise InvalidOperatorError(f"unknown operator {key}")
        elif is_operator_object(value) and (unknown := [k for k in value if k not in OPERATORS]):
            raise InvalidOperatorError(f"unknown operator {unknown[0]} on {key}")


def extract_columns(where: Mapping[str, Any]) -> list[str]:
    """The columns that a filter refers to, in order, each once."""
    found: dict[str, None] = {}
    for key, value in where.items():
        found |= dict.fromkeys(c for part in value for c in extract_columns(part)) if key in LOGICAL else {key: None}
    return list(found)


def validate_columns(names: Iterable[str], allowed: Collection[str]) -> None:
    if unknown := [n for n in names if n not in allowed]:
        raise BadRequestError(f"unknown columns: {', '.join(unknown)}")


def _conditions(where: Mapping[str, Any]) -> list[Column]:
    out: list[Column | None] = []
    for key, value in where.items():
        if value is UNDEFINED:
            continue
        if key in LOGICAL:
            out.append(reduce(LOGICAL[key], [compile_where(part) for part in value]) if value else None)
        elif is_operator_object(value):
            out += [OPERATORS[op](F.col(key), v) for op, v in value.items() if v is not UNDEFINED]
        else:
            out.append(OPERATORS["$eq"](F.col(key), value))
    return [c for c in out if c is not None]


def compile_where(where: Mapping[str, Any] | None, columns: Collection[str] | None = None) -> Column:
    """One condition for all of where; true when nothing is left of it."""
    where = where or {}
    validate_operators(where)
    if columns is not None:
        validate_columns(extract_columns(where), columns)
    conditions = _conditions(where)
    return reduce(and_, conditions) if conditions else F.lit(True)


def equalities(conditions: Mapping[str, Any] | None) -> Column:
    """Plain equality of each column; comparing with None is unknown, so it matches no row."""
    cs = [F.col(k) == F.lit(v) for k, v in (conditions or {}).items() if v is not UNDEFINED]
    return reduce(and_, cs) if cs else F.lit(True)


def date_range(column: str, start: Any = None, end: Any = None) -> Column:
    """start <= column <= end, either side optional."""
    cs = [F.col(column) >= F.lit(start)] * (start is not None) + [F.col(column) <= F.lit(end)] * (end is not None)
    return reduce(and_, cs) if cs else F.lit(True)


def applies_to_table(name: str, only: Collection[str] | None = None, without: Collection[str] | None = None) -> bool:
    """A non-empty `only` decides; else `without` does; else all tables."""
    if only:
        return name in only
    return name not in (without or ())
