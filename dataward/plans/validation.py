"""When results are checked against a table's rules, and what then becomes of rows that break them."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from ..errors import BadRequestError
from ..operators.writes import check_rows, violations

MODES, VARIABLE, ENVIRONMENT = ("always", "never", "development", "production"), "DATAWARD_VALIDATION", "ENVIRONMENT"


def mode() -> str:
    """As the environment says: the variable for it, else development or production."""
    chosen = os.environ.get(VARIABLE)
    if chosen in MODES:
        return chosen
    return "development" if os.environ.get(ENVIRONMENT) == "development" else "production"


def should_validate(chosen: str | None = None) -> bool:
    """always and never speak for themselves; development does in a development environment; production doesn't."""
    chosen = chosen or mode()
    if chosen not in MODES:
        raise BadRequestError(f"no such mode: {chosen}")
    return chosen == "always" or (chosen == "development" and os.environ.get(ENVIRONMENT) == "development")


def validated(df: DataFrame, required: Sequence[str] = (), checks: Mapping[str, Column] | None = None, chosen: str | None = None) -> DataFrame:
    """df, once no row breaks a rule, if the mode asks for that; else df as it is."""
    if should_validate(chosen):
        check_rows(df, required, checks)
    return df


def valid_rows(df: DataFrame, required: Sequence[str] = (), checks: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, the others with the names of the rules they break)."""
    broken = violations(df, required, checks)
    ok = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in required)) if required else df
    for rule in (checks or {}).values():
        ok = ok.filter(rule | rule.isNull())
    return ok, broken
