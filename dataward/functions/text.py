"""Fingerprints and small text functions, all as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadRequestError


def _squeezed(c: Column, length: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, length)


def query_fingerprint(sql: Column, length: int = 100) -> Column:
    """The query with numbers and quoted text as ?."""
    return _squeezed(F.regexp_replace(F.regexp_replace(sql, r"\b\d+\b", "?"), r"'[^']*'|\"[^\"]*\"", "?"), length)


def error_fingerprint(message: Column, length: int = 100) -> Column:
    """The message with numbers as N, quoted names as X and what stands in brackets left out."""
    c = F.regexp_replace(message, r"\d+", "N")
    c = F.regexp_replace(c, r"'[^']*'", "'X'")
    c = F.regexp_replace(c, r"`[^`]*`", "`X`")
    return _squeezed(F.regexp_replace(c, r"\([^)]*\)", "(...)"), length)


def query_verb(sql: Column) -> Column:
    return F.upper(F.split(F.trim(sql), r"\s+")[0])


def query_tables(sql: Column) -> Column:
    """Names after FROM, JOIN, INTO and UPDATE, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(sql), F.lit(r"\b(?:from|join|into|update)\s+[`\"]?([a-z_][a-z0-9_.]*)"), 1)))


def tenant_schema(tenant: Column, prefix: str = "tenant_") -> Column:
    return F.concat(F.lit(prefix), tenant)


def tenant_of(schema: Column, prefix: str = "tenant_") -> Column:
    return F.when(schema.startswith(prefix), F.substring(schema, len(prefix) + 1, 2**31 - 1))


def subdomain(host: Column) -> Column:
    """The first label of a host of three labels or more."""
    labels = F.split(F.regexp_replace(host, r":\d+$", ""), r"\.")
    return F.when(F.size(labels) >= 3, labels[0])


# Kinds of errors by what their message holds, in order.
ERROR_KINDS = (
    ("Connection Error", ("connection", "econnrefused")),
    ("Timeout Error", ("timeout",)),
    ("Syntax Error", ("syntax", "parse")),
    ("Constraint Violation", ("constraint", "violates")),
    ("Unique Violation", ("unique",)),
    ("Foreign Key Violation", ("foreign key",)),
    ("Permission Error", ("permission", "denied")),
    ("Not Found Error", ("not found", "does not exist")),
    ("Deadlock Error", ("deadlock",)),
)
OTHER_KIND = "Other Error"


def error_kind(message: Column) -> Column:
    low = F.lower(message)
    kind = F.when(F.lit(False), "")
    for name, words in ERROR_KINDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        kind = kind.when(hit, name)
    return kind.otherwise(OTHER_KIND)


# The longest identifier and what it may hold.
IDENTIFIER_LENGTH, IDENTIFIER = 128, r"[a-zA-Z_][a-zA-Z0-9_.]*"


def valid_identifier(name: Column) -> Column:
    return F.coalesce((F.char_length(name) <= IDENTIFIER_LENGTH) & name.rlike(rf"\A{IDENTIFIER}\z"), F.lit(False))


def check_identifier(name: str, what: str = "identifier") -> str:
    if len(name) > IDENTIFIER_LENGTH or not re.fullmatch(IDENTIFIER, name, re.ASCII):
        raise BadRequestError(f"invalid {what}: {name}")
    return name


def quoted(name: str) -> str:
    """The name as one identifier of SQL, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def qualified(*parts: str | None) -> str:
    return ".".join(quoted(p) for p in parts if p)


# The keywords that begin a line of formatted SQL, in the order in which they are looked for.
LINE_KEYWORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "LEFT JOIN", "RIGHT JOIN", "INNER JOIN", "OUTER JOIN", "CROSS JOIN", "ORDER BY", "GROUP BY", "HAVING", "LIMIT", "OFFSET",
    "INSERT INTO", "VALUES", "UPDATE", "SET", "DELETE FROM", "UNION", "EXCEPT", "INTERSECT", "ON", "AND", "OR", "RETURNING",
)


def minified_sql(sql: Column) -> Column:
    """One line, with one space where there is any, and commas and brackets spaced alike."""
    for pattern, put in ((r"\s+", " "), (r"\s*,\s*", ", "), (r"\s*\(\s*", " ("), (r"\s*\)\s*", ") ")):
        sql = F.regexp_replace(sql, pattern, put)
    return F.trim(sql)


def formatted_sql(sql: Column) -> Column:
    """A line for each keyword that has space around it."""
    for word in LINE_KEYWORDS:
        sql = F.regexp_replace(sql, rf"(?i)\s+({word})\s+", "\n$1 ")
    return F.regexp_replace(sql, r"^\s+|\s+$", "")


def pretty_sql(sql: Column, indent: int = 2) -> Column:
    """formatted_sql() with brackets on lines of their own: each opening one is set further in, each closing one back."""
    margin = lambda level: F.repeat(F.lit(" " * indent), level)
    text = formatted_sql(sql)
    parts = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), 0)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("opened"), F.size(F.filter(parts, lambda x: x == "(")).alias("level"))

    def step(a: Column, x: Column) -> Column:
        opened = a["opened"] + F.when(x == "(", 1).otherwise(0)
        level = F.greatest(F.lit(0), a["level"] - F.when(x == ")", 1).otherwise(0))
        put = F.when(x == "(", F.concat(F.lit("(\n"), margin(opened))).when(x == ")", F.concat(F.lit("\n"), margin(level), F.lit(")"))).otherwise(x)
        return F.struct(F.concat(a["text"], put).alias("text"), opened.alias("opened"), level.alias("level"))

    done = F.aggregate(parts, start, step, lambda a: a["text"])
    return F.regexp_replace(F.regexp_replace(done, r"\n\s*\n", "\n"), r"^\s+|\s+$", "")
