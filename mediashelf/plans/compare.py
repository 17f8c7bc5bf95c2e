"""Order-insensitive comparison of a Spark result with an oracle result."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import os

# exact float text (no rounding) when MEDIASHELF_STRICT_FLOATS is set
STRICT = bool(os.environ.get("MEDIASHELF_STRICT_FLOATS"))


def canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v) if STRICT else repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return str(v)


def digest(cols, rows) -> tuple[str, list[str]]:
    """Hash of the rows with columns sorted by name and rows sorted."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


# Spark simple type names and the DuckDB type names of the same values.
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]", "float": "FLOAT"}


def type_diffs(spark_dtypes, duck_columns, duck_types) -> dict:
    """Columns whose Spark type does not map to the oracle's DuckDB type."""
    ot = {c: str(t) for c, t in zip(duck_columns, duck_types)}
    return {c: (t, ot.get(c)) for c, t in spark_dtypes if DUCK_TYPES.get(t, t) != ot.get(c)}
