"""Small column-expression helpers shared by all operators (JVM-side, codegen-friendly)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYS = ["problem_id", "sample_idx"]
# 13 hex digits = 52 bits: exact in a DOUBLE, ties negligible at 1e12 rows
HASH_SCALE = 4503599627370496.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c, name: str | None = None) -> Column:
    """Round to 6 digits (DOUBLE) so value hashes agree across engines."""
    out = F.round(col(c).cast("double"), 6)
    return out.alias(name) if name else out


def as_int(c) -> Column:
    return col(c).cast("int")


def flag(cond) -> Column:
    """Boolean condition -> INT 0/1 (NULL condition -> 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (no ANSI error)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def sum_cols(cols) -> Column:
    cols = [col(c) for c in cols]
    return reduce(lambda a, b: a + b, cols)


def hash_unit(seed, *keys) -> Column:
    """Deterministic pseudo-random number in [0, 1) from md5(seed|keys).

    The same text works in DuckDB; it is stable across partitions and reruns,
    which is what every random choice in this package uses.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(HASH_SCALE)


def hash_order(seed, *keys) -> Column:
    """A sortable md5 key for seeded random orders."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def series_udf(fn, return_type: str = "double", n_args: int = 1):
    """Arrow-batched pandas UDF (Series -> Series) for modules using postponed annotations."""
    import pandas as pd

    fn.__annotations__ = {**{f"a{i}": pd.Series for i in range(n_args)}, "return": pd.Series}
    params = list(fn.__code__.co_varnames[:n_args])
    fn.__annotations__ = {**{p: pd.Series for p in params}, "return": pd.Series}
    return F.pandas_udf(fn, return_type)
