"""Key-hashed randomness.

``u(seed, tag, k...) = (int(first 13 hex digits of md5("seed|tag|k...")) + 0.5) / 2**52``

The value depends only on the key, never on partitioning or task retries, so a lost
executor recomputes exactly the same draws, and DuckDB can repeat every draw with
``('0x' || substr(md5(concat_ws('|', ...)), 1, 13))::BIGINT``.
Keys must be integers or fixed strings (their text form is the same in both engines).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(2 ** 52)


def _key(seed: int, tag: str, *keys) -> Column:
    parts = [F.lit(str(int(seed))), F.lit(tag)]
    for k in keys:
        parts.append(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"))
    return F.concat_ws("|", *parts)


def hash_uniform(seed: int, tag: str, *keys) -> Column:
    """Uniform in (0, 1), exact in a double; keys are column names or Columns."""
    hexdigits = F.substring(F.md5(_key(seed, tag, *keys)), 1, 13)
    as_int = F.conv(hexdigits, 16, 10).cast("bigint")
    return (as_int.cast("double") + F.lit(0.5)) / F.lit(_TWO_52)


def hash_normal(seed: int, tag: str, *keys) -> Column:
    """Standard normal by Box-Muller from two independent hashed uniforms."""
    u1 = hash_uniform(seed, tag + ":1", *keys)
    u2 = hash_uniform(seed, tag + ":2", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def sql_hash_uniform(seed: int, tag: str, *key_sql: str) -> str:
    """The same draw as DuckDB SQL text (for oracles and docs)."""
    parts = ", ".join([str(int(seed)), f"'{tag}'", *key_sql])
    return f"((('0x' || substr(md5(concat_ws('|', {parts})), 1, 13))::BIGINT)::DOUBLE + 0.5) / {_TWO_52!r}"


def sql_hash_normal(seed: int, tag: str, *key_sql: str) -> str:
    u1 = sql_hash_uniform(seed, tag + ":1", *key_sql)
    u2 = sql_hash_uniform(seed, tag + ":2", *key_sql)
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"
