"""Counter-based random draws from md5 of visible keys.

Every draw depends only on the values hashed, never on partitioning, task
order or retries, so a lost executor recomputes exactly the same numbers and
a SQL engine can repeat them:

  Spark : conv(substring(md5(cast(s as binary)), 1, 12), 16, 10) / 2^48
  DuckDB: ('0x' || substr(md5(s), 1, 12))::BIGINT / 2^48

where s = concat_ws('|', parts...).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_48 = float(2 ** 48)


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def md5_hex(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[_part(p) for p in parts]).cast("binary"))


def md5_uniform(*parts) -> Column:
    """Uniform double in [0, 1) from the first 48 bits of md5."""
    bits = F.conv(F.substring(md5_hex(*parts), 1, 12), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(TWO_POW_48)


def md5_normal(*parts) -> Column:
    """Standard normal by Box-Muller on two md5 uniforms ('a' and 'b' salts)."""
    u1 = F.lit(1.0) - md5_uniform(*parts, "a")          # in (0, 1]
    u2 = md5_uniform(*parts, "b")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def md5_bits(*parts) -> Column:
    """The first 48 bits of md5 as a BIGINT (a per-row key, hashed once)."""
    return F.conv(F.substring(md5_hex(*parts), 1, 12), 16, 10).cast("bigint")


# ---------------------------------------------------------------------------
# Per-epoch draws from a 48-bit row key without hashing every row again:
# a bijective mix of the key with constants taken from md5(seed, epoch) on the
# driver. Three multiply-add rounds on 24-bit halves; every product stays
# below 2^48, so BIGINT never overflows (ANSI mode) and SQL repeats it exactly.
# ---------------------------------------------------------------------------
_M24 = 1 << 24
_M48 = 1 << 48


def epoch_constants(seed, epoch) -> tuple[int, int, int, int]:
    import hashlib
    h = hashlib.md5(f"{seed}|{epoch}".encode()).hexdigest()
    c = int(h[0:12], 16)
    a, b, d = (int(h[12 + 6 * i: 18 + 6 * i], 16) | 1 for i in range(3))
    return c, a, b, d


def mix_uniform(key, seed, epoch) -> Column:
    """Uniform in [0, 1) for (row key, seed, epoch). ``key`` is a column name
    (one SQL expression, planned in one call) or a Column."""
    c, a, b, d = epoch_constants(seed, epoch)
    if isinstance(key, str):
        x = f"(({key} + {c}L) % {_M48}L)"
        hi = f"shiftright({x}, 24)"
        lo = f"({x} % {_M24}L)"
        lo1 = f"(({lo} * {a}L + {hi}) % {_M24}L)"
        hi1 = f"(({hi} * {b}L + {lo1}) % {_M24}L)"
        lo2 = f"(({lo1} * {d}L + {hi1}) % {_M24}L)"
        return F.expr(f"CAST({hi1} * {_M24}L + {lo2} AS DOUBLE) / {TWO_POW_48!r}")

    def mix(k: Column) -> Column:
        x = (k + F.lit(c)) % F.lit(_M48)
        hi = F.shiftright(x, 24)
        lo = x % F.lit(_M24)
        lo = (lo * F.lit(a) + hi) % F.lit(_M24)
        hi = (hi * F.lit(b) + lo) % F.lit(_M24)
        lo = (lo * F.lit(d) + hi) % F.lit(_M24)
        return (hi * F.lit(_M24) + lo).cast("double") / F.lit(TWO_POW_48)
    # the rounds name the key eight times; bound to a variable its md5 is computed once a row
    return F.transform(F.array(key), mix)[0]


def np_mix_uniform(key, seed, epoch):
    """NumPy twin of ``mix_uniform`` (same int64 arithmetic, same doubles)."""
    import numpy as np
    c, a, b, d = epoch_constants(seed, epoch)
    x = (np.asarray(key, dtype=np.int64) + np.int64(c)) % np.int64(_M48)
    hi = x >> 24
    lo = x % _M24
    lo = (lo * a + hi) % _M24
    hi = (hi * b + lo) % _M24
    lo = (lo * d + hi) % _M24
    return (hi * _M24 + lo).astype(np.float64) / TWO_POW_48


def sql_mix_uniform(key: str, seed, epoch) -> str:
    c, a, b, d = epoch_constants(seed, epoch)
    x = f"(({key} + {c}) % {_M48})"
    hi = f"({x} // {_M24})"
    lo = f"({x} % {_M24})"
    lo1 = f"(({lo} * {a} + {hi}) % {_M24})"
    hi1 = f"(({hi} * {b} + {lo1}) % {_M24})"
    lo2 = f"(({lo1} * {d} + {hi1}) % {_M24})"
    return f"(CAST({hi1} * {_M24} + {lo2} AS DOUBLE) / {TWO_POW_48!r})"


def md5_id(*parts) -> Column:
    """Stable BIGINT row id from 60 bits of md5 of the given key columns."""
    return F.conv(F.substring(md5_hex(*parts), 1, 15), 16, 10).cast("bigint")


# SQL twins (DuckDB dialect) used by the oracle text.

def sql_md5_hex(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def sql_md5_uniform(*parts: str) -> str:
    return (f"(('0x' || substr({sql_md5_hex(*parts)}, 1, 12))::BIGINT::DOUBLE "
            f"/ {TWO_POW_48!r})")


def sql_md5_normal(*parts: str) -> str:
    u1 = f"(1.0::DOUBLE - {sql_md5_uniform(*parts, repr('a'))})"
    u2 = sql_md5_uniform(*parts, repr("b"))
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos({2.0 * math.pi!r}::DOUBLE * {u2}))"


def sql_md5_id(*parts: str) -> str:
    return f"('0x' || substr({sql_md5_hex(*parts)}, 1, 15))::BIGINT"
