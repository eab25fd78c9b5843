"""Repeatable Gaussian noise from integer arithmetic.

``randn(seed)`` depends on partitioning, so a re-run (or a retried task)
would change a forecast.  Here every draw is a pure function of
(symbol, simulation, step, seed): two uniforms come from an integer mix
modulo the Mersenne prime 2^31 - 1 (products stay below 2^63, so ANSI
arithmetic never overflows) and Box-Muller turns them into a normal draw.
The same arithmetic is written in SQL (``*_sql``) for the DuckDB oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647  # 2^31 - 1


def _mix(x: Column) -> Column:
    a = (x * 48271) % P
    b = (a * a) % P
    c = (b * 16807 + 12345) % P
    return (c * c) % P


def symbol_code(symbol: Column) -> Column:
    """Polynomial hash of the symbol's characters, modulo P."""
    chars = F.transform(F.split(symbol, ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda acc, x: (acc * 131 + x) % P)


def uniform(code: Column, sim: Column, step: Column, k: int, seed: int) -> Column:
    """A value in (0, 1] from the integer key."""
    s = (code * 1009 + sim.cast("bigint") * 7919 + step.cast("bigint") * 104729
         + (seed * 31 + k) * 15485863) % P
    return (_mix(s) + 1).cast("double") / float(P + 1)


def gaussian(code: Column, sim: Column, step: Column, seed: int, sd: float = 1.0) -> Column:
    u1 = uniform(code, sim, step, 1, seed)
    u2 = uniform(code, sim, step, 2, seed)
    return F.sqrt(F.log(u1) * -2.0) * F.cos(u2 * (2 * math.pi)) * sd


# -- SQL twins (DuckDB) ---------------------------------------------------------

def _mix_sql(x: str) -> str:
    a = f"(({x}) * 48271) % {P}"
    b = f"(({a}) * ({a})) % {P}"
    c = f"(({b}) * 16807 + 12345) % {P}"
    return f"(({c}) * ({c})) % {P}"


def symbol_code_sql(symbol: str) -> str:
    return (f"list_reduce(list_transform(string_split({symbol}, ''), lambda ch: ascii(ch)), "
            f"lambda acc, x: (acc * 131 + x) % {P}, CAST(0 AS BIGINT))")


def uniform_sql(code: str, sim: str, step: str, k: int, seed: int) -> str:
    s = (f"(({code}) * 1009 + CAST({sim} AS BIGINT) * 7919 + CAST({step} AS BIGINT) * 104729"
         f" + {(seed * 31 + k) * 15485863}) % {P}")
    return f"(CAST({_mix_sql(s)} + 1 AS DOUBLE) / {float(P + 1)})"


def gaussian_sql(code: str, sim: str, step: str, seed: int, sd: float = 1.0) -> str:
    u1 = uniform_sql(code, sim, step, 1, seed)
    u2 = uniform_sql(code, sim, step, 2, seed)
    return f"(sqrt(ln({u1}) * -2.0) * cos({u2} * {2 * math.pi!r}) * {sd!r})"
