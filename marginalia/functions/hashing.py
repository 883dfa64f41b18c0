"""Hashes and uniforms that any SQL engine can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def hash32(*parts: Column) -> Column:
    """The first 32 bits of md5 over the parts' text, joined by '|'."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    return (hash32(*parts).cast("double") + F.lit(0.5)) / F.lit(TWO32)


def normal(*parts: Column) -> Column:
    """A standard normal deviate (Box and Muller) that depends on the parts alone."""
    u, v = uniform(*parts, F.lit("u")), uniform(*parts, F.lit("v"))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def laplace(scale: float, *parts: Column) -> Column:
    """A Laplace deviate that depends on the parts alone."""
    u = uniform(*parts) - F.lit(0.5)
    return F.lit(-float(scale)) * F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u))


def gumbel(*parts: Column) -> Column:
    return -F.log(-F.log(uniform(*parts)))


def geometric_level(h: Column, gamma: float) -> Column:
    """The level of a 32-bit hash: geometric with p = gamma / (1 + gamma); one is added to the hash so that none is infinite."""
    import math

    log_q = math.log(1.0 - gamma / (1.0 + gamma))
    return F.ceil(F.log((h.cast("double") + F.lit(1.0)) / F.lit(TWO32)) / F.lit(log_q)).cast("int")
