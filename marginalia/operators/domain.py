"""The schema of coded tables: attributes in order and how many codes each has."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Domain:
    names: tuple[str, ...]
    shape: tuple[int, ...]

    @classmethod
    def of(cls, sizes: dict[str, int]) -> Domain:
        return cls(tuple(sizes), tuple(int(n) for n in sizes.values()))

    @classmethod
    def from_json(cls, text: str) -> Domain:
        """From {attribute: {type, domain}}."""
        return cls.of({str(k): v["domain"] for k, v in json.loads(text).items()})

    def to_json(self) -> str:
        return json.dumps({n: {"type": "discrete", "domain": s} for n, s in self.items()})

    def items(self) -> list[tuple[str, int]]:
        return list(zip(self.names, self.shape))

    def __getitem__(self, name: str) -> int | None:
        return dict(self.items()).get(name)

    def __len__(self) -> int:
        return len(self.names)

    def __contains__(self, name: str) -> bool:
        return name in self.names

    @property
    def size(self) -> int:
        """Cells of the product; 1 if there are no attributes."""
        return prod(self.shape)

    def project(self, keep: Iterable[str]) -> Domain:
        """The kept attributes, in this domain's order."""
        keep = set(keep)
        return Domain.of({n: s for n, s in self.items() if n in keep})

    def reorder(self, order: Iterable[str]) -> Domain:
        """The attributes in the order given; those that aren't here are passed over."""
        mine = dict(self.items())
        return Domain.of({n: mine[n] for n in order if n in mine})

    def without(self, other: Iterable[str]) -> Domain:
        gone = set(other.names if isinstance(other, Domain) else other)
        return Domain.of({n: s for n, s in self.items() if n not in gone})

    def union(self, other: Domain) -> Domain:
        """This one's attributes, then the other's new ones."""
        return Domain.of(dict(self.items()) | {n: s for n, s in other.items() if n not in self})

    def positions(self, other: Iterable[str]) -> list[int]:
        return [self.names.index(n) for n in (other.names if isinstance(other, Domain) else other)]

    def edges(self) -> list[list[int]]:
        return [list(range(s + 1)) for s in self.shape]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.IntegerType(), False, {"domain": s}) for n, s in self.items()])


def encode_index(columns: Iterable[Column], shape: Iterable[int]) -> Column:
    """The number of a cell, the last axis fastest."""
    out = F.lit(0).cast("long")
    for c, s in zip(columns, shape):
        out = out * F.lit(int(s)) + c.cast("long")
    return out


def decode_index(index: Column, shape: Iterable[int]) -> list[Column]:
    """The codes of a cell's number."""
    shape, out, step = list(shape), [], 1
    for s in reversed(shape):
        out.append(F.pmod(F.floor(index / F.lit(step)), F.lit(int(s))).cast("int"))
        step *= int(s)
    return out[::-1]


def grid(spark: SparkSession, domain: Domain) -> DataFrame:
    """All cells of a domain, from their numbers (no join)."""
    codes = decode_index(F.col("id"), domain.shape)
    return spark.range(domain.size).select(*[c.alias(n) for c, n in zip(codes, domain.names)])
