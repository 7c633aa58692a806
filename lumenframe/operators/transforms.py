"""Named, keyed transformations of tables: a registry, and chains folded from its entries."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transformation:
    """A step and the key by which its results can be told apart."""

    key: str
    apply: Callable[[DataFrame], DataFrame]

    def __call__(self, rows: DataFrame) -> DataFrame:
        return rows.transform(self.apply)


IDENTITY = Transformation("identity", lambda rows: rows)


def chain(steps: Iterable[Transformation]) -> Transformation:
    """One transformation that applies the steps in turn; its key names them all."""
    steps = list(steps)
    return Transformation("+".join(s.key for s in steps) or IDENTITY.key, lambda rows: reduce(lambda r, s: s(r), steps, rows))


@dataclass(frozen=True)
class Effect:
    """A scalar setting: its default, its column and how it acts on a value where it is active."""

    name: str
    default: float
    act: Callable[[Column, Column], Column] = field(compare=False)

    def amount(self, settings: str = "settings") -> Column:
        return F.coalesce(F.try_element_at(F.col(settings), F.lit(self.name)), F.lit(self.default))

    def active(self, settings: str = "settings") -> Column:
        return self.amount(settings) != self.default


class Registry:
    """Effects and filters by name, in the order of their registration."""

    def __init__(self) -> None:
        self.effects: dict[str, Effect] = {}
        self.filters: dict[str, Callable[..., Transformation]] = {}

    def effect(self, name: str, default: float) -> Callable:
        return lambda act: self.effects.setdefault(name, Effect(name, default, act))

    def filter(self, name: str) -> Callable:
        return lambda make: self.filters.setdefault(name, make)

    def rendered(self, value: str, settings: str = "settings") -> Column:
        """``value`` after all effects that are active, in turn."""
        return reduce(lambda v, e: F.when(e.active(settings), e.act(v, e.amount(settings))).otherwise(v), self.effects.values(), F.col(value))

    def active_names(self, settings: str = "settings") -> Column:
        return F.array_compact(F.array(*[F.when(e.active(settings), e.name) for e in self.effects.values()]))


registry = Registry()
registry.effect("exposure", 0.0)(lambda v, a: v * F.pow(F.lit(2.0), a))
registry.effect("offset", 0.0)(lambda v, a: v + a)
registry.effect("contrast", 1.0)(lambda v, a: (v - 128) * a + 128)
registry.filter("negative")(lambda column: Transformation(f"negative({column})", lambda rows: rows.withColumn(column, 255 - F.col(column))))
registry.filter("threshold")(lambda column, at: Transformation(f"threshold({column},{at})", lambda rows: rows.withColumn(column, F.when(F.col(column) > at, 255).otherwise(0))))
registry.filter("gain")(lambda column, by: Transformation(f"gain({column},{by})", lambda rows: rows.withColumn(column, F.least(F.col(column) * by, F.lit(255)))))
