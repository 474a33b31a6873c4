"""The panel: a long table of many series, and the rules every operator relies on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def names(columns: str | Sequence[str]) -> list[str]:
    """A bare string means one column."""
    return [columns] if isinstance(columns, str) else list(columns)


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]


def string_columns(df: DataFrame, leave: Sequence[str] = ("sample",)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in leave]


@dataclass(frozen=True)
class PanelSpec:
    """Keys, date and signals of a panel; ``cutoff`` names the backtest column once there is one."""

    keys: tuple[str, ...]
    date: str
    signals: tuple[str, ...]
    target: str = ""
    cutoff: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", tuple(names(self.keys)))
        object.__setattr__(self, "signals", tuple(names(self.signals)))
        object.__setattr__(self, "target", self.target or self.signals[0])
        if self.target not in self.signals:
            object.__setattr__(self, "signals", (*self.signals, self.target))

    def with_cutoff(self, name: str = "cutoff") -> PanelSpec:
        return replace(self, cutoff=name)

    @property
    def series(self) -> list[str]:
        """What identifies one ordered series: the keys, and the cutoff in a backtest."""
        return [*self.keys, *([self.cutoff] if self.cutoff else [])]


def ordered(keys: str | Sequence[str], date: str):
    """Window of a series in date order."""
    return W.partitionBy(*names(keys)).orderBy(date)


def trailing(keys: str | Sequence[str], date: str, rows: int):
    return ordered(keys, date).rowsBetween(-(rows - 1), 0)


def upto(keys: str | Sequence[str], date: str):
    return ordered(keys, date).rowsBetween(W.unboundedPreceding, 0)


def ingest(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Types fixed once: date column to DATE, signals to DOUBLE with NaN as NULL, rows with a null key or date dropped."""
    signal = lambda c: F.nanvl(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(None).cast("double")).alias(c)
    typed = [
        F.to_date(c).alias(c) if c == spec.date else signal(c) if c in spec.signals else F.col(c) for c in df.columns
    ]
    wanted = [F.col(c).isNotNull() for c in (*spec.keys, spec.date)]
    keep = wanted[0]
    for w in wanted[1:]:
        keep = keep & w
    return df.select(*typed).where(keep)


def clip0(c: Column) -> Column:
    """At least 0; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def clip(c: Column, low: Column, high: Column) -> Column:
    """Between the bounds; NULL stays NULL and a NULL bound does not bind."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def finite_or_zero(c: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def nonzero_or_null(c: Column) -> Column:
    """True where the value is not 0 or is missing."""
    return c.isNull() | (c != 0)
