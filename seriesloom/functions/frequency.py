"""Calendar frequencies: their grids, their future dates, their detection and their defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


@dataclass(frozen=True)
class Frequency:
    """``kind`` is D, B, W, MS, M, Q, SM or Y; ``step`` counts days for D; ``day`` anchors W."""

    kind: str
    step: int = 1
    day: str = "SUN"

    @staticmethod
    def parse(alias: str | Frequency) -> Frequency:
        if isinstance(alias, Frequency):
            return alias
        text = alias.upper()
        if m := re.fullmatch(r"(\d*)D", text):
            return Frequency("D", int(m[1] or 1))
        if m := re.fullmatch(r"W(?:-(%s))?" % "|".join(DAYS), text):
            return Frequency("W", day=m[1] or "SUN")
        short = {"ME": "M", "QE": "Q", "YE": "Y", "A": "Y", "SME": "SM"}.get(text, text)
        if short in ("B", "MS", "M", "Q", "SM", "Y"):
            return Frequency(short)
        raise ValueError(f"unknown frequency: {alias}")

    @property
    def family(self) -> str:
        """D, W or M, as the defaults know them."""
        return "W" if self.kind == "W" else "D" if self.kind in ("D", "B") else "M"

    def on_grid(self, d: Column) -> Column:
        """The first date of the grid that is not before ``d``."""
        if self.kind == "D":
            return d
        if self.kind == "B":
            return F.date_add(d, F.when(F.weekday(d) == 5, 2).when(F.weekday(d) == 6, 1).otherwise(0))
        if self.kind == "W":
            return F.next_day(F.date_sub(d, 1), self.day)
        if self.kind == "MS":
            return F.when(F.dayofmonth(d) == 1, d).otherwise(F.add_months(F.trunc(d, "month"), 1))
        if self.kind == "M":
            return F.last_day(d)
        if self.kind == "Q":
            return F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)
        if self.kind == "Y":
            return F.make_date(F.year(d), F.lit(12), F.lit(31))
        return F.when(F.dayofmonth(d) <= 15, F.date_add(F.trunc(d, "month"), 14)).otherwise(F.last_day(d))

    def between(self, first: Column, stop: Column) -> Column:
        """Grid dates from ``first`` (on the grid) to ``stop``; empty if there are none."""
        months = {"MS": 1, "M": 1, "SM": 1, "Q": 3, "Y": 12}.get(self.kind)
        if months is None:
            days = F.sequence(first, stop, F.expr(f"INTERVAL {7 if self.kind == 'W' else self.step} DAYS"))
            dates = F.filter(days, lambda x: F.weekday(x) < 5) if self.kind == "B" else days
        else:
            unit = {"Q": "quarter", "Y": "year"}.get(self.kind, "month")
            starts = F.sequence(F.trunc(first, unit), F.trunc(stop, unit), F.expr(f"INTERVAL {months} MONTHS"))
            if self.kind == "SM":
                dates = F.flatten(F.transform(starts, lambda x: F.array(F.date_add(x, 14), F.last_day(x))))
            else:
                dates = F.transform(starts, self.on_grid)
            dates = F.filter(dates, lambda x: (x >= first) & (x <= stop))
        return F.when(first <= stop, dates).otherwise(F.array().cast("array<date>"))

    def grid(self, start: Column, stop: Column) -> Column:
        """All grid dates in [start, stop]; the start itself where there is none."""
        dates = self.between(self.on_grid(start), stop)
        return F.when(F.size(dates) > 0, dates).otherwise(F.array(start))

    def future(self, d: Column, n: int) -> Column:
        """The ``n`` grid dates after the first one that is not before ``d`` (an off-grid ``d`` skips that one too)."""
        first = self.on_grid(d)
        far = {"D": n * self.step, "B": 2 * n + 7, "W": 7 * n}.get(self.kind)
        if far is None:
            per = {"MS": 1, "M": 1, "SM": 1, "Q": 3, "Y": 12}[self.kind]
            stop = F.add_months(first, per * n + 1)
        else:
            stop = F.date_add(first, far)
        return F.slice(self.between(first, stop), 2, n)


#: Horizon, preparation, feature and baseline windows, lags and sample periods per family.
DEFAULTS = {
    "D": {"horizon": 28, "dp_window_size": 14, "fe_window_size": (14, 28), "bs_window_size": 14, "lags": (7, 14, 28, 35), "periods": 1095},
    "W": {"horizon": 13, "dp_window_size": 13, "fe_window_size": (4, 13), "bs_window_size": 13, "lags": (13, 26, 39, 52), "periods": 156},
    "M": {"horizon": 4, "dp_window_size": 4, "fe_window_size": (2, 6), "bs_window_size": 4, "lags": (4, 8, 12), "periods": 36},
}


def frequency_params(alias: str | None) -> dict:
    """Defaults of the family of a frequency; an unknown one counts as monthly."""
    try:
        return dict(DEFAULTS[Frequency.parse(alias or "M").family])
    except ValueError:
        return dict(DEFAULTS["M"])


def gap_counts(df: DataFrame, date_col: str) -> DataFrame:
    """(gap, n, first_seen) of the day gaps between consecutive distinct dates of the whole panel."""
    dates = df.select(F.to_date(date_col).alias("d")).where("d IS NOT NULL").distinct()
    gaps = dates.select("d", F.datediff("d", F.lag("d").over(W.orderBy("d"))).alias("gap"))
    return gaps.where("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"), F.min("d").alias("first_seen"))


def aligned(alias: str, df: DataFrame, date_col: str) -> str:
    """A week without a day, as the week that most of the data's dates end; any other frequency as it is."""
    if alias.upper() != "W":
        return alias
    days = df.select(F.to_date(date_col).alias("d")).where("d IS NOT NULL").groupBy(F.weekday("d").alias("p")).count()
    top = days.orderBy(F.desc("count"), "p").first()  # seven rows at most
    return alias if top is None else f"W-{DAYS[top.p]}"


def detect_frequency(df: DataFrame, date_col: str) -> str:
    """Alias of the modal gap between dates; ties go to the gap seen first. Runs two small jobs over distinct dates."""
    top = gap_counts(df, date_col).orderBy(F.desc("n"), "first_seen").first()
    if top is None:
        return "D"
    gap = top.gap
    dates = df.select(F.to_date(date_col).alias("d")).where("d IS NOT NULL").distinct()

    def leader(part: Column) -> tuple[int, float]:
        rows = dates.groupBy(part.alias("p")).count().orderBy(F.desc("count"), "p").collect()  # 31 rows at most
        return rows[0].p, rows[0]["count"] / sum(r["count"] for r in rows)

    # The gaps and shares below are those that results must agree with.
    if gap <= 1:
        return "D"
    if gap <= 3:
        return "B"
    if 6 <= gap <= 8:
        day, share = leader(F.weekday("d"))
        return f"W-{DAYS[day]}" if share > 0.7 else "W"
    if 28 <= gap <= 31:
        day, share = leader(F.dayofmonth("d"))
        return "MS" if share > 0.7 and day <= 5 else "M"
    if 89 <= gap <= 93:
        return "Q"
    if 180 <= gap <= 186:
        return "SM"
    if 364 <= gap <= 366:
        return "Y"
    return f"{gap}D"
