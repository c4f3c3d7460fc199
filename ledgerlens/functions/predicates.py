"""Row predicates and time scopes as Column factories. The variants differ on purpose; none is a shorthand for another."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def current(archived: str = "archived") -> Column:
    """Shared filter: a null archived flag counts as current."""
    return ~F.coalesce(F.col(archived), F.lit(False))


def current_native(archived: str = "archived") -> Column:
    """Native filter: a null archived flag drops the row."""
    return F.col(archived) == F.lit(False)


def contributions(amount: str = "amount", part: str = "d2_part", archived: str = "archived") -> Column:
    """Positive, current, individual part or blank part."""
    blank = F.coalesce(F.trim(F.col(part)), F.lit("")) == ""
    return (F.col(amount) > 0) & current(archived) & (blank | F.col(part).like("1%"))


def all_receipts(amount: str = "amount", archived: str = "archived") -> Column:
    """Positive and current, any part."""
    return (F.col(amount) > 0) & current(archived)


def entity_receipts(amount: str = "amount", part: str = "d2_part", archived: str = "archived") -> Column:
    """Positive, current, individual part; a blank part is excluded."""
    return (F.col(amount) > 0) & current(archived) & F.coalesce(F.col(part).like("1%"), F.lit(False))


def vendor_rows(part: str = "d2_part") -> Column:
    """Everything but independent expenditures; a null part stays."""
    return F.col(part).isNull() | ~F.col(part).like("9%")


def cycle(day: Column) -> Column:
    """Two-year cycle: an odd year belongs to the next."""
    return (F.year(day) + F.pmod(F.year(day), F.lit(2))).cast("int")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_overlaps(month: Column, low: date, high: date) -> Column:
    """Whether the month that starts at `month` shares a day with the inclusive range."""
    return (F.last_day(month) >= F.lit(low)) & (month <= F.lit(high))


@dataclass(frozen=True)
class Scope:
    """Inclusive time scope; no bound on an end means all time. Rows without a date are outside any bounded scope."""

    low: date | None = None
    high: date | None = None

    @classmethod
    def of_cycle(cls, year: int) -> Scope:
        year += year % 2
        return cls(date(year - 1, 1, 1), date(year, 12, 31))

    def snapped(self) -> Scope:
        """Widened to whole calendar years."""
        return Scope(self.low and date(self.low.year, 1, 1), self.high and date(self.high.year, 12, 31))

    def cycles(self) -> list[int]:
        if not self.low or not self.high:
            return []
        first, last = (d.year + d.year % 2 for d in (self.low, self.high))
        return list(range(first, last + 1, 2))

    def whole_cycles(self) -> bool:
        return bool(self.low and self.high and self.low == date(self.low.year, 1, 1) and self.high == date(self.high.year, 12, 31) and self.low.year % 2 == 1 and self.high.year % 2 == 0)

    def where(self, day: str) -> Column:
        test = F.lit(True)
        if self.low:
            test = test & F.coalesce(F.col(day) >= F.lit(self.low), F.lit(False))
        if self.high:
            test = test & F.coalesce(F.col(day) <= F.lit(self.high), F.lit(False))
        return test
