"""Labels made on the driver: sizes, times, threshold rules."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column


def memory_string(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024 or unit == "TiB":
            return f"{n:.4g}{unit}"
        n /= 1024
    raise AssertionError


def time_string(ns: float) -> str:
    for unit, size in (("ns", 1e3), ("us", 1e3), ("ms", 1e3)):
        if ns < size:
            return f"{ns:.4g}{unit}"
        ns /= size
    return f"{ns:.4g}s" if ns < 60 else f"{int(ns // 60)}m{ns % 60:.0f}s"


@dataclass(frozen=True)
class Threshold:
    """A comparison with a number, read from text such as ``>1`` or ``<=0.5``."""

    text: str = ">1"

    def __call__(self, value: Column) -> Column:
        sign, number = self._parts()
        return self.SIGNS[sign][0](value, float(number))

    @property
    def safe(self) -> str:
        """The rule in letters, for file names."""
        sign, number = self._parts()
        return self.SIGNS[sign][1] + (f"{int(number):02d}" if number.isdigit() else number)

    def _parts(self) -> tuple[str, str]:
        m = re.fullmatch(r"\s*(>=|<=|==|>|<)\s*(-?[0-9.]+)\s*", self.text)
        if not m:
            raise ValueError(f"no threshold rule: {self.text!r}")
        return m[1], m[2]


Threshold.SIGNS = {">": (operator.gt, "gt"), ">=": (operator.ge, "ge"), "<": (operator.lt, "lt"), "<=": (operator.le, "le"), "==": (operator.eq, "eq")}
Rule = Callable[[Column], Column]
