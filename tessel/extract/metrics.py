"""Metrics that both languages share."""

from __future__ import annotations

import math
import re

_BLANK = re.compile(r"\S")


def nonblank(text: str) -> int:
    return sum(1 for line in text.split("\n") if _BLANK.search(line))


def maintainability(vocabulary: int, cyclomatic: int, loc: int) -> float:
    volume = vocabulary * math.log2(vocabulary) if vocabulary > 1 else 1.0
    raw = (171 - 5.2 * math.log(max(volume, 1.0)) - 0.23 * cyclomatic - 16.2 * math.log(max(loc, 1))) * 100 / 171
    return round(min(100.0, max(0.0, raw)), 6)
