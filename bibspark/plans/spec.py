"""What the driver parses before a plan is built: query text and year ranges."""
from __future__ import annotations

import re
from functools import cached_property

from .. import constants as K


class QueryText:
    """One query string with the pieces the scorer turns into literals."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def norm(self) -> str:
        return " ".join(re.findall("[a-z0-9]+", self.text.casefold()))

    @cached_property
    def compact(self) -> str:
        return self.norm.replace(" ", "")

    @staticmethod
    def _informative(text: str) -> list[str]:
        found = [t.lower() for t in re.findall(K.TOKEN_PATTERN, text)]
        return sorted({t for t in found if len(t) > 1} - set(K.STOP_WORDS))

    @cached_property
    def tokens(self) -> list[str]:
        return self._informative(self.text)

    @cached_property
    def norm_tokens(self) -> list[str]:
        return self._informative(self.norm)

    @cached_property
    def years(self) -> list[int]:
        return [int(t) for t in self.tokens if re.fullmatch("[0-9]{4}", t) and 1800 <= int(t) <= 2100]

    @cached_property
    def phrases(self) -> list[str]:
        quoted = [QueryText(p).norm for p in re.findall('"([^"]+)"', self.text)]
        return [p for p in quoted if p]


def parse_year_range(spec: str) -> tuple[int | None, int | None] | None:
    """``2020``, ``2010-2020``, ``2020-`` or ``-2020`` to inclusive bounds; raises on anything else."""
    text = (spec or "").strip()
    if not text:
        return None
    shape = re.fullmatch(r"(\d{4})|(\d{4})?\s*-\s*(\d{4})?", text)
    if not shape or text == "-":
        raise ValueError(f"bad year filter: {spec!r}")
    if shape[1]:
        return int(shape[1]), int(shape[1])
    low, high = (int(g) if g else None for g in (shape[2], shape[3]))
    if low is not None and high is not None and low > high:
        raise ValueError(f"year filter runs backwards: {spec!r}")
    return low, high
