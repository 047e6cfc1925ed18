"""Names of runs and samples: their order, their parts, and which belong together."""

from __future__ import annotations

import re
from collections.abc import Sequence


def natural(text: str) -> list:
    return [int(t) if t.isdigit() else t.lower() for t in re.split(r"(\d+)", text)]


def run_parts(name: str) -> tuple[str, int] | None:
    """(condition, replicate) of a numbered run, such as Soil_3."""
    found = re.fullmatch(r"(.+)_([1-9]\d*)", name)
    return (found[1], int(found[2])) if found else None


def match_stem(stem: str, candidates: Sequence[str]) -> str | None:
    """The candidate equal to ``stem``, else equal without case and punctuation, else the only one that holds it or is held by it."""
    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    for fits in (lambda c: c == stem, lambda c: plain(c) == plain(stem), lambda c: plain(stem) in plain(c) or plain(c) in plain(stem)):
        found = [c for c in candidates if fits(c)]
        if len(found) == 1:
            return found[0]
        if len(found) > 1:
            return None
    return None
