"""Cutting one packed field into its values.

The functions here look at one field only; Spark brings the fields and the
dictionary to them (see ``operators.packed``).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import ahocorasick

#: One unquoted value: letters, digits, ``_ . - : '``, single ``|``, and any character behind a backslash.
_RUN = re.compile(r"(?:[\w.\-:']|(?<!\|)\|(?!\|)|\\.)+", re.DOTALL)
_WORD = re.compile(r"[\w.\-:'|\\]")
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_BRACKETS = {"[": "]", "(": ")", "{": "}", "<": ">"}

#: Costs of the cover. A known value is free, an unknown one is not, and a
#: quotation mark without a partner costs more than an unknown value but less
#: than an unknown value with delimiters inside. Quoted text that covers several
#: known values costs more for each, and so does a run that keeps an outer mark.
_UNKNOWN, _NOISE, _QUOTED_UNKNOWN, _PER_EXTRA, _OUTER_MARK = 2, 3, 4, 2, 6


def automaton(values: list[str]) -> ahocorasick.Automaton:
    """A multi-pattern automaton over whole values."""
    built = ahocorasick.Automaton()
    for value in values:
        if value:
            built.add_word(value, value)
    if len(built):
        built.make_automaton()
    return built


def _boundary(text: str, at: int) -> bool:
    return at < 0 or at >= len(text) or not _WORD.match(text[at]) or text[at : at + 2] == "||" or text[max(at - 1, 0) : at + 1] == "||"


def _strip_brackets(text: str) -> str:
    text = text.strip()
    while len(text) > 1 and _BRACKETS.get(text[0]) == text[-1]:
        depth = 0
        for at, char in enumerate(text):
            depth += (char == text[0]) - (char == text[-1])
            if depth == 0 and at < len(text) - 1:
                return text
        text = text[1:-1].strip()
    return text


def _closing(text: str, at: int) -> int:
    """The place of the mark that closes the one at ``at``, or -1."""
    mark, k = text[at], at + 1
    while k < len(text):
        if text[k] == "\\":
            k += 2
            continue
        if text[k] == mark:
            if mark == '"' and text[k + 1 : k + 2] == '"':
                k += 2
                continue
            if _boundary(text, k + 1):
                return k
        k += 1
    return -1


def known_spans(text: str, known: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Start and end of every known whole value that stands between boundaries."""
    found = []
    if text and len(known):
        for last, value in known.iter(text):
            first = last - len(value) + 1
            before, after = text[first - 1 : first], text[last + 1 : last + 2]
            if (before == "'" or _boundary(text, first - 1)) and (after == "'" or _boundary(text, last + 1)):
                found.append((first, last + 1))
    return found


def marks(field: str | None, known: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """``known_spans`` of one field, counted in its text without outer brackets."""
    return known_spans(_strip_brackets(field), known) if field else []


def segment(field: str | None, known: ahocorasick.Automaton) -> list[str]:
    """The values of one field, in order. Null and empty fields have no values."""
    return cover(field, marks(field, known))


def cover(field: str | None, marked: Iterable[tuple[int, int]]) -> list[str]:
    """The values of one field, in order, given its ``marks``, in any order.

    Dynamic programming over the field's positions picks the cheapest cover
    out of known values, quoted values, unquoted runs, single noise marks and
    separators. A known value may hold delimiters: its span is one edge of the
    cover.
    """
    if not field:
        return []
    text = _strip_brackets(field)
    n = len(text)
    spans: dict[int, list[tuple[int, str]]] = {}
    for first, end in marked:
        spans.setdefault(first, []).append((end, text[first:end]))
    # A cover by known values and separators alone costs nothing: none is better.
    at, found = 0, []
    while at < n:
        if at in spans:
            end, value = max(spans[at])
            found.append(value)
            at = end
        elif text[at] in "\"'\\" or _WORD.match(text[at]) and not _boundary(text, at):
            break
        else:
            at += 1
    if at >= n:
        return found

    starts = sorted(spans)
    infinite = 1 << 60
    best = [infinite] * (n + 1)
    back: list[tuple[int, str | None]] = [(0, None)] * (n + 1)
    best[0] = 0

    def edge(start: int, end: int, cost: int, value: str | None) -> None:
        if best[start] + cost < best[end]:
            best[end], back[end] = best[start] + cost, (start, value)

    for at in range(n):
        if best[at] == infinite:
            continue
        char = text[at]
        for end, value in spans.get(at, ()):
            edge(at, end, 0, value)
        if char in "\"'":
            edge(at, at + 1, _NOISE, None)
            close = _closing(text, at) if _boundary(text, at - 1) or text[at - 1] in "\"'" else -1
            if close > 0:
                raw = text[at + 1 : close]
                value = _ESCAPE.sub(r"\1", raw.replace('""', '"') if char == '"' else raw)
                inner = spans.get(at + 1, ())
                if not value.strip():
                    edge(at, close + 1, 0, None)
                elif any(end == close for end, _ in inner):
                    edge(at, close + 1, 0, value)
                else:
                    edge(at, close + 1, _UNKNOWN if _RUN.fullmatch(raw) else _QUOTED_UNKNOWN + _PER_EXTRA * max(0, bisect_left(starts, close) - bisect_left(starts, at) - 1), value)
        run = _RUN.match(text, at)
        if run:
            end = run.end()
            if at == 0 or text[at - 1] in "\"'" or _boundary(text, at - 1):
                edge(at, end, _OUTER_MARK if char == "'" or text[end - 1] == "'" else _UNKNOWN, _ESCAPE.sub(r"\1", run.group()))
                if text[end - 1] == "'" and end - at > 1 and text[end - 2] != "\\":
                    edge(at, end - 1, _UNKNOWN, _ESCAPE.sub(r"\1", text[at : end - 1]))
        elif char not in "\"'":
            edge(at, at + 1, 0, None)
    values, at = [], n
    while at > 0:
        at, value = back[at]
        if value is not None and value.strip():
            values.append(value)
    return values[::-1]
