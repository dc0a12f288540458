"""Patterns that are tried only where a text holds a piece of letters that every match has, or one of some."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser  # the parser that re itself uses


def folded(text: str) -> str:
    """The text in one case, as far as case-insensitive patterns take letters for equal."""
    return text.replace("ı", "i").replace("İ", "i").casefold()


def _sets(items) -> Iterator[tuple[str, ...]]:
    """Runs of characters of a parsed pattern, each with those it is an alternative to: one of a set stands in every match."""
    run = ""
    for op, value in items:
        if str(op) == "LITERAL":
            run += chr(value)
            continue
        yield (run,)
        run = ""
        if str(op) == "SUBPATTERN":
            yield from _sets(value[3])
        elif str(op) == "BRANCH":
            yield tuple(x for part in value[1] for x in _best(part))
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            yield from _sets(value[2])
    yield (run,)


def _best(items) -> tuple[str, ...]:
    return max(_sets(items), key=lambda xs: min(map(len, xs)))


def stem(pattern: str) -> str:
    """The longest run of characters, in one case, that stands in every match; empty if there is none."""
    return folded(max((xs[0] for xs in _sets(_parser.parse(pattern, re.IGNORECASE)) if len(xs) == 1), key=len))


def stems(pattern: str) -> tuple[str, ...]:
    """Runs of characters, in one case, of which one stands in every match: the set whose shortest is longest."""
    return tuple(dict.fromkeys(folded(x) for x in _best(_parser.parse(pattern, re.IGNORECASE))))


class Finder:
    """A case-insensitive pattern with its stems."""

    def __init__(self, pattern: str, flags: int = 0):
        self.pattern, self.stems = re.compile(pattern, re.IGNORECASE | flags), stems(pattern)

    def finditer(self, text: str, low: str) -> Iterator[re.Match]:
        """Matches in a text, given that text folded."""
        return self.pattern.finditer(text) if self.within(low) else iter(())

    def within(self, low: str) -> bool:
        """Whether a folded text holds a stem."""
        return any(s in low for s in self.stems)

    def reach(self, low: str) -> tuple[int, int]:
        """Where in a folded text that holds a stem the first one ends at the earliest, and where the last one begins."""
        held = [(at, s) for s in self.stems if (at := low.find(s)) >= 0]
        return min(at + len(s) for at, s in held), max(low.rfind(s) for _, s in held)
