"""Vectorised pre-tokenisation without regular expressions.

Codepoints become class symbols through one table. A small automaton over these
symbols reads the text; its transition functions are composed associatively,
block by block, so that the states of a whole batch come from array operations.
Token boundaries are then read off neighbouring states.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

# Symbols.
_LETTER, _NUMBER, _OTHER, _BLANK, _WHITE, _APOS, _STMD, _R, _V, _LL, _E, _BREAK = range(12)
# States: what has just been read.
FRESH, LETTER, NUMBER, OTHER, BLANK, WHITE, APOS, RV, L1, CLOSED = range(10)

#: Codepoints from here on are looked up one by one (planes above the emoji hold few letters in practice).
_TABLE_SIZE = 0x110000


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Symbol of each codepoint; classes by the Unicode tables of the regex library."""
    table = np.full(_TABLE_SIZE, _OTHER, np.uint8)
    every = np.delete(np.arange(_TABLE_SIZE, dtype="<u4"), slice(0xD800, 0xE000)).tobytes().decode("utf-32-le")
    for pattern, symbol in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\p{White_Space}+", _WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            table[a : b + 1] = symbol
    table[0xD800:0xE000] = _OTHER
    for text, symbol in ((" ", _BLANK), ("'", _APOS), ("stmd", _STMD), ("r", _R), ("v", _V), ("l", _LL), ("e", _E)):
        for c in text:
            table[ord(c)] = symbol
    return table


@lru_cache(maxsize=1)
def transitions() -> np.ndarray:
    """next state = transitions()[symbol, state]."""
    t = np.zeros((12, 10), np.uint8)
    t[[_LETTER, _STMD, _R, _V, _LL, _E], :] = LETTER
    t[_NUMBER, :], t[_OTHER, :], t[_BLANK, :], t[_WHITE, :], t[_BREAK, :] = NUMBER, OTHER, BLANK, WHITE, FRESH
    t[_APOS, :] = APOS
    t[_APOS, [OTHER, BLANK, APOS]] = OTHER
    t[_STMD, APOS], t[_R, APOS], t[_V, APOS], t[_LL, APOS] = CLOSED, RV, RV, L1
    t[_E, RV], t[_LL, L1] = CLOSED, CLOSED
    return t


@lru_cache(maxsize=1)
def _opens() -> np.ndarray:
    """_opens()[before, after]: a token starts at the character that leads from one state to the other."""
    t = np.zeros((10, 10), bool)
    t[[FRESH, NUMBER, OTHER, WHITE, CLOSED], LETTER] = True
    t[APOS, [LETTER, RV, L1]] = True
    t[[FRESH, LETTER, OTHER, WHITE, APOS, RV, L1, CLOSED], NUMBER] = True
    for s in (OTHER, APOS):
        t[[FRESH, LETTER, NUMBER, WHITE, RV, L1, CLOSED], s] = True
    for s in (BLANK, WHITE):
        t[[FRESH, LETTER, NUMBER, OTHER, APOS, RV, L1, CLOSED], s] = True
    return t


def scan(symbol: np.ndarray, width: int = 128) -> np.ndarray:
    """State after each symbol. Each row of `width` symbols is composed to one function, the rows' functions are scanned, then states are filled in."""
    t, n = transitions(), len(symbol)
    rows = -(-n // width)
    if not rows:
        return np.zeros(0, np.uint8)
    padded = np.full(rows * width, _BREAK, np.uint8)
    padded[:n] = symbol
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)
    # A row's function is constant from its last symbol that resets every state on.
    flat = t.ravel()
    start = np.zeros(rows, np.uint8)
    if rows > 1:
        f = np.repeat(np.arange(10, dtype=np.uint8)[:, None], rows, 1)
        tail = 4  # any four symbols compose to a constant function: a contraction spans three
        for k in range(width - tail, width):
            f = flat[grid[k].astype(np.int16) * 10 + f]
        constant = (f == f[0]).all(0)
        if not constant.all():
            f = np.repeat(np.arange(10, dtype=np.uint8)[:, None], rows, 1)
            for k in range(width):
                f = flat[grid[k].astype(np.int16) * 10 + f]
        step = 1
        while step < rows and not (f == f[0]).all():
            g = f.copy()
            g[:, step:] = np.take_along_axis(f[:, step:], f[:, :-step], 0)
            f, step = g, step * 2
        start[1:] = f[FRESH, :-1]
    out = np.empty((width, rows), np.uint8)
    state = start
    for k in range(width):
        state = flat[grid[k].astype(np.int16) * 10 + state]
        out[k] = state
    return np.ascontiguousarray(out.T).ravel()[:n]


def boundaries(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte starts of the pre-tokens of a batch of documents; each document's first token starts at its offset."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80) if len(points) != len(data) else np.arange(len(data))
    edge = np.searchsorted(lead, np.unique(off[(off < len(data))]))  # first characters of documents
    # A break stands before each document's first character.
    n = len(points) + len(edge)
    place = np.ones(n, bool)
    breaks = edge + np.arange(len(edge))
    place[breaks] = False
    symbol = np.full(n, _BREAK, np.uint8)
    symbol[place] = symbols()[points]
    state = scan(symbol)
    before, after = np.concatenate(([FRESH], state[:-1])).astype(np.uint8), state
    opens = _opens()[before, after]
    following = np.concatenate((state[1:], [FRESH])).astype(np.uint8)
    opens &= ~(((after == RV) | (after == L1)) & (following == CLOSED))
    white = (after == BLANK) | (after == WHITE)
    opens |= white & ~((following == BLANK) | (following == WHITE) | (following == FRESH))
    return lead[np.flatnonzero(opens[place])]
