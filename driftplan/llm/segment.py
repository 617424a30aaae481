"""Vectorised text segmentation: words, and the pre-tokens of two public tokenizers.

A chunk of documents is one array of code points; token boundaries, spans and
64-bit span hashes come out of whole-array numpy operations.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Below this code point the classes come from a table; texts with others go to the library's own pre-tokenizer.
TABLE = 0x3000
#: Unicode's White_Space below TABLE.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F)
ROOT = 0x9E3779B97F4A7C15
STEP = 1 << 20


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(TABLE)], np.uint8)
    table[list(WHITE)] = SPACE
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROOT**i and its inverse modulo 2**64, for i up to n."""
    up = np.full(n + 1, ROOT, np.uint64)
    down = np.full(n + 1, pow(ROOT, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of symbols; equal spans have equal hashes wherever they stand."""
    n = -(-max(len(symbols), 1) // STEP) * STEP
    up, down = powers(n)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def distinct_spans(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans: the first of each distinct content, and each one's place among these. Hashes sort them, symbols prove them; where hashes clash, contents decide."""
    _, first, inverse = np.unique(span_hashes(symbols, starts, ends), return_index=True, return_inverse=True)
    size, there = ends - starts, starts[first][inverse]
    sound = bool((size == size[first][inverse]).all())
    for at in range(0, len(starts) if sound else 0, STEP >> 5):
        n, a, b = (x[at : at + (STEP >> 5)] for x in (size, starts, there))
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        sound &= bool((symbols[np.repeat(a, n) + step] == symbols[np.repeat(b, n) + step]).all())
    if not sound:
        places: dict[bytes, int] = {}
        inverse = np.array([places.setdefault(symbols[a:b].tobytes(), len(places)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(inverse, return_index=True)[1]
    return first, inverse


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, and where each text starts (with the end)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def simple(text: str) -> bool:
    return text.isascii() or (max(text) < chr(TABLE))


def contractions(points: np.ndarray, first: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes where one of 's 't 'm 'd 're 've 'll begins a token, and the places behind these tokens."""
    at = np.flatnonzero((points == 0x27) & opens)
    if not len(at):
        return at, at
    padded = np.concatenate((points, np.zeros(3, points.dtype)))
    fresh = np.concatenate((first, np.ones(3, bool)))
    one, two = padded[at + 1], padded[at + 2]
    within = ~fresh[at + 1]
    short = within & np.isin(one, [ord(c) for c in "stmd"])
    long = within & ~fresh[at + 2] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    hit = short | long
    return at[hit], at[hit] + np.where(short[hit], 2, 3)


def byte_bpe_spans(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the byte-level pattern start; they cover every code point, and no text's last one runs into the next."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    space = kind == SPACE
    before = np.concatenate(([False], space[:-1])) & ~first
    start = first | (kind != np.concatenate(([9], kind[:-1])))
    # the last white space before a word goes its own way: a blank joins the word, others stand alone
    last = space & np.concatenate((~space[1:] & ~first[1:], [False])) if n else space
    start |= last
    blank = np.concatenate(([False], points[:-1] == 0x20)) & before
    start &= ~(blank & ~space)
    opens = start & (kind == OTHER)
    at, end = contractions(points, first, opens)
    start[at + 1] = False
    start[end[end < n]] = True
    return np.flatnonzero(start)


def word_bpe_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of the lower-case pattern: letters, single digits, other signs; white space is in none."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    start = first | (kind != np.concatenate(([9], kind[:-1]))) | (kind == NUMBER)
    at, end = contractions(points, first, start & (kind == OTHER))
    start[at + 1] = False
    start[end[end < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    held = kind[starts] != SPACE
    return starts[held], ends[held]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of ASCII-lower-cased texts in UTF-8, and how many words lie before each text (with the total)."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass") + b"\n"
    data = np.frombuffer(raw, np.uint8)
    white = (data == 0x20) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], white)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    upper = (data >= 65) & (data <= 90)
    hashes = span_hashes(data + np.where(upper, 32, 0).astype(np.uint8), starts, ends)
    sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
    bounds = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1)))
    return hashes, np.searchsorted(starts, bounds)
