"""Word hashes of many texts at once, by array operations over their code points."""

import numpy as np

PRIME = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all of them."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", PRIME), ("down", pow(PRIME, -1, 1 << 64))):
            line = np.full(size, base, np.uint64)
            line[0] = 1
            _POWERS[name] = np.cumprod(line)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def letters_table(word: str) -> np.ndarray:
    """Code point to the number that stands for it in words, 0 between words: `ascii` or `alnum`.

    ascii: digits, letters a-z (A-Z count as them) and everything beyond ASCII. alnum: what Python calls alphanumeric.
    """
    table = np.arange(0x110000, dtype=np.uint64)
    if word == "ascii":
        table[:0x80] = 0
        table[48:58] = np.arange(48, 58)
        table[97:123] = table[65:91] = np.arange(97, 123)
    else:
        table[~np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)] = 0
    return table


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a line end between two, and where each text begins."""
    sizes = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    codes = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.cumsum(sizes) - sizes


def span_hashes(codes: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end) of every word; starts and ends are places in `codes`."""
    value = table[codes]
    edges = np.diff(np.r_[0, (value > 0).view(np.int8), 0])
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = powers(len(codes) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(value * up[: len(codes)])]
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(offsets, starts, "right") - 1, starts, ends


def word_hashes(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end) of every word; starts and ends are code points within its text."""
    codes, offsets = code_points(texts)
    h, owner, starts, ends = span_hashes(codes, offsets, table)
    return h, owner, starts - offsets[owner], ends - offsets[owner]
