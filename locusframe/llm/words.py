"""Words of many texts at once as 64-bit hashes, in numpy.

A word's hash is a polynomial over its bytes modulo 2^64, read off prefix sums of the whole batch, then mixed; A-Z count
as a-z.  Two different words share one by a chance of about 2^-64; nothing here resolves that.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at once; a longer text is hashed alone.
AT_ONCE = 400_000
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, x in enumerate((_BASE, _INVERSE)):
            p = np.full(n, x)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the texts in order, number of words of each text)."""
    done, at = [], 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
            size += len(texts[end])
            end += 1
        done.append(_hashed(texts[at:end]))
        at = end
    if not done:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in done]), np.concatenate([n for _, n in done])


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, back = _powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * powers)])
    hashes = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)]))


def shingle_hashes(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of runs of ``width`` words; of all its words as one run, if they are fewer."""
    words, n = word_hashes(texts)
    runs = max(0, len(words) - width + 1)
    run = np.zeros(runs, np.uint64)
    for k in range(width):
        run = mix(run * _BASE + words[k : k + runs])
    out, at = [], 0
    for count in n.tolist():
        if count >= width:
            out.append(np.unique(run[at : at + count - width + 1]))
        elif count:
            h = np.full(1, np.uint64(count))
            for w in words[at : at + count]:
                h = mix(h * _INVERSE + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
