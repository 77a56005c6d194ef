"""Word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_OF_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x94D049BB133111EB)
#: The bytes that end a word, and those that A-Z become.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = []
        for base in (_BASE, _BACK):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _STEP
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has. A-Z count as a-z."""
    raw = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    word = ~_SPACE[raw]
    turn = np.flatnonzero(np.diff(word, prepend=False).astype(bool))
    starts, ends = turn[0::2], turn[1::2]
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_OF_BYTE[raw] * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    edges = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, edges), prepend=0)
    return hashes, counts


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct n-word shingles; fewer words make one shingle, none an empty set."""
    hashes, counts = word_hashes(texts)
    out, at = [], 0
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE))
    for count in counts.tolist():
        own = hashes[at : at + count]
        at += count
        if count == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        k = min(n, count)
        joined = np.full(count - k + 1, np.uint64(k))
        for j in range(k):
            joined = mix(joined + own[j : count - k + 1 + j] * (seeds[j] | np.uint64(1)))
        out.append(np.unique(joined))
    return out


def slices(texts: list[str | None], size: int = 400_000):
    """Runs of texts as bytes, of about size bytes each, so that memory is bounded by the longest text."""
    held: list[bytes] = []
    total = 0
    for text in texts:
        held.append((text or "").encode())
        total += len(held[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held
