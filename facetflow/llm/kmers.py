"""Word k-mers of texts by rolling hashes, and their minimizers."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be divided by


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all others; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(lists: list[list[bytes]], seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words of several texts, end to end."""
    memo: dict[bytes, int] = {}
    distinct: set[bytes] = set()
    for words in lists:
        distinct.update(words)
    memo = {w: xxhash.xxh64_intdigest(w, seed) for w in distinct}
    total = sum(map(len, lists))
    return np.fromiter((h for words in lists for h in map(memo.__getitem__, words)), np.uint64, total)


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        _POWERS = np.r_[np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64), dtype=np.uint64)]
    return _POWERS[:n]


def window_hashes(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of `size` of the hashes: the sum of hash x base^place within the run, mixed. Empty if there are fewer."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    h = mix(hashes ^ np.uint64(salt)) if salt else hashes
    # Horner's rule over the places of the run, for all runs at once: doubling the length handled.
    done, out = 0, np.zeros(n, np.uint64)
    block, length = h, 1  # block[i]: hash of the run of `length` at i
    bits, power = size, _BASE
    while bits:
        if bits & 1:
            shifted = np.zeros(n, np.uint64)
            shifted[: n - done] = block[done:]
            out = out + shifted * powers(done + 1)[done]
            done += length
        bits >>= 1
        if bits:
            nxt = block.copy()
            nxt[: n - length] += block[length:] * power
            block, length, power = nxt, 2 * length, power * power
    return mix(out[: n - size + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    length, block = 1, x
    while 2 * length <= width:
        block = np.minimum(block[: len(block) - length], block[length:])
        length *= 2
    rest = width - length
    return np.minimum(block[: len(block) - rest], block[rest:]) if rest else block
