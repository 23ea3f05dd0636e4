"""Two Bloom filters over the names of one slice.

Both follow the number of names that the slice holds, and live only in the task that
has them: neither is sent anywhere.
"""

from __future__ import annotations

import numpy as np

from ._text import mix

PROBES = 4
BITS_A_NAME = 10


def probes(names: np.ndarray, bits: int) -> list[np.ndarray]:
    """``PROBES`` positions below ``bits`` (a power of two) for every name.

    Names are mixed once more: all of a slice share their first bits.
    """
    h = mix(names)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(j) * step) & np.uint64(bits - 1)).astype(np.int64) for j in range(PROBES)]


def put(bitmap: np.ndarray, names: np.ndarray) -> None:
    for at in probes(names, len(bitmap) * 8):
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))


def has(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    out = np.ones(len(names), bool)
    for at in probes(names, len(bitmap) * 8):
        out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def sized(names: int) -> int:
    """Bits for this many names: a power of two."""
    return max(1 << 10, 1 << int(np.ceil(np.log2(BITS_A_NAME * names + 1))))


def seen_twice(names: list[np.ndarray], many: list[np.ndarray], bits: int | None = None) -> list[np.ndarray]:
    """Which names the second filter holds, list by list; a list has each name once.

    A name goes into the first filter; if it is there already, or ``many`` says that its
    list met it twice, it goes into the second one.
    """
    total = sum(map(len, names))
    once = np.zeros(sized(total) >> 3, np.uint8)
    twice = np.zeros((bits or sized(total)) >> 3, np.uint8)
    for some, flag in zip(names, many, strict=True):
        put(twice, some[flag | has(once, some)])
        put(once, some)
    return [has(twice, some) for some in names]
