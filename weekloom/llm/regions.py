"""Regions of a text that can repeat: content-defined runs of windows.

The least hash of the ``GRAM``-byte strings inside a window of ``span`` bytes depends on the
window's bytes alone, so equal windows have the same one, anywhere. Neighbouring windows with the
same least hash form a run; a window can only have a twin in a run of the same hash.
"""

import numpy as np

GRAM = 32
MIXERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all strings of ``GRAM`` bytes, by doubling."""
    hashed = data.astype(np.uint64) + np.uint64(1)
    width = 1
    for mixer in MIXERS:
        hashed = hashed[:-width] * mixer + (hashed[width:] ^ (hashed[width:] >> np.uint64(29)))
        width *= 2
    hashed ^= hashed >> np.uint64(32)
    hashed *= MIXERS[0]
    return hashed ^ (hashed >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def runs(data: bytes, span: int) -> list[tuple[int, int, int, bool]]:
    """(least hash, first window, last window, inner) of every run; ``inner`` if the hash occurs
    more than once in the run, so that windows inside it may be equal."""
    if len(data) < span:
        return []
    hashed = gram_hashes(np.frombuffer(data, np.uint8))
    width = span - GRAM + 1
    least = sliding_min(hashed, width)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(starts[1:], len(least)) - 1
    keys = least[starts]
    out = []
    for key, a, b in zip(keys, starts.tolist(), ends.tolist()):
        inner = np.count_nonzero(hashed[a:b + width] == key) > 1
        out.append((int(key), a, b, bool(inner)))
    return out
