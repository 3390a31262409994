"""Names of a token sequence by recompression: rounds that name runs of one
symbol, then pairs of neighbours from two halves of the alphabet.

A name is a 64-bit hash of what it stands for and the halves are chosen by a
bit of it, so all tasks give equal strings equal names without an exchange.
What a round does to a symbol depends on its neighbours alone: inside an
occurrence of a string, all but its outermost symbols come out alike wherever
it occurs.  ``lf[p]`` and ``rt[p]`` are the first symbol that is sure for a
string that starts at token ``p``, and the end of those sure for one that ends
before ``p``: a round gives up the outermost run on each side (it may go on
outside) and then a symbol that may pair with what is given up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

U = np.uint64


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two, order and all."""
    x = (a * U(0x9E3779B97F4A7C15)) ^ (((b << U(31)) | (b >> U(33))) * U(0xC2B2AE3D27D4EB4F))
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def token_names(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), U, len(tokens))


@dataclass
class Level:
    """Symbols of one level; ``wall`` marks the ends of documents, which are never joined."""

    names: np.ndarray
    start: np.ndarray
    wall: np.ndarray
    lf: np.ndarray
    rt: np.ndarray


def base(names: np.ndarray, wall: np.ndarray) -> Level:
    n = len(names)
    return Level(names, np.arange(n), wall, np.arange(n), np.arange(n + 1))


def next_level(v: Level, salt: int) -> Level:
    """One round: runs, then pairs."""
    m = len(v.names)
    new = np.ones(m, bool)
    np.not_equal(v.names[1:], v.names[:-1], out=new[1:])
    new |= v.wall
    first = np.flatnonzero(new)
    k = len(first)
    run = np.append(np.cumsum(new) - 1, k)
    length = np.diff(np.append(first, m))
    names, start, wall = v.names[first], v.start[first], v.wall[first]
    many = np.flatnonzero(length > 1)
    names[many] = mix(names[many], length[many].astype(U) + U(salt << 48))
    lf = np.minimum(run[v.lf] + 1, k)
    rt = np.where(v.rt > 0, run[np.maximum(v.rt - 1, 0)], 0)

    side = ((names * U(0xD6E8FEB86659FD93 + 2 * salt)) >> U(63)).astype(bool)
    left, right = side & ~wall, ~side & ~wall
    pair = np.zeros(k, bool)
    pair[:-1] = left[:-1] & right[1:]
    kept = np.ones(k, bool)
    kept[1:] = ~pair[:-1]
    at = np.append(np.cumsum(kept) - 1, kept.sum())
    joined = names.copy()
    p = np.flatnonzero(pair)
    joined[p] = mix(names[p], names[p + 1])
    # a sure first symbol of the right half may pair with what is before it, a last one of the left half with what follows
    lf = at[np.minimum(lf + np.append(right, False)[lf], k)]
    rt = at[np.where(rt > 0, rt - left[np.maximum(rt - 1, 0)], 0)]
    return Level(joined[kept], start[kept], wall[kept], lf, rt)


def window_names(names: np.ndarray, window: int, seed: int) -> np.ndarray:
    """64-bit name of each string of ``window`` tokens, by their starts."""
    n = len(names) - window + 1
    out = np.full(max(n, 0), U(seed))
    for k in range(window if n > 0 else 0):
        out = mix(out, names[k:k + n])
    return out


def anchors(names: np.ndarray, wall: np.ndarray, window: int, rounds: int, grams: tuple[int, ...]) -> np.ndarray:
    """One key per window, equal for equal windows: the least-hashed group of
    ``grams[r]`` sure symbols of the highest level r that has one in the window,
    or the window's own name where none has (long runs)."""
    out = window_names(names, window, 1)
    n = len(out)
    v = base(names, wall)
    for r in range(rounds):
        v, g = next_level(v, r + 1), grams[r]
        m = len(v.names) - g + 1
        if m <= 0:
            break
        group = window_names(v.names, g, 2 + r)
        lf, end = v.lf[:n], v.rt[window:window + n] - g
        best = np.full(n, np.iinfo(U).max)
        t, open_ = 0, np.flatnonzero(lf <= end)
        some = open_
        while len(open_):
            at = lf[open_] + t
            best[open_] = np.minimum(best[open_], group[at])
            t += 1
            open_ = open_[at < end[open_]]
        out[some] = best[some]
    return out
