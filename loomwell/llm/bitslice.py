"""Bit-sliced Hamming comparison.

Fingerprints are stored vertically: plane b holds bit b of every fingerprint, 64 fingerprints
to a machine word.  A comparison XORs planes, adds the difference bits into carry-save bitwise
counters (one counter bit per plane of the counter), and gives a block of 64 up as soon as all
of its counters have passed the radius.
"""

from __future__ import annotations

import itertools

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Groups up to this size are compared together by shifting the planes; larger ones row against block.
SMALL = 32
#: Rows of a large group that are compared at a time.
ROWS = 256
#: Planes between two looks at which blocks can be given up.
CHECK = 8


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(n, w) uint64 fingerprints -> (64 w, ceil(n / 64)) planes."""
    n, w = prints.shape
    pad = -n % 64
    raw = np.ascontiguousarray(prints).view(np.uint8).reshape(n, w * 8)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    if pad:
        bits = np.vstack([bits, np.zeros((pad, w * 64), np.uint8)])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


class Counter:
    """Bitwise carry-save counters, preset so that the carry out of the top means `over radius`."""

    def __init__(self, radius: int, shape):
        self.k = max(1, int(radius + 1).bit_length())
        start = (1 << self.k) - 1 - radius
        self.c = [np.full(shape, FULL if start >> j & 1 else 0, np.uint64) for j in range(self.k)]
        self.over = np.zeros(shape, np.uint64)

    def add(self, x: np.ndarray) -> None:
        for j in range(self.k):
            c = self.c[j]
            carry = c & x
            c ^= x
            x = carry
        self.over |= x

    def keep(self, at) -> None:
        self.c = [c[at] for c in self.c]
        self.over = self.over[at]


def _shifted(planes: np.ndarray, s: int) -> np.ndarray:
    """Plane bits i + s moved to i."""
    words, bits = divmod(s, 64)
    out = np.zeros_like(planes)
    n = planes.shape[-1]
    if words < n:
        out[..., : n - words] = planes[..., words:] >> np.uint64(bits)
        if bits:
            out[..., : n - words - 1] |= planes[..., words + 1 :] << np.uint64(64 - bits)
    return out


def near_neighbours(prints: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int):
    """Links inside many small groups of consecutive rows, as (i, j) index arrays with i < j."""
    n = len(prints)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    planes = planes_of(prints)
    last = np.repeat(ends, ends - starts)  # of each row: the end of its group
    rows = np.arange(n)
    left, right = [], []
    for s in range(1, int((ends - starts).max())):
        same = np.zeros(planes.shape[1] * 64, np.uint8)
        same[:n] = rows + s < last
        mask = np.packbits(same, bitorder="little").view(np.uint64)
        live = np.flatnonzero(mask)
        if not len(live):
            break
        far = _shifted(planes, s)
        count = Counter(radius, len(live))
        mask = mask[live]
        for b in range(len(planes)):
            count.add(planes[b, live] ^ far[b, live])
            if b % CHECK == CHECK - 1:
                stay = (mask & ~count.over) != 0
                if not stay.all():
                    live, mask = live[stay], mask[stay]
                    count.keep(stay)
                    if not len(live):
                        break
        if len(live):
            hit = np.unpackbits((mask & ~count.over).view(np.uint8), bitorder="little").reshape(-1, 64)
            word, bit = np.nonzero(hit)
            i = live[word] * 64 + bit
            left.append(i)
            right.append(i + s)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def distances(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each pair of rows."""
    return np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int32)


def tree(a: np.ndarray, b: np.ndarray, prints: np.ndarray):
    """Of the links (a, b) between rows those of a spanning forest, links of few differing bits first."""
    order = np.argsort(distances(prints, a, b), kind="stable")
    a, b = a[order], b[order]
    parent = list(range(len(prints)))
    keep = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)
            keep.append(k)
    return a[keep], b[keep]


def within(planes: np.ndarray, queries: np.ndarray, radius: int, open_words: np.ndarray) -> np.ndarray:
    """For each query the columns at `radius` or less, as a bit matrix (query, word).

    Words of `open_words` that are 0 are never looked at.
    """
    out = np.zeros((len(queries), planes.shape[1]), np.uint64)
    live = np.flatnonzero(open_words)
    qbits = planes_of(queries)
    ask = np.unpackbits(qbits.view(np.uint8), axis=1, bitorder="little")[:, : len(queries)].astype(bool)
    count = Counter(radius, (len(queries), len(live)))
    for b in range(len(planes)):
        count.add(planes[b, live][None, :] ^ np.where(ask[b], FULL, np.uint64(0))[:, None])
        if b % CHECK == CHECK - 1:
            stay = ((open_words[live][None, :] & ~count.over) != 0).any(axis=0)
            if not stay.all():
                live = live[stay]
                count.c = [np.ascontiguousarray(c[:, stay]) for c in count.c]
                count.over = np.ascontiguousarray(count.over[:, stay])
                if not len(live):
                    return out
    out[:, live] = open_words[live][None, :] & ~count.over
    return out


def crossing(prints: np.ndarray, label: np.ndarray, radius: int):
    """All links (i, j), i < j, between rows of different labels, ROWS rows at a time."""
    n = len(prints)
    planes = planes_of(prints)
    for at in range(0, n, ROWS):
        ask = np.arange(at, min(n, at + ROWS))
        want = np.zeros(planes.shape[1] * 64, np.uint8)
        want[:n] = np.arange(n) > at
        if (label[ask] == label[at]).all():
            want[:n] &= label != label[at]
        if not want.any():
            continue
        hit = within(planes, prints[ask], radius, np.packbits(want, bitorder="little").view(np.uint64))
        q, j = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little"))
        i = ask[q]
        new = (j > i) & (label[i] != label[j])
        yield i[new], j[new]


def levels(radius: int) -> list[int]:
    """Radii that `classes` goes through: a wide one in three steps, so that near links come first."""
    return [radius] if radius < 9 else [radius // 3, 2 * radius // 3, radius]


def classes(prints: np.ndarray, radius: int):
    """Tree edges (i, j) of the link graph inside one large group: n - 1 at most, never all pairs.

    Each level of radius joins the classes that the level before left.  Every row is compared, ROWS at a time, with the columns that may still join another class
    to its own; a link that joins two classes becomes an edge, any other adds nothing.
    """
    n = len(prints)
    planes = planes_of(prints)
    label = np.arange(n)
    left, right = [], []
    for near, at in itertools.product(levels(radius), range(0, n, ROWS)):
        ask = np.arange(at, min(n, at + ROWS))
        want = np.zeros(planes.shape[1] * 64, np.uint8)
        want[:n] = np.arange(n) > at
        if (label[ask] == label[at]).all():
            want[:n] &= label != label[at]
        if not want.any():
            continue
        hit = within(planes, prints[ask], near, np.packbits(want, bitorder="little").view(np.uint64))
        some = np.flatnonzero(hit.any(axis=1))
        for q in some:
            got = np.flatnonzero(np.unpackbits(hit[q].view(np.uint8), bitorder="little"))
            was = own = label[ask[q]]
            other, first = np.unique(label[got], return_index=True)
            for k, i in zip(other, first):
                if k != was:
                    left.append(ask[q])
                    right.append(got[i])
                    low = min(k, own)
                    label[(label == k) | (label == own)] = low
                    own = low
    return np.array(left, np.int64), np.array(right, np.int64)
