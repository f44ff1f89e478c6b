"""Order MinHash fingerprints, sensitive to edit distance.

A k-mer is K consecutive code points together with the number of its occurrence in the text, so
repeated k-mers are distinct.  Each of ROWS hash functions ranks all of them, takes the PICK
smallest, puts them back into text order and hashes that tuple of k-mers; the row of the
fingerprint is that hash.  Two texts agree in a row with a probability that falls with their
edit distance, because both the chosen k-mers and their order have to survive.  Likeness is the
share of agreeing rows.

A text of fewer than K code points is one k-mer.  Empty texts share one fingerprint of zeros.
Equal texts always have equal fingerprints.

Next document: order is doc_id ascending (a null id first), rows of equal id by text; the last
is followed by the first, and a single row by itself.  Null text is empty.  An empty table gives
an empty result; extra columns are ignored.

Plan: one exchange.  Rows go to segments of consecutive ids (segments.py) as compressed Arrow
blocks; a segment also gets a copy of the first row of the next one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .segments import pack, segment_plan, unpack

K, PICK, ROWS = 5, 2, 48

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.random.default_rng(11).integers(0, 2**31, (ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(12).integers(0, 2**32, (ROWS, 1), dtype=np.uint32)
#: Cells of the (hash function, k-mer) table that are made at a time.
CELLS = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def kmers(points: np.ndarray) -> np.ndarray:
    """Hash of each k-mer, in text order."""
    x = points.astype(np.uint64) + np.uint64(1)
    if len(x) < K:
        x = np.concatenate([x, np.zeros(K - len(x), np.uint64)])
    n = len(x) - K + 1
    h = x[:n].copy()
    for j in range(1, K):  # 21 bits hold a code point; five of them wrap, so mix as we go
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n]
    return _mix(h)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hash of (k-mer, occurrence number)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(h)
    out[order] = np.where(nth > 0, _mix(s + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), s)
    return out


def fingerprint(text: str) -> np.ndarray:
    """ROWS 32-bit rows."""
    if not text:
        return np.zeros(ROWS, np.uint32)
    h = kmers(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    u = (numbered(h) >> np.uint64(32)).astype(np.uint32)
    step = max(1, CELLS // len(u))
    first, second = np.empty(ROWS, np.int64), np.empty(ROWS, np.int64)
    for r in range(0, ROWS, step):
        v = u * _ODD[r : r + step]
        v ^= _ADD[r : r + step]
        first[r : r + step] = a = v.argmin(axis=1)
        v[np.arange(len(v)), a] = 0xFFFFFFFF
        second[r : r + step] = v.argmin(axis=1)
    lo, hi = np.minimum(first, second), np.maximum(first, second)
    rows = _mix(_mix(h[lo]) * np.uint64(3) + h[hi] + np.arange(ROWS, dtype=np.uint64))
    return np.maximum((rows >> np.uint64(32)).astype(np.uint32), 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _group(key, tables):
    rows = unpack(tables, with_guest=True)  # ordered; the last is the guest that follows
    if not rows:
        return pa.table({n: pa.array([], t) for n, t in _ARROW})
    out = {n: [] for n, _ in _ARROW}
    texts = [t for _, t, _ in rows]
    own = fingerprint(texts[0])
    for (doc_id, text, guest), after in zip(rows, texts[1:]):
        nxt = fingerprint(after)
        changed = edited(text, after)
        print_ = fingerprint(changed) if changed != text else own
        for name, value in zip(out, (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u4").tobytes().hex(), print_.astype(">u4").tobytes().hex(), likeness(own, print_), likeness(own, nxt))):
            out[name].append(value)
        own = nxt
    return pa.table({n: pa.array(out[n], t) for n, t in _ARROW})


_ARROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    plan = segment_plan(docs)
    packed = pack(docs, plan, guests=True)
    return packed.groupBy("seg").applyInArrow(_group, _SCHEMA)
