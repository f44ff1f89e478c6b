"""Substring deduplication with a log-structured fingerprint index.

A window is SPAN consecutive words of one document.  A word is removed if some window over it
also starts earlier: in a document of smaller doc_id, or earlier in its own document.

Documents arrive as segments of consecutive doc_id (segments.py).  A segment turns its windows
into entries (64-bit hash, 16-bit check from a second polynomial), sorted and without repeats,
and deals them to hash ranges ("parts").  Inside a part the index is log-structured: each
segment's entries form a sorted immutable run; a new batch is merge-joined with every earlier
run, hits are verified on the check, and what was new becomes the next run; runs of like size
are compacted into one.  The part answers with one bit for each entry (seen earlier or not), and
the segment, made again from the same exchange, marks its words.

A hash value occurs once for each segment at most, so a passage that many documents share costs
no more than a rare one; nothing is emitted for pairs of documents.

FingerprintIndex keeps the runs as tables between calls, for corpora that arrive in batches; it can be
opened again after a restart.

Two different windows count as equal with a chance of 2 ** -80 a pair: of the 1.7e13 windows of 100 TB
about 100 would be removed wrongly; below 10 TB less than one is to be expected.

Null text has no words.  Rows of equal doc_id are ordered by text; a null doc_id comes first.
Fewer than SPAN words: nothing is removed.  An empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_folder, shared_folder
from .segments import pack, segment_plan, unpack

SPAN = 20
#: Entries that one part holds, about.
PART_ENTRIES = 4_000_000
#: Parts of an index that is kept between calls.
INDEX_PARTS_BITS = 6
#: Runs of a kept index before they are compacted.
INDEX_RUNS = 4

_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _poly(h: np.ndarray, mult: int) -> np.ndarray:
    """Polynomial hash of every SPAN consecutive values, from hashes of 1, 2, 4, ... values."""
    cur, width, m = h, 1, mult
    part, done = None, 0
    while True:
        if SPAN & width:  # `cur` covers the first `width` values, `part` the `done` after them
            if part is None:
                part = cur
            else:
                n = len(h) - (done + width) + 1
                part = cur[:n] * np.uint64(pow(mult, done, 1 << 64)) + part[width : width + n]
            done += width
            if done == SPAN:
                return part
        cur = cur[:-width] * np.uint64(m) + cur[width:]
        m = m * m % (1 << 64)
        width *= 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """All windows of a segment, in order, and their sorted distinct entries."""

    def __init__(self, words: list[list[bytes]]):
        digest = xxhash.xxh3_64_intdigest
        self.sizes = np.array([len(w) for w in words], np.int64)
        total = int(self.sizes.sum())
        h = np.fromiter(map(digest, itertools.chain.from_iterable(words)), np.uint64, total)
        if total >= SPAN:
            left = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(total)  # words to the document's end
            self.start = np.flatnonzero(left[: total - SPAN + 1] >= SPAN)
            hashes = _mix(_poly(h, _A))[self.start]
            checks = (_mix(_poly(h, _B))[self.start] >> np.uint64(48)).astype(np.uint16)
        else:
            self.start = np.empty(0, np.int64)
            hashes, checks = np.empty(0, np.uint64), np.empty(0, np.uint16)
        order = np.argsort(hashes, kind="stable")
        s, c = hashes[order], checks[order]
        if ((s[1:] == s[:-1]) & (c[1:] != c[:-1])).any():
            order = np.lexsort((np.arange(len(hashes)), checks, hashes))
            s, c = hashes[order], checks[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        self.order, self.new = order, new
        self.hashes, self.checks = s[new], c[new]

    def bounds(self, bits: int) -> np.ndarray:
        """Where each part begins among the entries."""
        if not bits:
            return np.array([0, len(self.hashes)])
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.append(np.searchsorted(self.hashes, edges), len(self.hashes))

    def covered(self, seen: np.ndarray) -> np.ndarray:
        """Words under a window that starts earlier; seen: of each entry, in an earlier segment."""
        late_sorted = ~self.new | np.repeat(seen, np.diff(np.append(np.flatnonzero(self.new), len(self.new))))
        late = self.start[self.order[late_sorted]]
        step = np.zeros(int(self.sizes.sum()) + SPAN + 1, np.int32)
        step[late] += 1  # starts are distinct
        step[late + SPAN] -= 1
        return np.cumsum(step)[: int(self.sizes.sum())] > 0


def squeeze(h: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted entries as bytes: steps between hashes at the least whole width, then checks."""
    if not len(h):
        return b""
    steps = np.diff(h, prepend=np.uint64(0))
    first, steps = steps[:1], steps[1:]
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    raw = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + len(h).to_bytes(8, "little") + first.tobytes() + raw.tobytes() + c.tobytes()


def unsqueeze(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not raw:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8, 9)
    end = 17 + (n - 1) * width
    steps[1:, :width] = np.frombuffer(raw, np.uint8, (n - 1) * width, 17).reshape(-1, width)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), np.frombuffer(raw, np.uint16, n, end).copy()


def merge_join(h, c, run_h, run_c) -> np.ndarray:
    """Which entries (h, c) the run has; equal hashes count only with an equal check."""
    if not len(run_h):
        return np.zeros(len(h), bool)
    at = np.searchsorted(run_h, h)
    hit = np.zeros(len(h), bool)
    open_ = np.flatnonzero((at < len(run_h)) & (run_h[np.minimum(at, len(run_h) - 1)] == h))
    while len(open_):
        ok = run_c[at[open_]] == c[open_]
        hit[open_[ok]] = True
        open_ = open_[~ok]
        at[open_] += 1
        open_ = open_[at[open_] < len(run_h)]
        open_ = open_[run_h[at[open_]] == h[open_]]
    return hit


def compact(runs):
    """Several sorted runs as one."""
    h, c = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    order = np.argsort(h, kind="stable")
    return h[order], c[order]


class Log:
    """Runs of one part."""

    def __init__(self, runs=()):
        self.runs = list(runs)

    def add(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Join a batch with all runs, keep what is new as a run, compact; returns what was seen."""
        seen = np.zeros(len(h), bool)
        for run in self.runs:
            rest = ~seen
            seen[rest] = merge_join(h[rest], c[rest], *run)
        self.runs.append((h[~seen], c[~seen]))
        while len(self.runs) > 1 and len(self.runs[-2][0]) <= 2 * len(self.runs[-1][0]):
            self.runs[-2:] = [compact(self.runs[-2:])]
        return seen


def _words(table: pa.Table):
    rows = unpack(table)
    return rows, [t.encode("utf-8", "surrogatepass").split() for _, t, _ in rows]


def _entries(bits: int):
    def run(key, table):
        _, words = _words(table)
        w = Windows(words)
        b = w.bounds(bits)
        parts = np.flatnonzero(np.diff(b) > 0)
        blobs = [squeeze(w.hashes[b[p] : b[p + 1]], w.checks[b[p] : b[p + 1]]) for p in parts]
        seg = key[0].as_py()
        return pa.table({"part": pa.array(parts, pa.int64()), "seg": pa.array([seg] * len(parts), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _answer(keep_run: bool):
    def run(key, table):
        rows = sorted(zip(table.column("seg").to_pylist(), table.column("blob").to_pylist()), key=lambda r: r[0])
        past = Log([unsqueeze(b) for s, b in rows if s < 0])
        fresh = Log()
        segs, marks = [], []
        for s, b in rows:
            if s < 0:
                continue
            h, c = unsqueeze(b)
            old = np.zeros(len(h), bool)
            for r in past.runs:
                old |= merge_join(h, c, *r)
            rest = ~old
            seen = old.copy()
            seen[rest] = fresh.add(h[rest], c[rest])
            segs.append(s)
            marks.append(np.packbits(seen).tobytes())
        part = key[0].as_py()
        if keep_run and fresh.runs:
            segs.append(-1)
            marks.append(squeeze(*compact(fresh.runs)))
        return pa.table({"seg": pa.array(segs, pa.int64()), "part": pa.array([part] * len(segs), pa.int64()), "marks": pa.array(marks, pa.binary())})

    return run


_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]


def _apply(bits: int):
    def run(key, docs, marks):
        rows, words = _words(docs)
        if not rows:
            return pa.table({n: pa.array([], t) for n, t in _OUT})
        w = Windows(words)
        b = w.bounds(bits)
        seen = np.zeros(len(w.hashes), bool)
        for p, m in zip(marks.column("part").to_pylist(), marks.column("marks").to_pylist()):
            seen[b[p] : b[p + 1]] = np.unpackbits(np.frombuffer(m, np.uint8))[: b[p + 1] - b[p]]
        stay = ~w.covered(seen)
        ends = np.cumsum(w.sizes)
        kept = [b" ".join(itertools.compress(ws, stay[e - n : e])).decode("utf-8", "surrogatepass") for ws, n, e in zip(words, w.sizes, ends)]
        gone = np.concatenate([[0], np.cumsum(~stay)])
        removed = gone[ends] - gone[ends - w.sizes]
        return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "n_words": pa.array(w.sizes), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def _dedup(docs: DataFrame, bits: int | None, history: DataFrame | None, keep: str | None) -> DataFrame:
    plan = segment_plan(docs)
    if bits is None:
        bits = max(0, int(np.ceil(np.log2(max(1, plan.text_bytes / 6 / PART_ENTRIES)))))
    packed = pack(docs, plan)
    entries = packed.groupBy("seg").applyInArrow(_entries(bits), "part long, seg long, blob binary")
    if history is not None:
        entries = entries.union(history.select("part", "seg", "blob"))
    marks = entries.groupBy("part").applyInArrow(_answer(keep is not None), "seg long, part long, marks binary")
    if keep is not None:
        marks.write.parquet(keep)
        marks = docs.sparkSession.read.parquet(keep).filter("seg >= 0")
    return packed.groupBy("seg").cogroup(marks.groupBy("seg")).applyInArrow(_apply(bits), "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): whole table, the segments being the batches."""
    return _dedup(docs, None, None, None)


class FingerprintIndex:
    """Runs of window entries in a shared folder, one table for each batch until compacted.

    Batches must come in ascending doc_id for "earlier" to hold between them.  A manifest, written after
    each batch, names the runs that count, so an index opened again on the same path, after a restart
    or a failed batch, goes on from the last finished one.  A run that was compacted away is deleted
    with the next batch but one: the result of a batch must be used or written before that.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_folder(spark, "fingerprint-index")
        self.runs, self.gone, self.made = [], [], 0
        names = sorted(self._names("manifest-"))
        if names:
            state = json.loads("".join(r[0] for r in spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).collect()))
            self.runs, self.gone, self.made = state["runs"], state["gone"], state["made"]

    def _names(self, prefix: str) -> list[str]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []
        # a table counts once it is whole
        return [n for n in found if n.startswith(prefix) and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def _commit(self) -> None:
        state = json.dumps({"runs": self.runs, "gone": self.gone, "made": self.made})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{self.made:08d}")

    def _history(self) -> DataFrame | None:
        found = None
        for k, run in enumerate(self.runs):
            rows = self.spark.read.parquet(f"{self.path}/{run}").filter("seg = -1").select("part", F.lit(-1 - k).cast("long").alias("seg"), F.col("marks").alias("blob"))
            found = rows if found is None else found.union(rows)
        return found

    def _next(self) -> str:
        """A folder for a run; what a failed batch left there goes."""
        self.made += 1
        name = f"run-{self.made:08d}"
        delete_folder(self.spark, f"{self.path}/{name}")
        return name

    def add(self, docs: DataFrame) -> DataFrame:
        """Deduplicate a batch against all earlier ones and add its windows as a run."""
        for name in self.gone:
            delete_folder(self.spark, f"{self.path}/{name}")
        self.gone = []
        target = self._next()
        out = _dedup(docs, INDEX_PARTS_BITS, self._history(), f"{self.path}/{target}")
        self.runs = [*self.runs, target]
        if len(self.runs) > INDEX_RUNS:
            self.compact()
        self._commit()
        return out

    def compact(self) -> None:
        target = self._next()

        def run(key, table):
            blob = squeeze(*compact([unsqueeze(b) for b in table.column("blob").to_pylist()]))
            return pa.table({"seg": pa.array([-1], pa.int64()), "part": pa.array([key[0].as_py()], pa.int64()), "marks": pa.array([blob], pa.binary())})

        self._history().groupBy("part").applyInArrow(run, "seg long, part long, marks binary").write.parquet(f"{self.path}/{target}")
        self.gone, self.runs = self.runs, [target]
