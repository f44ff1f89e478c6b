"""Near-duplicates of texts: sets of word shingles, bit-sliced SimHash, exact check in the same task.

A text is its set of `size`-word shingles (64-bit hashes of them).  Two texts are alike if the Jaccard
similarity of their sets is `similarity` or more; classes are the connected components of that.

 1. Each text gives a SimHash print of 64 * WORDS bits, BANDS keys of ROWS min-hashes each, and its set
    as sorted 32-bit hashes.  Texts of equal sets (128-bit digest) become one node.
 2. Nodes that share a key meet.  Pairs of similarity s share one with 1 - (1 - s ** ROWS) ** BANDS:
    0.998 at 0.8, for every number of rows.  Keys of one node alone are dropped on narrow rows
    (key, node), before prints and sets travel.
 3. In a bucket planes of print bits are compared with carry-save counters (bitslice.py); pairs within
    the radius (mean distance at `similarity` plus SPREAD standard deviations: 0.9998 of the pairs at
    that similarity) are checked on their sets there and then, and edges of a spanning forest
    of the pairs found alike go out: fewer than the bucket has rows.
 4. Components of these edges name the classes (components.py).

Large buckets are dealt out in chunks.  The first pass (FIRST keys) compares a chunk in itself and with
HEADS rows of its bucket that every chunk gets.  The second pass (all keys) takes only buckets that
still hold several classes: rows outside the bucket's largest class meet all chunks, rows inside it
only those.  Each pair of rows that shares a key is thus compared, or already in one verified class.

A 32-bit hash makes two different shingles of a pair equal about once in 4e9 / (n * m) pairs of texts
of n and m shingles; that can matter only where one shingle decides.  No text of a class without a
verified link is lost, and rows are told apart by doc_id and text, not by doc_id alone.

Null text is empty; all texts without words are alike.  A null doc_id comes after all others.  Repeated
rows (equal doc_id and text) are one.  Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bitslice
from .common import cut, delete_folder, fresh_name, shared_folder, slices, trimmed
from .components import connected_components

WORDS, BANDS, ROWS, FIRST = 2, 12, 4, 4
SPREAD = 3.5
#: Rows, and bytes of sets, of a bucket that one task group holds; larger buckets are dealt out in chunks.
CHUNK_ROWS, CHUNK_BYTES = 1024, 16 << 20
HEADS = 16
#: Rows and bytes gathered before buckets are compared together.
BATCH_ROWS, BATCH_BYTES = 1 << 14, 8 << 20
#: Bytes of rows (sets, and ROW_BYTES for the rest of one) of a task that compares; more data makes more tasks, not larger ones.
TASK_BYTES, ROW_BYTES = 16 << 20, 64
#: A narrow side of a join is broadcast up to this many rows (counted first).
BROADCAST_ROWS = 100_000
#: Columns of the matrix that counts common shingles, and values of sets that are numbered at a time.
COLUMNS, VALUES = 2048, 1 << 18

def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_DRAW = np.random.default_rng(7)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FOLD = _DRAW.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words (A-Z lower-cased; fewer words: of all)."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    run = np.full(n, np.uint64(size))
    for k in range(size):
        run = (run * np.uint64(0x9E3779B97F4A7C15)) ^ (run >> np.uint64(32))
        run += h[k : k + n]
    return np.unique(mix(run))


def print_of(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """SimHash print: each bit is that of more than half of the values; none: zero."""
    out = np.zeros(words, np.uint64)
    if not len(h):
        return out
    offsets = np.arange(8) * 256
    for k in range(words):
        raw = (h if k == 0 else mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))).view(np.uint8).reshape(-1, 8)
        ones = (np.bincount((raw + offsets).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key for each band; no shingles: the keys of the empty set."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 1 << 14):
        least = np.minimum(least, (h[at : at + (1 << 14), None] * _TIMES + _PLUS).min(axis=0))
    return mix((least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64) + _BAND)


def radius_of(similarity: float, words: int = WORDS) -> int:
    """Differing bits at that similarity (the angle between the sets), with room for chance."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return round(64 * words * share + SPREAD * math.sqrt(64 * words * share * (1 - share)))


def alike(a: set, b: set, similarity: float) -> bool:
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


_NODE = "s1 long, s2 long, print array<long>, keys array<long>, grams binary"


def _signatures(size: int, narrow: bool):
    def run(batches):
        for part in slices(batches, 512):
            ids, prints, keys, grams = [], [], [], []
            for t in part.column(3):
                h = shingle_hashes(t.as_py() or b"", size)
                ids.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64))
                if not narrow:
                    prints.append(print_of(h))
                    keys.append(band_keys(h))
                    grams.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes())
            if not ids:
                continue
            s = np.stack(ids)
            rows = [*part.columns[:3], pa.array(s[:, 0]), pa.array(s[:, 1])]
            if not narrow:
                for arrays, width in ((prints, WORDS), (keys, BANDS)):
                    offs = pa.array(np.arange(0, width * len(s) + 1, width, dtype=np.int32))
                    rows.append(pa.ListArray.from_arrays(offs, pa.array(np.concatenate(arrays).view(np.int64))))
                rows.append(pa.array(grams, pa.binary()))
            names = ["id", "t1", "t2", "s1", "s2", "print", "keys", "grams"]
            yield pa.RecordBatch.from_arrays(rows, names[: len(rows)])

    return run


def _text_key(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.crc32(text) * F.lit(1 << 31) + F.octet_length(text)]


def _signed(docs: DataFrame, size: int, narrow: bool) -> DataFrame:
    t1, t2 = _text_key(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), t1.alias("t1"), t2.cast("long").alias("t2"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(_signatures(size, narrow)), "id long, t1 long, t2 long, " + ("s1 long, s2 long" if narrow else _NODE))


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _small(df) else df


def _dealt_first(rows: DataFrame) -> DataFrame:
    """(key, i, j, node, label, bytes): buckets of one pass, large ones by chunk, heads in every chunk."""
    load = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).filter("n > 1")
    load = cut(load.select("key", "n", F.greatest(F.ceil(F.col("n") / CHUNK_ROWS), F.ceil(F.col("b") / CHUNK_BYTES)).cast("int").alias("c")))
    rows = rows.join(_hinted(load), "key")
    head = (F.col("c") > 1) & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")) < HEADS)
    chunk = F.when(head, F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("c")).cast("int")))
    return rows.select("key", F.lit(0).alias("i"), F.explode(chunk).alias("j"), "node", F.col("node").alias("label"), "bytes")


def _dealt_second(rows: DataFrame) -> DataFrame:
    """As above, of buckets with several classes; what is outside the largest class meets every chunk."""
    load = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    size = lambda n, b: F.greatest(F.ceil(F.col(n) / CHUNK_ROWS), F.ceil(F.col(b) / CHUNK_BYTES), F.lit(1)).cast("int")
    load = cut(load.select("key", size("n", "b").alias("c")))
    rows = rows.join(_hinted(load), "key")
    by_label = rows.filter("c > 1").groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    main = by_label.groupBy("key").agg(F.max(F.struct("n", "label", "b")).alias("top"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    main = main.select("key", F.col("top.label").alias("main"), (F.col("n") - F.col("top.n")).alias("n"), (F.col("b") - F.col("top.b")).alias("b"))
    main = cut(main.select("key", "main", size("n", "b").alias("r")))
    rows = rows.join(_hinted(main), "key", "left")
    own_i = F.pmod(F.xxhash64("node", F.lit(1)), F.col("r")).cast("int")
    own_j = F.pmod(F.xxhash64("node"), F.col("c")).cast("int")
    at = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    down = F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda i: at(i, own_j))
    along = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: at(own_i, j))
    to = F.when(F.col("r").isNull(), F.array(at(F.lit(0), F.lit(0)))).when(F.col("label") == F.col("main"), down).otherwise(F.array_union(down, along))
    return rows.select("key", F.explode(to).alias("at"), "node", "label", "bytes").select("key", "at.i", "at.j", "node", "label", "bytes")


class _Classes:
    """Union-find over labels."""

    def __init__(self, label: np.ndarray):
        self.up: dict[int, int] = {}
        self.label = label.tolist()

    def top(self, row: int) -> int:
        up, x = self.up, self.label[row]
        while x in up:
            if up[x] in up:
                up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _few(prints, label, grams, starts, ends, radius, similarity):
    """Verified edges (rows) inside many small groups."""
    a, b = bitslice.near_neighbours(prints, starts, ends, radius)
    open_ = label[a] != label[b]
    a, b = a[open_], b[open_]
    group = np.searchsorted(starts, a, side="right")
    order = np.lexsort((bitslice.distances(prints, a, b), group))
    known: dict[int, set] = {}

    def of(k):
        if k not in known:
            known[k] = set(np.frombuffer(grams[k], np.uint32).tolist())
        return known[k]

    classes, at = _Classes(label), 0
    for g, i, j in zip(group[order].tolist(), a[order].tolist(), b[order].tolist()):
        if g != at:  # Python sets take many times the bytes: those of one group are held
            classes.up, at = {}, g
            known.clear()
        if classes.top(i) != classes.top(j) and alike(of(i), of(j), similarity) and classes.join(i, j):
            yield i, j


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sorted sets share, counted range by range of values, block by block of columns."""
    n, total = len(sets), sum(map(len, sets))
    out = np.zeros((n, n), np.float32)
    if not total:
        return out
    block, both = np.zeros((n, COLUMNS), np.float32), np.empty((n, n), np.float32)
    steps = -(-total // VALUES)
    bounds = np.array([(1 << 32) * k // steps for k in range(1, steps)], np.uint32)
    cuts = np.array([[0, *np.searchsorted(s, bounds), len(s)] for s in sets])
    for at in range(steps):
        row = np.repeat(np.arange(n), cuts[:, at + 1] - cuts[:, at])
        values = np.concatenate([s[b:e] for s, b, e in zip(sets, cuts[:, at], cuts[:, at + 1])])
        _, column, often = np.unique(values, return_inverse=True, return_counts=True)
        shared = often[column] > 1
        rank = np.cumsum(often > 1) - 1
        row, column = row[shared], rank[column[shared]]
        if not len(row):
            continue
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        edges = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + COLUMNS, COLUMNS))
        for k, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
            block[:] = 0
            block[row[s:e], column[s:e] - k * COLUMNS] = 1
            out += np.matmul(block, block.T, out=both)
    return out


def _many(prints, label, grams, radius, similarity):
    """Verified edges (rows) inside one large group."""
    classes, both, n = _Classes(label), None, len(prints)
    now = label.copy()
    for i, j in bitslice.crossing(prints, label, radius):
        if not len(i):
            continue
        if both is None:
            sets = [np.frombuffer(g, np.uint32) for g in grams]
            both, size = common_counts(sets), np.array([len(s) for s in sets], np.float32)
        shared = both[i, j]
        good = shared >= similarity * (size[i] + size[j] - shared) - 1e-4
        i, j = i[good], j[good]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.diff(i, prepend=-1))
        for s, e in zip(cuts, np.append(cuts[1:], len(i))):
            other, first = np.unique(now[j[s:e]], return_index=True)
            for k in first:
                q, t = int(i[s]), int(j[s + k])
                if classes.join(q, t):
                    yield q, t
                    low = classes.top(q)
                    now[(now == now[q]) | (now == now[t])] = low
    assert both is None or len(both) == n


def _compare(radius: int, similarity: float):
    """Sorted rows (key, i, j, node, label, print, grams) -> verified edges (a, b) of whole groups."""

    def flush(group, node, label, prints, grams):
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(group))
        size = ends - starts
        found = []
        small = (size > 1) & (size <= bitslice.SMALL)
        if small.any():
            at = np.flatnonzero(np.repeat(small, size))
            e2 = np.cumsum(size[small])
            found += [(at[a], at[b]) for a, b in _few(prints[at], label[at], [grams[k] for k in at], e2 - size[small], e2, radius, similarity)]
        for s, e in zip(starts[size > bitslice.SMALL], ends[size > bitslice.SMALL]):
            found += [(s + a, s + b) for a, b in _many(prints[s:e], label[s:e], grams[s:e], radius, similarity)]
        if found:
            ends_ = node[np.array(found)]
            both = np.unique(np.sort(ends_, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches):
        held, rows, size = [], 0, 0

        def joined():
            arrays = [np.concatenate(x) for x in zip(*[h[:4] for h in held])]
            return [*arrays, [g for h in held for g in h[4]]]

        for batch in batches:
            for part in slices([batch], 4096):
                if not part.num_rows:
                    continue
                group = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns[:3]], axis=1)
                prints = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).view(np.uint64)
                grams = part.column(6).to_pylist()
                held.append((group, part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy(zero_copy_only=False), prints, grams))
                rows, size = rows + part.num_rows, size + sum(map(len, grams))
                if rows < BATCH_ROWS and size < BATCH_BYTES:
                    continue
                whole = joined()
                last = np.flatnonzero((whole[0] != whole[0][-1]).any(axis=1))
                end = int(last[-1]) + 1 if len(last) else 0
                if end:
                    yield from flush(*(x[:end] for x in whole))
                held = [tuple(x[end:].copy() for x in whole)]
                rows, size = len(held[0][0]), sum(map(len, held[0][4]))
        if rows:
            yield from flush(*joined())

    return run


def tasks_of(size: int, set_: int) -> list[int]:
    """Number of tasks for `size` bytes, [] if the `set_` ones of the session, which AQE may coalesce, are enough."""
    need = -(-size // TASK_BYTES)
    return [need] if need > set_ else []


def _edges(nodes: DataFrame, dealt: DataFrame, radius: int, similarity: float) -> DataFrame:
    heavy = nodes.select("node", "print", "grams")
    rows = cut(dealt)
    parts = tasks_of(rows.agg(F.sum(F.col("bytes") + ROW_BYTES)).first()[0] or 0, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = F.broadcast(rows).join(heavy, "node") if _small(rows) else rows.join(heavy, "node")
    rows = rows.select("key", "i", "j", "node", "label", "print", "grams").repartition(*parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return cut(rows.mapInArrow(trimmed(_compare(radius, similarity)), "a long, b long").distinct())


def _roots(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the components of alike nodes; nodes without a like one are absent."""
    radius = radius_of(similarity)
    narrow = lambda keys: nodes.select(F.explode(keys).alias("key"), "node", F.octet_length("grams").cast("long").alias("bytes"))
    edges = _edges(nodes, _dealt_first(narrow(F.slice("keys", 1, FIRST))), radius, similarity)
    roots = cut(connected_components(edges))
    labelled = narrow(F.col("keys")).join(_hinted(roots), "node", "left").select("key", "node", "bytes", F.coalesce("root", "node").alias("label"))
    more = _edges(nodes, _dealt_second(labelled), radius, similarity)
    return roots if more.isEmpty() else cut(connected_components(edges.union(more)))


def _named(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(s1, s2, first, root): each distinct set of shingles, its first row (no, id, t1, t2) and its class."""
    spark = docs.sparkSession
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "t1", "t2")).alias("first")
    # equal sets have equal prints, keys and grams: any row's will do
    nodes = _signed(docs, size, False).groupBy("s1", "s2").agg(first, *[F.first(c).alias(c) for c in ("print", "keys", "grams")])
    path = shared_folder(spark, "near-nodes")
    nodes.withColumn("node", F.monotonically_increasing_id()).write.parquet(path)
    nodes = spark.read.parquet(path)
    roots = _roots(nodes, similarity)
    named = nodes.select("s1", "s2", "first", "node").join(_hinted(roots), "node", "left")
    named = cut(named.select("s1", "s2", "first", F.coalesce("root", "node").alias("root")))
    delete_folder(spark, path)
    return named


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id of its class, null if none has one."""
    named = _named(docs, size, similarity)
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    found = named.join(heads, "root").select("s1", "s2", F.col("head.id").alias("component_id"))
    return _signed(docs, size, True).join(found, ["s1", "s2"]).select(F.col("id").alias("doc_id"), "component_id")


def keep_first(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each class the row with the smallest doc_id (then by a hash of the text), with all its columns."""
    heads = _named(docs, size, similarity).groupBy("root").agg(F.min("first").alias("head"))
    no, k1, k2, nth = (fresh_name(docs, "near_" + n) for n in ("id", "k1", "k2", "nth"))
    heads = cut(heads.select(F.col("head.id").alias(no), F.col("head.t1").alias(k1), F.col("head.t2").alias(k2)))
    t1, t2 = _text_key(F.col("text"))
    keyed = docs.withColumns({no: F.col("doc_id").cast("long"), k1: t1, k2: t2.cast("long")})
    same = keyed[no].eqNullSafe(heads[no]) & (keyed[k1] == heads[k1]) & (keyed[k2] == heads[k2])
    kept = keyed.join(_hinted(heads), same, "left_semi")
    # rows of equal doc_id and text: one stays, whichever its other columns come first
    order = F.struct(*docs.columns).cast("string")
    return kept.withColumn(nth, F.row_number().over(Window.partitionBy(no, k1, k2).orderBy(order))).filter(F.col(nth) == 1).select(*docs.columns)
