"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints.  A text is lower-cased (A-Z only), cut into words at space and \\x09-\\x0D, and
into runs of `shingle` words joined by one space (fewer words: all of them).  Bit b of the
fingerprint is 1 if more than half of the shingles' XXH64 values (seed 42; further 64-bit words
use the seeds 43, 44, ...) have bit b.  Repeated shingles count each time, unless `distinct` asks for sets.  No words: all zero.

Links.  Two texts link if their fingerprints differ in `radius` bits or fewer.  Equal
fingerprints are collapsed first, so exact copies cost nothing.  A fingerprint is cut into `blocks`
blocks and a bucket key is the content of `blocks - radius` of them: two fingerprints within the
radius agree in at least that many blocks, so no link is lost (exact).  Inside a bucket, planes of
bits are compared with carry-save counters (bitslice.py).  A bucket of more than BUCKET_ROWS rows is
dealt out as pairs of chunks, each its own task group; a group gives tree edges only, one fewer than
its rows at most.  Components are found by components.connected_components.

The pipeline's near-duplicates (sets of shingles, a similarity instead of a radius) are in neardup.py.

Null text is empty; empty texts link to each other.  Rows with a null doc_id are returned, take
part in links and bridge others, and never name a component: it is null only if no member has an id.
Repeated rows are returned as often as they come in.  Extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitslice
from .common import cut, slices, trimmed
from .components import connected_components
from .shingle import shingles

SEED = 42
#: Rows of a bucket that one task group holds; larger buckets are compared chunk by chunk.
BUCKET_ROWS = 4096
#: Rows gathered before small buckets are compared together.
BATCH_ROWS = 1 << 16
#: The list of large buckets is broadcast up to this many.
BROADCAST_BUCKETS = 100_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, size: int = 3, words: int = 1, distinct: bool = False) -> np.ndarray:
    """`words` 64-bit words of the fingerprint; distinct: each shingle counts once."""
    parts = shingles(text, size)
    if distinct:
        parts = list(set(parts))
    out = np.zeros(words, np.uint64)
    if not parts:
        return out
    offsets = np.arange(8) * 256
    for k in range(words):
        seed, digest = SEED + k, xxhash.xxh64_digest
        raw = np.frombuffer(b"".join([digest(p, seed) for p in parts]), np.uint8).reshape(-1, 8)
        seen = np.bincount((raw + offsets).ravel(), minlength=2048).reshape(8, 256)
        ones = (seen @ _BITS)[::-1].ravel()  # the digest is big-endian
        out[k] = np.packbits(2 * ones > len(parts), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, print array<long>), one row for each input row."""

    def run(batches):
        for part in slices(batches):
            rows = [fingerprint(t.as_py() or b"", size, words, distinct) for t in part.column(1)]
            prints = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
            offs = pa.array(np.arange(0, len(prints) + 1, words, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(offs, pa.array(prints))], ["doc_id", "print"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(trimmed(run), "doc_id long, print array<long>")


def block_keys(radius: int, words: int = 1, blocks: int = 4) -> list[list[int]]:
    """Bit sets of the exact bucket keys: every choice of blocks - radius blocks."""
    if radius >= blocks:
        raise ValueError("an exact key needs more blocks than the radius")
    parts = [list(map(int, p)) for p in np.array_split(np.arange(words * 64), blocks)]
    return [sum(c, []) for c in itertools.combinations(parts, blocks - radius)]


def _key_rows(sets: list[list[int]]):
    def run(batches):
        for part in slices(batches, 4096):
            if not part.num_rows:
                continue
            w = len(part.column(1)[0])
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            prints = flat.reshape(-1, w)
            bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
            for k, chosen in enumerate(sets):
                packed = np.zeros((len(prints), 8), np.uint8)
                got = np.packbits(bits[:, chosen], axis=1, bitorder="little")
                packed[:, : got.shape[1]] = got
                key = packed.view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), *part.columns], ["k", "key", *part.schema.names])

    return run


def _compare(radius: int):
    """Sorted rows (k, key, i, j, node, print) -> tree edges, a batch of whole groups at a time."""

    def flush(group: np.ndarray, node: np.ndarray, prints: np.ndarray):
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(group))
        size = ends - starts
        small = (size > 1) & (size <= bitslice.SMALL)
        pairs = []
        if small.any():
            at = np.flatnonzero(np.repeat(small, size))
            e2 = np.cumsum(size[small])
            a, b = bitslice.tree(*bitslice.near_neighbours(prints[at], e2 - size[small], e2, radius), prints[at])
            pairs.append((at[a], at[b]))
        for s, e in zip(starts[size > bitslice.SMALL], ends[size > bitslice.SMALL]):
            a, b = bitslice.classes(prints[s:e], radius)
            pairs.append((s + a, s + b))
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs))
            if len(a):
                a, b = node[a], node[b]
                found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    def run(batches):
        held, rows = [], 0

        def joined():
            return [np.concatenate(x) for x in zip(*held)]

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], axis=1)
            prints = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).view(np.uint64)
            held.append((group, batch.column(4).to_numpy(zero_copy_only=False), prints))
            rows += batch.num_rows
            if rows < BATCH_ROWS:
                continue
            group, node, prints = joined()
            last = np.flatnonzero((group != group[-1]).any(axis=1))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield from flush(group[:end], node[:end], prints[:end])
            held = [(group[end:].copy(), node[end:].copy(), prints[end:].copy())]
            rows = len(held[0][0])
        if rows:
            yield from flush(*joined())

    return run


def _bucket_rows(prints: DataFrame, sets: list[list[int]]) -> DataFrame:
    """(k, key, i, j, node, print) in sorted groups."""
    rows = prints.mapInArrow(trimmed(_key_rows(sets)), "k int, key long, node long, print array<long>")
    # buckets above BUCKET_ROWS: at most one for each BUCKET_ROWS rows
    load = cut(rows.groupBy("k", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS))
    if load.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS:
        load = F.broadcast(load)
    chunks = F.coalesce(F.ceil(F.col("n") / F.lit(BUCKET_ROWS)).cast("int"), F.lit(1))
    rows = rows.join(load, ["k", "key"], "left").withColumn("c", chunks)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select("k", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "print")
    return rows.repartition("k", "key", "i", "j").sortWithinPartitions("k", "key", "i", "j")


def links(prints: DataFrame, sets: list[list[int]], radius: int) -> DataFrame:
    """Distinct fingerprints (node long, print array<long>) -> tree edges (a, b) of their links."""
    return _bucket_rows(prints, sets).mapInArrow(trimmed(_compare(radius)), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, words: int = 1, radius: int = 2, distinct: bool = False) -> DataFrame:
    """(doc_id, print, component_id) of every row; distinct: fingerprints of shingle sets."""
    prints = cut(fingerprints(docs, size, words, distinct))
    # nodes have numbers of their own, so prints that only null ids have take part as well
    different = cut(prints.groupBy("print").agg(F.min("doc_id").alias("low")).withColumn("node", F.monotonically_increasing_id()))
    roots = connected_components(links(different.select("node", "print"), block_keys(radius, words), radius))
    rooted = different.join(roots, "node", "left").select("print", "low", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classed = rooted.join(named, "root").select("print", "component_id")
    return prints.join(classed, "print").select("doc_id", "print", "component_id")


def hex_print(column: str = "print"):
    """16 lower-case hex digits for each 64-bit word."""
    return F.array_join(F.transform(column, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
