"""Segments: documents cut into runs of consecutive doc_id and moved there in one exchange.

The plan of the segments (bounds and first ids) has one entry for each SEGMENT_BYTES of text, so
it is some millions of times smaller than the text.  Texts travel as compressed Arrow blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_input

#: Bytes of text in a segment, about; it is handled by one Python call.
SEGMENT_BYTES = 4 << 20
#: Accuracy of the sketch that bounds come from, at most.
SKETCH = 1_000_000
#: A null doc_id comes first.
NULL_ID = -(1 << 63)
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


@dataclass
class Plan:
    bounds: np.ndarray  # segment s holds bounds[s - 1] <= id < bounds[s]
    first: dict  # first id of each segment that has rows
    size: int
    text_bytes: int

    def segment(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, ids, side="right").astype(np.int64)

    def leads(self) -> tuple[np.ndarray, np.ndarray]:
        """First ids, ascending, and for each the segment whose last row it follows (of the least: the last)."""
        segs = np.array(sorted(self.first), np.int64)
        ids = np.array([self.first[s] for s in segs.tolist()], np.int64)
        return ids, np.roll(segs, 1)


def _ids(docs: DataFrame):
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text")


def segment_plan(docs: DataFrame, size: int = SEGMENT_BYTES) -> Plan:
    total = _ids(docs).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    count = max(1, -(-(total["b"] or 0) // size))
    ids = _ids(docs).select("id")
    if count == 1:
        bounds = np.empty(0, np.int64)
    else:
        at = [i / count for i in range(1, count)]
        # the sketch is bounded; with many segments their sizes vary more
        cuts = ids.agg(F.percentile_approx("id", at, min(100 * count, SKETCH))).first()[0] or []
        bounds = np.unique(np.array(cuts, np.int64))
    plan = Plan(bounds, {}, count, total["b"] or 0)
    first = ids.mapInArrow(_firsts(bounds), "seg long, id long").groupBy("seg").agg(F.min("id").alias("id"))
    plan.first = {r["seg"]: r["id"] for r in first.collect()}
    return plan


def _firsts(bounds: np.ndarray):
    def run(batches):
        best: dict = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            seg = np.searchsorted(bounds, ids, side="right")
            for s in np.unique(seg):
                low = int(ids[seg == s].min())
                best[int(s)] = min(low, best.get(int(s), low))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], ["seg", "id"])

    return run


def _block(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack(docs: DataFrame, plan: Plan, guests: bool = False) -> DataFrame:
    """(seg, block): every row in its segment; with guests, also the rows of the first id of a
    segment in the segment before (the first segment's in the last)."""

    def run(batches):
        leads, before = plan.leads() if guests else (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            seg = plan.segment(ids)
            for guest in (False, True) if guests else (False,):
                if guest:
                    place = np.minimum(np.searchsorted(leads, ids), len(leads) - 1)
                    at = np.flatnonzero(leads[place] == ids)
                    to = before[place[at]]
                else:
                    at, to = np.arange(len(ids)), seg
                for s in np.unique(to):
                    rows = batch.take(pa.array(at[to == s]))
                    rows = pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, guest))], ["id", "text", "guest"])
                    yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int64()), pa.array([_block(rows)], pa.binary())], ["seg", "block"])

    rows = text_input(_ids(docs).withColumnRenamed("id", "doc_id"), "doc_id")
    return rows.mapInArrow(run, "seg long, block binary")


def unpack(table: pa.Table, with_guest: bool = False) -> list[tuple]:
    """Rows (doc_id or None, text, guest) in order; of the guests only the first, at the end."""
    parts = []
    for block in table.column("block"):
        with pa.ipc.open_stream(block.as_buffer()) as source:
            parts.append(source.read_all())
    if not parts:
        return []
    whole = pa.concat_tables(parts)
    order = pc.sort_indices(whole, sort_keys=[("guest", "ascending"), ("id", "ascending"), ("text", "ascending")])
    whole = whole.take(order)
    rows = [(None if i == NULL_ID else i, t, g) for i, t, g in zip(whole.column("id").to_pylist(), whole.column("text").to_pylist(), whole.column("guest").to_pylist())]
    if not with_guest:
        return [r for r in rows if not r[2]]
    own = [r for r in rows if not r[2]]
    follow = [r for r in rows if r[2]]
    return own + follow[:1] if own else []
