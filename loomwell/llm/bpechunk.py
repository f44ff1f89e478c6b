"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last WINDOW bytes cuts a text wherever its low bits are zero, so equal
passages of different documents are cut alike, whatever stands before them.  Each distinct chunk
is encoded once by a worker and remembered with its safe places: a single space between two
non-space characters, which no pre-token crosses.  Between its first and last safe place a chunk
reads the same in every text.  What remains around a join of chunks is encoded again, over a
window that grows by whole chunks until both of its ends are safe places; there its tokens agree
exactly with the whole text's, and it is spliced in.

The memory of a worker is bounded by MEMO_CHARS; a full memory is emptied, which changes no result.
A null text is empty: no tokens.  Special strings inside a text encode as the library encodes them.
Repeated rows are encoded again, a null doc_id is passed on, an empty table gives an empty result,
and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_input, trimmed
from .tokencount import MEMO, library, pieces

#: Bytes under the rolling hash; low bits that must be zero for a cut (chunks of 512 bytes on average).
WINDOW, CUT_BITS = 16, 9
#: Characters of chunks and joins that a worker remembers.
MEMO_CHARS = 16_000_000
_SAFE = re.compile(r"\S(?= \S)")


def cuts(raw: bytes) -> np.ndarray:
    """Content-defined chunk ends (byte offsets), moved to the next character boundary."""
    if len(raw) <= WINDOW:
        return np.empty(0, np.int64)
    b = np.frombuffer(raw, np.uint8)
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    mult, width = 0xD6E8FEB86659FD93, 1
    while width < WINDOW:  # hash of 2w bytes from two hashes of w bytes
        h = h[:-width] * np.uint64(mult) + h[width:]
        mult, width = mult * mult % (1 << 64), width * 2
    h ^= h >> np.uint64(32)
    at = np.flatnonzero(h & np.uint64((1 << CUT_BITS) - 1) == 0) + WINDOW
    at = at[at < len(raw)]
    while len(at):
        inside = (b[at] & 0xC0) == 0x80
        if not inside.any():
            break
        at = at + inside
        at = at[at < len(raw)]
    return np.unique(at)


def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id.  A vocabulary string has one letter for each byte: printable Latin-1
    letters stand for themselves, the other bytes in order for U+0100 and up."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = {t: i for t, i in file["model"]["vocab"].items()} | {t["content"]: t["id"] for t in file["added_tokens"]}
    out = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        out[i] = bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode("utf-8")
    return out


class Codec:
    """Encodes whole texts to token ids through remembered chunks, and decodes them."""

    def __init__(self, path: str):
        self.tok = library(path)
        self.parts = token_bytes(path)
        self.chunks: dict = {}
        self.joins: dict = {}
        self.held = 0
        self.words: dict[str, bytes] = {}
        self.reused = self.encoded = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids (32-bit) of texts taken alone; a piece between two safe places is merged once."""
        cut = [pieces(t) for t in texts]
        memo = self.words
        new = list({p for row in cut for p in row if p not in memo})
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for p, c in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False)):
                memo[p] = array("i", c.ids).tobytes()
        out = [b"".join(map(memo.__getitem__, row)) for row in cut]
        if len(memo) > MEMO:
            memo.clear()
        return out

    def _learn(self, texts: set[str]) -> None:
        """Encode chunks alone: (head, ids between the safe places, tail); no safe place: None."""
        todo, cores = [], []
        for t in texts:
            first = _SAFE.search(t)
            if first is None:
                self.chunks[t] = None
                continue
            last = t.rfind(" ")
            while not (last > 0 and last + 1 < len(t) and not t[last - 1].isspace() and not t[last + 1].isspace()):
                last = t.rfind(" ", 0, last)
            todo.append((t, first.end(), last))
            cores.append(t[first.end() : last])
        for (t, a, b), ids in zip(todo, self._ids(cores)):
            self.chunks[t] = (t[:a], ids, t[b:])
        self.held += sum(map(len, texts))
        self.encoded += len(texts)

    def _split(self, text: str) -> list[str]:
        raw = text.encode("utf-8")
        at = [0, *cuts(raw).tolist(), len(raw)]
        return [raw[a:b].decode("utf-8") for a, b in zip(at, at[1:]) if b > a]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > MEMO_CHARS:
            self.chunks.clear()
            self.joins.clear()
            self.held = 0
        split = [self._split(t) for t in texts]
        new = {c for chunks in split for c in chunks if c not in self.chunks}
        self.reused += sum(map(len, split)) - len(new)
        self._learn(new)
        plans, joins = [], set()
        for chunks in split:
            plan, open_ = [], ""
            for c in chunks:
                known = self.chunks[c]
                if known is None:  # no safe place: the window grows over this chunk
                    open_ += c
                    continue
                head, core, tail = known
                plan.append(open_ + head)
                plan.append(core)
                open_ = tail
            plan.append(open_)
            joins.update(x for x in plan[::2] if x not in self.joins)
            plans.append(plan)
        fresh = list(joins)
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            for t, ids in zip(some, self._ids(some)):
                self.joins[t] = ids
                self.held += len(t)
        return [np.frombuffer(b"".join([self.joins[x] if isinstance(x, str) else x for x in plan]), np.int32) for plan in plans]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.parts.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row; keep=False gives only digests:
    (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches):
        codec = Codec(path)
        names = [str(i) for i in range(len(codec.parts))]
        for part in slices(batches, 512):
            all_ids = codec.encode(part.column(1).to_pylist())
            lists = [x.tolist() for x in all_ids]
            back = [codec.decode(x) for x in lists]
            if keep:
                offs = np.concatenate([[0], np.cumsum([len(x) for x in all_ids])]).astype(np.int32)
                flat = np.concatenate([*all_ids, np.empty(0, np.int32)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])
            else:
                digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in all_ids], pa.int64()), pa.array([digest(",".join(map(names.__getitem__, x))) for x in lists], pa.string()), pa.array([digest(t) for t in back], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, ids array<int>, decoded string" if keep else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = text_input(docs, "doc_id")
    return rows.select(rows.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)
