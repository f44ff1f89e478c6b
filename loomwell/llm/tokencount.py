"""Token counts of a byte-level BPE tokenizer with the whole-token shortcut.

Offline proof: every string of the vocabulary is encoded alone by the library; those that come
back as exactly one token form the whole-token set.  It holds no more entries than the
vocabulary, so its size is bounded.

Counting: a text is cut before every single space that stands between two non-space characters.
No pre-token of the tokenizer's pattern crosses such a place (a run of spaces keeps all but its
last space; a single space belongs to what follows), so the pieces are independent.  A piece in
the whole-token set counts 1; the rest is merged by the library once for each distinct piece and
remembered (at most MEMO pieces; a full memory is emptied, which changes no count).

A null text is empty: 0 bytes, 0 tokens.  Special strings inside a text count as the library
counts them.  Repeated rows are counted again; a null doc_id is passed on.  An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_input, trimmed

#: Distinct pieces remembered by a worker.
MEMO = 400_000
#: Places where no pre-token is ever joined.
SAFE = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=2)
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset:
    """Vocabulary strings that the library encodes, alone, as exactly one token."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    tok = library(path)
    texts = [tok.decode([i], skip_special_tokens=False) for i in vocab.values()]
    texts = [t for t in texts if t and "�" not in t]
    codes = tok.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, c in zip(texts, codes) if len(c.ids) == 1)


def pieces(text: str) -> list[str]:
    """The text cut at its safe places.

    Besides single spaces these are: a full stop or comma between a Latin letter and a single
    space or line break, and a single line break between non-spaces; both are pre-tokens.
    """
    # str.split and re-attaching the space is the fast form of SAFE for single-spaced text
    if text[:1] == " " or text[-1:] == " " or _ODD.search(text):
        return SAFE.split(text)
    out: list[str] = []
    for part in _MARK.split(text):
        if part:
            first, *rest = part.split(" ")
            if first:
                out.append(first)
            out += [" " + x for x in rest]
    return out


#: White space beside a space: there the plain split would cut inside a run.
_ODD = re.compile(r"\s | \s")
_MARK = re.compile(r"([.,](?<=[A-Za-zÀ-ÖØ-öø-ÿ][.,])(?=[ \n]\S)|\n(?<=\S\n)(?=\S))")


class Counter:
    def __init__(self, path: str):
        self.tok = library(path)
        self.whole = whole_tokens(path)
        self.memo: dict[str, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        cut = [pieces(t) for t in texts]
        memo, whole = self.memo, self.whole
        new = {p for row in cut for p in row if p not in memo}
        for p in new & whole:
            memo[p] = 1
        rest = list(new - whole)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for p, c in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False)):
                memo[p] = len(c.ids)
        out = np.fromiter((sum(map(memo.__getitem__, row)) for row in cut), np.int64, len(cut))
        if len(memo) > MEMO:
            memo.clear()
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""

    def run(batches):
        counter = Counter(path)
        for part in slices(batches):
            n = counter.count(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = text_input(docs, "doc_id").select(F.col("doc_id").cast("long"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
