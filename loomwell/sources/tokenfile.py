"""Flat token files as a Python data source: 8-byte little-endian count, then 16-bit ids.

Reading splits a file into byte ranges; the header must agree with the file's length.  Writing
makes one file for each task and, on commit, a manifest; `concatenate` makes the single file.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import errors

HEADER, STEP = 8, 1 << 20


class Range(InputPartition):
    def __init__(self, start: int, count: int):
        super().__init__(start)
        self.start, self.count = start, count


class TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        size = os.path.getsize(path)
        if size < HEADER or (size - HEADER) % 2:
            raise errors.KINDS["DataCorrupt"](offset=0, reason=f"{path} is not a token file")
        with open(path, "rb") as f:
            self.count = int.from_bytes(f.read(HEADER), "little")
        if self.count != (size - HEADER) // 2:
            raise errors.KINDS["DataCorrupt"](offset=0, reason=f"{path}: header says {self.count} tokens, file has {(size - HEADER) // 2}")

    def partitions(self):
        return [Range(a, min(STEP, self.count - a)) for a in range(0, self.count, STEP)] or [Range(0, 0)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            f.seek(HEADER + 2 * partition.start)
            ids = np.frombuffer(f.read(2 * partition.count), "<u2")
        for i, x in enumerate(ids.tolist()):
            yield (partition.start + i, x)


class Written(WriterCommitMessage):
    def __init__(self, name: str, count: int):
        self.name, self.count = name, count


class TokenWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        name = f"part-{TaskContext.get().partitionId():05d}.bin"
        count = 0
        with open(os.path.join(self.path, name), "wb") as f:
            f.write(bytes(HEADER))
            for row in rows:
                ids = np.asarray(row[0], np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
                    raise ValueError("ids have 16 bits")
                f.write(ids.astype("<u2").tobytes())
                count += len(ids)
            f.seek(0)
            f.write(count.to_bytes(HEADER, "little"))
        return Written(name, count)

    def commit(self, messages):
        with open(os.path.join(self.path, "_TOKENS"), "w") as f:
            f.writelines(f"{m.name}\t{m.count}\n" for m in messages if m)

    def abort(self, messages):
        for m in messages:
            if m:
                os.remove(os.path.join(self.path, m.name))


class TokenFile(DataSource):
    """spark.dataSource.register(TokenFile); format("tokenfile").load(path) -> (pos, token)."""

    @classmethod
    def name(cls):
        return "tokenfile"

    def schema(self):
        return "pos long, token int"

    def reader(self, schema):
        return TokenReader(self.options["path"])

    def writer(self, schema, overwrite):
        return TokenWriter(self.options["path"])


def concatenate(folder: str, target: str) -> int:
    """One file from the parts in order; returns the number of tokens."""
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    total = 0
    with open(target, "wb") as out:
        out.write(bytes(HEADER))
        for n in names:
            with open(os.path.join(folder, n), "rb") as f:
                total += int.from_bytes(f.read(HEADER), "little")
                while chunk := f.read(1 << 20):
                    out.write(chunk)
        out.seek(0)
        out.write(total.to_bytes(HEADER, "little"))
    return total
