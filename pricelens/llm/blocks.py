"""Compact rows for work that is shipped in blocks: byte planes under zstd.

A block row is ``(route, block, kind, data)``: rows are dealt by route or
block, sorted, and streamed, so a task holds one block or route at a time.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import zstandard

ROW = "route long, block long, kind int, data binary"


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, lowest first, as many as the largest needs."""
    x = np.ascontiguousarray(x, dtype="<u8")
    wide = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([wide]) + x.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def numbers(raw: bytes) -> np.ndarray:
    got = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((got.shape[1], 8), dtype=np.uint8)
    out[:, :raw[0]] = got.T
    return out.reshape(-1).view("<i8")


def pack(*parts: bytes) -> bytes:
    buf = io.BytesIO()
    for raw in parts:
        buf.write(len(raw).to_bytes(8, "little") + raw)
    return zstandard.compress(buf.getvalue(), 3)


def unpack(data: bytes) -> list[bytes]:
    raw, out, at = zstandard.decompress(data), [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at:at + 8], "little")
        out.append(raw[at + 8:at + 8 + n])
        at += 8 + n
    return out


def rows(got: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    route, block, kind, data = zip(*got, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(route, pa.int64()), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["route", "block", "kind", "data"])


def items(batch: pa.RecordBatch):
    """(route, block, kind, data) of each row, one row's data copied at a time."""
    *keys, data = batch.columns
    return ((*k, x.as_py()) for *k, x in zip(*(c.to_pylist() for c in keys), data, strict=True))


def ipc(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue()
