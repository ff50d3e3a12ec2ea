"""Write requests in their binary form: protocol-buffer messages, block-compressed with snappy.

Read by field number, so unknown fields are skipped: request.timeseries = 1; series.labels = 1 and
.samples = 2; label.name = 1 and .value = 2; sample.value = 1 (double) and .timestamp = 2.

Defined cases. Bodies that can't be decompressed or read are left out, as are null ones; an
uncompressed message is read as it is. Labels and samples may come in any order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.sources.ingest import from_labels

SERIES, LABELS, SAMPLES, NAME, VALUE, TIME = 1, 1, 2, 1, 2, 2
#: A body may not grow beyond this when it is decompressed.
MOST_BYTES = 256 << 20


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number of more than 64 bits")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message: numbers, or the bytes of what is fixed or of stated length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
            yield key >> 3, value
            continue
        n, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(data, at)
        if kind not in (1, 2, 5) or at + n > len(data):
            raise ValueError("not a message")
        yield key >> 3, data[at : at + n]
        at += n


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def decompressed(body: bytes) -> bytes:
    n, _ = varint(body, 0)
    if n > MOST_BYTES:
        raise ValueError("the body is too large")
    return pa.decompress(body, decompressed_size=n, codec="snappy", asbytes=True)


def decoded(body: bytes) -> list[tuple[dict[str, str], int, float]]:
    """(labels, ts_ms, value) of a request."""
    try:
        data = decompressed(body)
    except (ValueError, IndexError, OSError):
        data = body
    out = []
    for number, series in fields(data):
        if number != SERIES or not isinstance(series, bytes):
            continue
        labels, points = {}, []
        for part, inner in fields(series):
            got = dict(fields(inner)) if isinstance(inner, bytes) else {}
            if part == LABELS:
                labels[got.get(NAME, b"").decode()] = got.get(VALUE, b"").decode()
            elif part == SAMPLES:
                # what is 0 may be left out
                points.append((signed(got.get(TIME, 0)), struct.unpack("<d", got.get(1, bytes(8)))[0]))
        out += [(labels, t, v) for t, v in points]
    return out


def number(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def chunk(field: int, data: bytes) -> bytes:
    return number(field << 3 | 2) + number(len(data)) + data


def encoded(series: list[dict]) -> bytes:
    """A request of series ``{"labels": [{"name", "value"}], "samples": [{"value", "timestamp"}]}``."""
    out = b""
    for s in series:
        labels = b"".join(chunk(LABELS, chunk(NAME, x["name"].encode()) + chunk(VALUE, x["value"].encode())) for x in s["labels"])
        points = b"".join(chunk(SAMPLES, b"\x09" + struct.pack("<d", x["value"]) + number(TIME << 3) + number(x["timestamp"])) for x in s["samples"])
        out += chunk(SERIES, labels + points)
    return pa.compress(out, codec="snappy", asbytes=True)


def remote_write(requests: DataFrame, column: str = "body") -> DataFrame:
    """Binary write requests to samples."""
    schema = pa.schema([("labels", pa.map_(pa.string(), pa.string())), ("ts_ms", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for body in b.column(0).to_pylist():
                try:
                    rows += decoded(body) if body else []
                except (ValueError, IndexError, TypeError, struct.error):
                    continue
            labels = pa.array([list(r[0].items()) for r in rows], schema.field("labels").type)
            yield pa.RecordBatch.from_arrays([labels, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], schema=schema)

    return from_labels(requests.select(F.col(column)).mapInArrow(run, "labels map<string,string>, ts_ms bigint, value double"))
