"""Binary log files of checksummed frames: header (magic, length, CRC-32), then an entry."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..schema import DELETE, LOG, UPSERT

# Fixed values of the format.
MAGIC = 0x56444231
MAX_FRAME = 64 * 1024 * 1024
MAX_FIELDS = 1_000_000
TEXT, WHOLE, REAL, TRUTH = 0, 1, 2, 3


def encode_entry(lsn: int, op: int, id_: int, generation: int, vector: list[float] = (), payload: dict | None = None) -> bytes:
    """One frame with its header."""
    body = [struct.pack("<QBQQI", lsn, op, id_, generation, len(vector) if op == UPSERT else 0)]
    if op == UPSERT:
        body += [np.asarray(vector, "<f4").tobytes(), struct.pack("<I", len(payload or {}))]
        for key, value in (payload or {}).items():
            name = key.encode()
            body += [struct.pack("<I", len(name)), name]
            if isinstance(value, bool):
                body.append(struct.pack("<BB", TRUTH, value))
            elif isinstance(value, int):
                body.append(struct.pack("<Bq", WHOLE, value))
            elif isinstance(value, float):
                body.append(struct.pack("<Bd", REAL, value))
            else:
                raw = value.encode()
                body.append(struct.pack("<BI", TEXT, len(raw)) + raw)
    raw = b"".join(body)
    return struct.pack("<III", MAGIC, len(raw), zlib.crc32(raw)) + raw


def decode_entry(raw: bytes) -> tuple[int, int, int, int, list[float] | None, str | None]:
    """lsn, op, id, generation, vector, payload (JSON) of an entry; anything amiss is an error."""
    try:
        lsn, op, id_, generation, n = struct.unpack_from("<QBQQI", raw)
        at = 29
        if op == DELETE and n == 0 and at == len(raw):
            return lsn, op, id_, generation, None, None
        if op != UPSERT:
            raise ValueError("invalid operation")
        vector = np.frombuffer(raw, "<f4", n, at).tolist()
        at += 4 * n
        (fields,) = struct.unpack_from("<I", raw, at)
        at += 4
        if fields > MAX_FIELDS:
            raise ValueError("too many payload fields")
        payload: dict[str, object] = {}

        def text() -> str:
            nonlocal at
            (size,) = struct.unpack_from("<I", raw, at)
            at += 4 + size
            if at > len(raw):
                raise ValueError("truncated text")
            return raw[at - size : at].decode()

        for _ in range(fields):
            key, kind = text(), raw[at]
            at += 1
            if kind == TEXT:
                payload[key] = text()
            elif kind in (WHOLE, REAL):
                (payload[key],) = struct.unpack_from("<q" if kind == WHOLE else "<d", raw, at)
                at += 8
            elif kind == TRUTH:
                payload[key] = raw[at] != 0
                at += 1
            else:
                raise ValueError("invalid payload type")
    except (struct.error, IndexError) as error:
        raise ValueError("truncated entry") from error
    if at != len(raw):
        raise ValueError("trailing bytes")
    return lsn, op, id_, generation, vector, json.dumps(payload)


def frames(raw: bytes) -> Iterator[bytes]:
    """Entries of a file. A torn tail ends it quietly; a bad header or checksum is an error."""
    at = 0
    while len(raw) - at >= 12:
        magic, size, check = struct.unpack_from("<III", raw, at)
        if magic != MAGIC or size > MAX_FRAME:
            raise ValueError("corrupt header")
        if len(raw) - at - 12 < size:
            return
        body = raw[at + 12 : at + 12 + size]
        if zlib.crc32(body) != check:
            raise ValueError("checksum mismatch")
        yield body
        at += 12 + size


def _tables(entries: Iterator[bytes], rows: int = 4096):
    """Entries as tables of at most `rows`, so that a long file isn't decoded at once."""
    import pandas as pd

    while held := [decode_entry(e) for e in islice(entries, rows)]:
        yield pd.DataFrame(held, columns=["lsn", "op", "id", "generation", "vector", "payload"])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The log (lsn, op, id, generation, vector, payload) of all files at a path, a task for each file.

    A file is read whole, so writers must close a file before Spark's bound of 2 GB.
    """

    def decode(batches):
        for batch in batches:
            for raw in batch["content"]:
                yield from _tables(frames(bytes(raw)))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, LOG)


def encode_frames(log: DataFrame) -> DataFrame:
    """lsn, frame (header and entry) of each row of a log."""

    def encode(batches):
        import pandas as pd

        for batch in batches:
            made = [encode_entry(int(r.lsn), int(r.op), int(r.id), int(r.generation), [] if r.vector is None else r.vector, json.loads(r.payload) if r.payload else {}) for r in batch.itertuples()]
            yield pd.DataFrame({"lsn": batch["lsn"], "frame": made})

    return log.mapInPandas(encode, "lsn long, frame binary")


def decode_frames(coded: DataFrame) -> DataFrame:
    """The log of single frames (column `frame`)."""

    def decode(batches):
        for batch in batches:
            yield from _tables(f for raw in batch["frame"] for f in frames(bytes(raw)))

    return coded.select("frame").mapInPandas(decode, LOG)
