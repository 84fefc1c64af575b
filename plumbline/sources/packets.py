"""Packets of live previews and the multiplexed messages that carry them."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the formats: headers, kinds of numbers, the most elements of a packet.
POINTS_HEADER = struct.Struct("<4sIQfI")
MESH_HEADER = struct.Struct("<4sIII")
MESSAGE_HEADER = struct.Struct("<4sHHIQ")
POINT = np.dtype([("p", "<f4", 3), ("c", "u1", 3)])
MOST = 150_000
#: The most bytes of a message's payload.
PAYLOAD = 64 << 20


def even_places(n: int, keep: int) -> np.ndarray:
    """At most `keep` places, spread evenly, the first and the last among them."""
    return np.arange(n) if n <= keep else np.arange(keep) * (n - 1) // (keep - 1)


def point_packet(magic: bytes, frame: int, t_us: int, fps: float, points: np.ndarray, colours: np.ndarray, most: int = MOST) -> bytes:
    """A header and 15 bytes a point, of at most `most` points spread evenly."""
    at = even_places(len(points), most)
    body = np.zeros(len(at), dtype=POINT)
    body["p"], body["c"] = points[at], colours[at]
    return POINTS_HEADER.pack(magic, frame, t_us, fps, len(at)) + body.tobytes()


def read_point_packet(raw: bytes, magic: bytes, most: int = MOST) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """(frame, t_us, fps, points, colours); ValueError for what is no whole packet."""
    if len(raw) < POINTS_HEADER.size:
        raise ValueError("packet without a header")
    found, frame, t_us, fps, n = POINTS_HEADER.unpack_from(raw)
    if found != magic or n > most or len(raw) != POINTS_HEADER.size + POINT.itemsize * n or not np.isfinite(fps):
        raise ValueError("not a packet of this format")
    body = np.frombuffer(raw, dtype=POINT, offset=POINTS_HEADER.size)
    return frame, t_us, fps, body["p"], body["c"]


def mesh_packet(magic: bytes, frame: int, vertices: np.ndarray, colours: np.ndarray, triangles: np.ndarray, flip: bool = False, most: int = MOST) -> bytes:
    """A header, then the places, colours and corners of at most `most` triangles spread evenly and the vertices they use (K10, P9); flip turns their winding round."""
    kept = triangles.reshape(-1, 3)[even_places(len(triangles.reshape(-1, 3)), most)]
    used, corners = np.unique(kept, return_inverse=True)
    corners = corners.reshape(-1, 3)
    if flip:
        corners = corners[:, ::-1]
    used = used.astype(np.int64)
    return MESH_HEADER.pack(magic, frame, len(used), corners.size) + vertices[used].astype("<f4").tobytes() + colours[used].astype("u1").tobytes() + corners.astype("<u4").tobytes()


def point_packets(points: DataFrame, frame: str, t_us: str, fps: float, magic: bytes, most: int = MOST) -> DataFrame:
    """(frame, payload): one packet for each frame of (frame, t_us, order, x, y, z, r, g, b); a frame's points, capped by the packet, are packed in one task."""
    from plumbline.operators.relational import evenly_spaced

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("order")
        raw = point_packet(magic, int(key[0]), int(part[t_us].iloc[0]), fps, part[list("xyz")].to_numpy(), part[list("rgb")].to_numpy(), most)
        return pd.DataFrame({frame: [key[0]], "payload": [raw]})

    kind = points.schema[frame].dataType.simpleString()
    return evenly_spaced(points, ["order"], most, frame).groupBy(frame).applyInPandas(pack, f"`{frame}` {kind}, payload binary")


def write_message(magic: bytes, kind: int, sequence: int, payload: bytes, version: int = 1) -> bytes:
    return MESSAGE_HEADER.pack(magic, version, kind, len(payload), sequence) + payload


def read_messages(source: io.BufferedIOBase, magic: bytes, version: int = 1, most: int = PAYLOAD) -> Iterator[tuple[int, int, bytes]]:
    """(kind, sequence, payload) until the stream's end; ValueError for a message that is cut, too long or of another protocol."""
    while head := source.read(MESSAGE_HEADER.size):
        if len(head) < MESSAGE_HEADER.size:
            raise ValueError("stream ends within a header")
        found, v, kind, size, sequence = MESSAGE_HEADER.unpack(head)
        if found != magic or v != version or size > most:
            raise ValueError("not a message of this protocol")
        payload = source.read(size)
        if len(payload) < size:
            raise ValueError("stream ends within a message")
        yield kind, sequence, payload


def messages(spark: SparkSession, path: str, magic: bytes, version: int = 1) -> DataFrame:
    """(path, kind, sequence, payload) of recorded streams, the kinds told apart by a column; one task reads a file."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                for kind, sequence, payload in read_messages(io.BytesIO(bytes(content)), magic, version):
                    yield pd.DataFrame({"path": [name], "kind": [kind], "sequence": [sequence], "payload": [payload]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, kind int, sequence long, payload binary")
