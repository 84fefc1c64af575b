"""Operator 10: byte-exact substring dedup over sorted suffixes.

Sorting the suffixes at all bytes would shuffle some fifty times the input. Instead only suffixes
at anchors are sorted: the positions whose K-byte hash is the least among those of some `length`
byte window, so that every window holds an anchor, and equal windows hold the same one.

1. Hashes of leading K bytes are range-partitioned and counted. A bitmap keeps those that occur in
   two documents, another those with two different surroundings (the bytes that windows around
   the anchor can reach). A task sends each hash once.
2. Anchors that pass are range-partitioned again, with their surroundings where these differ. Each
   bucket is sorted locally and equal neighbours are compared: whole surroundings first, and,
   where they differ, each window by itself. The least id among equals stays.
3. Removed ranges are merged by document and applied.

No position is left out: an anchor that occurs once has no window that occurs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import sieve
from plumbline.llm.lines import LAST
from plumbline.llm.textio import buffers, inverse_powers, lean, mix, pieces, powers, small_batches

K = 24
#: Bits of the hashes counted first, and of the bitmaps.
COUNTED_BITS, SIEVE_BITS = 40, 27
#: Anchors that a task gathers before it sends them.
FLUSH = 1_000_000

COUNTED = np.dtype([("h", "<u8"), ("around", "<u4"), ("flags", "u1")])
SINGLE = np.dtype([("around", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<i4"), ("left", "u1"), ("right", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("start", "<i4"), ("end", "<i4")])


def several(length: int) -> np.dtype:
    return np.dtype([("key", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<i4"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", (2 * length - K,))])


def _extreme(x: np.ndarray, width: int, function) -> np.ndarray:
    """function over x[i : i + width] for every i, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = function(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return function(out[: len(out) - rest], out[rest:]) if rest else out


class Anchors:
    """Anchors of a piece of texts: positions, rows, hashes, extents and digests of the surroundings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        n, w = len(data), length - K + 1
        self.data, self.length = data, length
        self.at = self.row = np.zeros(0, np.int64)
        self.h = self.around = np.zeros(0, np.uint64)
        self.left = self.right = np.zeros(0, np.int64)
        if n < length:
            return
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[data] * powers(n), out=total[1:])
        inverse = inverse_powers(n + 1)
        h = mix((total[K:] - total[:-K]) * inverse[: n - K + 1])
        ends = np.repeat(offsets[1:], np.diff(offsets))
        room = ends - np.arange(n)
        h[room[: n - K + 1] < K] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least = _extreme(h, w, np.minimum)
        least[room[: len(least)] < length] = 0
        padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(len(h) - len(least), np.uint64)])
        at = np.flatnonzero((_extreme(padded, w, np.maximum) == h) & (room[: len(h)] >= K))
        self.at, self.h = at, mix(h[at])  # least hashes are small ones; parts and bitmaps need even ones
        self.row = np.searchsorted(offsets, at, side="right") - 1
        self.begin = offsets[self.row]
        self.left = np.minimum(at - self.begin, length - K)
        self.right = np.minimum(offsets[self.row + 1] - at - K, length - K)
        s, e = at - self.left, at + K + self.right
        self.around = mix((total[e] - total[s]) * inverse[s] ^ mix(self.left.astype(np.uint64) * np.uint64(256) + self.right.astype(np.uint64)) ^ self.h)

    def surroundings(self, which: np.ndarray) -> np.ndarray:
        side = self.length - K
        padded = np.concatenate([np.zeros(side, np.uint8), self.data, np.zeros(self.length, np.uint8)])
        return padded[self.at[which][:, None] + np.arange(2 * self.length - K)[None, :]]


def packed(records: np.ndarray) -> bytes:
    """Records byte plane by byte plane, so that planes that hardly change compress; `bytes` as they stand."""
    names = [x for x in records.dtype.names if x != "bytes"]
    planes = [records[x].copy().view(np.uint8).reshape(len(records), -1).T.tobytes() for x in names]
    return b"".join(planes + ([records["bytes"].tobytes()] if "bytes" in records.dtype.names else []))


def unpacked(raw: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(raw) // kind.itemsize, 0
    out = np.zeros(n, dtype=kind)
    data = np.frombuffer(raw, dtype=np.uint8)
    for name in [x for x in kind.names if x != "bytes"]:
        width = kind[name].itemsize
        out[name] = np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(kind[name]).ravel()
        at += n * width
    if "bytes" in kind.names:
        out["bytes"] = data[at:].reshape(n, -1)
    return out


def _dealt(records: np.ndarray, part: np.ndarray, parts: int, kind: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each part: its number, the kind of the records, and their bytes."""
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32)), pa.array([packed(records[cuts[p] : cuts[p + 1]]) for p in full.tolist()], type=pa.binary())], schema=out)


BLOBS = pa.schema({"part": pa.int32(), "kind": pa.int32(), "records": pa.binary()})
BLOBS_DDL = "part int, kind int, records binary"


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _collapsed(x: np.ndarray) -> np.ndarray:
    """One record for each hash: flag 1 if it occurred in two documents, flag 2 if with two surroundings. Records of a hash in one document come once."""
    x = x[np.argsort(x["h"], kind="stable")]
    if not len(x):
        return x
    new = np.ones(len(x), dtype=bool)
    new[1:] = x["h"][1:] != x["h"][:-1]
    first = np.flatnonzero(new)
    flags = np.bitwise_or.reduceat(x["flags"], first)
    flags[np.diff(np.append(first, len(x))) > 1] |= 1
    flags[np.minimum.reduceat(x["around"], first) != np.maximum.reduceat(x["around"], first)] |= 2
    out = x[first]
    out["flags"] = flags
    return out


def _count(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    held, number = [], 0

    def flush():
        x = _collapsed(np.concatenate(held))
        yield from _dealt(x, _part(x["h"] << np.uint64(64 - COUNTED_BITS), parts), parts, 0, BLOBS)

    for b in batches:
        data, offsets = buffers(b.column(0))
        for i, j in pieces(offsets, 1 << 19):
            a = Anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
            h, around = a.h >> np.uint64(64 - COUNTED_BITS), (a.around & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.lexsort((a.row, h))
            h, row, around = h[order], a.row[order], around[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            x = np.zeros(len(first), dtype=COUNTED)
            if len(first):
                x["h"], x["around"] = h[first], around[first]
                x["flags"] = 2 * (np.minimum.reduceat(around, first) != np.maximum.reduceat(around, first))
            held.append(x)
            number += len(x)
            if number > FLUSH:
                yield from flush()
                held, number = [], 0
    if held:
        yield from flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the two bitmaps (kind 0: in two documents; kind 1: and with two surroundings) that the hashes of this task set."""
    blobs = [unpacked(r, COUNTED) for b in batches for r in b.column(2).to_pylist()]
    if not blobs:
        return
    x = _collapsed(np.concatenate(blobs))
    for kind, flags in ((0, 1), (1, 3)):
        place = x["h"][x["flags"] & flags == flags] >> np.uint64(COUNTED_BITS - SIEVE_BITS)
        word, at = np.unique(place >> np.uint64(6), return_index=True)
        if len(word):
            bits = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), at)
            record = np.zeros(len(word), dtype=[("word", "<u4"), ("bits", "<u8")])
            record["word"], record["bits"] = word, bits
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([kind], pa.int32()), pa.array([record.tobytes()], pa.binary())], schema=BLOBS)


def _ranges(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges of the rows of records `of`; a row is known by its id's rank and a digest of its text."""
    out = np.zeros(len(of), dtype=RANGE)
    out["doc"], out["mark"], out["start"], out["end"] = of["doc"], of["mark"], start, end
    return out


def _changes(r: np.ndarray) -> np.ndarray:
    """Where a new row begins among sorted records."""
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r["doc"][1:] != r["doc"][:-1]) | (r["mark"][1:] != r["mark"][:-1])
    return new


def _later(group: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Which rows have an equal row (in all arrays of group) with a smaller doc."""
    order = np.lexsort((doc, *group))
    new = np.zeros(len(doc), dtype=bool)
    new[:1] = True
    for g in group:
        s = g[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    least = np.repeat(doc[order][first], np.diff(np.append(first, len(doc))))
    out = np.zeros(len(doc), dtype=bool)
    out[order] = doc[order] > least
    return out


def _single_ranges(x: np.ndarray, later: np.ndarray) -> np.ndarray:
    x = x[later]
    return _ranges(x, x["at"] - x["left"], x["at"] + K + x["right"])


def _row_part(r: np.ndarray, parts: int) -> np.ndarray:
    return _part(mix(r["doc"].astype(np.uint64) ^ mix(r["mark"].astype(np.uint64))), parts)


def _by_document(ranges: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    ranges = _merged(ranges)
    yield from _dealt(ranges, _row_part(ranges, parts), parts, 2, BLOBS)


def _merged(r: np.ndarray) -> np.ndarray:
    """Overlapping and touching ranges of a row as one."""
    if not len(r):
        return r
    r = r[np.lexsort((r["start"], r["mark"], r["doc"]))]
    new_doc = _changes(r)
    which = np.cumsum(new_doc).astype(np.int64) << np.int64(33)
    reach = np.maximum.accumulate(which + r["end"])
    new = np.ones(len(r), dtype=bool)
    new[1:] = which[1:] + r["start"][1:] > reach[:-1]
    first = np.flatnonzero(new)
    return _ranges(r[first], r["start"][first], (reach[np.append(first[1:], len(r)) - 1] - which[first]))


def _send(batches: Iterator[pa.RecordBatch], length: int, parts: int, shared: np.ndarray, differing: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Anchors that pass; those with the same surroundings as one of a smaller id in the same task are settled at once."""
    singles, multiples, number = [], [], 0

    def flush():
        x = np.concatenate(singles) if singles else np.zeros(0, SINGLE)
        later = _later([x["around"]], x["doc"])
        yield from _by_document(_single_ranges(x, later), parts)
        yield from _dealt(x[~later], _part(x["around"][~later], parts), parts, 0, BLOBS)
        m = np.concatenate(multiples) if multiples else np.zeros(0, several(length))
        yield from _dealt(m, _part(m["key"], parts), parts, 1, BLOBS)

    for b in batches:
        ids, marks = b.column(1).to_numpy(), b.column(2).to_numpy()
        data, offsets = buffers(b.column(0))
        for i, j in pieces(offsets, 1 << 19):
            a = Anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
            passing = np.flatnonzero(sieve.passes(shared, a.h))
            many = sieve.passes(differing, a.h[passing])
            one = passing[~many]
            x = np.zeros(len(one), dtype=SINGLE)
            x["around"], x["doc"], x["mark"], x["at"], x["left"], x["right"] = a.around[one], ids[i + a.row[one]], marks[i + a.row[one]], a.at[one] - offsets[a.row[one] + i] + offsets[i], a.left[one], a.right[one]
            singles.append(x)
            which = passing[many]
            m = np.zeros(len(which), dtype=several(length))
            m["key"], m["doc"], m["mark"], m["at"], m["left"], m["right"] = a.h[which], ids[i + a.row[which]], marks[i + a.row[which]], a.at[which] - offsets[a.row[which] + i] + offsets[i], a.left[which], a.right[which]
            if len(which):
                m["bytes"] = a.surroundings(which)
            multiples.append(m)
            number += len(x) + 8 * len(m)
            if number > FLUSH:
                yield from flush()
                singles, multiples, number = [], [], 0
    yield from flush()


def _window_ranges(m: np.ndarray, length: int) -> np.ndarray:
    """Ranges of the windows around anchors of several surroundings that also start at an equal place in a smaller id."""
    side = length - K
    if not len(m):
        return np.zeros(0, RANGE)
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    columns = np.ascontiguousarray(m["bytes"].T)
    weight = powers(2 * length - K)
    window = np.zeros(len(m), dtype=np.uint64)
    for j in range(length):
        window += table[columns[j]] * weight[j]
    found = np.zeros(0, RANGE)
    for o in range(side + 1):
        fits = np.flatnonzero((m["left"] >= side - o) & (m["right"] >= o))
        digest = mix(window[fits] * inverse_powers(o + 1)[o])
        later = fits[_later([digest, m["key"][fits]], m["doc"][fits])]
        start = m["at"][later].astype(np.int64) - side + o
        found = np.concatenate([found, _ranges(m[later], start, start + length)])
        if len(found) > 2 * len(m):
            found = _merged(found)
        if o < side:  # the next window: one byte leaves, one enters
            window += table[columns[o + length]] * weight[o + length] - table[columns[o]] * weight[o]
    return _merged(found)


def _settle(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    single, multiple = [], []
    for b in batches:
        for kind, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if kind == 2:
                x = unpacked(r, RANGE)
                yield from _dealt(x, _row_part(x, parts), parts, 2, BLOBS)
            else:
                (multiple if kind else single).append(unpacked(r, several(length) if kind else SINGLE))
    if single:
        x = np.concatenate(single)
        yield from _by_document(_single_ranges(x, _later([x["around"]], x["doc"])), parts)
    if multiple:
        m = np.concatenate(multiple)
        keys = m["key"]
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        # whole runs of a key at a time, some 50 000 rows together
        borders, last = [0], 0
        for c in [*cuts.tolist(), len(m)]:
            if c - last >= 50_000 or c == len(m):
                borders.append(c)
                last = c
        for i, j in zip(borders[:-1], borders[1:]):
            yield from _by_document(_window_ranges(m[order[i:j]], length), parts)


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [unpacked(r, RANGE) for b in batches for r in b.column(2).to_pylist()]
    if not held:
        return
    r = _merged(np.concatenate(held))
    cuts = np.append(np.flatnonzero(_changes(r)), len(r))
    for i in range(0, len(cuts) - 1, 5000):
        own = cuts[i : i + 5001]
        first = r[own[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(first["doc"].copy()), pa.array(first["mark"].copy()), pa.array([np.stack([r["start"][s:e], r["end"][s:e]]).tobytes() for s, e in zip(own[:-1], own[1:])], type=pa.binary()), pa.array(mix(first["mark"].astype(np.uint64)).view(np.int64))], names=["_doc", "_own", "ranges", "spot"])


OUT = pa.schema({"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()})


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256, removed (list of byte ranges).

    Removes each byte of the UTF-8 text that a string of `length` bytes covers which also starts in
    a document with a smaller id; strings are judged on the input, overlaps count, matches never
    cross documents. A null text is empty. Rows without an id rank last and do not match one
    another, nor do rows that repeat an id; every row is judged by its own text. Other columns are
    not read. Strings are compared by 64-bit digests.
    """
    if length < K + 1 or length > 250:
        raise ValueError(f"length must be from {K + 1} to 250")
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = docs.select(F.col(key), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("_rank"), F.xxhash64(F.col(text)).alias("_mark"), F.col(text).alias("_text"))

    counted = ranked.select("_text").mapInArrow(lean(lambda it: _count(it, length, parts)), BLOBS_DDL).repartitionById(parts, F.col("part"))
    words = counted.mapInArrow(lean(_shared), BLOBS_DDL).toArrow()  # words of two bitmaps of fixed size
    maps = np.zeros((2, 1 << (SIEVE_BITS - 6)), dtype=np.uint64)
    for kind, r in zip(words.column("kind").to_pylist(), words.column("records").to_pylist()):
        record = np.frombuffer(r, dtype=[("word", "<u4"), ("bits", "<u8")])
        maps[kind][record["word"]] |= record["bits"]
    shared = spark.sparkContext.broadcast(maps)

    sent = ranked.select("_text", "_rank", "_mark").mapInArrow(lean(lambda it: _send(it, length, parts, shared.value[0], shared.value[1])), BLOBS_DDL).repartitionById(parts, F.col("part"))
    settled = sent.mapInArrow(lean(lambda it: _settle(it, length, parts)), BLOBS_DDL).repartitionById(parts, F.col("part"))
    from plumbline.llm.store import cut

    removed = cut(settled.mapInArrow(lean(_per_document), "_doc long, _own long, ranges binary, spot long"))
    touched = spark.sparkContext.broadcast(sieve.build(removed, F.col("spot"), 23))
    return _applied(ranked, removed.drop("spot"), key, touched)


def _digest(data: bytes, ranges: bytes | None) -> tuple[int, int, str, list]:
    if not ranges:
        return 0, 0, hashlib.sha256(data).hexdigest(), []
    starts, ends = np.frombuffer(ranges, dtype="<i4").reshape(2, -1).tolist()
    kept, at, gone, spans = hashlib.sha256(), 0, 0, []
    for s, e in zip(starts, ends):
        s, e = min(s, len(data)), min(e, len(data))
        if e > s:
            kept.update(data[at:s])
            at, gone = e, gone + e - s
            spans.append({"start": s, "end": e})
    kept.update(data[at:])
    return gone, len(spans), kept.hexdigest(), spans


def _applied(ranked: DataFrame, removed: DataFrame, key: str, touched) -> DataFrame:
    """Documents that nothing is removed from are digested where they are read; only the others' texts are shuffled."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = ranked.schema[key].dataType
    key_type = to_arrow_type(kind)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                marks = b.column(2).to_numpy().astype(np.int64)
                passes = sieve.passes(touched.value, mix(marks.view(np.uint64)))
                texts = [b"" if t is None else t for t in b.column(3).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(key_type), b.column(1), b.column(2), pa.array([t if p else None for t, p in zip(texts, passes)], type=pa.binary()), pa.array([len(t) for t in texts], type=pa.int64()), pa.array([None if p else hashlib.sha256(t).hexdigest() for t, p in zip(texts, passes)], type=pa.string())],
                    names=[key, "_rank", "_mark", "_bytes", "n_bytes", "kept_sha256"],
                )

    once = ranked.mapInArrow(lean(first), f"`{key}` {kind.simpleString()}, _rank long, _mark long, _bytes binary, n_bytes long, kept_sha256 string")
    joined = once.join(removed, (once["_rank"] == removed["_doc"]) & (once["_mark"] == removed["_own"]), "left").drop("_rank", "_mark", "_doc", "_own")
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                found = [(0, 0, s, []) if t is None else _digest(t, r) for t, s, r in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())]
                gone, spans, digests, lists = zip(*found)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(key_type), b.column(2), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(lists, span_type)], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return joined.mapInArrow(lean(last), f"`{key}` {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>")
