"""Operator 9: substring dedup by hashing lines or paragraphs, and the sentences of lines.

Units are normalised (ASCII case folded, white space collapsed) and hashed to 128 bits; digests are
grouped over all documents, the earliest occurrence by (id, place) is kept and the others are
removed. What is removed is retained as offsets into the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import cut
from plumbline.llm.textio import SPACE, batch, buffers, inverse_powers, lean, mix, pieces, powers, small_batches, span_hashes, word_spans

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
UNITS = {"line": b"\n", "paragraph": b"\n\n", "sentence": b"\n"}
LAST = (1 << 63) - 1
#: Characters from which a unit counts as long, however few its words.
LONG = 64
#: Bytes that end a sentence when white space follows.
STOPS = np.zeros(256, dtype=bool)
STOPS[list(b".!?")] = True
#: A digest is hot if it is one in so many units (and has MIN_HOT of them): so many hot digests are there at most.
HOT, MIN_HOT = 20_000, 1000
BLANK = bytes(np.flatnonzero(SPACE).tolist())


def unspaced(data: np.ndarray) -> np.ndarray:
    """Whether a character of a script without spaces between words begins at a byte: Thai, Lao, Burmese, Khmer, kana, ideographs."""
    then = np.append(data[1:], 0)
    found = (data >= 0xE3) & (data <= 0xE9) | (data == 0xE2) & (then >= 0xBA) | (data == 0xEF) & (then >= 0xA4) & (then <= 0xAB)
    found |= (data == 0xE0) & (then >= 0xB8) & (then <= 0xBB) | (data == 0xE1) & ((then >= 0x80) & (then <= 0x82) | (then == 0x9E) | (then == 0x9F))
    return found | (data == 0xF0) & (then >= 0xA0)


def _borders(data: np.ndarray, offsets: np.ndarray, paragraphs: bool) -> np.ndarray:
    """Where the borders between units begin: newlines, or pairs of newlines, taken from the left of each text."""
    at = np.flatnonzero(data == 10)
    if not paragraphs:
        return at
    ends, found, last = set(offsets[1:].tolist()), [], -2
    for i in at[np.isin(at + 1, at)].tolist():
        if i > last and i + 1 not in ends:
            found.append(i)
            last = i + 1
    return np.array(found, dtype=np.int64)


def unit_digests(data: np.ndarray, offsets: np.ndarray, unit: str, least: int) -> tuple[np.ndarray, ...]:
    """(row, start, end, digest, digest) of all units of `least` words or unspaced characters, or LONG characters, or more; start and end count the bytes of the text."""
    data = FOLD[data]
    starts, ends, rows = word_spans(data, offsets)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    border = _borders(data, offsets, unit == "paragraph")
    line = np.searchsorted(border, starts)  # borders before a word
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (line[1:] != line[:-1])
    # where the unit of each word begins and ends
    fence = np.concatenate([[-len(UNITS[unit])], border, [len(data)]])
    begin, end = np.maximum(fence[line] + len(UNITS[unit]), offsets[rows]), np.minimum(fence[line + 1], offsets[rows + 1])
    kinds = [(np.flatnonzero(new), begin, end)]
    if unit == "sentence":
        cut_ = new.copy()
        cut_[1:] |= STOPS[data[ends[:-1] - 1]]
        first = np.flatnonzero(cut_)
        own = np.cumsum(new)[first]
        several = np.bincount(own)[own] > 1  # a line of one sentence is that sentence
        stop = np.append(starts[first[1:]], len(data))
        whole = np.append(new[first[1:]], True)
        left, right = begin.copy(), end.copy()
        left[first[~new[first]]] = starts[first[~new[first]]]
        right[first[~whole]] = stop[~whole]
        size = np.diff(np.append(first, len(starts)))
        kinds.append((first[several], left, right, size[several]))
    sums = []
    for seed in (1, 2):
        h = mix(span_hashes(data, starts, ends, seed))
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * powers(len(h)), out=total[1:])
        sums.append(total)
    masks = [(LONG, (data & 0xC0) != 0x80), *([(least, unspaced(data))] if data.max() >= 0xE0 else [])]
    counted = [np.concatenate([[0], np.cumsum(m, dtype=np.int32)]) for _, m in masks]
    out = []
    for first, left, right, *rest in kinds:
        size = rest[0] if rest else np.diff(np.append(first, len(starts)))
        keep = size >= least
        short = np.flatnonzero(~keep)
        for (most, _), c in zip(masks, counted):
            keep[short] |= c[ends[first + size - 1][short]] - c[starts[first][short]] >= most
        first, size = first[keep], size[keep]
        digests = [mix((t[first + size] - t[first]) * inverse_powers(len(starts) + 1)[first] + size.astype(np.uint64)) for t in sums]
        base = offsets[rows[first]]
        out.append((rows[first], left[first] - base, right[first] - base, *digests))
    return tuple(np.concatenate(x) for x in zip(*out))


def _units(batches: Iterator[pa.RecordBatch], unit: str, least: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
        data, offsets = buffers(b.column(2))
        for i, j in pieces(offsets):
            rows, start, end, one, two = unit_digests(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit, least)
            yield batch(out, one.view(np.int64), two.view(np.int64), ids[i + rows], marks[i + rows], start.astype(np.int32), end.astype(np.int32))


def without(text: str, border: bytes, gone: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the units at these byte ranges, and the character offsets of what is removed.

    A unit goes with one border; a line of which sentences go and no word is left goes whole.
    """
    raw = text.encode()
    plain = len(raw) == len(text)
    gone = sorted(gone)
    whole, kept, spans, at, k = set(gone), [], [], 0, 0
    for unit in raw.split(border):
        end = at + len(unit)
        inside = []
        while k < len(gone) and gone[k][0] < end:
            inside.append(gone[k])
            k += 1
        if inside and (at, end) not in whole:
            left, place = [], at
            for s, e in inside:
                left.append(raw[place:s])
                place = e
            left = b"".join([*left, raw[place:end]])
            if left.strip(BLANK):
                kept.append(left)
                spans += inside
            else:
                spans.append((at, end))
        elif inside:
            spans.append((at, end))
        else:
            kept.append(unit)
        at = end + len(border)
    if not plain:
        places = [x for s in spans for x in s]
        counted, have, last = [], 0, 0
        for p in places:
            have += len(raw[last:p].decode())
            last = p
            counted.append(have)
        spans = list(zip(counted[::2], counted[1::2]))
    return border.join(kept).decode(), spans


def _repeated(units: DataFrame) -> DataFrame:
    """units that stand behind the first of their digest. A hot digest is looked up by broadcast, so that no task gets all of its units."""
    first = cut(units.groupBy("one", "two").agg(F.min(F.struct("rank", "mark", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    many = max(MIN_HOT, units.count() // HOT)
    hot, rest = first.where(F.col("n") > many), first.where(F.col("n") <= many)  # hot: at most HOT rows
    later = "struct(rank, mark, start) <> first"
    spread = units.join(F.broadcast(hot), ["one", "two"]).where(later)
    cold = units.join(F.broadcast(hot.select("one", "two")), ["one", "two"], "left_anti")
    return spread.unionByName(cold.join(rest, ["one", "two"]).where(later)).select("rank", "mark", "start", "end")


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", least_words: int = 5) -> DataFrame:
    """docs with the repeated units taken out of the text, and the columns n_units, n_removed and removed_spans.

    unit: "line"; "paragraph" (text between blank lines); or "sentence": lines, and, where a line
    stays, its sentences (a word that ends in . ! or ? ends one). A unit of `least_words` words
    or more, or as many characters of scripts without spaces between words, or of LONG characters
    or more, goes where an equal unit, after normalising, stands in a document with a smaller id
    or earlier in the same one. A line of which no word is left goes whole. Every row is judged by
    its own text: rows of one id are ordered by a digest of their texts, rows without an id rank
    last, in the same order. Rows alike in id and text are one document and stay alike.
    Null texts stay null, with no units; empty texts have one. n_units: lines or paragraphs;
    n_removed: removed spans; removed_spans: their character offsets (start, end) in the original
    text. Columns of docs with the names of the added ones are replaced; others stay as they are.
    """
    small_batches(docs.sparkSession)
    added = ["n_units", "n_removed", "removed_spans"]
    kept = [c for c in docs.columns if c not in added]
    border = UNITS[unit]
    identity = [F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64(F.col(text)).alias("mark")]
    schema = pa.schema({"one": pa.int64(), "two": pa.int64(), "rank": pa.int64(), "mark": pa.int64(), "start": pa.int32(), "end": pa.int32()})

    def digest(batches):
        return _units(batches, unit, least_words, schema)

    units = cut(docs.select(*identity, F.col(text).alias("text")).mapInArrow(lean(digest), "one long, two long, rank long, mark long, start int, end int"))
    places = _repeated(units).groupBy("rank", "mark").agg(F.collect_set(F.struct("start", "end")).alias("places"))  # a document's own units

    rows = docs.select(F.struct(*kept).alias("row"), *identity)
    joined = rows.join(places, ["rank", "mark"], "left").select("row", "places")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out_type = StructType([*docs.select(*kept).schema.fields, *StructType.fromDDL("n_units long, n_removed long, removed_spans array<struct<start:int,end:int>>").fields])
    out = to_arrow_schema(out_type)
    text_at = kept.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                columns = [c.cast(f.type) for c, f in zip(b.column(0).flatten(), out)]
                texts, n_units, spans = [], [], []
                for t, gone in zip(columns[text_at].to_pylist(), b.column(1).to_pylist()):
                    left, removed = (t, []) if t is None or not gone else without(t, border, [(g["start"], g["end"]) for g in gone])
                    texts.append(left)
                    n_units.append(0 if t is None else t.count(border.decode()) + 1)
                    spans.append([{"start": s, "end": e} for s, e in removed])
                columns[text_at] = pa.array(texts, type=out[text_at].type)
                yield batch(out, *columns, n_units, [len(s) for s in spans], spans)

    return joined.mapInArrow(lean(apply), out_type)
