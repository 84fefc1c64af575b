"""Operator 4: BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token the last token of its encoding is unique. An automaton over
all tokens gives the tokens that end at each byte; the one whose neighbour in front (the last
token of the shorter prefix) is compatible is stored. Back-pointers give the ids.

Texts are cut where a pre-token always begins; parts and pre-tokens seen before come from a
bounded table.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import partial
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm.bpe import BpeTable, table
from plumbline.llm.textio import batch, small_batches, strings

#: The pre-token pattern of byte-level vocabularies.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space as the pattern understands it, but for the space and the newline.
BLANK = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\0]")
BORDER = regex.compile(r"(?<=\S)(?= \S)")
#: Parts and pre-tokens kept with their ids in each of two generations, the older dropped when the newer is full; characters of the longest.
KEPT, KEPT_CHARACTERS = 500_000, 48
#: Bytes from which a pre-token's table is kept in compact arrays.
COMPACT = 4096


class PrefixEncoder:
    """Exact ids of texts under one byte-level vocabulary."""

    def __init__(self, vocabulary: BpeTable):
        self.vocabulary = vocabulary
        self.matches = ahocorasick.Automaton()
        for token, i in vocabulary.ids.items():
            self.matches.add_word(token, (i, len(token)))
        self.matches.make_automaton()
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        bytes_of = [b""] * vocabulary.size
        for i, t in vocabulary.token.items():
            bytes_of[i] = t.encode("latin-1")
        for t, i in vocabulary.special.items():
            bytes_of[i] = t.encode()
        #: the bytes of all tokens in a row, and where each begins
        self.flat = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)
        self.width = np.array([len(b) for b in bytes_of], dtype=np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pre_token(self, piece: str) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        s = piece.encode().decode("latin-1")
        n, known, apart = len(s), self.vocabulary.known, self.vocabulary.apart
        if n < COMPACT:
            last: Any = [-1] * (n + 1)
            size: Any = [0] * (n + 1)
        else:
            last, size = array("i", [-1]) * (n + 1), array("H", [0]) * (n + 1)
        done = 0  # the longest token that fits comes first; the shorter ones that end here too are passed over
        for end, (i, length) in self.matches.iter(s):
            if end < done:
                continue
            start = end + 1 - length
            if start:
                front = last[start]
                if front < 0:
                    continue
                fits = known.get(front << 20 | i)
                if not (apart(front, i) if fits is None else fits):
                    continue
            done = end + 1
            last[done], size[done] = i, length
        ids, at = array("I"), n
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids.tobytes()

    def _keep(self, part: str, ids: bytes) -> None:
        if len(part) <= KEPT_CHARACTERS:
            if len(self.new) >= KEPT:
                self.old, self.new = self.new, {}
            self.new[part] = ids

    def part(self, part: str) -> bytes:
        """Ids of a part that begins and ends at borders; of its pre-tokens, where it has several, those seen before come from the table too."""
        found = self.old.get(part)
        if found is None:
            pieces = PRE_TOKEN.findall(part) if len(part) <= KEPT_CHARACTERS else (m[0] for m in PRE_TOKEN.finditer(part))
            found = []
            for x in pieces:
                ids = self.new.get(x) or self.old.get(x)
                if ids is None:
                    ids = self.pre_token(x)
                    if x != part:
                        self._keep(x, ids)
                found.append(ids)
            found = b"".join(found)
        self._keep(part, found)
        return found

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        A pre-token begins where one space stands between other characters, and a newline between
        others that are not white space is one: there the text is cut.
        """
        if not text:
            return b""
        if "  " in text or "\n" in text and ("\n\n" in text or " \n" in text or "\n " in text) or text[0] in " \n" or text[-1] in " \n" or BLANK.search(text):
            parts = BORDER.split(text)
        else:
            parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        get, part = self.new.get, self.part
        return b"".join([get(p) or part(p) for p in parts])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; the strings of special tokens stand for those tokens."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain(text[at : m.start()]), int(self.vocabulary.special[m[0]]).to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8; bytes that are none are replaced."""
        tokens = np.frombuffer(ids, dtype="<u4")
        out = []
        for i in range(0, len(tokens), 1 << 20):
            part = tokens[i : i + (1 << 20)]
            width = self.width[part]
            ends = np.cumsum(width)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(self.begin[part] - ends + width, width)].tobytes())
        raw = b"".join(out)
        return raw if raw.isascii() else raw.decode("utf-8", "replace").encode()


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(table(path))
    return _ENCODERS[path]


def _each(batches: Iterator[pa.RecordBatch], path: str, make) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for b in batches:
        for i in range(0, b.num_rows, 512):
            yield make(b.slice(i, 512), coder)


def _digests(b: pa.RecordBatch, coder: PrefixEncoder, schema: pa.Schema) -> pa.RecordBatch:
    count, ids_sum, text_sum = [], [], []
    for text in strings(b.column(1)):
        ids = coder.encode(text)
        count.append(len(ids) // 4)
        ids_sum.append(hashlib.sha256(ids).hexdigest())
        text_sum.append(hashlib.sha256(coder.decode(ids)).hexdigest())
    return batch(schema, b.column(0), count, ids_sum, text_sum)


def _ids(b: pa.RecordBatch, coder: PrefixEncoder, schema: pa.Schema, text_at: int) -> pa.RecordBatch:
    found = [np.frombuffer(coder.encode(t), dtype="<u4").astype(np.int32) for t in strings(b.column(text_at))]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
    return batch(schema, *[c.cast(f.type) for c, f in zip(b.columns, schema)], ids.cast(schema[-1].type))


def arrow_schema(ddl_fields: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(ddl_fields.items()))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs and `ids array<int>`, the tokens of the whole text (null or empty: no tokens).

    A column of docs that is already called `ids` is replaced. Rows stay as they are, repeated ones included.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    small_batches(docs.sparkSession)
    kept = docs.drop(ids)
    out = StructType([*kept.schema.fields]).add(ids, ArrayType(IntegerType(), False))
    schema = to_arrow_schema(out)
    return kept.mapInArrow(partial(_each, path=path, make=partial(_ids, schema=schema, text_at=kept.columns.index(text))), out)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_tokens, SHA-256 of the ids and of the text decoded from them.

    Null and empty texts have no tokens and the digests of nothing; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = arrow_schema({key: to_arrow_type(kind), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})
    ddl = f"`{key}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(partial(_each, path=path, make=partial(_digests, schema=schema)), ddl)
