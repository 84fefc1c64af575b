"""Byte-pair vocabularies of the `tokenizers` JSON format: tokens, merges and the pair-compatibility test.

A sequence of tokens is the encoding that byte-pair merging gives exactly if every token is
its own encoding and every two neighbours stay apart when merged together. `BpeTable.apart`
is that test; operators 3 and 4 build on it.
"""

from __future__ import annotations

import json

#: Stands for the end-of-word suffix behind the last byte of a word.
END = chr(256)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, to the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BpeTable:
    """Tokens as strings over chr(0..255) and END, with ids, merge ranks and halves."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.suffix = model.get("end_of_word_suffix") or ""

        def plain(token: str) -> str:
            end = self.suffix and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if end else token
            return "".join(chr(letters[c]) for c in body) + (END if end else "")

        special = {t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: plain(t) for t, i in model["vocab"].items() if t not in special}
        ids = {t: i for i, t in self.token.items()}
        size = max([*self.token, *self.special.values()]) + 1
        self.rank, self.halves = [-1] * size, [(-1, -1)] * size
        self.joined: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (plain(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = ids.get(a + b)
            if whole is None:
                continue
            self.joined.setdefault(ids[a] << 20 | ids[b], rank)
            if self.rank[whole] < 0:
                self.rank[whole], self.halves[whole] = rank, (ids[a], ids[b])
        self.size = size
        #: pairs tested before
        self.known: dict[int, bool] = {}
        #: id of each token that byte-pair merging of its own text gives
        self.ids = {t: i for t, i in ids.items() if self._whole(i)}

    def _whole(self, i: int) -> bool:
        if self.rank[i] < 0:
            return len(self.token[i].rstrip(END)) == 1
        a, b = self.halves[i]
        return self._whole(a) and self._whole(b) and self._stay(a, b, self.rank[i])

    def _stay(self, a: int, b: int, until: float) -> bool:
        """Whether no merge of rank below `until` crosses the border of a and b.

        Goes back in time: of the two neighbours at the border the one made last comes apart
        (of equal ranks the right one, as merging goes from the left). A merge across the
        border that was possible before that moment would have been taken.
        """
        rank, halves, joined = self.rank, self.halves, self.joined
        while True:
            across = joined.get(a << 20 | b)
            if across is not None and across < until:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a = ra, halves[a][1]
            else:
                until, b = rb + 1, halves[b][0]

    def apart(self, a: int, b: int) -> bool:
        """Whether token a directly before token b can stand in an encoding."""
        key = a << 20 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[key] = self._stay(a, b, float("inf"))
        return found


_TABLES: dict[str, BpeTable] = {}


def table(path: str) -> BpeTable:
    """The vocabulary at path, built once in each Python worker."""
    if path not in _TABLES:
        _TABLES[path] = BpeTable(path)
    return _TABLES[path]
