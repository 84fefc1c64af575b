"""Operator 3: token counts by a compiled finite-state transducer.

The vocabulary is compiled, state by state as texts need them, into a deterministic transducer
over bytes. A state holds the tokens that may still grow at this point of a word, each with the
last token in front of it; a transition carries how many tokens the encoding of the prefix gains
(the number may be negative when tokens merge). A long text is cut into chunks. Each chunk is a
map from the state in front of it to the state behind it and the tokens gained; maps compose,
and the scan over them from the left holds one state and one count, whatever the length. A text
that is cut nowhere by white space is carried on in its state.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm.bpe import END, BpeTable, table
from plumbline.llm.textio import batch, small_batches, strings

#: The pre-token pattern of the vocabulary with word ends.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: What goes on with an open pre-token of either kind.
GOES_ON = {"letters": regex.compile(r"\p{L}*"), "others": regex.compile(r"[^\s\p{L}\p{N}]*")}
CLOSED = regex.compile(r"'(?:s|t|re|ve|m|ll|d)|\p{N}")
LETTER = regex.compile(r"\p{L}")
#: What str.split takes for white space and the pattern does not.
NO_SPACE = re.compile("[\x1c-\x1f]")
#: Characters of a chunk; words and pre-tokens kept with their counts in each of two generations, characters of the longest; transitions kept.
CHUNK, KEPT, KEPT_CHARACTERS, KEPT_STEPS = 1 << 16, 500_000, 48, 600_000

#: A state between chunks: the kind of the open pre-token, if one is, and what is live in it.
State = tuple[str, tuple]
ROOT = ((0, -1, 0),)
START: State = ("", ())


def _composes(c: str) -> bool:
    """Whether a character may join with those in front of it under NFC (True also where that is not sure)."""
    o = ord(c)
    return not (o < 0x300 or 0x3400 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or 0x3041 <= o <= 0x3096 or 0x30A1 <= o <= 0x30FA or 0x400 <= o < 0x483 or 0x20000 <= o <= 0x2FFFF)


class ChunkMap:
    """The map of one chunk, computed for the states that ask."""

    def __init__(self, transducer: TokenTransducer, text: str):
        self.transducer, self.text = transducer, text

    def __call__(self, state: State) -> tuple[State, int]:
        return self.transducer.after(state, self.text)


class TokenTransducer:
    """Counts tokens under one vocabulary."""

    def __init__(self, vocabulary: BpeTable):
        self.apart = vocabulary.apart
        self.suffix = END if vocabulary.suffix else ""
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.next: dict[int, int] = {}
        self.token, self.open = [-1], [False]
        for text, i in vocabulary.ids.items():
            node = 0
            for c in text:
                key = node << 9 | ord(c)
                child = self.next.get(key)
                if child is None:
                    child = self.next[key] = len(self.token)
                    self.token.append(-1)
                    self.open.append(False)
                    self.open[node] = True
                node = child
            self.token[node] = i
        self._reset()
        self.longest = max(map(len, vocabulary.special), default=0)
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.new_pre: dict[str, int] = {}
        self.old_pre: dict[str, int] = {}

    def _reset(self) -> None:
        #: states: the live (trie node, token in front or -1, tokens up to there less tokens so far)
        self.states: list[tuple] = [ROOT]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def _compile(self, state: int, c: int) -> tuple[int, int]:
        """The transition of a state under a byte: the next state and the tokens gained."""
        live, gained, ended = [], 0, -1
        for node, front, before in self.states[state]:
            child = self.next.get(node << 9 | c)
            if child is None:
                continue
            t = self.token[child]
            if t >= 0 and ended < 0 and (front < 0 or self.apart(front, t)):
                ended, gained = t, before + 1
            if self.open[child]:
                live.append((child, front, before))
        after = tuple((node, front, before - gained) for node, front, before in live) if gained else tuple(live)
        if ended >= 0:
            after += ((0, ended, 0),)
        found = self.number.get(after)
        if found is None:
            found = self.number[after] = len(self.states)
            self.states.append(after)
        return found, gained

    def _run(self, live: tuple, text: str) -> tuple[tuple, int]:
        """What is live behind text, and the tokens gained, in blocks between which states may be dropped."""
        total = 0
        for i in range(0, len(text), CHUNK):
            if len(self.steps) > KEPT_STEPS:
                self._reset()
            state = self.number.get(live)
            if state is None:
                state = self.number[live] = len(self.states)
                self.states.append(live)
            steps = self.steps
            for c in text[i : i + CHUNK].encode():
                step = steps.get(state << 9 | c)
                if step is None:
                    step = steps[state << 9 | c] = self._compile(state, c)
                state = step[0]
                total += step[1]
            live = self.states[state]
        return live, total

    def _close(self, state: State) -> int:
        """Tokens gained when the open pre-token ends."""
        if not state[0] or not self.suffix:
            return 0
        if (at := self.number.get(state[1])) is None:
            at = self.number[state[1]] = len(self.states)
            self.states.append(state[1])
        return self._compile(at, ord(self.suffix))[1]

    def pre_token(self, piece: str) -> int:
        if len(piece) > CHUNK:
            live, total = self._run(ROOT, piece)
            return total + self._close(("letters", live))
        if len(self.steps) > KEPT_STEPS:
            self._reset()
        state, total, steps = 0, 0, self.steps
        for c in piece.encode():
            key = state << 9 | c
            step = steps.get(key)
            if step is None:
                step = steps[key] = self._compile(state, c)
            state = step[0]
            total += step[1]
        if self.suffix:
            key = state << 9 | 256
            step = steps.get(key)
            if step is None:
                step = steps[key] = self._compile(state, 256)
            total += step[1]
        return total

    def known(self, piece: str) -> int:
        """Tokens of a pre-token, from the table if it was seen before."""
        found = self.new_pre.get(piece)
        if found is None:
            found = self.old_pre.get(piece) or self.pre_token(piece)
            if len(piece) <= KEPT_CHARACTERS:
                if len(self.new_pre) >= KEPT:
                    self.old_pre, self.new_pre = self.new_pre, {}
                self.new_pre[piece] = found
        return found

    def normal(self, run: str) -> str:
        if run.isascii():
            return run.lower()
        run = unicodedata.normalize("NFC", run)
        return "".join([c.lower() for c in run]) if "Σ" in run else run.lower()

    def word(self, word: str) -> int:
        """Tokens of a run of text without white space."""
        found = self.old.get(word)
        if found is None:
            runs, found = [word], 0
            if self.special is not None and "<|" in word:
                runs = self.special.split(word)
                found = len(runs) - 1
            for run in runs:
                found += sum(map(self.known, PRE_TOKEN.findall(self.normal(run))))
        if len(word) <= KEPT_CHARACTERS:
            if len(self.new) >= KEPT:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found

    def words(self, text: str) -> int:
        get, word = self.new.get, self.word
        words = text.split() if not NO_SPACE.search(text) else regex.split(r"\s+", text)
        return sum([get(w) or word(w) for w in words])

    def after(self, state: State, text: str) -> tuple[State, int]:
        """The state behind a chunk, and the tokens gained, from the state in front of it."""
        total = 0
        for k, run in enumerate(self.special.split(text) if self.special is not None else [text]):
            if k:
                total += self._close(state) + 1
                state = START
            run, at = self.normal(run), 0
            if state[0] and run:
                at = GOES_ON[state[0]].match(run).end()
                live, gained = self._run(state[1], run[:at])
                state, total = (state[0], live), total + gained
                if at == len(run):
                    continue
                total += self._close(state)
                state = START
            for m in PRE_TOKEN.finditer(run, at):
                if m.end() < len(run) or CLOSED.fullmatch(m[0]):
                    total += self.known(m[0])
                else:
                    live, gained = self._run(ROOT, m[0])
                    state, total = ("letters" if LETTER.match(m[0]) else "others", live), total + gained
        return state, total

    def _safe(self, text: str, p: int) -> bool:
        """Whether nothing that has to be seen whole stands across p: a contraction, a special token, characters that NFC joins."""
        if _composes(text[p]) or ("'" in text[p - 3 : p] and text[p - 2 : p] != "''"):
            return False
        begin = max(0, p - self.longest)
        return self.special is None or not any(m.start() < p - begin < m.end() for m in self.special.finditer(text[begin : p + self.longest]))

    def chunks(self, text: str, size: int = CHUNK) -> Iterator[tuple[str, bool]]:
        """Chunks of about `size` characters, and whether white space ends them."""
        at = 0
        while len(text) - at > size:
            p = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size)) + 1
            if space := p > at:
                yield text[at:p], True
            else:
                p = next((q for q in range(at + size, max(at + size // 2, at + size - 4096), -1) if self._safe(text, q)), 0) or next((q for q in range(at + size, len(text)) if self._safe(text, q)), len(text))
                yield text[at:p], space
            at = p
        if at < len(text):
            yield text[at:], True

    def count(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.words(text)
        state, total = START, 0
        for chunk, space in self.chunks(text):
            if space and state is START:
                total += self.words(chunk)
            else:
                state, gained = ChunkMap(self, chunk)(state)
                state, total = state if state[0] else START, total + gained
        return total + self._close(state)


_COUNTERS: dict[str, TokenTransducer] = {}


def transducer(path: str) -> TokenTransducer:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenTransducer(table(path))
    return _COUNTERS[path]


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    count = transducer(path).count
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            texts = strings(part.column(1))
            tokens = [count(t) for t in texts]
            yield batch(schema, part.column(0), [len(t) if t.isascii() else len(t.encode()) for t in texts], tokens, [n > limit for n in tokens])


def token_counts(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Rows may repeat; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = pa.schema({key: to_arrow_type(kind), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_()})
    return docs.select(key, text).mapInArrow(partial(_count, path=path, limit=limit, schema=schema), f"`{key}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
