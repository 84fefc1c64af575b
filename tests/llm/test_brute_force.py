"""Operators against plain versions of themselves and against the libraries, on sf0.001 and made-up rows."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import components, language, lines, queries, scoring, shingles, suffixes, vectors
from plumbline.llm.bpe import table
from plumbline.llm.counting import START, ChunkMap, TokenTransducer
from plumbline.llm.encoding import PrefixEncoder

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def fuzz(n, alphabet="abcdefghij THE's 're n't \n\t  \r\x0b\x0c\x1c\x85\xa0 ​ éÉßΣσİ한글日本🙂ȩ́ 123४ !?.,<|endoftext|>-- 'll"):
    r = random.Random(5)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["<|endoftext|>", "a<|startoftext|>b c", "  x  ", "İΣΑΣ ΑΣ.", "a" * 3000, "ab \n" * 40_000, "x\0y z", "a\nb\n\nc \n d", "\n", " \n", "dont'" * 2000, "日本語の本" * 3000]


def test_counts_as_the_library(texts):
    path = queries.vocabulary("word_bpe_49k.json")
    mine, theirs = TokenTransducer(table(path)), Tokenizer.from_file(path)
    every = fuzz(3000) + [r["text"] for r in texts.values()]
    assert [mine.count(t) for t in every] == [len(e.ids) for e in theirs.encode_batch(every, add_special_tokens=False)]


def test_chunk_maps_compose():
    path = queries.vocabulary("word_bpe_49k.json")
    mine, theirs = TokenTransducer(table(path)), Tokenizer.from_file(path)
    joined = "".join(fuzz(300)[:300])
    for text in (joined, joined.replace(" ", ""), "".join(joined.split()).replace("|", ""), "'" * 300 + "s're", "日本" * 300, "a" * 700 + "1'll"):
        for step in (1, 7, 64):
            state, total = START, 0
            for chunk, _ in mine.chunks(text, step):
                state, gained = ChunkMap(mine, chunk)(state)
                total += gained
            assert total + mine._close(state) == len(theirs.encode(text, add_special_tokens=False).ids)


def test_long_texts_without_white_space():
    """Counts as the library, in memory that does not grow beyond some copies of the text."""
    path = queries.vocabulary("word_bpe_49k.json")
    mine, theirs = TokenTransducer(table(path)), Tokenizer.from_file(path)
    r = random.Random(7)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDabcd0123+/=", "日本語の文章を書く。", "=-'", "aé\u0301ß"):
        text = "".join(r.choices(alphabet, k=200_000))
        assert mine.count(text) == len(theirs.encode(text, add_special_tokens=False).ids)
    text = "abcd" * 500_000
    tracemalloc.start()
    mine.count(text)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_ids_as_the_library(texts):
    path = queries.vocabulary("byte_bpe_50k.json")
    mine, theirs = PrefixEncoder(table(path)), Tokenizer.from_file(path)
    every = fuzz(3000) + [r["text"] for r in texts.values()]
    ids = [e.ids for e in theirs.encode_batch(every, add_special_tokens=False)]
    found = [mine.encode(t) for t in every]
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == ids
    assert [mine.decode(f).decode() for f in found] == theirs.decode_batch(ids, skip_special_tokens=False)


def test_mix_targets(spark, texts):
    found = queries.op1_source_mix(spark, DATA).collect()
    size, weight = collections.Counter(), {}
    for r in texts.values():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    for i, s in enumerate(sorted(size, key=lambda s: (s is None, s))):
        weight[s] = (5, 2, 1)[i % 3]
    left, target, open_ = 1.5 * sum(size.values()), {}, set(size)
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    taken = collections.Counter()
    for r in found:
        s = texts[r["doc_id"]]["source"]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    largest = max(r["size"] for r in found)
    assert all(abs(taken[s] - target[s]) <= largest for s in size)


def test_quality_base(spark, texts):
    for r in queries.op5_quality_rules(spark, DATA).collect():
        t = texts[r["doc_id"]]["text"] or ""
        w = WORD.findall(t)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in (i, i + 1, i + 2)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(again))
        assert base == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_keeps_good_documents(spark, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = [(labels[r["doc_id"]], r["kept"]) for r in queries.op5_quality_rules(spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = [k for q, k in found if q == 1], [k for q, k in found if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_languages_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = [r for r in queries.op6_language_id(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in found)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in found) >= 0.95 * len(found)


def test_language_model(spark, texts):
    count = collections.Counter()
    for i, r in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update((r["text"] or "").encode().lower().split() + [0])
    n, v = sum(count.values()), len(count)
    bits = size = 0
    for r in queries.op7_language_model_scores(spark, DATA).collect():
        raw = (texts[r["doc_id"]]["text"] or "").encode()
        w = raw.lower().split() + [0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        if r["held_out"]:
            bits, size = bits - r["score"] / math.log10(2), size + len(raw)
    assert bits / size < 3.2


def test_languages_against_plain(spark, docs):
    """Predictions are those of whole texts compressed block by block with each dictionary."""
    import zstandard

    learned = docs.where("crc32(cast(doc_id AS string)) % 3 <> 1 AND text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    dictionaries = language.fit(learned, "text", "lang", "doc_id")
    each = {k: zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for k, v in sorted(dictionaries.items())}
    found = {r["doc_id"]: r for r in queries.op6_language_id(spark, DATA).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").lower().encode()
        size = {k: sum(len(c.compress(raw[i : i + language.BLOCK])) for i in range(0, len(raw), language.BLOCK)) for k, c in each.items()}
        want = min(size, key=size.get) if any(c.isalpha() for c in r["text"] or "") else "und"
        assert found[r["doc_id"]]["lang_pred"] == want
        first, second = sorted(size.values())[:2] if size and raw else (1, 1)
        if want != "und":
            assert found[r["doc_id"]]["narrow"] == (1 - first / second < language.MARGIN)


def plain_score(table, text):
    """log2 probability of one text, decision by decision, in plain loops over symbols and blocks."""
    p = np.clip(table, 1e-4, 1 - 1e-4)
    stretched = np.clip(np.log(p / (1 - p)), -8, 8)
    seq = [*text, scoring.END]
    before, rows = scoring.contexts(np.array(seq, np.int32), np.array([0, len(seq)]))
    rows = [list(map(int, r)) for r in zip(*rows)]
    last = len(scoring.BITS)

    def block(i):
        n = 0
        for size, low, high in scoring.BLOCKS:
            n += min(max(i, low), high) // size - low // size
        return n

    class State:
        def __init__(self):
            self.w = {g: [scoring.WEIGHT] * last + [0.0] for g in (0, 1)}
            self.hits = [scoring.BEGIN / (1 + math.exp(-(k - scoring.STEPS // 2) / 2)) for k in range(scoring.STEPS)]
            self.seen = [scoring.BEGIN] * scoring.STEPS

    total, states, held, now = 0.0, [State(), State()], [[], []], None

    def adapt(state, decisions):
        if decisions:
            rate = 1 / (1 / scoring.RATE + len(decisions) / scoring.STEP)
            for x, gate, error, bucket, bit in decisions:
                for k in range(last + 1):
                    state.w[gate][k] += rate * error * (x[k] if k < last else 1)
                state.seen[bucket] += 1
                state.hits[bucket] += bit

    for i, s in enumerate(seq):
        if block(i) != now:
            for state, decisions in zip(states, held):
                adapt(state, decisions)
            held, now = [[], []], block(i)
        three = table[rows[i][1]].copy()
        first = int(three.argmax())
        three[first] = -1
        second = int(three.argmax())
        gate = int(before[i] in (0x20, *range(9, 14)))
        for d, guess in enumerate((first, second)):
            x = [float(stretched[r, guess]) for r in rows[i]]
            dot = min(8.0, max(-8.0, sum(a * b for a, b in zip(states[d].w[gate], [*x, 1]))))
            q = 1 / (1 + math.exp(-dot))
            bucket = scoring.STEPS // 2 + round(2 * dot)
            mixed = (q + states[d].hits[bucket] / states[d].seen[bucket]) / 2
            hit = s == guess
            total += math.log2(mixed if hit else 1 - mixed)
            held[d].append((x, gate, hit - q, bucket, hit))
            if hit:
                break
        else:
            total += math.log2(sum(w * table[r, s] / (1 - table[r, first] - table[r, second]) for w, r in zip(scoring.REST, rows[i])))
    return total


def test_mixing_against_plain(texts):
    some = [(texts[i]["text"] or "").encode().lower() for i in sorted(texts)]
    counts = np.zeros((scoring.ROWS, scoring.SYMBOLS))
    for t in some[::2]:
        seq, at = scoring.symbols(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        for r in scoring.contexts(seq, at)[1]:
            np.add.at(counts, (r, seq), 1)
    table = scoring.shares(counts, counts[:256].sum(0))
    picked = [t for t in some[1::2] if len(t) < 6000][:12] + [b"", b"a", b"\xff\x00 x"]
    data, offsets = np.frombuffer(b"".join(picked), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in picked])])
    found = scoring.Mixer(table).scores(data, offsets)
    for t, f in zip(picked, found):
        assert f == pytest.approx(plain_score(table, t), rel=2e-3, abs=1e-3)


def test_mixing_is_a_distribution_and_adapts():
    """The probabilities of all texts of one byte and the empty one sum to 1 behind any beginning; slices change nothing; what repeats gets cheaper."""
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 40, (scoring.ROWS, scoring.SYMBOLS)) * (rng.random((scoring.ROWS, scoring.SYMBOLS)) < 0.2)
    mixer = scoring.Mixer(scoring.shares(counts, counts.sum(0)))
    for begin in (b"", b"the cat sat on "):
        state = mixer.fresh(257)
        texts = [begin + bytes([c]) for c in range(256)] + [begin]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        seq, at = scoring.symbols(data, offsets)
        # the probability of the symbol behind `begin`, without the end symbols that follow a byte
        keep = np.ones(len(seq), dtype=bool)
        keep[at[1:-1] - 1] = False
        mixer.read(seq[keep], np.arange(258) * (len(begin) + 1), state)
        front = 0.0
        if begin:
            alone = mixer.fresh(1)
            mixer.read(np.frombuffer(begin, np.uint8).astype(np.int32), np.array([0, len(begin)]), alone)
            front = alone[2][0]
        assert np.exp2(state[2] - front).sum() == pytest.approx(1, abs=2e-3)
    text = np.frombuffer(b"abc abd xyz " * 100, np.uint8)
    costs = [-mixer.scores(text[:n], np.array([0, n]))[0] for n in (300, 600, 1200)]
    assert costs[1] < 2 * costs[0] and costs[2] < 2 * costs[1]
    long = np.frombuffer(bytes(rng.choice(list(b"abcdefgh ij"), 40_000).tolist()), np.uint8)
    whole, piece = mixer.scores(long, np.array([0, len(long)]))[0], scoring.PIECE
    try:
        scoring.PIECE = 8192
        assert mixer.scores(long, np.array([0, len(long)]))[0] == pytest.approx(whole, rel=1e-2)
    finally:
        scoring.PIECE = piece


def test_mixing_adapts_behind_every_symbol():
    """A second 'a' behind a first is dearer or cheaper by what the first taught, within the first 128 bytes; short slices carry the state on."""
    counts = np.ones((scoring.ROWS, scoring.SYMBOLS)) * (np.arange(scoring.SYMBOLS) < 40)
    mixer = scoring.Mixer(scoring.shares(counts, counts.sum(0)))
    text = bytes([7] * 100)
    state, costs = mixer.fresh(1), []
    for i in range(1, 4):  # prefixes of one symbol more each
        state = mixer.fresh(1)
        mixer.read(np.frombuffer(text[: 20 * i], np.uint8).astype(np.int32), np.array([0, 20 * i]), state)
        costs.append(state[2][0])
    assert costs[1] - costs[0] != pytest.approx(costs[2] - costs[1], rel=1e-6)
    assert all(size == 1 for size, _, _ in scoring.BLOCKS)
    table = scoring.shares(counts, counts.sum(0))
    data = bytes([0, 1, 0, 0, 1, 2, 0] * 15)
    assert mixer.scores(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0] == pytest.approx(plain_score(table, data), rel=1e-4)


def test_texts_of_many_batches_are_scored_in_step(monkeypatch):
    """One pass over the texts of all batches, not one for each: the longest text sets the number of steps. Each text scores as it does alone."""
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 40, (scoring.ROWS, scoring.SYMBOLS)) * (rng.random((scoring.ROWS, scoring.SYMBOLS)) < 0.2)
    mixer = scoring.Mixer(scoring.shares(counts, counts.sum(0)))
    texts = [bytes(rng.choice(list(b"abcdefgh ij"), int(n)).tolist()) for n in rng.integers(0, 900, 60)] + [b"", b"x" * 700, b"ab " * 300]
    alone = [mixer.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] * np.log10(2) for t in texts]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 9)), pa.array([t.decode() for t in texts[i : i + 9]])], names=["k", "text"]) for i in range(0, 63, 9)]
    out = pa.schema({"k": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "in_head": pa.int64(), "head_sum": pa.float64(), "tail": pa.list_(pa.int64()), "tail_n": pa.list_(pa.int64()), "score": pa.float64()})
    passes, read = [], scoring.Mixer.read
    monkeypatch.setattr(scoring.Mixer, "read", lambda self, seq, at, *rest: (passes.append(len(at) - 1), read(self, seq, at, *rest))[1])
    got = pa.Table.from_batches(scoring._scored(iter(batches), mixer, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), out), out).to_pylist()
    assert passes == [63]
    assert [(r["k"], r["n_bytes"]) for r in got] == [(i, len(t)) for i, t in enumerate(texts)]
    assert [r["score"] for r in got] == pytest.approx(alone, rel=1e-9)


def test_jaccard_against_all_pairs(spark, docs, texts):
    sets = {}
    for i, r in texts.items():
        w = (r["text"] or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    links = {i: [j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    label = {i: i for i in sets}
    for _ in sets:
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in sets}
    for r in shingles.jaccard_classes(docs).collect():
        assert (r["n_links"], r["class_id"]) == (len(links[r["doc_id"]]), label[r["doc_id"]])


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK_ROWS", 8)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[:50] + [f"x{i}"] + words[51:])) for i in range(60)]
    found = shingles.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_links"] == 59 and r["class_id"] == 0 for r in found)  # 91 of 101 n-grams are shared


def test_bands_reach_the_recall():
    bands, rows = shingles.bands_and_rows(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[300:420] = x[:120] + 0.05 * rng.normal(size=(120, 16))
    x[500:560] = x[499] + 0.02 * rng.normal(size=(60, 16))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(600)
    for _ in range(600):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(600)])
    for r in vectors.near_vectors(d, cell_rows=40, block=16, visitors=24).collect():
        assert (r["n_links"], r["component_id"]) == (near[r["vec_id"]].sum(), label[r["vec_id"]])


FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_lines(rows):
    """(id, text) in order: the texts without repeated lines and sentences, and the number of removed spans."""
    def long(x):
        return len(WORD.findall(x)) >= 5 or len(x.strip(" \t\n\x0b\x0c\r")) >= 64

    seen, want = set(), []
    for i, text in rows:
        kept, n, met = [], 0, set()
        for line in (text or "").split("\n"):
            parts = [p for p in re.sub(r"([.!?])([\x20\x09-\x0D]+)", "\\1\\2\0", line).split("\0") if p]
            key = tuple(WORD.findall(line.translate(FOLD)))
            gone = long(line) and key in seen
            if long(line):
                seen.add(key)
            left, cut = [], 0
            several = sum(bool(WORD.search(p)) for p in parts) > 1
            for p in parts:
                own = tuple(WORD.findall(p.translate(FOLD)))
                if several and long(p) and own in seen:
                    cut += 1
                else:
                    left.append(p)
                if several and long(p):
                    seen.add(own)
            left = "".join(left)
            if gone or (cut and not WORD.search(left)):
                n += 1
            else:
                kept.append(left)
                n += cut
        want.append((i, None if text is None else "\n".join(kept), n))
    return want


def test_lines_against_plain(spark, texts):
    want = plain_lines((i, texts[i]["text"]) for i in sorted(texts))
    found = queries.op9_line_dedup(spark, DATA).collect()
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in found) == want
    for r in found:
        spans = [tuple(map(int, s.split("-"))) for s in r["removed_spans"].split(",") if s]
        assert len(spans) == r["n_removed"] and spans == sorted(spans)
        taken = sum(e - s for s, e in spans)
        assert len(texts[r["doc_id"]]["text"]) - taken - len(r["text"]) in range(len(spans) + 1)  # borders go with lines


def test_rows_of_one_id_and_without_an_id(spark):
    a, b, c = "one two three four five six seven eight nine ten. eleven", "a b c d e f g h i j k l m n o p q r s t u v w x y z a b c d e", "k k k k k k l l l l l l m m m m m m"
    rows = [(1, a), (5, a), (5, b), (None, a), (None, b), (None, c), (None, c + "\n" + b), (7, b), (7, b), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__places", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("mark", F.lit(2)).withColumn("row", F.lit(3)).repartition(3)
    for unit in ("line", "paragraph", "sentence"):
        found = lines.line_dedup(d, unit=unit)
        assert found.columns == [*d.columns, "n_units", "n_removed", "removed_spans"]
        left = sorted((r["doc_id"] or 99, r["text"] or "") for r in found.collect())
        every = " ".join(t for _, t in left)
        assert all(x in every for x in (a, b, c)) and left.count((5, b)) == 1 and left.count((5, "")) == 1  # b stands first in a row of 5
        assert [t for i, t in left if i == 7] == ["", ""] and (1, a) in left
    removed = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffixes.substring_dedup(d).collect()}
    assert removed[1, len(a)] == 0 and removed[5, len(a)] == len(a) and removed[5, len(b)] == 0  # not in a smaller id
    assert removed[7, len(b)] == len(b) and removed[None, len(b)] == len(b) and removed[None, len(a)] == len(a) and removed[None, len(c)] == 0
    assert removed[None, len(c) + 1 + len(b)] == len(b)


def brute_suffixes(rows, length=50):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen.get(b[s : s + length], i) < i:
                gone[s : s + length] = b"\1" * length
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], i)
        out[i] = (len(b), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_suffixes_against_plain(spark, docs, texts):
    r = random.Random(3)
    base = ["".join(r.choice("abcd ") for _ in range(400)) for _ in range(6)]
    rows = [(i, "".join(r.choice(base)[(a := r.randint(0, 300)) : a + r.randint(20, 120)] for _ in range(r.randint(0, 6)))) for i in range(200)]
    rows += [(1000, None), (1001, "a" * 500), (1002, "a" * 49), (1003, "a" * 120), (1005, "ab" * 400), (1006, "xab" + "ab" * 300 + "é\n" * 80), (1007, "\0" * 200), (1008, "\0" * 60 + "z")]
    for table_, every in ((spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows), (docs, [(i, t["text"]) for i, t in texts.items()])):
        found = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffixes.substring_dedup(table_).collect()}
        assert found == brute_suffixes(every)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(200, 300), (300, 250), (7, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {200: 200, 250: 200, 300: 200}
