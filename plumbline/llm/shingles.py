"""Operator 8: n-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Every document gets the set of its 64-bit hashes of five consecutive words, a digest of the set
   and band hashes of its MinHash signature. Bands and rows follow from the wanted recall.
2. Documents of equal sets form classes at once; their smallest id stands for them from here on.
3. Representatives are shuffled on band hashes. Buckets tie them into candidate groups.
4. The full sets of candidates travel once to their group and pairs that share a band are
   verified there. A group too large for one task is compared bucket by bucket, in blocks.
5. Verified links give the classes (connected components) and the number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import sieve
from plumbline.llm.blocks import compared, in_blocks, link_rows, resolved
from plumbline.llm.components import components
from plumbline.llm.lines import LAST
from plumbline.llm.store import cut
from plumbline.llm.textio import buffers, lean, mix, pieces, small_batches, span_hashes, word_spans

#: Members and n-grams that one block may hold.
BLOCK_ROWS, BLOCK_GRAMS = 2048, 2_000_000


def bands_and_rows(threshold: float, recall: float, hashes: int = 96) -> tuple[int, int]:
    """The most rows a band (so the fewest false candidates) with which pairs at the threshold share one of the bands with probability `recall`."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold**rows < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def gram_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, and offsets into them. A text of fewer words has one n-gram, of all its words; one of none has none."""
    starts, ends, rows = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    n = len(offsets) - 1
    per = np.bincount(rows, minlength=n)
    if len(h) >= words:
        total = np.zeros(len(h) - words + 1, dtype=np.uint64)
        for j in range(words):
            total += mix(h[j : len(h) - words + 1 + j] + np.uint64(j + 1))
            total *= np.uint64(0x9E3779B97F4A7C15)
        whole = rows[: len(total)] == rows[words - 1 :]
        grams, owner = mix(total[whole]), rows[: len(total)][whole]
    else:
        grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((per > 0) & (per < words))
    if len(short):
        first = np.concatenate([[0], np.cumsum(per)])
        extra = np.empty(len(short), dtype=np.uint64)
        for k, r in enumerate(short.tolist()):
            v = np.full(1, per[r], dtype=np.uint64)
            for x in range(first[r], first[r + 1]):
                v = mix(v * np.uint64(31) + h[x : x + 1])
            extra[k] = v[0]
        grams, owner = np.concatenate([grams, extra]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(n + 1))


def _per_set(function, values: np.ndarray, at: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(at) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = function.reduceat(values, at[full])
    return out


def _signatures(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    c = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    for b in batches:
        data, offsets = buffers(b.column(1))
        spot = mix(b.column(0).to_numpy().astype(np.int64).view(np.uint64)).view(np.int64)
        marks = b.column(2)
        for i, j in pieces(offsets):
            at = offsets[i : j + 1] - offsets[i]
            grams, of = gram_sets(data[offsets[i] : offsets[j]], at, words)
            one = _per_set(np.add, mix(grams + np.uint64(0x1234567)), of, 0)
            two = _per_set(np.add, mix(grams ^ np.uint64(0xABCDEF0123)), of, 0)
            keys = np.empty((j - i, bands), dtype=np.uint64)
            for band in range(bands):
                key = np.full(j - i, band + 1, dtype=np.uint64)
                for k in range(band * rows, band * rows + rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ _per_set(np.minimum, grams * a[k] + c[k], of, 0))
                keys[:, band] = key
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), bands).cast(out[4].type)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(of).astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, pa.array(spot[i:j]), marks.slice(i, j - i)], schema=out)


def _sets(batches: Iterator[pa.RecordBatch], words: int, wanted: np.ndarray, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        b = b.filter(pa.array(sieve.passes(wanted, mix(ids.view(np.uint64)))))
        data, offsets = buffers(b.column(1))
        for i, j in pieces(offsets):
            grams, of = gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            one = _per_set(np.add, mix(grams + np.uint64(0x1234567)), of, 0)
            raw = grams.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(one.view(np.int64)), pa.array([raw[8 * s : 8 * e] for s, e in zip(of[:-1], of[1:])], type=pa.binary())], schema=out)


def _verified(group: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between the documents of a block pair: those that share a band (the bucket's own as the first, if it is one) and are similar."""
    ids, side = group.column("node").to_numpy(), group.column("side").to_numpy()
    weight = group.column("copies").to_numpy()
    band = group.column("band")[0].as_py()
    n = len(ids)
    keys = group.column("keys").chunk(0).flatten().to_numpy().reshape(n, -1)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("grams").to_pylist()]
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat = flat.ravel()
    flag = np.zeros(int(flat.max()) + 1 if len(flat) else 0, dtype=bool)
    within = group.column("bi")[0].as_py() == group.column("bj")[0].as_py()
    left = np.flatnonzero(side == 0)
    right = left if within else np.flatnonzero(side == 1)
    firsts, seconds = [], []
    for p, i in enumerate(left.tolist()):
        others = right[p + 1 :] if within else right
        if not len(others):
            continue
        same = keys[others] == keys[i]
        near = same.any(1) if band < 0 else same.any(1) & (same.argmax(1) == band)
        others = others[near]
        others = others[(np.minimum(size[others], size[i]) >= threshold * np.maximum(size[others], size[i]) - 1e-9)]
        if not len(others):
            continue
        mine = flat[at[i] : at[i + 1]]
        flag[mine] = True
        if len(others) * 8 > n:
            common = np.add.reduceat(flag[flat], at[:-1])[others]
        else:
            common = np.array([np.count_nonzero(flag[flat[at[o] : at[o + 1]]]) for o in others.tolist()])
        flag[mine] = False
        linked = others[common / (size[others] + size[i] - common) >= threshold]
        firsts.append(np.full(len(linked), i))
        seconds.append(linked)
    if firsts:
        yield link_rows(ids, np.concatenate(firsts), np.concatenate(seconds), weight)


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per row of docs: key, n_links, class_id, kept, mark.

    n_links: other documents whose set of n-grams of `words` words has a Jaccard similarity of
    `threshold` or more with this one's; class_id: the smallest key reachable by links; kept: it
    is this one's. Words are runs of characters that are not ASCII white space, as they stand.
    A text of fewer words has one n-gram; a null or empty text or one of white space links with
    nothing. Every row is judged by its own text, also where it repeats a key or has none; a class
    without a key has a null class_id, and all its rows are kept. mark: a digest of the text, which
    with the key names the row. Columns other than key and text are not read. Pairs at the
    threshold are found with probability `recall`, more similar ones with a greater one, equal sets always.
    """
    bands, rows = bands_and_rows(threshold, recall)
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    out = pa.schema({"doc_id": pa.int64(), "n": pa.int64(), "one": pa.int64(), "two": pa.int64(), "keys": pa.list_(pa.int64()), "spot": pa.int64(), "mark": pa.int64()})

    def sign(batches):
        return _signatures(batches, words, bands, rows, out)

    signed = cut(source.mapInArrow(lean(sign), "doc_id long, n long, one long, two long, keys array<long>, spot long, mark long"))
    # Documents of equal sets are one node from here on; the text of the one with the least key stands for them.
    classes = signed.where("n > 0").groupBy("n", "one", "two").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    first = signed.select("n", "one", "two", "doc_id", "keys", "spot").join(classes, ["n", "one", "two", "doc_id"]).dropDuplicates(["n", "one", "two"])
    leaders = cut(cut(first).withColumn("node", F.monotonically_increasing_id()))  # numbered from a written table

    in_bands = leaders.select("node", F.posexplode("keys").alias("band", "bucket"))
    shared = in_bands.groupBy("band", "bucket").agg(F.min("node").alias("lead"), F.count("*").alias("c")).where("c > 1")
    members = cut(in_bands.join(shared.drop("c"), ["band", "bucket"]))
    candidates = components(members.where("node <> lead"), "node", "lead")
    candidates = candidates.join(leaders, "node")
    groups = candidates.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("grams"))
    groups = groups.withColumn("large", (F.col("c") > BLOCK_ROWS) | (F.col("grams") > BLOCK_GRAMS)).select("component", "large")
    candidates = cut(candidates.join(groups, "component"))

    wanted = spark.sparkContext.broadcast(sieve.build(candidates, F.col("spot"), 23))
    sets_out = pa.schema({"doc_id": pa.int64(), "one": pa.int64(), "grams": pa.binary()})

    def ship(batches):
        return _sets(batches, words, wanted.value, sets_out)

    sets = source.select("doc_id", "text").mapInArrow(lean(ship), "doc_id long, one long, grams binary")
    whole = candidates.where("not large").select("node", "doc_id", "one", "copies", "keys", F.lit(-1).alias("band"), F.col("component").alias("bucket"), F.lit(1).alias("blocks"))
    large = candidates.where("large")
    dealt_large = members.join(large.select("node", "doc_id", "one", "n", "copies", "keys"), "node")
    sizes = dealt_large.groupBy("band", "bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    dealt_large = dealt_large.join(sizes, ["band", "bucket"]).select("node", "doc_id", "one", "copies", "keys", "band", "bucket", "blocks")
    to_verify = whole.unionByName(dealt_large).join(sets.dropDuplicates(["doc_id", "one"]), ["doc_id", "one"])
    dealt = in_blocks(to_verify, ["band", "bucket"], "node")

    def links(group):
        return _verified(group, threshold)

    found = cut(compared(dealt, ["band", "bucket"], links))
    linked = resolved(found, leaders.select("node", "n", "one", "two", "copies", F.col("doc_id").alias("least")), "node")
    named = linked.where("n_links > 0").groupBy("component_id").agg(F.min("least").alias("smallest"))
    linked = linked.join(named, "component_id", "left").select("n", "one", "two", (F.col("n_links") + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("smallest"))
    own = F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id"))
    found = signed.select("doc_id", "n", "one", "two", "mark").join(linked, ["n", "one", "two"], "left")
    given = [F.nullif(c, F.lit(LAST)) for c in (F.col("doc_id"), own)]
    return found.select(given[0].alias(key), F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), given[1].alias("class_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), "mark")
