"""Operator 6: language identification by compression.

For every language a zstandard raw-content dictionary is made of a bounded sample of labelled
texts. A text is cut into blocks, all of which are compressed with each dictionary; the language
whose dictionary gives the smallest total is chosen. A narrow margin is a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.textio import batch, small_batches, strings

LETTER = regex.compile(r"\p{L}")
#: Bounds of the fit: sampled texts a language, characters of each, bytes of a dictionary and of all (beyond, each is smaller).
MAX_TEXTS, EXCERPT, DICTIONARY, ALL_DICTIONARIES = 200, 1000, 98_304, 1 << 27
#: Languages whose compressors are held at once.
GROUP = 64
#: Bytes of a block of text, and zstandard's level; the share of the second smallest size by which the smallest must be smaller.
BLOCK, MARGIN, LEVEL = 4096, 0.02, 5
UNDECIDED = "und"


def fit(labelled: DataFrame, text: str, lang: str, key: str) -> dict[str, bytes]:
    """Dictionaries by language, of DICTIONARY bytes at most, from at most MAX_TEXTS texts of each. Every language has one.

    The texts are those whose ids have the least digests, so every part of the corpus is as
    likely to be in the sample. Case is folded, here and in prediction. Only rows under a digest that about 1.5 times MAX_TEXTS rows of
    their language have are shuffled.
    """
    counts = labelled.groupBy(lang).count().collect()  # a row for each language
    size = min(DICTIONARY, ALL_DICTIONARIES // max(len(counts), 1))
    share = labelled.sparkSession.createDataFrame([(r[lang], min(1.0, 1.5 * MAX_TEXTS / r["count"])) for r in counts], "_lang string, _share double")
    drawn = labelled.withColumn("_u", (F.xxhash64(F.col(key).cast("string"), F.lit(3)).cast("double") / F.lit(float(1 << 63)) + 1) / 2)
    drawn = drawn.join(F.broadcast(share), F.col(lang) == F.col("_lang")).where("_u < _share")
    # Many short excerpts, from places that a digest chooses, cover a language better than a few whole texts.
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(5)), F.greatest(F.length(text) - EXCERPT + 1, F.lit(1))).cast("int") + 1
    number = F.row_number().over(Window.partitionBy("_lang").orderBy("_u", text))
    drawn = drawn.select("_lang", "_u", F.substring(F.col(text), place, F.lit(EXCERPT)).alias("_text"), number.alias("_n")).where(F.col("_n") <= MAX_TEXTS)
    found: dict[str, bytes] = {}
    for row in drawn.orderBy("_lang", "_n").select("_lang", "_text").toLocalIterator():  # at most MAX_TEXTS rows a language
        have = found.get(row["_lang"], b"")
        if len(have) < size:
            found[row["_lang"]] = (row["_text"].lower().encode() + b"\n" + have)[-size:]
    return found


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs, self.dictionaries = sorted(dictionaries), dictionaries
        self.groups = [self.langs[i : i + GROUP] for i in range(0, len(self.langs), GROUP)]
        self.only = self.made(self.langs) if len(self.groups) == 1 else None

    def made(self, langs: list[str]) -> list[zstandard.ZstdCompressor]:
        each = []
        for lang in langs:
            raw = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False))
        return each

    def sizes(self, texts: list[bytes]) -> list[list[int]]:
        """For each text its compressed size by language, in passes over groups of languages."""
        found: list[list[int]] = [[] for _ in texts]
        for group in self.groups:
            each = self.only or self.made(group)
            for text, have in zip(texts, found):
                blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
                have += [sum([len(c.compress(b)) for b in blocks]) for c in each]
        return found

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Language, score and whether the margin is narrow. score: from 0 (the second language fits as well) to 1."""
        asked = [i for i, t in enumerate(texts) if t and self.langs and LETTER.search(t)]
        found = [(UNDECIDED, 0.0, True)] * len(texts)
        for i, sizes in zip(asked, self.sizes([texts[i].lower().encode() for i in asked])):
            found[i] = self.chosen(sizes)
        return found

    def chosen(self, sizes: list[int]) -> tuple[str, float, bool]:
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return self.langs[0], 1.0, False
        margin = 1 - sizes[order[0]] / sizes[order[1]]
        return self.langs[order[0]], min(1.0, margin / (margin + MARGIN)) if margin > 0 else 0.0, margin < MARGIN


def languages(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: key, lang_pred, score, narrow.

    Learns from the rows of `training` with a text and a language. lang_pred is the language of
    the smallest compressed size (of equal ones the first by name), `und` for a null text or one
    without a letter, and for all if there is nothing to learn from. narrow: the margin is under
    MARGIN; a caller that rather has no language than a doubtful one rejects these rows. Whole
    texts are compressed, however long, in blocks. Repeated rows are predicted alike.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    learned = training.select(F.col(key).alias("_key"), F.col(text).alias("_text_in"), F.col(lang).alias("_lang_in")).where("_text_in IS NOT NULL AND _lang_in IS NOT NULL AND length(_text_in) > 0")
    dictionaries = fit(learned, "_text_in", "_lang_in", "_key")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most ALL_DICTIONARIES bytes
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = pa.schema({key: to_arrow_type(kind), "lang_pred": pa.string(), "score": pa.float64(), "narrow": pa.bool_()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                found = model.predict(strings(part.column(1)))
                yield batch(schema, part.column(0), *([f[k] for f in found] for k in range(3)))

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, lang_pred string, score double, narrow boolean")
