"""Operator 5: quality rules by distribution divergence, in DataFrame functions only.

Histograms of character classes and of common words of a document are compared with those of its
language by the Jensen-Shannon distance. The references are the pooled counts of all documents of
a language that pass the base rules; a document without a language is compared with all languages
pooled. Documents under a minimum length are not judged by divergence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Disjoint classes of characters; what is in none of them and not white space is the last class.
CLASSES = {
    "vowel": "aeiou",
    "consonant": "b-df-hj-np-tv-z",
    "capital": "A-Z",
    "digit": "0-9",
    "stop": ".,;:!?'\"()-",
    "mark": "#*$%&|<>/+=@^_~`{}\\[\\]\\\\",
}
#: Common words of the languages, each with the letter that stands for it while counting.
COMMON = "the of and to in that is was for on le la les de des et un une que der die und den von zu das el los y".split()
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(COMMON)]
#: Words that a document must have for each histogram to count; the distance from which it is rejected.
CHARACTER_WORDS, COMMON_WORDS, MOST = 50, 100, 0.25


def _left(text: str, characters: str) -> Column:
    """Characters of the class in the text."""
    return F.coalesce(F.length(F.regexp_replace(text, f"[^{characters}]+", "")), F.lit(0)).cast("long")


def base_features(docs: DataFrame, text: str) -> DataFrame:
    """docs with the columns of the base rules and the counts of both histograms."""
    x = docs.withColumn("_w", F.coalesce(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>")))
    x = x.withColumn("n_words", F.size("_w").cast("long"))
    x = x.withColumn("word_chars", F.coalesce(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long"))
    x = x.withColumn("n_symbols", _left(text, "#*$%&|<>"))
    x = x.withColumn("_l", F.expr(rf"filter(split(`{text}`, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    x = x.withColumn("n_dup_lines", F.coalesce(F.size("_l") - F.size(F.array_distinct("_l")), F.lit(0)).cast("long")).drop("_l")
    # Windows of three words as hashes; the low 20 bits of the sorted numbers are the place, so equal windows stand side by side.
    x = x.withColumn("_h", F.expr("CASE WHEN n_words >= 3 THEN transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE cast(array() AS array<bigint>) END"))
    x = x.withColumn("_again", F.size("_h") > F.size(F.array_distinct("_h")))
    x = x.withColumn("_s", F.expr("""CASE WHEN NOT _again THEN cast(array() AS array<bigint>)
        WHEN n_words < 1048576 THEN transform(sort_array(transform(_h, (h, i) -> (h & -1048576L) | i)), v -> v & 1048575L)
        ELSE transform(sort_array(transform(_h, (h, i) -> struct(h, i))), v -> cast(v.i AS bigint)) END"""))
    x = x.withColumn("_p", F.expr("""CASE WHEN NOT _again THEN cast(array() AS array<bigint>) ELSE
        sort_array(filter(transform(_s, (p, j) -> CASE WHEN (j > 0 AND _h[cast(_s[j - 1] AS int)] = _h[cast(p AS int)]) OR (j < size(_s) - 1 AND _h[cast(_s[j + 1] AS int)] = _h[cast(p AS int)]) THEN p ELSE -1L END), p -> p >= 0)) END"""))
    x = x.withColumn("n_repeat_words", F.expr("aggregate(_p, named_struct('last', -3L, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)"))
    x = x.drop("_h", "_again", "_s", "_p")
    codes = ", ".join(f"'{w}', '{c}'" for w, c in zip(COMMON, LETTERS))
    inside = ", ".join(f"'{w}'" for w in COMMON)
    x = x.withColumn("_c", F.expr(f"array_join(transform(filter(_w, w -> w IN ({inside})), w -> element_at(map({codes}), w)), '')")).drop("_w")
    characters = [_left(text, c) for c in CLASSES.values()]
    x = x.withColumn("_chars", F.array(*characters))
    x = x.withColumn("_chars", F.expr("concat(_chars, array(word_chars - aggregate(_chars, 0L, (a, c) -> a + c)))"))
    counts = [(F.length("_c") - F.length(F.replace("_c", F.lit(c), F.lit("")))).cast("long") for c in LETTERS]
    x = x.withColumn("_words", F.array(*counts, F.col("n_words") - F.length("_c"))).drop("_c")
    return x.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _distance(own: str, reference: str) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; null if one of them has none."""
    total = "aggregate({0}, 0D, (a, c) -> a + c)"
    half = "CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0D END"
    p, q = "(v.p / s.p)", "(v.q / s.q)"
    return F.expr(f"""transform(array(named_struct('p', {total.format(own)}, 'q', {total.format(reference)})), s -> CASE WHEN s.p > 0 AND s.q > 0 THEN
        sqrt(greatest(0D, aggregate(zip_with({own}, {reference}, (x, y) -> named_struct('p', cast(x AS double), 'q', cast(y AS double))), 0D,
        (a, v) -> a + ({half.format(p=p, q=q)} + {half.format(p=q, q=p)}) / 2))) END)[0]""")


def references(features: DataFrame) -> DataFrame:
    """(lang, counts of characters, counts of words): pooled over the documents of a language that pass the base rules; null: over all of them."""
    labelled = features.where("NOT base_failed AND _lang IS NOT NULL")
    n, m = len(CLASSES) + 1, len(COMMON) + 1
    sums = [F.sum(F.col("_chars")[i]).alias(f"c{i}") for i in range(n)] + [F.sum(F.col("_words")[i]).alias(f"w{i}") for i in range(m)]
    per = cut(labelled.groupBy("_lang").agg(*sums))
    pooled = per.agg(*[F.sum(c).alias(c) for c in per.columns[1:]]).select(F.lit(None).cast("string").alias("_lang"), "*")
    both = per.unionByName(pooled)
    return both.select(F.col("_lang").alias("_of"), F.array(*[f"c{i}" for i in range(n)]).alias("_ref_chars"), F.array(*[f"w{i}" for i in range(m)]).alias("_ref_words"))


def with_verdict(features: DataFrame, reference: DataFrame, most: float) -> DataFrame:
    """features with divergence and kept; all columns that only serve the comparison are dropped."""
    reference = cut(reference)
    own = reference.where("_of IS NOT NULL")
    own = F.broadcast(own) if own.count() <= 10_000 else own
    rest = reference.where("_of IS NULL").first()  # one row
    joined = features.join(own, features["_lang"] == own["_of"], "left")
    for column, pooled in (("_ref_chars", rest["_ref_chars"]), ("_ref_words", rest["_ref_words"])):
        joined = joined.withColumn(column, F.coalesce(column, F.array(*[F.lit(x).cast("long") for x in pooled])))
    characters = F.when(F.col("n_words") >= CHARACTER_WORDS, _distance("_chars", "_ref_chars"))
    common = F.when(F.col("n_words") >= COMMON_WORDS, _distance("_words", "_ref_words"))
    joined = joined.withColumn("divergence", F.coalesce(F.greatest(characters, common), F.lit(0.0)))
    joined = joined.withColumn("kept", ~F.col("base_failed") & (F.col("divergence") < most))
    return joined.drop("_chars", "_words", "_of", "_ref_chars", "_ref_words", "_lang")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", most: float = MOST) -> DataFrame:
    """docs without text and lang, with the columns of the base rules, `divergence` and `kept`.

    divergence: the greater of the two Jensen-Shannon distances that the document is long enough
    for (CHARACTER_WORDS, COMMON_WORDS); 0 if it is too short for either. kept: the base rules hold
    and divergence is under `most`. A null text has no words. Repeated rows are judged alike. A
    language none of whose documents passes the base rules, and a null language, have the pooled
    reference of all; without any reference the divergence is 0. Columns of docs with the names of
    the added ones are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "divergence", "kept"]
    own = [c for c in docs.columns if c not in (text, lang, *added)]
    features = cut(base_features(docs.select(F.struct(*own).alias("_row") if own else F.lit(None).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_lang")), "_text").drop("_text"))
    return with_verdict(features, references(features), most).select(*[F.col("_row")[c].alias(c) for c in own], *added)


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang", most: float = MOST) -> DataFrame:
    """The rows of docs that `judged` keeps, all their columns as they are.

    Texts are read twice, once for the references, rather than shuffled or written between.
    """
    features = cut(base_features(docs.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")), "_text").drop("_text"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    verdict = with_verdict(base_features(rows, "_text").drop("_text"), references(features), most)
    # Always true, but not deterministic: it keeps the optimizer from copying all that `kept` comes from into the filter.
    held = F.monotonically_increasing_id() >= 0
    return verdict.withColumn("kept", F.col("kept") & held).where("kept").select("_row.*")
