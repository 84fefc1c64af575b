"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import counting, encoding, language, lines, mixing, quality, queries, scoring, shingles, suffixes, vectors

EMPTY = hashlib.sha256(b"").hexdigest()
LONG = " ".join(f"word{i % 977} and" for i in range(60_000))
ROWS = [
    (1, "the cat sat on the mat and the dog ran", "en", "a", 38),
    (1, "the cat sat on the mat and the dog ran", "en", "a", 38),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "le chat est sur la table et le chien court", "fr", "b", 42),
    (4, " \n\t ", None, "c", 4),
    (5, LONG, "en", "c", len(LONG)),
    (6, "été 日本 🙂 <|endoftext|> a\x00b", "fr", None, 30),
    (7, "the cat sat on the mat and the dog ran", "en", "a", 38),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with extra columns whose names the operators use themselves."""
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("ids", "kept", "size", "copies", "rank", "n_links", "draw", "n_removed", "component", "row", "h", "n", "_u", "_w", "class"):
        d = d.withColumn(c, F.lit(9))
    return d


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


OPERATORS = {
    "mix": lambda d: mixing.mix(d),
    "mixed": lambda d: mixing.mixed_documents(d),
    "counts": lambda d: counting.token_counts(d, queries.vocabulary("word_bpe_49k.json")),
    "digests": lambda d: encoding.digests(d, queries.vocabulary("byte_bpe_50k.json")),
    "encode": lambda d: encoding.encode(d, queries.vocabulary("byte_bpe_50k.json")),
    "judged": lambda d: quality.judged(d),
    "kept": lambda d: quality.kept_documents(d),
    "languages": lambda d: language.languages(d, d),
    "scores": lambda d: scoring.language_scores(d, d),
    "jaccard": lambda d: shingles.jaccard_classes(d),
    "lines": lambda d: lines.line_dedup(d),
    "suffixes": lambda d: suffixes.substring_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, none):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("mixed", "kept")])
def test_row_for_row(name, docs):
    found = OPERATORS[name](docs).collect()
    assert len(found) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)


def test_mix(docs):
    found = mixing.mix(docs).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    assert {r["size"] for r in found if r["doc_id"] in (2, 3, 4)} == {0}
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_counts_and_digests(docs):
    counts = {r["doc_id"]: r for r in OPERATORS["counts"](docs).collect()}
    assert counts[2]["n_tokens"] == counts[3]["n_tokens"] == counts[4]["n_tokens"] == 0 and counts[5]["over_limit"]
    found = {r["doc_id"]: r for r in OPERATORS["digests"](docs).collect()}
    assert found[2]["ids_sha256"] == found[3]["decoded_sha256"] == EMPTY
    for i, text, *_ in ROWS:
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert encoding.encode(docs, queries.vocabulary("byte_bpe_50k.json")).columns.count("ids") == 1


def test_quality_keeps_columns(docs):
    assert quality.kept_documents(docs).columns == docs.columns
    found = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert found[2]["n_words"] == found[3]["n_words"] == 0 and found[2]["base_failed"] and not found[2]["kept"]
    assert found[5]["n_words"] == 120_000


def test_languages(docs):
    found = {r["doc_id"]: r for r in language.languages(docs, docs).collect()}
    assert found[2]["lang_pred"] == found[3]["lang_pred"] == found[4]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert {r["lang_pred"] for r in language.languages(docs, docs.where("false")).collect()} == {"und"}


def test_scores_without_training(docs):
    found = {r["doc_id"]: r for r in scoring.language_scores(docs, docs.where("false")).collect()}
    assert found[2]["n_tokens"] == 1 and found[2]["train_tokens"] == 0 and found[2]["base_score"] == 0
    assert found[2]["bits_per_byte"] is None and found[5]["score"] < 0


def test_jaccard(docs):
    found = sorted(((r["doc_id"], r["n_links"], r["class_id"], r["kept"]) for r in shingles.jaccard_classes(docs).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (7, 2, 1, False), (None, 0, None, True), *[(i, 0, i, True) for i in (2, 3, 4, 5, 6)]], key=str)


def test_jaccard_judges_rows(spark):
    """Rows of one id, and rows without, by their own texts."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (5, a + " x"), (5, b), (None, a), (None, b + " y"), (None, None), (9, b), (None, "alone it is and so it stays"), (None, "alone it is and so it stays")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted(((r["doc_id"], r["n_links"], r["class_id"], r["kept"]) for r in shingles.jaccard_classes(d).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (5, 2, 1, False), (5, 2, 5, True), (None, 2, 1, False), (None, 2, 5, False), (None, 0, None, True), (9, 2, 5, False), (None, 1, None, True), (None, 1, None, True)], key=str)


def test_lines(docs):
    found = {r["doc_id"]: r for r in lines.line_dedup(docs).collect()}
    assert found[7]["text"] == "" and [tuple(s) for s in found[7]["removed_spans"]] == [(0, 38)]
    assert found[1]["n_removed"] == 0 and found[2]["text"] is None and found[3]["n_units"] == 1


def test_suffixes(docs):
    found = {r["doc_id"]: r for r in suffixes.substring_dedup(docs).collect()}
    assert found[2]["kept_sha256"] == EMPTY and found[2]["n_removed"] == 0
    assert found[7]["n_removed"] == 0  # shorter than 50 bytes


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (None, [-1.0, 0.0]), (11, [1e200, -1e200]), (12, [1e-200, -1e-200]), (13, [1.0]), (14, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("home", F.lit(1)).withColumn("cell", F.lit(2)).withColumn("node", F.lit(3)).withColumn("one", F.lit(3))
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(d).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert found == [
        (1, 2, 1, True), (2, 2, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7)], (8, 1, 8, True), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 9, False),
        (11, 1, 11, True), (12, 1, 11, False), (13, 0, 13, True), (14, 0, 14, True), (None, 0, None, True), (None, 2, 1, False),
    ]
    assert vectors.near_vectors(d.where("false")).collect() == []
    assert [r["n_links"] for r in vectors.near_vectors(d.where("vec_id = 3")).collect()] == [0]


def test_many_equal_vectors(spark):
    """Equal vectors are compared once, whatever their number."""
    d = spark.range(6000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 5000, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0) + F.col("id") / 1e6)).alias("embedding"))
    found = vectors.near_vectors(d).groupBy("n_links", "component_id").count().collect()
    assert sorted(map(tuple, found)) == [(999, 5000, 1000), (4999, 0, 5000)]


@pytest.mark.parametrize("size, ids", [(100, 10), (7, 1), (50, 500)])
def test_mix_of_rows_alike(spark, size, ids):
    """Rows that repeat an id, with the same text or another, bring no source further from its target than one document."""
    d = spark.range(1000).select((F.col("id") % ids).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("a "), size)).otherwise(F.concat(F.repeat(F.lit("b "), size - 1), F.col("id").cast("string"))).alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source"))
    found = mixing.mix(d).collect()
    assert len(found) == 1000
    per = {}
    for r in found:
        key = (r["source_size"], r["target"])
        per[key] = per.get(key, 0) + r["taken"]
    assert all(abs(taken - target) <= size for (_, target), taken in per.items())
    again = mixing.mix(d.repartition(5)).groupBy("doc_id", "size", "taken").count().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, spark.createDataFrame([(r["doc_id"], r["size"], r["taken"]) for r in found], "doc_id long, size long, taken long").groupBy("doc_id", "size", "taken").count().collect()))
    assert mixing.mixed_documents(d).count() == sum(r["copies"] for r in found)
