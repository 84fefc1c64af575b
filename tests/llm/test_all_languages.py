"""Every language of the training rows is learned, however many there are."""

import random

from plumbline.llm import language


def test_more_languages_than_a_group(spark):
    rng, rows = random.Random(5), []
    for k in range(70):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(40)]
        for i in range(2 if k < 6 else 3):  # the first six are the least frequent
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(150)), f"l{k:02}"))
        rows.append((10_000 + k, " ".join(rng.choice(words) for _ in range(60)), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = {r["doc_id"]: r["lang_pred"] for r in language.languages(docs, docs).collect()}
    assert {k: found[10_000 + k] for k in range(70)} == {k: f"l{k:02}" for k in range(70)}
