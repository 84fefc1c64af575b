"""The pipeline against a plain version of its stages, and the guard of the entry."""

import collections
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import mixing, quality, queries
from test_brute_force import plain_lines

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "source mix", "BPE ids"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, DATA)
    verdict = {r["doc_id"] for r in quality.judged(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdict

    rows = [r for r in docs.orderBy("doc_id").collect() if r["doc_id"] in verdict]
    sets, left = [], []
    for r in rows:
        w = r["text"].split()
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        group = [g for g in sets if any(len(s & o) >= 0.8 * len(s | o) for o in g)]
        if not group:
            left.append(r)
        sets = [g for g in sets if g not in group] + [[s, *(o for g in group for o in g)]]
    texts = {i: t for i, t, _ in plain_lines((r["doc_id"], r["text"]) for r in left) if t.strip()}
    after = corpus_pipeline.without_repeated_lines(spark, corpus_pipeline.one_of_each_group(spark, kept, DATA), DATA).cache()
    assert after.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"]: r["text"] for r in after.collect()} == texts

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(after).collect()}
    theirs = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    found = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, DATA).collect())
    want = collections.Counter({(i, tuple(np.array(theirs.encode(t, add_special_tokens=False).ids))): copies[i] for i, t in texts.items() if copies[i]})
    assert found == want


EDGES = [
    (1, "same words here " * 30, "en", "a", 480),
    (1, "other words of the same id " * 20, "en", "a", 520),
    (None, "same words here " * 30, None, None, None),
    (None, None, None, None, None),
    (2, "", "en", "b", 0),
    (3, " ".join(f"word{i % 997} and" for i in range(40_000)), "en", "b", 1),
    (3, " ".join(f"word{i % 997} and" for i in range(40_000)), "en", "b", 1),
]


@pytest.mark.parametrize("stage", range(5))
@pytest.mark.parametrize("which", ["edges", "empty"])
def test_stage_edges(spark, stage, which):
    """Nulls, repeated ids, empty and long texts, extra columns, an empty table: every stage gives its columns and invents no text."""
    d = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long").withColumn("rank", F.lit(1)).withColumn("kept", F.lit(None).cast("string"))
    found = corpus_pipeline.STAGES[stage][1](spark, d if which == "edges" else d.where("false"), DATA)
    rows = found.collect()
    assert found.columns == (corpus_pipeline.COLUMNS if stage < 4 else ["doc_id", "lang", "source", "n_tokens", "ids"])
    if which == "empty":
        assert rows == []
    if which == "edges" and stage in (1, 2):
        assert {r["text"] for r in rows if r["text"]} <= {t for _, t, *_ in EDGES}
        assert any((r["text"] or "").startswith("other words") for r in rows)


def test_without_the_operators(tmp_path):
    """Without plumbline/llm and tests/llm the entry still gives the engine's own queries."""
    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    for _ in range(2):
        said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
        assert int(said[0]) > 100 and int(said[1]) > 90 and said[2] == "False"
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry_registers_all():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
