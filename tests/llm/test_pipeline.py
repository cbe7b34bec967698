"""The pipeline against its stages in plain Python."""

import hashlib

import brute
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm.quality_rules import judge
from tickloom.llm.token_codes import tokenizer_path


def draw(doc_id, source, size):
    text = "|".join(["mix-1", "" if doc_id is None else str(doc_id), source or "", str(size)])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16**13


def wanted_rows(spark, at):
    from tokenizers import Tokenizer

    # Line verdicts come from the rules (tested by themselves and against SQL).
    docs = spark.read.parquet(f"{at}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    kept = [(r.doc_id, r.cleaned, source[r.doc_id]) for r in judge(docs).where("kept").collect()]
    kept = sorted({x[0]: x for x in kept}.values(), key=lambda x: x[0])
    roots = brute.classes([brute.fingerprint(t) for _, t, _ in kept])
    kept = [x for k, x in enumerate(kept) if roots[k] == k]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{at}/benchmark.parquet").where("text IS NOT NULL").collect()]
    kept = [x for x in kept if not any(i in " ".join(x[1].lower().split()) for i in items)]
    size = {}
    for _, t, s in kept:
        size[s] = size.get(s, 0) + len(brute.WORD.findall(t))
    target = brute.mix_targets(size)
    mixed = []
    for d, t, s in kept:
        n = len(brute.WORD.findall(t))
        rate = target[s] / size[s]
        mixed += [(d, t)] * (int(rate) + (draw(d, s, n) < rate - int(rate)))
    return brute.token_rows(sorted(mixed), Tokenizer.from_file(tokenizer_path()))


def test_pipeline(spark):
    found = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect())
    wanted = wanted_rows(spark, SMALL)
    assert len(wanted) > 100 and found == sorted(wanted)


@pytest.mark.parametrize("kind", ["edge", "empty"])
def test_stages_keep_the_columns(spark, edge_dir, empty_dir, kind):
    at = edge_dir if kind == "edge" else empty_dir
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    if kind == "edge":
        assert corpus_pipeline.run(spark, at).count() >= 0
        docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for _, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, at)
        assert out.columns == columns
        out.collect()


def test_near_dedup_keeps_one_row_of_each_class(spark):
    """Rows that share an id but not a text are no duplicates; rows that tie are chosen by their values."""
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(1, texts[0], "x"), (1, texts[1], "x"), (2, texts[0], "x"), (3, texts[2], "x"), (3, texts[2], "y"), (None, texts[0], "x")]
    seen = set()
    for k in range(len(rows)):
        docs = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, source string").repartition(1 + k)
        out = [tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, docs, SMALL).collect()]
        assert sorted(x[:2] for x in out if x[0]) == [(1, texts[0]), (1, texts[1]), (3, texts[2])] and len(out) == 4
        seen.add(tuple(sorted(out, key=str)))
    assert len(seen) == 1


def test_decontamination_keeps_clean_rows_under_a_contaminated_id(spark, tmp_path):
    item = "A train leaves Boston at nine and travels toward Chicago while Maria waits an hour before she drives home again."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "so " + item, "x"), (1, "a clean text under the same id", "x"), (1, "a clean text under the same id", "x"), (2, "clean", "x"), (2, None, "y"), (None, item, "x"), (None, "clean too", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = [tuple(r) for r in corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)
