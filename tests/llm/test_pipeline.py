import zlib

import numpy as np
import public_tokenizers
import pytest
import test_decontamination
import test_jaccard
import test_passages
import test_quality

from siftmill.llm.common import written

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_one_by_one(spark, sf):
    """Every stage against a brute-force version of its decisions, on what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    kept = written(stages["quality_rules"](spark, docs, sf), "a")
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want = test_quality.brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()], labels)
    assert kept.columns == columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)

    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    single = written(stages["ngram_jaccard_join"](spark, kept, sf), "b")
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(d for d, _, c in test_jaccard.brute(rows) if d == c)

    before = {r["doc_id"]: r["text"] for r in single.collect()}
    cut = written(stages["substring_dedup"](spark, single, sf), "c")
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    repeats = test_passages.sure_repeats(list(before.items()))
    assert cut.columns == columns and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert not test_passages.sure_repeats(list(after.items()))
    assert set(repeats) <= {d for d in before if after.get(d) != before[d]}

    clean = written(stages["benchmark_decontamination"](spark, cut, sf), "d")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert clean.columns == columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, t in after.items() if not test_decontamination.brute(t, items)[4])

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array(t.encode(r["text"], add_special_tokens=False).ids + [0], "<u4") for r in clean.collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in got)


def test_odd_and_empty(spark, odd_docs, empty_docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(15, 1, 0), (4, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (odd_docs, empty_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, folder), name)
            assert docs.columns == odd_docs.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
