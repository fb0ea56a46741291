import zlib

import numpy as np
import public_tokenizers
import pytest

from siftmill.llm import packing, token_counts, token_files


def _ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def _key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")


def _frames(spark, sf, odd_docs):
    yield odd_docs
    yield spark.read.parquet(f"{sf}/documents.parquet")


def test_token_files_round_trip(spark, sf, odd_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for docs in _frames(spark, sf, odd_docs):
        rows = sorted(docs.collect(), key=_key)
        ids = _ids([r["text"] for r in rows])
        n = np.array([len(x) for x in ids])
        got = sorted(token_files.read_token_files(spark, token_files.write_token_files(docs, path)).collect(), key=lambda r: r["start"])
        assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(r["doc_id"], s, k, _crc(x)) for r, s, k, x in zip(rows, (np.cumsum(n) - n).tolist(), n.tolist(), ids)]


def test_token_files_empty(spark, empty_docs):
    assert token_files.read_token_files(spark, token_files.write_token_files(empty_docs, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_token_counts(spark, sf, odd_docs, empty_docs):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for docs in _frames(spark, sf, odd_docs):
        want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(sp.encode(r["text"] or "")), n > 4096) for r in docs.collect()), key=str)
        assert sorted((tuple(r) for r in token_counts.token_counts(docs, model).collect()), key=str) == want
    assert token_counts.token_counts(empty_docs, model).count() == 0


def test_whole_tokens_are_proved():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = token_counts.whole_tokens(sp)
    assert len(known) > 10_000 and all(len(sp.encode(s)) == 1 for s in list(known)[::50])


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, sf, odd_docs, capacity):
    for docs in _frames(spark, sf, odd_docs):
        rows = docs.collect()
        ids = {}
        for r, x in zip(rows, _ids([r["text"] for r in rows])):
            ids.setdefault(r["doc_id"], []).append(x)
        got = packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity).collect()
        assert sum(r["length"] for r in got) == sum(len(x) for xs in ids.values() for x in xs)
        by_sequence = {}
        for r in got:
            assert any(_crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in ids[r["doc_id"]])
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(by_sequence) <= 1.03 * sum(r["length"] for r in got) / capacity + 2
        for doc, xs in ids.items():
            if len(xs) == 1 and len(xs[0]) > capacity:
                lengths = [r["length"] for r in sorted(got, key=lambda r: r["piece"]) if r["doc_id"] == doc]
                assert all(n == capacity for n in lengths[1:])


def test_packing_empty(empty_docs):
    assert packing.best_fit_packing(empty_docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_pack_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 257, 5000), minlength=257)
    left = counts.copy()
    for pattern, r in packing.pack_plan(counts, 256):
        assert sum(pattern) <= 256
        for n in pattern:
            left[n] -= r
    assert not left.any()


def test_token_files_say_their_format(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    folder = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder=str(tmp_path / "plain path"))
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert {tuple(r) for r in manifest.select("id_bytes", "version").collect()} == {(2, token_files.VERSION)} and folder.startswith("file:/")
    assert token_files.read_token_files(spark, folder).count() == 20
    other = str(tmp_path / "other")
    manifest.withColumn("version", F.lit(99)).write.parquet(f"{other}/manifest")
    with pytest.raises(ValueError):
        token_files.read_token_files(spark, other)


def test_a_very_common_length_is_ranked_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_GROUP", 100)
    rows = [(7, 0, 0, 256, 5)] * 900 + [(i, 0, 0, 1 + i % 255, 5) for i in range(600)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5)
    got = packing.pack(pieces, 256).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 256


@pytest.mark.parametrize("capacity", [512, 2048])
def test_packing_of_wide_histograms_is_near_the_lower_bound(capacity):
    """Triples are fitted among 192 lengths only; pieces of other lengths still pack as pairs and residuals."""
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, capacity + 1, 20_000), rng.integers(1, capacity // 3, 20_000), np.minimum(capacity, 1 + rng.lognormal(np.log(capacity / 6), 1.0, 20_000).astype(int))):
        counts = np.bincount(lengths, minlength=capacity + 1)
        sequences = sum(r for _, r in packing.pack_plan(counts, capacity))
        # a sequence holds one piece longer than half of it, and no more tokens than its capacity
        bound = max(-(-int(lengths.sum()) // capacity), int(counts[capacity // 2 + 1 :].sum()))
        assert sequences <= 1.02 * bound + 2
