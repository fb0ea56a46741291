"""Chunkers against plain versions over a whole table, and on the cases that decide their rules."""

import math

from siftmill.operators import chunking


def plain_sentences(text):
    out, words = [[]], text.split()
    for w, after in zip(words, [*words[1:], ""]):
        out[-1].append(w)
        if w[-1] in ".!?" and "A" <= after[:1] <= "Z":
            out.append([])
    return [" ".join(s) for s in out if s]


def tokens(s):
    return max(1, math.ceil(len(s) / 4))


def plain_sentence_chunks(text, budget=512, overlap=64):
    out, now = [], []
    for s in plain_sentences(text):
        if tokens(s) > budget:
            out += [" ".join(now)] if now else []
            now, line = [], []
            for w in s.split():
                if line and sum(map(tokens, line)) + tokens(w) > budget:
                    out.append(" ".join(line))
                    line = []
                line.append(w)
            out.append(" ".join(line))
            continue
        if now and sum(map(tokens, now)) + tokens(s) > budget:
            out.append(" ".join(now))
            fits = [k for k in range(len(now) + 1) if sum(map(tokens, now[k:])) <= overlap]
            now = now[min(fits) :]
        now.append(s)
    return out + ([" ".join(now)] if now else [])


def plain_paragraph_chunks(text, size, separator):
    """A list of (kind, parts): paragraphs of a chunk, or sentences of one cut paragraph."""
    groups = []
    for p in (q.strip() for q in text.split(separator)):
        if not p:
            continue
        if len(p) <= size:
            if groups and groups[-1][0] == "whole" and sum(map(len, groups[-1][1])) + len(p) <= size:
                groups[-1][1].append(p)
            else:
                groups.append(("whole", [p]))
            continue
        now = []
        for s in chunking.re.split(r"(?<=[.!?])\s+", p):
            if now and sum(map(len, now)) + len(s) > size:
                groups.append(("cut", now))
                now = []
            now.append(s)
        groups.append(("cut", now))
    return [(separator if kind == "whole" else " ").join(parts) for kind, parts in groups]


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["chunk"]):
        out.setdefault(r["doc_id"], []).append(r["content"])
    return out


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] and r["text"].strip()}
    assert collected(chunking.chunked(docs, "doc_id", "text", chunking.sentence_chunks)) == {d: plain_sentence_chunks(t) for d, t in texts.items()}
    small = lambda t: chunking.paragraph_chunks(t, 400, "\n")
    assert collected(chunking.chunked(docs, "doc_id", "text", small)) == {d: plain_paragraph_chunks(t, 400, "\n") for d, t in texts.items()}


def test_sentences():
    assert chunking.sentences_of("We met Dr. smith at 5 p.m. today.") == ["We met Dr. smith at 5 p.m. today."]
    assert chunking.sentences_of("One. Two!  Three?\nfour") == ["One.", "Two!", "Three? four"]
    assert chunking.sentences_of("یک۔ دو؟ سه. one", "fa") == ["یک۔", "دو؟", "سه.", "one"]


def test_budget_overlap_and_long_sentences():
    count = lambda s: len(s.split())
    text = "A b c. D e. F g h i j k l m n o. P q."
    assert chunking.sentence_chunks(text, 6, 2, count) == ["A b c. D e.", "F g h i j k", "l m n o.", "P q."]
    assert chunking.sentence_chunks("A b c. D e. F g. H i. J k.", 5, 2, count) == ["A b c. D e.", "D e. F g.", "F g. H i.", "H i. J k."]
    assert chunking.sentence_chunks("A b c d. E f g h.", 4, 4, count) == ["A b c d.", "A b c d. E f g h."]
    assert chunking.sentence_chunks("", 4, 4) == []


def test_fixed():
    assert [len(c) for c in chunking.fixed_chunks("x" * 600)] == [600] and chunking.fixed_chunks("y" * 40) == ["y" * 40]
    assert [len(c) for c in chunking.fixed_chunks("x" * 1300)] == [1000, 500]
    assert [len(c) for c in chunking.fixed_chunks("x" * 950 + "." + "y" * 400)] == [951, 600]


def test_paragraphs_do_not_share_chunks_with_cut_ones():
    long = "S" * 10 + ". " + "T" * 10 + "."
    assert chunking.paragraph_chunks(f"a\n\n{long}\n\nb\n\nc", 15) == ["a", "S" * 10 + ".", "T" * 10 + ".", "b\n\nc"]


def test_chunks_leave_a_worker_by_blocks_of_text(spark):
    from pyspark.sql import functions as F

    n = 1200
    d = spark.range(n).repartition(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 50 == 1, " \n").otherwise(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words. ")), 300)).alias("text"))
    got = chunking.chunked(d, "doc_id", "text", chunking.fixed_chunks)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()  # rows of a whole batch were held before
    want = [(r["doc_id"], i, c) for r in d.collect() if r["text"] and r["text"].strip() for i, c in enumerate(chunking.fixed_chunks(r["text"]))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(len(c) for _, _, c in want) > 2 * chunking.BLOCK_BYTES


def test_cleaning_as_by_the_plain_patterns(spark):
    from pyspark.sql import functions as F

    from siftmill.functions import text as X

    plain = (r" +", " "), (r"\n{3,}", "\n\n"), (r"\n\d+\n", "\n"), (r"\n- \d+ -\n", "\n"), (r"\n[A-Z\s]{10,}\n", "\n"), (r"https?://[!$-_a-z]+", ""), (r"\S+@\S+", "")
    texts = ["a@b", "@a", "a@", "@@a b@", "x y@z@ q", "a  b   @ c@d", "\n\n\n\nA 1\n12\n- 3 -\n- 4 -\nHEADER  LINES\nx", "see http://a.b/c?d and https://e  .", " \x85a @b \x85", "", None, "  ", "a\n@b\nc@"]
    want = F.col("text")
    for pattern, to in (*plain, *((p, to) for p, to, _ in X.CLEANING[len(plain) :])):
        want = F.regexp_replace(want, pattern, to)
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", X.clean_text(F.col("text")).alias("got"), want.alias("want")).collect()
    assert len(rows) == len(texts) and all(r["got"] == r["want"] for r in rows), rows


def test_ingest_cleans_and_chunks_each_text_once(spark, tmp_path):
    import pytest

    from siftmill import plans

    docs = spark.createDataFrame([(i, f"Text {i} says this. " * 40, f"src{i % 2}", "en", 9) for i in range(20)], "doc_id long, text string, source string, lang string, n_chars int")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    runs, made = spark.sparkContext.accumulator(0), chunking.sentence_chunks

    def counting(text):
        runs.add(1)
        return made(text)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(chunking, "sentence_chunks", counting)
        log = plans.QUERIES["ingest_pipeline"](spark, str(tmp_path)).collect()
    assert {r["title"]: r["status"] for r in log} == {"src0": "completed", "src1": "completed"} and runs.value == 20
