import random

import pytest

pytest.importorskip("siftmill.llm")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, ties, repeated rows, long and strange texts, and columns whose names clash with the operators' own."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8)))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(70)]
    texts = [
        None, "", " ", "\n\n", "one", "a b c d", "a b c d", "a  b\t\tc \n d", " leading", "trailing ", "x. y, z.. (a.b) 3.5,2 _.a a_, b",
        "<|endoftext|> in <s> text </s>", "▁mark ▁▁ x", "é ① 한국어 日本語   nbsp \x01 ctl", "don't. I'll, we've", " ".join(base), " ".join(base), " ".join(base[:-3] + ["changed", "tail"]),
        " ".join(base[:60] + ["mid"] + base[61:]), " ".join([*(word() for _ in range(80)), *passage, *(word() for _ in range(60))]), " ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(90))]),
        "line a\nline b\nline a\n\n line a\nline a", " ".join(["same three words"] * 60), "#### $$$ || <<>> && %%", " ".join(word() for _ in range(9000)), "\n".join(["rep eat"] * 200), "Released under the MIT License. " + " ".join(base[:50]),
    ]
    rows = [(i, t, "en", "s", len(t or ""), 1, "clash", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[16], (None, "no id here", "en", "s", 1, 1, "clash", 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, component_id string, n_tokens long, salt int")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)
