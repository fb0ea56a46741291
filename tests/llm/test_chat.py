import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from siftmill.llm import chat, queries

_TEXT = st.text(alphabet="\\#: </turn>ecAassistant\nx", max_size=30)


@given(st.lists(st.tuples(_TEXT, _TEXT), max_size=5))
def test_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in zip(spans[::2], spans[1::2])] == [t for r, t in turns if r == "assistant"]


def test_paths_and_branches(spark):
    #        1           10 - 11
    #      2   3
    #    4    5 6 - 7
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 1.0), (1, 4, 2, 9.0), (1, 5, 3, 1.0), (1, 6, 3, 1.0), (1, 7, 6, 1.0), (1, 10, None, None), (1, 11, 10, 0.0), (2, 1, 99, 1.0)]
    found = chat.best_paths(spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, score double"), 9).collect()
    paths = {}
    for r in sorted(found, key=lambda r: r["step"]):
        paths.setdefault((r["conv_id"], r["branch"]), []).append(r["node_id"])
    assert paths == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 6, 7], (1, 3): [1, 3, 5], (1, 4): [10, 11], (2, 1): [1]}


def test_circles_and_repeated_messages(spark):
    # 1 and 2 answer each other, 3 answers 2, 4 answers itself, 5 answers 4; 6 - 7 is a tree, 7 stands twice and under 6 first
    rows = [(1, 1, 2, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 9.0), (1, 4, 4, 1.0), (1, 5, 4, 9.0), (1, 6, None, 0.0), (1, 7, 6, 1.0), (1, 7, 6, 2.0), (1, 7, 99, 0.0), (1, None, 6, 5.0), (None, 1, None, 5.0), (2, 1, 1, 0.0)]
    df = spark.createDataFrame([(*r, "user", f"t{i}") for i, r in enumerate(rows)], "conv_id long, node_id long, parent_id long, score double, role string, text string")
    assert sorted((r["conv_id"], r["branch"], r["step"], r["node_id"]) for r in chat.best_paths(df, 9).collect()) == [(1, 1, 0, 6), (1, 1, 1, 7)]
    (r,) = chat.format_trees(df, 9).collect()
    assert chat.parse_turns(r["formatted"]) == [("user", "t5"), ("user", "t6")]


def test_random_trees_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, i, rng.choice([None, *range(i)]) if i else None, float(rng.randint(0, 8))) for c in range(12) for i in range(rng.randint(1, 60))]
    parent, score, inner = {(c, i): p for c, i, p, _ in rows}, {(c, i): s for c, i, _, s in rows}, {(c, p) for c, _, p, _ in rows}
    want = {}
    for c, i, _, _ in rows:
        if (c, i) not in inner:
            path = [i]
            while (p := parent[c, path[0]]) is not None:
                path.insert(0, p)
            want.setdefault(c, []).append((-sum(score[c, n] for n in path) / len(path), i, path))
    want = {(c, b): path for c, found in want.items() for b, (_, _, path) in enumerate(sorted(found)[:3], 1)}
    got = {}
    for r in sorted(chat.best_paths(spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, score double"), 3).collect(), key=lambda r: r["step"]):
        got.setdefault((r["conv_id"], r["branch"]), []).append(r["node_id"])
    assert got == want


def test_long_chain_nulls_and_ties(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(70)] + [(2, 0, None, None), (2, 0, None, None), (None, 0, "user", "x"), (3, 5, "assistant", "a: b</turn>"), (3, 5, "assistant", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, step string")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_trees(chat.turn_chain(df)).collect()}
    assert set(got) == {1, 2, 3}
    assert chat.parse_turns(got[1]) == [(r, t) for _, _, r, t in rows[:70]]
    assert chat.parse_turns(got[2]) == [("", ""), ("", "")]
    assert chat.parse_turns(got[3]) == [("assistant", "a"), ("assistant", "a: b</turn>")]
    assert chat.format_trees(chat.turn_chain(df.limit(0))).count() == 0


def test_query(spark, sf):
    said = r"\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    by = {}
    for c, _, r, t in sorted(rows):
        by.setdefault(c, []).append((r, t or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {c: (len(x), sha("".join(f"{r}\n{t}\n" for r, t in x)), len(y := "".join(t for r, t in x if r == "assistant")), sha(y)) for c, x in by.items()}
    got = queries.op6_chat_formatting(spark, sf).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == want and len(got) == len(want)
