import json

from siftmill.sources.json_walk import json_leaves, json_texts

ODD = [
    '{"b": 1, "a": {"z": [1, 2.50, {"k": null}], "y": "x: 1"}, "c": true, "d": "  ", "e": 1e20, "f": 1.5e-7, "g": 12345678.9, "h": "{\\"q\\": 1}", "i": [], "j": {}, "k": [[1, [2]], 3]}',
    '{"dot.ted": {"sp ace": 0.1}, "l": 100000000000000000000000, "m": 1.0, "n": 1e5, "o": 0.0001, "p": 123456789012345680.0, "q": -0.00001, "": 1}',
    '[1, "a", [true, false]]', "5", "bad {", None, "", json.dumps(list(range(700))), json.dumps([[[[[{"deep": [i] * 3}]]]] for i in range(3)]), json.dumps({"long": "x" * 1_000_000}),
]


def walk(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, path + k)
    elif isinstance(value, list):
        for i, v in enumerate(value[:500]):
            yield from walk(v, f"{path}[{i}]")
    elif str(value).strip():
        yield f"{path}: {value}"


def plain(text):
    try:
        return list(walk(json.loads(text)))
    except (TypeError, ValueError):
        return []


def test_depth_first_lines(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "key long, value string").withColumnRenamed("value", "raw")
    got = {}
    for r in sorted(json_leaves(docs, "key", "raw").collect(), key=lambda r: (r["key"], r["at"])):
        got.setdefault(r["key"], []).append(f"{r['path']}: {r['value']}")
    assert [got.get(i, []) for i in range(len(ODD))] == [plain(t) for t in ODD]


def test_texts_with_heading(spark):
    docs = spark.createDataFrame([(i, t, "set") for i, t in enumerate(ODD)], "id long, j string, title string")
    got = {r["key"]: (r["text"], r["char_count"]) for r in json_texts(docs, "id", "j", "title").collect()}
    for i, t in enumerate(ODD):
        want = "\n".join(["JSON Dataset: set", "", *plain(t)])
        assert got[i] == (want, len(want))
    assert json_leaves(docs.limit(0), "id", "j").collect() == []


def test_one_pass_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, t, "set") for i, t in enumerate(ODD)], "id long, j string, title string")
    for made in (json_leaves(docs, "id", "j"), json_texts(docs, "id", "j", "title")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Scan") == 1  # no level is written, no leaf moved


def test_what_is_no_json_and_what_is_blank(spark):
    odd = ['{"a": 1, "a": 2}', "[NaN]", '{"x": "\\ud83d"}', '["\u0085", " ", " \u0085", "\u0085 "]', "[-0, -0.0, 2e-5]", "[" * 900 + "1" + "]" * 900]
    got = {}
    for r in json_leaves(spark.createDataFrame(list(enumerate(odd)), "id long, j string"), "id", "j").collect():
        got.setdefault(r["key"], []).append((list(r["at"]), r["value"]))
    assert got == {2: [([1], "?")], 3: [([3], "\u0085 ")], 4: [([0], "-0"), ([1], "-0.0"), ([2], "2e-05")], 5: [([0] * 900, "1")]}
