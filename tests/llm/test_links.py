"""Decontamination and tool calls on small cases."""

import json

from folioworks.llm import decontam, tool_calls

ITEM = "Alice drives 12 km to the market with Alice and buys 7 red apples. How many km does Bob walk when Alice returns with 12 pears and some bread for the old man?"


def test_templates_find_changed_numbers_and_names(spark):
    other = ITEM.replace("Alice", "Zoe").replace("Bob", "Karl").replace("12", "45").replace("7", "9")
    mixed = "Xu drives 1 km to the market with Yan and buys 7 red apples. How many km does Xu walk when Pia returns with 3 pears and some bread for the old man?"
    rows = [(1, f"Some words before it. {ITEM} And some after."), (2, other.lower().replace("zoe", "Zoe")), (3, other), (4, mixed), (5, "how many km does"), (6, None), (7, ""), (None, ITEM), (8, "drives 12 km to the market with a friend who likes none of this at all")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, hash string, windows int")
    items = spark.createDataFrame([(0, ITEM), (0, ITEM), (9, None), (None, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.matches(docs, items).collect()}
    assert got[1]["contaminated"] and got[1]["literal"]
    assert got[3]["contaminated"] and not got[3]["literal"] and got[3]["consistent"] == 1.0
    assert got[4]["share"] > 0.5 and not got[4]["contaminated"]
    assert not {5, 6, 7, None} & set(got)
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns and {1, 3} & {r["doc_id"] for r in kept.collect()} == set() and kept.count() >= 6
    assert decontam.matches(docs.limit(0), items).count() == 0 and decontam.matches(docs, items.limit(0)).count() == 0


def contaminated(spark, texts, items):
    """(text, item): whether literally, of those that contaminate."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontam.matches(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): r["literal"] for r in found.collect() if r["contaminated"]}


def test_each_occurrence_is_judged_by_itself(spark):
    other = ITEM.replace("Alice", "Zoe").replace("Bob", "Karl").replace("12", "45").replace("7", "9")
    twice = "we saw 3 red birds in the old garden there and we saw 8 red birds in the old garden there"
    # A word put in moves the offset a little, a paragraph put in moves it far.
    texts = [f"First {ITEM} Then some words between. {other} And so on.", twice, ITEM.replace("apples.", "shiny apples."), ITEM.replace("How many", "x y z " * 20 + "how many")]
    assert contaminated(spark, texts, [ITEM, twice]) == {(0, 0): True, (1, 1): True, (2, 0): True, (3, 0): True}


def test_short_long_and_literal_items(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    long = " ".join(words)
    # Short; long; without a window of four plain words; marks at the ends are none of an item, those inside are.
    items = ["how far is it home?", long, "Anna Berta Carla Dora Emma Frida Gerda Hanna Ilse", "12 + 45 = ?", "...", "How old is Anna"]
    texts = [f"They asked: {items[0]} Nobody knew the answer to it then.", "before that " + " ".join(words[50:80]) + " and after", "before that " + " ".join(words[50:60]) + " and after",
             f"the list of {items[2]} is read out here", "so 12 + 45 = 57 is what we all got", "pages 12, 45 and 60 of the book are torn out ...", "he asked how old is Anna and the others did not know", "he asked how old is Berta and the others did not know"]
    assert contaminated(spark, texts, items) == {(0, 0): True, (1, 1): True, (3, 2): True, (4, 3): True, (6, 5): True}


def calls_frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, call_id string, turn long, tool string, arguments string, needs array<string>")


def test_calls_are_linked_ordered_and_checked(spark):
    calls = calls_frame(spark, [
        (1, "a", 1, "find", '{"q": "x", "n": 3}', []),
        (1, "b", 2, "find", '{"n": 1.5, "q": "y", "z": 1}', ["a"]),
        (1, "c", 3, "find", "[1]", ["b", "a"]),
        (1, "d", 4, "find", '{"q": 1}', ["e"]),
        (1, "e", 5, "nope", "{}", ["d"]),
        (1, "f", 6, "find", '{"q":"x"}', ["gone"]),
        (2, "a", 1, "find", '{"q":"k"}', None),
        (2, "a", 2, "find", '{"q":"l"}', []),
        (None, "a", 1, "find", '{"q":"k"}', []),
        (3, None, 1, "find", None, []),
    ])
    results = spark.createDataFrame([(1, "a", 2, "one"), (1, "a", 3, "two"), (1, "zz", 9, "lost"), (None, "a", 1, "n")], "conv_id long, call_id string, turn long, content string")
    parameters = spark.createDataFrame([("find", "q", "string", True), ("find", "n", "integer", False)], "tool string, name string, type string, required boolean")
    out = {(r["conv_id"], r["call_id"], r["turn"]): r for r in tool_calls.link_calls(calls, results, parameters).collect()}
    assert len(out) == 10
    a, b, c = out[1, "a", 1], out[1, "b", 2], out[1, "c", 3]
    assert (a["level"], b["level"], c["level"]) == (0, 1, 2) and (a["place"], b["place"], c["place"]) == (1, 2, 3)
    assert a["content"] == "one" and a["results"] == 2 and a["faults"] == [] and b["faults"] == ["n: no integer", "z: not a parameter"]
    assert c["faults"] == ["arguments: no object"] and out[1, "d", 4]["faults"] == ["q: no string"] and out[1, "e", 5]["faults"] == ["tool: unknown"]
    assert out[1, "d", 4]["level"] is out[1, "e", 5]["level"] is out[1, "f", 6]["level"] is None
    assert out[2, "a", 1]["repeated"] and out[None, "a", 1]["faults"] == ["call: no id"] and out[None, "a", 1]["content"] is None
    record = json.loads(a["record"])
    assert record["arguments"] == {"n": 3, "q": "x"} and a["record"] == json.dumps(record, sort_keys=True, separators=(",", ":"))
    assert tool_calls.link_calls(calls.limit(0), results.limit(0), parameters).count() == 0


def test_results_without_a_call_are_rows(spark):
    messages = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 3, "assistant", "cut off"), (2, 4, "assistant", None), (None, 1, "assistant", "whose")], "conv_id long, turn long, role string, text string")
    calls, results = tool_calls.calls_of_turns(messages)
    linked = tool_calls.link_all(calls, results, tool_calls.reply_parameters(spark))
    out = {(r["conv_id"], r["call_id"]): (r["turn"], r["result_turn"], r["content"], r["faults"]) for r in linked.collect()}
    assert out == {
        (1, "call-0"): (0, 1, "hello", []),
        (2, "call-2"): (None, 3, "cut off", ["result: no call"]),
        (2, "call-3"): (None, 4, None, ["result: no call"]),
        (None, "call-0"): (None, 1, "whose", ["result: no id"]),
    }


def test_results_that_name_no_call(spark):
    messages = spark.createDataFrame([(1, 0, "tool", '{"result": null, "content": "x"}\n{"content": "no \\"result\\""}')], "conv_id long, turn long, role string, text string")
    assert [(r["call_id"], r["content"]) for r in tool_calls.calls_in(messages)[1].collect()] == [(None, "x")]


def test_calls_in_messages(spark):
    messages = spark.createDataFrame([(1, 0, "assistant", 'ok\n{"call": "k", "tool": "find", "arguments": {"q": "v"}, "needs": []}'), (1, 1, "user", '{"result": "k", "content": "done"}'), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    calls, results = tool_calls.calls_in(messages)
    assert [(r["call_id"], r["arguments"]) for r in calls.collect()] == [("k", '{"q":"v"}')] and results.count() == 1


def test_levels_equal_a_plain_order(spark):
    import random

    rng = random.Random(4)
    rows = [(1, f"c{i}", i, "t", "{}", [f"c{i - 1}"] if i else []) for i in range(300)]
    for conv in range(2, 12):
        n = rng.randint(3, 25)
        names = [f"n{i}" for i in range(n)]
        rng.shuffle(names)
        rows += [(conv, names[i], i, "t", "{}", rng.sample(names[: i + (rng.random() < 0.03)], min(i, rng.choice([0, 1, 1, 2, 3])))) for i in range(n)]
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.ordered(calls_frame(spark, rows)).collect()}
    needs, want = {(c, k): [(c, x) for x in ns] for c, k, _, _, _, ns in rows}, {}
    for _ in range(400):
        want |= {k: 1 + max((want[x] for x in ns), default=-1) for k, ns in needs.items() if k not in want and all(x in want for x in ns)}
    assert {k: v for k, v in got.items() if v is not None} == want and got[1, "c299"] == 299


def test_arguments_against_a_plain_check(spark):
    import random

    rng = random.Random(9)
    values = {"string": "s", "integer": 3, "number": 1.5, "boolean": True, "array": [1, "a"], "object": {"b": 1}}
    parameters = [(t, f"p{i}", rng.choice([*values, "odd"]), rng.random() < 0.4) for t in ("one", "two") for i in range(6)] + [("one", "p0", "string", False), ("three", None, None, True), (None, "p0", "string", True)]
    calls = []
    for i in range(300):
        args = {f"p{j}": rng.choice([*values.values(), None, {}]) for j in range(8) if rng.random() < 0.5}
        text = rng.choice([json.dumps(args), json.dumps(args), json.dumps(args), "[1]", "3", "null", "", "{", None])
        calls.append((i % 7, f"c{i}", i, rng.choice(["one", "one", "two", "three", "none", None]), text, []))

    def kind(v):
        return next((k for k, t in (("boolean", bool), ("integer", int), ("number", float), ("string", str), ("array", list), ("object", dict)) if isinstance(v, t)), "null")

    def want(tool, text):
        try:
            args = json.loads(text or "")
        except ValueError:
            args = None
        known = {t for t, *_ in parameters if t is not None}
        out = set() if isinstance(args, dict) else {"arguments: no object"}
        out |= set() if tool in known else {"tool: unknown"}
        if out:
            return sorted(out)
        mine = [p for p in parameters if p[0] == tool and p[1] is not None]
        for name, v in args.items():
            specs = [p for p in mine if p[1] == name]
            out |= set() if specs else {f"{name}: not a parameter"}
            out |= {f"{name}: no {p[2]}" for p in specs if kind(v) != p[2] and (kind(v), p[2]) != ("integer", "number")}
        return sorted(out | {f"{p[1]}: missing" for p in mine if p[3] and p[1] not in args})

    frame = calls_frame(spark, calls).withColumnRenamed("turn", "Given")
    got = tool_calls.argument_faults(frame, spark.createDataFrame(parameters, "tool string, name string, type string, required boolean"))
    assert got.columns == [*frame.columns, "faults"]
    rows = {r["call_id"]: r["faults"] for r in got.collect()}
    assert rows == {c[1]: want(c[3], c[4]) for c in calls}
