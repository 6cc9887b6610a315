"""Containment against all pairs, reading order against a plain join."""

import random

from folioworks.operators import containment, reading


def test_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for tree in range(12):
        size = rng.choice([1, 2, 60, 200])
        parents = [0] + [rng.choice([i - 1, rng.randrange(i)]) if rng.random() < 0.9 else 0 for i in range(1, size)] if tree else [max(0, i - 1) for i in range(300)]  # the first is one long path
        kids = {}
        for i, p in enumerate(parents[1:], 1):
            kids.setdefault(p, []).append(i)
        count = [0]

        def walk(root):
            stack, spans = [(root, False)], {}
            while stack:
                n, done = stack.pop()
                if done:
                    spans[n][1] = count[0]  # noqa: B023
                    continue
                count[0] += 1  # noqa: B023
                spans[n] = [count[0], 0]  # noqa: B023
                stack += [(n, True), *[(k, False) for k in reversed(kids.get(n, []))]]  # noqa: B023
            return spans

        rows += [(None if tree == 11 else tree, a, b, rng.choice("abc")) for a, b in walk(0).values()]
    df = spark.createDataFrame(rows, "tree int, pre int, last int, name string")
    of = lambda n: df.where(f"name = '{n}'")
    got = sorted((r.tree, r.holder.pre, r.held.pre) for r in containment.pairs(of("a"), of("b"), ["tree"]).collect())
    want = sorted((t, p, q) for t, p, e, n in rows for u, q, _, m in rows if t is not None and t == u and n == "a" and m == "b" and p < q <= e)
    assert got == want and len(want) > 1000
    first, inner = {}, {}
    for t, p, q in want:
        first[t, p] = min(first.get((t, p), q), q)
        inner[t, q] = max(inner.get((t, q), p), p)
    assert {(r.tree, r.pre): r.held.pre for r in containment.first_in(of("a"), of("b"), ["tree"]).collect()} == first
    assert {(r.tree, r.pre): r.holder.pre for r in containment.innermost(of("b"), of("a"), ["tree"]).collect()} == inner
    assert containment.pairs(df.where("false"), df, ["tree"]).count() == containment.pairs(df, df.where("false"), ["tree"]).count() == 0


def test_reading_order(spark):
    elements = spark.createDataFrame(
        [(1, 1, 1, None, [(0, None), (1, 2)]), (1, 2, None, 1, [(2, None)]), (1, 3, None, None, [(3, None), (4, 1)]), (1, 4, 1, None, [(0, None)]), (2, 1, 1, None, [])], "doc_id int, pre int, page int, above int, marks array<struct<mcid:int,page:int>>"
    )
    refs = reading.marked_refs(elements)
    assert sorted(map(tuple, refs.collect())) == [(1, 1, 0, 0), (1, 1, 0, 4), (1, 1, 2, 2), (1, 1, 4, 3), (1, 2, 1, 1)]
    run = lambda page, at, text, open_, top: (1, page, 600.0, at, text, open_, top, top + 10, 10.0 * at, 10.0 * at + 5)
    runs = [run(1, 1, "Two", [2], 50.0), run(1, 2, "words", [7, 2, None], 52.0), run(1, 3, " ", [2], 0.0), run(1, 4, "No tag", [5], 0.0), run(1, 5, "Outside", [], 0.0), run(1, 6, "Zero at the end", [None, 0], 10.0), run(1, 7, "Four", [4], 90.0), run(2, 1, "Alone", [1], 0.0)]
    df = spark.createDataFrame(runs, "doc_id int, page int, width double, ord int, text string, open array<int>, top double, bottom double, left double, right double")
    blocks = reading.placed_blocks(refs, df)
    assert sorted((r.page, r.ord, r.text, r.top, r.bottom, r.left, r.right) for r in blocks.collect()) == [(1, 2, "Two words", 50.0, 62.0, 10.0, 25.0), (1, 3, "Four", 90.0, 100.0, 70.0, 75.0), (1, 4, "Zero at the end", 10.0, 20.0, 60.0, 65.0), (2, 1, "Alone", 0.0, 10.0, 10.0, 15.0)]
    docs = spark.createDataFrame([(1, True), (2, True), (3, False)], "doc_id int, tagged boolean")
    got = sorted((r.doc_id, r.page, r.severity, r.reason, r.earlier, r.later) for r in reading.sequence_findings(docs, blocks).collect())
    assert got == [(1, 1, "partial", "inverted", "Four", "Zero at the end"), (2, None, "partial", "unmatched", None, None), (3, None, "blocking", "untagged", None, None)]
    columns = spark.createDataFrame([(1, 1, i, 600.0, i, f"Block {i}", 20.0 * (i % 4), 20.0 * (i % 4) + 9, 320.0 * (i // 4), 320.0 * (i // 4) + 250) for i in range(8)], "doc_id int, page int, mcid int, width double, ord int, text string, top double, bottom double, left double, right double")
    assert [(r.reason, r.columns) for r in reading.sequence_findings(docs.where("doc_id = 1"), columns).collect()] == [("columns", 2)]
