"""Merkle proofs, repaired conversations and main texts against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from folioworks import scans
from folioworks.llm import html_text, merkle, queries, repair

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
SF = "/root/testdata/sf0.001"


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: SHA("".join(map(enc, r)))
    low = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def climb(nodes, paths):
        """nodes: digest, leaves below; paths by leaf get the siblings left and right."""
        while len(nodes) > 1:
            up = []
            for i in range(0, len(nodes), 8):
                run = nodes[i : i + 8]
                for j, (_, below) in enumerate(run):
                    for x in below:
                        paths[x].append((run, j))
                up.append((SHA("".join(d for d, _ in run)), [x for _, b in run for x in b]))
            nodes = up
        return nodes[0]

    paths, tops, out = {i: [] for i in range(len(rows))}, [], {}
    for lang in sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode())):
        mine = [i for i, r in enumerate(rows) if r[2] == lang]
        mine.sort(key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf(rows[i])))
        tops.append(climb([(leaf(rows[i]), [i]) for i in mine], paths))
    root = climb(tops, paths)[0] if tops else None
    subroots = {i: d for d, below in tops for i in below}
    for i, r in enumerate(rows):
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        at = leaf((*r[:4], low(r[4]))) if bad else leaf(r)
        for run, j in paths[i]:
            at = SHA("".join(at if k == j else d for k, (d, _) in enumerate(run)))
        proof = SHA("".join(d for run, j in paths[i] for k, (d, _) in enumerate(run) if k != j))
        out.setdefault((r[0], leaf(r)), []).append((subroots[i], root, proof, at, at == root))
    return out


@pytest.mark.parametrize("size", [0, 1, 9, 150])
def test_manifest_equals_plain_trees(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [(i, rng.choice([None, "web", ""]), rng.choices([None, "", "de", "en", f"x{i}"], [1, 1, 4, 9, 1])[0], rng.choice([None, i]), rng.choice([None, "", "Ein Text", "été A", "plain"])) for i in range(size)]
    if size > 9:
        rows += [rows[3], rows[3], (None, "s", "en", 1, "No id"), (5, "other", rows[5][2], 1, "Same id"), *[(7, "w", "en", 1, "copy")] * 20]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumn("leaf", F.lit(1)).withColumn("TREE", F.lit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.op11_merkle(spark, str(tmp_path)).collect():
        got.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified))
    want = plain_manifest(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    if size == 150:
        flags = {x[-1] for v in got.values() for x in v}
        assert flags == {True, False}


def test_manifest_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = {(r.doc_id, r.leaf): [(r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)] for r in queries.op11_merkle(spark, SF).collect()}
    assert got == plain_manifest(rows)


def plain_repair(rows):
    """All of op12 for (conv_id, turn, role, text) rows, by a fold over rows and states that keeps whole letter strings."""
    convs = {}
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        how, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        mine = convs.setdefault(c, [])
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            mine += [(t, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = {}
    for c, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        due = {"": "u", "s": "u", "u": "a", "a": "u"}
        # best[state]: cost, letters, repaired lines of rows i to the end
        best = {"": (0, "", []), "s": (6, "II", ["user:", "assistant:"]), "u": (3, "I", ["assistant:"]), "a": (0, "", [])}
        names = {"u": "user", "a": "assistant"}
        for (_, role, text), fault in zip(reversed(mine), reversed(faults), strict=True):
            extra, new = 3 * (fault == "truncated"), {}
            for q in best:
                options = [(4 + best[q][0], "D" + best[q][1], best[q][2])]
                if fault not in ("blank", "duplicate"):
                    to = best[due[q]]
                    options.append((3 + extra + to[0], "R" + to[1], [f"{names[due[q]]}:{text}", *to[2]]))
                    for x in {role[:1]} & ({due[q]} | ({"s"} if q == "" else set())):
                        options.append((extra + best[x][0], "K" + best[x][1], [f"{role}:{text}", *best[x][2]]))
                new[q] = min(options)
            for _ in range(4):
                for q in new:
                    to = new[due[q]]
                    new[q] = min(new[q], (3 + to[0], "I" + to[1], [f"{names[due[q]]}:", *to[2]]))
            best = new
        turns = [t for t, _, _ in mine if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        cost, letters, lines = best[""]
        count = lambda x: faults.count(x)  # noqa: B023, E731
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, SHA("\n".join(lines)))
    return out


def repaired_by_spark(spark, folder, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.withColumn("conv", F.lit(1)).withColumn("RANK", F.lit(2)).write.parquet(f"{folder}/conversations.parquet")
    got = queries.op12_repair(spark, str(folder)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def conversations(rng, count, longest):
    texts = ["", " \t", "Yes.", "no", "What? ", "Really!\n", "…", "A long one. And more", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]
    return [(c, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice([*texts, f"text {c} {t}.", f"cut {t}"])) for c in [*range(count), None] for t in range(rng.randrange(1, longest))]


def test_repair_equals_a_plain_fold(spark, tmp_path):
    rows = conversations(random.Random(5), 120, 14)
    assert repaired_by_spark(spark, tmp_path, rows) == plain_repair(rows)


def test_long_conversations_are_folded_in_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 5)
    monkeypatch.setattr(scans, "FAN", 2)
    rng = random.Random(6)
    rows = conversations(rng, 5, 9) + [(99, t, rng.choice(["user", "assistant", "system"]), rng.choice(["", "Same.", f"Row {t}.", f"cut {t}"])) for t in range(230)]
    assert repaired_by_spark(spark, tmp_path, rows) == plain_repair(rows)


def test_repair_of_nothing_and_of_the_tables(spark, tmp_path):
    assert repaired_by_spark(spark, tmp_path, []) == {}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in queries.op12_repair(spark, SF).collect()} == plain_repair(rows)


def test_cut_is_the_cheapest():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(1, 9)
        odds = [rng.choice([-3, -1, -0.5, 0.5, 1, 4]) for _ in range(n)]
        edges = [(i, j, rng.choice([0.3, 0.6, 2.0])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        cost = lambda side: sum(abs(o) for o, s in zip(odds, side, strict=True) if s != (o > 0)) + sum(c for i, j, c in edges if side[i] != side[j])  # noqa: B023, E731
        least = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.cut(odds, edges)) == pytest.approx(least)


CASES = {
    "plain": ("<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>two</b>\n three.<p>Four.</article><footer>&copy; us</footer>", "A & B One two three. Four."),
    "no article": ("<body><div id=top-menu><ul><li><a href=a>News</a><li><a href=b>Sport</a></ul></div><div class='content'><h2>Head line</h2><p>" + "A sentence of words that goes on. " * 5 + "</p><p>" + "And one more of them here. " * 5 + "</p></div><div class=sidebar>Most read</div>", "Head line " + ("A sentence of words that goes on. " * 5) + ("And one more of them here. " * 5).strip()),
    "inside": ("<article><header><h1>Title</h1></header><p>First.</p><div class=ad>Buy now.</div><aside>See also this.</aside><p>Second.</p><form><label>Name</label><input></form><section id=comments><article class=comment><p>I disagree.</p></article></section></article>", "Title First. Second."),
    "open parts": ("<div class=ad>Buy<article><p>Text <a href='x'>with a link</a> in it.<script>var a = '<p>no</p>';</script><style>p{}</style><!-- c <p>no</p> --><p>End.", "Text with a link in it. End."),
    "cookies": ("<body><p class='cookie-notice'>We use cookies. They are good for you.</p><main><h1>Main</h1><p>The text, which is long enough to be one.</p><ul><li>a point<li>another</ul></main><p>Unmarked words beside it</p>", None),
    "odd": ("<p>5 < 6 &amp; 7 > 3</p><a title=\"never closed", None),
    "only text": ("Just words. No tags here.", None),
    "nothing": ("", ""),
    "script only": ("<script>x()", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text_of_small_pages(name):
    source, want = CASES[name]
    got = html_text.main_text(source, html_text.PRIOR)
    if want is not None:
        assert got == want
    assert "cookies" not in got and "<p>" not in got


def test_main_text_of_the_tables(spark, tmp_path):
    import html as plain

    got = {r.page_id: r for r in queries.op13_main_text(spark, "/root/testdata/sf0.01").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", plain.unescape(x)).strip() for x in re.split(r"</?(?:p|h1|br)>", article.replace("<b>", ""))]
        want = " ".join(x for x in blocks if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_pages_of_any_shape(spark):
    long = "<article>" + "<p>A sentence with words.</p>" * 20000 + "</article>"
    rows = [(1, None), (2, ""), (2, ""), (3, long), (4, "<" * 50000), (5, "<a \"" * 20000), (6, "<div>" * 5000 + "deep"), (7, "&" * 1000)]
    df = spark.createDataFrame(rows, "page_id int, html string").withColumn("Text", F.lit("old"))
    got = {r.page_id: r.text for r in html_text.extract(df, html_text.PRIOR).collect()}
    assert got[1] == got[2] == "" and got[3].count("sentence") == 20000 and len(got) == 7
    assert html_text.extract(df, html_text.PRIOR).columns == ["page_id", "html", "text"]
    empty = df.where("false")
    assert html_text.extract(empty, html_text.fit(empty)).count() == 0
    assert (html_text.fit(empty) == html_text.PRIOR).all()


def test_manifest_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    told = c.execute(queries.ORACLE_SQL["op11_merkle"])
    names = [d[0] for d in told.description]
    want = sorted(told.fetchall())
    df = queries.op11_merkle(spark, SF)
    assert sorted(names) == sorted(df.columns) and sorted(map(tuple, df.select(*names).collect())) == want and len(want) == 200
