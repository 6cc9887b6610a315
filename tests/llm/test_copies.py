"""Similarity joins against all pairs."""

import random
import re
from collections import defaultdict

from folioworks.llm import line_dedup, ngram_join


def near_texts(seed, n, words=(1, 60), alphabet=40):
    """Random texts, with copies that are edited a little, and passages in common."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(alphabet)) if rng.random() < 0.3 else "x" + str(rng.randrange(10**6))
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.55:
            t = rng.choice(out).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [word()], [t[i], word()], [t[i].upper()]]) or ["z"]
        else:
            t = [word() for _ in range(rng.randint(*words))] + (passage if rng.random() < 0.3 else [])
        out.append(" ".join(t))
    return out


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected_components(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def linked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc"]: (r["n_shingles"], r["component"]) for r in ngram_join.link_documents(df).collect()}


def test_components_equal_all_pairs(spark):
    texts = near_texts(1, 260) + near_texts(2, 120, (150, 400)) + near_texts(3, 150, (1, 9), 4)
    texts += [None, "", " \n\t", "one", "ONE", "one  two", "\x0bone\rtwo\x0c", "É a b c d", "é a b c d", "a b c d e f", "a b c d e"]
    assert linked(spark, texts) == expected_components(texts)


def test_large_groups_of_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(base)] * 60
    for _ in range(120):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    assert linked(spark, texts) == expected_components(texts)


def test_crowds_of_documents(spark, monkeypatch):
    """Passages that most documents share, near copies of two texts, signatures dealt to several windows."""
    monkeypatch.setattr(ngram_join, "MANY", 4)
    monkeypatch.setattr(ngram_join, "DEALT", 3)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.choice([2, 5, 18, 80]))]) for _ in range(90)]
    for base in ([f"b{i}" for i in range(80)], [f"b{i}" for i in range(40)] + [f"c{i}" for i in range(40)]):
        for _ in range(60):
            edited = list(base)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    assert linked(spark, texts) == expected_components(texts)


def test_hashes_do_not_hang_on_where_a_word_is(spark):
    words = ["alpha", "beta", "g" * 700_000, "delta", "eps", "zeta"]
    a = ngram_join.shingles(" ".join(words))
    b = ngram_join.shingles("  \n" + "\r\n".join(words) + "\x0b")
    c = ngram_join.shingles("pad " * 400_000 + " ".join(words))
    assert len(a) == 2 and (a == b).all() and set(a) <= set(c)


def test_functions_that_hash_words_are_small(spark):
    """They travel by value with every step of a job and wait in the driver meanwhile."""
    from pyspark import cloudpickle

    assert len(cloudpickle.dumps(ngram_join.shingles)) < 1 << 20
    words = [f"word{i}" for i in range(9000)]
    a, b = (ngram_join.shingles(start + " ".join(words)) for start in ("", "  " * 5000))
    assert len(a) == 8996 and (a == b).all()


def test_near_copies_meet_once(spark, monkeypatch):
    """Each with two or three words changed, they agree in many parts: a pair is a row, not a row for each of these."""
    monkeypatch.setattr(ngram_join, "MANY", 4)
    kept = []
    stored = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name="part": kept.append((name, stored(df, name))) or kept[-1][1])
    rng, base, texts = random.Random(8), [f"b{i}" for i in range(150)], []
    for _ in range(40):
        edited = list(base)
        for i in rng.sample(range(150), rng.choice([2, 3])):
            edited[i] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(edited))
    assert linked(spark, texts) == expected_components(texts)
    parts = next(df for name, df in reversed(kept) if name == "parts")
    apart = parts.withColumn("group", parts["doc"])
    met = [(r["a"], r["b"]) for r in ngram_join.crowd_pairs(apart, 75).collect()]
    sets = [shingles(t) for t in texts]
    similar = {(a, b) for b in range(40) for a in range(b) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert similar and similar <= set(met) and 100 < len(set(met)) <= len(met) < 1.2 * len(set(met))


def test_one_of_each_keeps_columns(spark):
    df = spark.createDataFrame([(3, "a b c d e f", 1, "p"), (1, "a b c d e f", 2, "q"), (None, "a b c d e f", 3, "r"), (7, None, 4, "s")], "doc_id long, text string, n int, component string")
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns and sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 1, 7]
    clash = df.withColumnsRenamed({"n": "doc", "component": "_doc"})
    assert ngram_join.one_of_each(clash).columns == clash.columns and ngram_join.one_of_each(clash).count() == 3
    assert ngram_join.link_documents(df.limit(0)).count() == 0


def line_sets(text):
    for no, line in enumerate((text or "").split("\n")):
        w = [x for x in re.sub("[\t\x0b\f\r]", " ", line.lower()).split(" ") if x]
        if w:
            yield no, frozenset(w)


def expected_lines(texts, similar=line_dedup.SIMILAR):
    seen, out = [], defaultdict(set)
    for doc, text in enumerate(texts):
        for no, s in line_sets(text):
            if any(len(s & t) >= similar * len(s | t) - 1e-9 for t in seen):
                out[doc].add(no)
            seen.append(s)
    return {d: sorted(v) for d, v in out.items()}


def removed_lines(spark, texts, similar=line_dedup.SIMILAR):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in line_dedup.later_copies(df, similar=similar).collect():
        got[r["doc"]].append(r["no"])
    return {d: sorted(v) for d, v in got.items()}


def test_lines_equal_all_pairs(spark):
    rng = random.Random(9)
    pool = near_texts(11, 150, (1, 30)) + ["Same line.", "same  LINE.", "", "  ", "a b c d e", "a b c d e f", "É x\ty", "é x y"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(80)] + [None, "", "\n\n"]
    for similar in (0.9, 0.75):
        assert removed_lines(spark, texts, similar) == expected_lines(texts, similar)


def test_one_word_in_twelve(spark):
    twelve = "one two three four five six seven eight nine ten eleven twelve"
    texts = [twelve, twelve.replace("six", "other"), twelve.replace("twelve", "")]
    assert removed_lines(spark, texts, 0.84) == {1: [0], 2: [0]} and removed_lines(spark, texts) == {2: [0]}


def test_crowds_of_lines(spark, monkeypatch):
    """Lines that share a passage, edited copies of one line, small vocabularies and long lines, with crowds from five lines on."""
    monkeypatch.setattr(line_dedup, "MANY", 4)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(30)]
    lines = [" ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 4, 30]))]) for _ in range(60)]
    base = [f"b{i}" for i in range(60)]
    for _ in range(80):
        edited = list(base)
        for _ in range(rng.randint(0, 5)):
            edited[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        lines.append(" ".join(edited))
    lines += [" ".join(f"s{rng.randrange(14)}" for _ in range(rng.randint(8, 40))) for _ in range(120)]
    long = [f"l{i}" for i in range(3000)]
    lines += [" ".join(long), " ".join(long[:2800]), " ".join(long[400:])]
    rng.shuffle(lines)
    for similar in (0.9,):
        assert removed_lines(spark, lines, similar) == expected_lines(lines, similar)


def test_dropping_lines(spark):
    df = spark.createDataFrame([(1, "keep me here now\nsecond line", "x"), (2, "SECOND   line\nthird\n", "y"), (3, None, "z"), (None, "third", "w")], "doc_id long, text string, no string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert out == {1: "keep me here now\nsecond line", 2: "third\n", 3: None, None: "third"}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "no as gone", "1 as doc", "2 as n", "3 as line")
    left = line_dedup.dedup_lines(clash)
    assert left.columns == clash.columns and {r["doc_id"]: r["text"] for r in left.collect()} == out
