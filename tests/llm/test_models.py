"""Packing, languages, toxicity, neighbours: round trips, held-out accuracy, brute force."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import public_tokenizers
from folioworks.llm import ann, langid, packing, toxicity

SYLLABLES = {"aa": "ka lo mi te su", "bb": "schr eng ung heit ver", "cc": "eau oir que ment tion"}


def made_up(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_packing_is_a_partition_of_all_ids(spark):
    rng = random.Random(3)
    texts = [None, "", "é€😀 x", "<|endoftext|> a", "  spaces   and\n\ttabs ", "x" * 3000, " " * 1_000_000 + "a", "y" * 100_000] + [made_up(rng, "aa", rng.choice([1, 30, 700, 3000])) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, length int").repartition(2)
    pieces = packing.pack_documents(df).toPandas()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = pieces[pieces.doc_id == i].sort_values("start")
        mine = mine if i != 3 else mine.drop_duplicates("start")
        assert (mine.doc_tokens == len(ids)).all() and mine.length.sum() == len(ids)
        at = 0
        for r in mine.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all()
        total = s.length.sum()
        assert total <= 1024 and total & (total - 1) == 0
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_step_groups_are_balanced(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, made_up(rng, "aa", rng.choice([3, 20, 90, 400, 2000]))) for i in range(700)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack_documents(df, group=8).toPandas()
    groups = pieces.groupby(["tier", "step_group"]).agg(n=("sequence_id", "nunique"), pieces=("length", "size")).reset_index()
    assert groups.step_group.is_unique
    full = groups[groups.tier == 1024]
    most = pieces[pieces.tier == 1024].groupby("sequence_id").size().max()
    assert len(full) >= 50 and full.n.max() == 8
    assert full.pieces.max() <= max(full.pieces.mean() + 2, most + 1) and full.pieces.min() >= full.pieces.median() - 3


def test_fast_ids_equal_the_vocabulary(spark):
    rng = random.Random(4)
    pool = "aàé ñ\n\t  0123!?.,'’\"€😀漢字العربيةßẞ​ \x00-_/\\"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.byte_bpe()(texts) == [exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_language_codes_are_apart():
    for n in (2, 3, 4, 7, 20):
        code = langid.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= code.shape[1] // 4


def test_language_of_held_out_texts(spark):
    rng = random.Random(6)
    rows = [(i, made_up(rng, lang, rng.randint(5, 60)), lang, "s") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=240))]
    rows += [(900, None, "aa", "s"), (901, "123 !!", "aa", "s"), (902, "", None, "s"), (903, "½ ² _", "aa", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df.where("doc_id % 3 <> 0"))
    told = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    held = [r for r in rows[:240] if r[0] % 3 == 0]
    assert sum(told[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert {told[i]["lang_pred"] for i in (900, 901, 902, 903)} == {"und"} and all(0 <= r["score"] <= 1 for r in told.values())
    none = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(8)
    bad = ["vilexor", "grumbot", "hatzen"]
    docs, labels = [], []
    for i in range(400):
        words = made_up(rng, "aa", 40).split()
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(40), rng.choice(bad))
        docs.append((i, " ".join(words), "p"))
        labels.append((i, 1, toxic))
    docs += [(900, None, "p"), (901, "", "p")]
    df = spark.createDataFrame(docs, "doc_id long, text string, predicted string")
    lab = spark.createDataFrame(labels + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df.where("doc_id % 3 <> 1"), lab.where("doc_id % 3 <> 1"))
    told = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    held = [r for r in labels if r[0] % 3 == 1]
    assert sum(told[i]["predicted"] == t for i, _, t in held) >= 0.95 * len(held)
    assert told[900]["score"] == told[901]["score"] < 0.7
    empty = toxicity.fit(df, lab.limit(0))
    assert max(r["score"] for r in toxicity.score_documents(df, empty).collect()) < 0.01


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 32))
    x[40] = x[700]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2100, [0.0] * 32, 1), (2200, [float("nan")] + [1.0] * 31, 1), (None, x[0].tolist(), 1), (2300, [None] + [1.0] * 31, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = ann.nearest(df, every=20, k=10, sample=500).toPandas()
    x32, hits = x.astype(np.float32).astype(float), 0
    for q in range(0, 900, 20):
        d = np.sqrt(((x32 - x32[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(mine.score, d[mine.vec_id]) and (np.diff(mine.score) >= 0).all()
        hits += len(set(np.argsort(d)[:10]) & set(mine.vec_id))
    assert set(got.query_id) == set(range(0, 900, 20)) and hits >= 0.9 * 450
    few = ann.nearest(df.where("vec_id < 5"), every=2, k=10).toPandas()
    assert (few.groupby("query_id").size() == 4).all()
    assert ann.nearest(df.limit(0), every=2).count() == 0


def test_neighbours_in_many_cells_and_ties(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 24)), 6, axis=0)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    # Every row asks; 15 vectors a block at most, so 16 blocks by 16; every vector has five equal ones, in the order of their ids.
    got = ann.nearest(df, every=1, k=5, sample=200, most=15).toPandas().sort_values(["query_id", "rank"])
    for q, found in got.groupby("query_id"):
        assert list(found.vec_id) == [i for i in range(q // 6 * 6, q // 6 * 6 + 6) if i != q] and (found.score == 0).all()
    assert got.query_id.nunique() == 240
    assert ann.nearest(df.limit(200), every=5000, k=5).where("query_id <> 0").count() == 0


def test_language_sample_comes_row_by_row(spark, monkeypatch):
    """The driver holds the features of the sample once, not as rows and as a matrix."""
    from folioworks.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kind, most = type(docs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: most.append(len(out := collect(self))) or out)
    model = langid.fit(docs)
    assert len(model.languages) == docs.select("lang").where("lang is not null").distinct().count() and max(most) <= 1
