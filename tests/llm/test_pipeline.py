"""The pipeline on the smallest tables, stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from folioworks.tables import stored, table
from tests.llm.test_copies import expected_components, expected_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.orderBy("doc_id").collect()
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns
        kept[name] = (before, docs.orderBy("doc_id").collect())
    ids = lambda rows: [r["doc_id"] for r in rows]

    before, after = kept["language identification"]
    assert 0.95 * len(before) <= len(after) <= len(before)

    before, after = kept["line dedup"]
    gone, want = expected_lines([r["text"] for r in before]), {}
    for i, r in enumerate(before):
        left = "\n".join(t for n, t in enumerate(r["text"].split("\n")) if n not in gone.get(i, []))
        if left.split():
            want[r["doc_id"]] = left
    assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = kept["near copies"]
    groups = expected_components([r["text"] for r in before])
    assert ids(after) == [r["doc_id"] for i, r in enumerate(before) if groups[i][1] == i]

    before, after = kept["benchmark decontamination"]
    held = [" ".join(r["text"].split()) for r in table(spark, SF, "benchmark").collect()]
    leaks = {r["doc_id"] for r in before if any(h in " ".join(r["text"].split()) for h in held)}
    assert leaks <= set(ids(before)) - set(ids(after)) and len(after) > 0.8 * len(before)

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(ids(after))


def test_rows_that_share_an_id_lose_nothing(spark):
    from folioworks.llm import line_dedup, ngram_join

    rows = [(0, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (1, "only here and nowhere else at all"), (None, "no id here"), (None, "no id here"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Rank", F.lit(1)).withColumn("own_id", F.lit(2))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    lines = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()), key=repr)
    assert lines == sorted([(0, rows[0][1]), (1, ""), rows[2], rows[3], rows[4], (2, None)], key=repr)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert [(r.doc_id, r.text) for r in sorted(kept.collect(), key=key)] == [rows[0], rows[2], (2, None), rows[3], rows[4]]


def test_columns_named_like_predictions_come_through(spark):
    from folioworks.llm import langid, secrets

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({c: F.lit(42.0) for c in ("Score", "margin", "__language", "lang_pred", "__secrets_text")})
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns and {tuple(r) for r in out.select("Score", "margin", "__language", "lang_pred").distinct().collect()} == {(42.0,) * 4}
    told = langid.identify(docs, langid.fit(docs))
    assert told.columns[-4:] == ["lang_pred", "score", "margin", "ambiguous"] and told.where("score > 1").count() == 0 and "__language" in told.columns
    assert secrets.find_secrets(docs.withColumn("Secrets", F.lit(1))).where("__secrets_text <> 42").count() == 0
