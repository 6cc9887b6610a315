"""Rules on small cases, and folds against plain Python."""

import dataclasses
import math
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from folioworks.functions import colour, language, phrases, text
from folioworks.operators import findings, headings, lifecycle, painted, pdf, triage
from folioworks.plans import catalog
from folioworks.sources import trees
from folioworks.sources import word as word_source


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def rgb(r, g, b):
    return F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))


def test_colours(spark):
    r = one(
        spark, a=colour.parse_hex(F.lit("#f00")), b=colour.parse_hex(F.lit("00ff7F")), c=colour.parse_hex(F.lit("auto")), d=colour.parse_hex(F.lit("12345")),
        x=colour.contrast(rgb(0, 0, 0), rgb(255, 255, 255)), y=colour.contrast(rgb(118, 118, 118), rgb(255, 255, 255)), z=colour.contrast(rgb(119, 119, 119), rgb(255, 255, 255)),
        m=colour.minimum_ratio(F.lit(14.0), F.lit(True)), n=colour.minimum_ratio(F.lit(17.5), F.lit(False)), o=colour.minimum_ratio(F.lit(18.0), F.lit(False)),
        f=colour.format_ratio(F.lit(4.499)), g=colour.format_ratio(F.lit(21.0)), h=colour.format_ratio(F.lit(4.5)),
    )
    assert tuple(r["a"]) == (255, 0, 0) and tuple(r["b"]) == (0, 255, 127) and r["c"] is None and r["d"] is None
    assert round(r["x"], 9) == 21 and r["y"] >= 4.5 > r["z"] and (r["m"], r["n"], r["o"]) == (3.0, 4.5, 3.0)
    assert (r["f"], r["g"], r["h"]) == ("4.49:1", "21:1", "4.5:1")


def test_phrases_and_sentences(spark):
    hits = lambda f, s: [(h["kind"], h["phrase"]) for h in one(spark, h=f(F.lit(s)))["h"]]
    assert hits(phrases.sensory_hits, "Click the button on the left. The lamp is on the left.") == [("position", "on the left")]
    assert hits(phrases.sensory_hits, "Press the round button when you hear a tone.") == [("shape", "round button"), ("sound", "when you hear a")]
    assert hits(phrases.colour_hits, "Required fields are marked in red.")[0][1].lower().endswith("red")
    assert hits(phrases.colour_hits, "Green, amber or red.") == [] and hits(phrases.colour_hits, "Green, amber or red shows the status.") == [("colour", "Green, amber or red")]
    assert hits(phrases.colour_hits, "He coloured édred things.") == []
    assert one(spark, s=text.sentences(F.lit("See 2.1 now. Then go! “Yes.” done. ok")))["s"] == ["See 2.1 now.", "Then go!", "“Yes.” done. ok"]


def test_text_rules(spark):
    r = one(
        spark, a=text.scrub_quotes(F.lit("x “a\nb” y “c”")), b=text.money(F.lit(0)), c=text.money(F.lit(4900)), d=text.money(F.lit(4950)), e=text.stem(F.lit("a.b.docx")), f=text.stem(F.lit(".x")),
        g=text.upload_problem(F.lit("a.PDF"), F.lit(9), F.lit("25504446")), h=text.upload_problem(F.lit("a.pdf"), F.lit(9), F.lit("504b0304")), i=text.normalised_draft(F.lit("“image of a cat”")), j=text.normalised_draft(F.lit("Sorry, no")),
        k=F.length(text.normalised_draft(F.repeat(F.lit("word. "), 80))), l=text.is_refusal(F.lit(" cannot describe ")), m=text.email_problem(F.lit("a@b")), n=text.password_problem(F.lit("😀" * 12), F.lit("a@b.c")),
    )
    assert r["a"] == "x [removed] y [removed]" and (r["b"], r["c"], r["d"]) == ("Free", "$49", "$49.50") and (r["e"], r["f"]) == ("a.b", ".x")
    assert r["g"] is None and r["h"] == "wrong-content" and r["i"] == "A cat" and r["j"] == "" and 125 < r["k"] <= 250 and r["l"] and r["m"] == "malformed" and r["n"] is None


def test_languages(spark):
    rows = [("el perro de la casa que los niños y las niñas no se lo con para una por el del al su en la es", "es"), ("the cat of the house and to in a is that for it as with on be this by are", None), ("le la", None), ("你好世界你好世界你好世界", "zh"), ("こんにちは世界こんにちは世界", "ja"), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["detected"] for r in language.detect_language(df, "t", F.lit("en")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]


def test_heading_folds(spark):
    rng = random.Random(1)
    docs = [[rng.randint(0, 6) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    df = spark.createDataFrame([(d, i, v) for d, levels in enumerate(docs) for i, v in enumerate(levels)], "doc_id int, ord int, level int")
    up = {(r["doc_id"], r["ord"]): r["corrected"] for r in headings.pulled_up(df.where("level > 0")).collect()}
    carried = {(r["doc_id"], r["ord"]): r["carried"] for r in headings.carried(df).collect()}
    for d, levels in enumerate(docs):
        before, last = None, 1
        for i, v in enumerate(levels):
            last = v or last
            assert carried[d, i] == last
            if v:
                before = v if before is None else min(v, before + 1)
                assert up[d, i] == before


def test_assessment(spark):
    jobs = spark.createDataFrame([(1, "docx"), (2, "docx"), (3, "pdf")], "job_id long, format string")
    rows = [(1, "image-alt", "partial", False, None), (1, "pdf-no-text", "blocking", False, None), (2, "contrast", "partial", True, None), (2, "link-text", "partial", False, "dismiss")]
    found = spark.createDataFrame(rows, "job_id long, kind string, severity string, remediated boolean, action string")
    confirmed = spark.createDataFrame([(2, c) for c in catalog.REVIEWER], "job_id long, criterion string")
    all_ = findings.assess_all(jobs, found, confirmed)
    status = {(r["job_id"], r["criterion"]): r["status"] for r in all_.collect()}
    assert len(status) == 114 and status[1, "1.1.1"] == "Does Not Support" and status[2, "1.4.3"] == status[2, "2.4.4"] == "Supports" and status[3, "1.4.1"] == "Needs Review" and status[1, "2.4.1"] == "Not Applicable"
    summary = {r["job_id"]: r for r in findings.summarise(all_).collect()}
    assert summary[2]["conforms"] and not summary[3]["conforms"] and summary[3]["review"] == 4 and (summary[1]["owed"], summary[1]["blocking"], summary[1]["other"]) == (34, 1, 1)


def test_columns_and_inversions(spark):
    def blocks(rows):
        return spark.createDataFrame([("d", 1, 1000.0, i, *r) for i, r in enumerate(rows)], "doc_id string, page int, width double, ord int, top double, bottom double, left double, right double")

    two = blocks([(i * 30.0, i * 30.0 + 20, x, x + 400) for x in (50.0, 550.0) for i in range(3)])
    assert painted.count_columns(two).first()["columns"] == 2
    order = blocks([(500.0, 520.0, 100.0, 900.0), (100.0, 120.0, 100.0, 900.0), (600.0, 620.0, 100.0, 900.0)])
    r = painted.first_inversions(order).first()
    assert (r["earlier"], r["later"]) == (0, 1) and painted.first_inversions(blocks([(100.0, 120.0, 1.0, 2.0), (98.0, 118.0, 3.0, 4.0)])).count() == 0


def test_prices_and_tiers(spark):
    work = spark.createDataFrame([(1, "docx", None, 12), (2, "pdf", "scan", 0), (3, "pdf", "untagged", 0), (4, "pdf", "tagged", 10)], "job_id int, format string, tier string, figures int")
    quoted = triage.quotes(work)
    got = {(r["job_id"], r["offer"]): r["cents"] for r in quoted.collect()}
    assert got[1, "remediation"] == 15500 and got[2, "statement"] is None and got[3, "statement"] == 4900 and got[3, "remediation"] is None and got[4, "remediation"] == 9900 and got[2, "assessment"] == 0
    assert {r["job_id"]: r["offer"] for r in triage.best_offers(quoted).collect()} == {1: "remediation", 2: "assessment", 3: "statement", 4: "remediation"}


def test_retention_and_sessions(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    s = F.lit
    n = F.lit(None).cast("string")
    due = lambda *a: lifecycle.due(*a)[0]
    r = one(
        spark, a=lifecycle.days_left(due(n, s("2024-01-08 00:00:00"), n, n), now), b=lifecycle.expired(due(n, n, s("x"), s("2020-01-01 00:00:00")), now), c=lifecycle.expired(due(s("junk"), n, n, n), now),
        d=lifecycle.session_state(s("2024-01-09 23:00:00"), s("2024-01-09 23:40:00"), now), e=lifecycle.session_state(s("bad"), s("2024-01-09 23:40:00"), now), f=lifecycle.session_state(s("2024-01-09 23:00:00"), s("2024-01-09 23:30:00"), now),
        g=lifecycle.reset_state(s("2024-01-09 23:30:00"), n, now), h=lifecycle.reset_state(s("2024-01-09 23:31:00"), s("u"), now),
    )
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"], r["g"], r["h"]) == (1, False, True, "active", "expired", "idle", "expired", "used")


def test_word_archives_round_trip(spark):
    from folioworks.operators import word
    from folioworks.sources import word as source

    rows = [(1, "T", "en", ["Top <&>", "plain", "Deep"], [1, 0, 3]), (2, None, None, ["x"] * 20, [0] * 20), (3, None, "fr", [], [])]
    df = spark.createDataFrame(rows, "doc_id long, title string, lang string, lines array<string>, levels array<int>")
    files = df.select("doc_id", source.archive(F.col("title"), F.col("lang"), F.col("lines"), F.col("levels")).alias("content"))
    files = files.union(spark.createDataFrame([(4, bytearray(b"no archive")), (5, None)], "doc_id long, content binary"))
    parts = source.parts_of(files)
    assert {r["doc_id"] for r in parts.where("error is not null").collect()} == {4, 5}
    nodes = source.nodes_of(parts)
    assert [r["text"] for r in word.paragraphs(nodes).where("doc_id = 1").orderBy("pre").collect()] == ["Top <&>", "plain", "Deep"]
    got = {(r["doc_id"], r["kind"], r["location"]) for r in word.detect(nodes).collect()}
    assert got == {(1, "heading-skip", "paragraph 3 (“Deep”)"), (2, "no-title", "document properties"), (2, "no-language", "document defaults"), (2, "no-headings", "whole document"), (3, "no-title", "document properties")}


def test_word_rules_as_stated(spark):
    """One case that is found and one that isn't for each kind, as XML."""
    from folioworks.operators import word
    from folioworks.sources import word as source

    r = lambda t, props="": f"<r>{props}<t>{t}</t></r>"
    p = lambda inner, props="": f"<p>{props}{inner}</p>"
    drawing = lambda props: p(f"<r><drawing><inline><docPr {props}/></inline></drawing></r>")
    box = f"<txbxContent>{p(r('Inside'))}</txbxContent>"
    cell = lambda *ps: f"<tc>{''.join(ps)}</tc>"
    row = lambda inner, props="": f"<tr>{props}{inner}</tr>"
    two = cell(p(r("A"))) + cell(p(r("B")))
    faulty = [
        p(r("One"), '<pPr><pStyle val="Kop"/></pPr>'), p(r("Three"), '<pPr><outlineLvl val="2"/></pPr>'), drawing('id="7" name="Logo"'), f"<tbl>{row(two)}</tbl>",
        p(r("Go ") + f"<hyperlink>{r('Click here.')}</hyperlink><hyperlink>{r('www.a.org')}</hyperlink><hyperlink/>"),
        p(r("Pale", '<rPr><color val="999"/></rPr>') + r("plain")), p("<r><audioFile/></r>"), p(f"<sdt>{r('x')}</sdt><r><instrText>FORMCHECKBOX</instrText></r>"),
        p(f"<r><AlternateContent><Choice>{box}</Choice><Fallback>{box}</Fallback></AlternateContent></r>"), p(r("Set aside"), "<pPr><framePr/></pPr>"),
        f"<tbl>{row(cell(p(r('A')), p(r('B'))) + cell(p(r('C'))), '<trPr><tblHeader/></trPr>')}</tbl>", p(r("Press the round button. Errors are shown in red.")), p("<r><chart/></r>"),
    ]
    sound = [
        p(r("Two"), '<pPr><pStyle val="Kop"/></pPr>'), p(r("Two"), '<pPr><outlineLvl val="1"/></pPr>'), drawing('descr="A logo"'), f"<tbl>{row(two, '<trPr><tblHeader/></trPr>')}</tbl>", p(f"<hyperlink>{r('Annual report')}</hyperlink>"),
        p(r("Dark", '<rPr><color val="595959"/><b/></rPr>') + r("plain")), p(r("Pale", '<rPr><color val="8C8C8C"/><sz val="36"/></rPr>')), p("<r><instrText>PAGE</instrText></r>"), p(r(" "), "<pPr><framePr/></pPr>"),
        f"<tbl><tblPr><tblBorders><top val='single'/></tblBorders></tblPr>{row(cell(p(r('A')), p(r('B'))) + cell(p(r('C'))), '<trPr><tblHeader/></trPr>')}</tbl>", p(r("The round tower is red.")),
    ]
    styles = '<styles><docDefaults><rPrDefault><rPr><lang val="en-GB"/></rPr></rPrDefault></docDefaults><style type="paragraph" styleId="Kop"><pPr><outlineLvl val="0"/></pPr></style></styles>'
    rows = [(i, part, xml, None) for i, doc in ((1, faulty), (2, sound)) for part, xml in (("word/document.xml", f"<document><body>{''.join(doc)}</body></document>"), ("word/styles.xml", styles), ("docProps/core.xml", "<core><title>T</title></core>"))]
    rows += [(3, "word/document.xml", "<document><body/></document>", None), (3, "word/settings.xml", '<settings><themeFontLang eastAsia="ja-JP"/></settings>', None), (4, "word/document.xml", "<broken", None)]
    found = word.detect(source.nodes_of(spark.createDataFrame(rows, "doc_id long, part string, xml string, error string"))).orderBy("doc_id", "seq").collect()
    got = [(r["kind"], r["location"], r["detail"]) for r in found if r["doc_id"] == 1]
    assert got == [
        ("image-alt", "image 1 (Logo), paragraph 3", None), ("table-header", "table 1 (“A · B”)", None), ("heading-skip", "paragraph 2 (“Three”)", "3 after 1"),
        ("link-text", "paragraph 6 (“Go Click here.www.a.org”)", "generic: Click here."), ("link-text", "paragraph 6 (“Go Click here.www.a.org”)", "address: www.a.org"), ("link-text", "paragraph 6 (“Go Click here.www.a.org”)", "empty"),
        ("contrast", "paragraph 7 (“Paleplain”)", "#999999 on #FFFFFF, 2.84:1; 4.5:1"), ("media", "recording 1, paragraph 8", None), ("forms", "field 1, paragraph 9 (“x”)", None), ("forms", "field 2, paragraph 9 (“x”)", None),
        ("reading-order", "text box 1 (“Inside”), paragraph 10", None), ("reading-order", "paragraph 11 (“Set aside”)", None), ("layout-table", "table 2", None),
        ("sensory", "paragraph 15 (“Press the round button. Errors are shown in red.”)", "shape: round button"), ("colour-words", "paragraph 15 (“Press the round button. Errors are shown in red.”)", "shown in red"),
        ("colour-only", "paragraph 7 (“Paleplain”)", "#999"), ("chart", "chart 1, paragraph 16", None),
    ]
    assert [r["kind"] for r in found if r["doc_id"] == 2] == [] and [r["kind"] for r in found if r["doc_id"] == 3] == ["no-title"]
    assert [r["anchor"] for r in found if r["anchor"]] == ["docPr:7", "hyperlink:0", "hyperlink:1", "hyperlink:2"]


def test_colours_are_adjusted_a_batch_at_a_time(spark):
    """300,000 rows, some with nulls, equal a plain search for each; evaluated row by row, 20,000 took 62 s."""
    rows = spark.range(300_000).select((F.col("id") * 48_271 % 0x1000000).alias("n"), F.get(F.array(*map(F.lit, (0xFFFFFF, 0, 0x808080, None))), (F.col("id") % 4).cast("int")).alias("on"), F.when(F.col("id") % 3 == 0, 3.0).otherwise(4.5).alias("least"))
    began = time.time()
    got = rows.select("*", colour.adjusted(colour.from_number(F.col("n")), colour.from_number(F.col("on")), F.col("least")).alias("c")).withColumn("kept", F.col("c").eqNullSafe(colour.from_number(F.col("n"))))
    got = got.withColumn("fits", colour.contrast(F.col("c"), colour.from_number(F.col("on"))) >= F.col("least")).groupBy("on").agg(F.count("c").alias("c"), F.count_if("fits").alias("fits"), F.count_if("kept").alias("kept")).collect()
    took = time.time() - began
    got = {r["on"]: tuple(r)[1:] for r in got}
    assert got.pop(None) == (0, 0, 0) and all(c == 75_000 and 0 < kept < c for c, _, kept in got.values()) and got[0][1] == got[0xFFFFFF][1] == 75_000 > got[0x808080][1] and took < 60

    def plain(n, on, least):
        level = lambda v: v / 255 / 12.92 if v / 255 <= 0.03928 else ((v / 255 + 0.055) / 1.055) ** 2.4
        light = lambda c: sum(w * level(v) for w, v in zip((0.2126, 0.7152, 0.0722), c, strict=True))
        split = lambda v: (v >> 16, v >> 8 & 255, v & 255)
        ratio = lambda c: (max(light(c), light(split(on))) + 0.05) / (min(light(c), light(split(on))) + 0.05)
        end, low, high = 0 if light(split(on)) > 0.5 else 255, 0.0, 1.0
        mix = lambda s: tuple(math.floor(v + (end - v) * s + 0.5) for v in split(n))
        for _ in range(24):
            low, high = (low, (low + high) / 2) if ratio(mix((low + high) / 2)) >= least else ((low + high) / 2, high)
        return split(n) if ratio(split(n)) >= least else mix(high)

    few = rows.where("n % 211 = 0 and on is not null").select("*", colour.adjusted(colour.from_number(F.col("n")), colour.from_number(F.col("on")), F.col("least")).alias("c")).collect()
    assert len(few) > 500 and all(tuple(r["c"]) == plain(r["n"], r["on"], r["least"]) for r in few)


def test_colours_are_adjusted(spark):
    white = rgb(255, 255, 255)
    fit = lambda c, least: tuple(one(spark, c=colour.adjusted(c, white, F.lit(least)))["c"])
    pale = fit(rgb(153, 153, 153), 4.5)
    assert 0x70 <= pale[0] < 0x80 and len(set(pale)) == 1 and fit(rgb(0x59, 0x59, 0x59), 4.5) == (0x59,) * 3 and fit(rgb(0x8C, 0x8C, 0x8C), 3.0) == (0x8C,) * 3
    grey = rgb(128, 128, 128)
    assert tuple(one(spark, c=colour.adjusted(rgb(100, 100, 100), grey, F.lit(4.5)))["c"]) == (255, 255, 255)


def test_idle_sessions_as_a_stream(spark, tmp_path):
    from folioworks.streaming import sessions

    rows = spark.sql("select cast(u as long) user_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) ts from values (1, 0), (1, 20), (1, 60), (2, 5), (3, 600) t(u, m)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        sessions.run_available(sessions.idle_sessions(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted((r["user_id"], r["events"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_rules_as_stated(spark):
    """Literal cases of audit, triage, figures and status."""
    actions = ["sign-in.failed", "sign-out", "session.expired", "session.started", "mail.failed", "account.created", "reset.requested", "job.created"]
    events = spark.createDataFrame([("a", x, "2024-01-01 00:00:00") for x in actions], "account string, action string, at string")
    assert lifecycle.history(events).first()["security"] == 5
    facts = spark.createDataFrame([("scan", 2, 1), ("untagged", 0, 3), ("tagged", 4, 0), ("structured", 1, 2)], "tier string, undescribed int, raster_images int")
    assert triage.counts_by_tier(facts).first()["certifiable_percent"] == 50
    assert tuple(triage.figures_mix(facts).first()) == (3, 2, 7)
    jobs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, None)], "job_id long, remediated_at string")
    summary = spark.createDataFrame([(1, True), (2, False), (3, False), (4, False)], "job_id long, conforms boolean")
    touched = spark.createDataFrame([(1,), (2,), (2,)], "job_id long")
    assert {r["job_id"]: r["status"] for r in findings.job_status(jobs, summary, touched).collect()} == {1: "delivered", 2: "in-review", 3: "remediated", 4: "detected"}


def test_pdf_rules_as_stated(spark):
    """One case that is found and one that isn't for each kind; roles over hops, pages from around."""
    from folioworks.operators import pdf

    flags = "doc_id long, tagged boolean, language string, title string, display_title boolean, pages int, pages_without_text array<int>, pages_with_graphics array<int>, fields int"
    facts = spark.createDataFrame([(1, True, "", "T", False, 3, [2, 3], [1], 2), (2, True, "en", "T", True, 1, [1], [], 0), (3, False, None, None, None, 2, [], [1], 1), (4, True, "en", "T", True, 1, [], [], 0)], flags)
    tree = [
        (1, 1, 9, 0, "Sect", 10, 2, None, None), (1, 2, 2, 1, "Kop", 11, None, None, None), (1, 3, 3, 1, "H", 12, None, None, None), (1, 4, 4, 1, "H4", 13, None, None, None), (1, 5, 7, 1, "Table", 14, None, None, None), (1, 6, 7, 5, "TR", 15, None, None, None),
        (1, 7, 7, 6, "TD", 16, None, None, None), (1, 8, 8, 1, "Figure", 17, None, " ", None), (1, 9, 9, 1, "Bild", 18, 3, None, None),
        (2, 1, 1, 0, "Figure", 1, 1, "A cat", None), (2, 2, 2, 0, "H3", 2, 1, None, None), (2, 3, 3, 0, "H4", 3, 1, None, None), (2, 4, 6, 0, "Table", 4, 1, None, None), (2, 5, 5, 4, "TH", 5, 1, None, None), (2, 6, 6, 4, "TD", 6, 1, None, None), (3, 1, 1, 0, "Figure", 1, 1, None, None),
        *[(4, i, i, 0, "P", i, 1, None, None) for i in range(1, 21)],
    ]
    elements = spark.createDataFrame(tree, "doc_id long, pre int, last int, parent int, tag string, num long, page int, alt string, actual_text string")
    roles = spark.createDataFrame([(1, "Kop", "Titel"), (1, "Titel", "H1"), (1, "Bild", "Abb"), (1, "Abb", "Bild")], "doc_id long, tag string, mapped string")
    notes = [(1, 1, 1, "Link", "More", None), (1, 2, 1, "Link", "", "/a"), (1, 3, 1, "Movie", None, None), (2, 1, 1, "Link", "Annual report", None), (2, 1, 2, "Text", None, None), (3, 1, 1, "Link", "", None)]
    annotations = spark.createDataFrame(notes, "doc_id long, page int, ord int, subtype string, contents string, uri string")
    rows = pdf.detect(facts, elements, roles, annotations).orderBy("doc_id", "seq").collect()
    assert [(r["kind"], r["location"], r["anchor"]) for r in rows if r["doc_id"] == 1] == [
        ("pdf-title-not-shown", "document properties", None), ("no-language", "document catalogue", None), ("pdf-no-text", "pages 2, 3", None), ("image-alt", "figure 1, page 2", "struct:17"), ("heading-skip", "page 2", None),
        ("table-header", "table 1, page 2", None), ("link-text", "link 1, page 1", None), ("link-text", "link 2, page 2", None), ("media", "page 3", None), ("forms", "2 fields", None),
    ]
    assert [(r["kind"], r["location"]) for r in rows if r["doc_id"] == 3] == [("no-title", "document properties"), ("no-language", "document catalogue"), ("pdf-untagged", "whole document"), ("image-alt", "whole document")]
    assert [(r["doc_id"], r["kind"]) for r in rows if r["doc_id"] in (2, 4)] == [(4, "no-headings")]


def test_small_parts_are_read_in_one_batch(spark, tmp_path):
    """Nodes and trees of many small parts come in few batches, each part whole; a part that can't be read is one row."""
    xml = lambda i: f'<w:p xmlns:w="urn:w" w:id="{i}"><w:r><w:t a="1">x{i}</w:t>tail</w:r><w:t/></w:p>' if i % 10 else "<w:p>"
    batches = lambda: iter([pa.RecordBatch.from_pydict({"doc_id": [i, i], "part": ["a", "b"], "xml": [xml(i), xml(i)]}) for i in range(1000)])
    got = list(word_source.gathered(batches(), word_source.node_rows))
    assert len(got) == 1 and len(got[0][0]) == len(got[0][1]) == len(got[0][2]) == 2 * (900 * 4 + 100)
    parts = spark.createDataFrame([(i, "a", xml(i)) for i in (10, 11)], "doc_id int, part string, xml string")
    rows = {r["doc_id"]: [] for r in parts.collect()}
    for r in sorted(word_source.nodes_of(parts).collect(), key=lambda r: r["pre"]):
        rows[r["doc_id"]].append(tuple(r)[2:])
    assert [r[6] for r in rows[10]] == ["#error"] and rows[11] == [
        (1, 4, 0, 0, "/", 0, "p", {"id": "11"}, None), (2, 3, 1, 0, "/p", 1, "r", {}, None), (3, 3, 2, 1, "p/r", 2, "t", {"a": "1"}, "x11"), (4, 4, 1, 0, "/p", 1, "t", {}, None),
    ]
    assert [r["name"] for r in trees.trees_of(parts).where("doc_id = 11").orderBy("pre").collect()] == ["w:p", "w:r", "w:t", None, None, "w:t"]


def test_texts_without_the_words_are_not_searched(spark):
    told = dataclasses.replace(phrases.ENGLISH_PATTERNS, sensed="zebra", hued="zebra")
    one_ = lambda f, t, p: one(spark, h=f(F.lit(t), p))["h"]
    for f, said in ((phrases.sensory_hits, "Click the button on the LEFT."), (phrases.colour_hits, "Fields are marked in Red."), (phrases.colour_hits, "Told apart by their colours.")):
        assert one_(f, said, told) == [] and len(one_(f, said, phrases.ENGLISH_PATTERNS)) == len(one_(f, said, dataclasses.replace(told, sensed="", hued=""))) == 1
        assert len(one_(f, said + " A zebra.", told)) == 1 and one_(f, None, told) is None


def test_pages_of_elements_come_from_the_nearest_around_them_without_reading_all_again(spark):
    """Chains as deep as a tree may be, some with a page halfway and some with none; the plan grows with the rounds, not with their power."""
    deep = pdf.DEPTH
    rows = [(d, i, deep, i - 1, (7 if i == 1 else 9) if d != 2 and i in ((1,) if d == 0 else (1, 30)) else None) for d in range(3) for i in range(1, deep + 1)]
    df = spark.createDataFrame(rows, "doc_id int, pre int, last int, parent int, page int")
    got = pdf.with_pages(df)
    want = {(d, i): None if d == 2 else 9 if d == 1 and i >= 30 else 7 for d, i, *_ in rows}
    assert {(r["doc_id"], r["pre"]): r["page"] for r in got.collect()} == want and got.columns.count("page") == 1
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= pdf.DEPTH.bit_length() + 1
    flat = pdf.with_pages(df.where("pre = 1"))
    assert {(r["doc_id"], r["page"]) for r in flat.collect()} == {(0, 7), (1, 7), (2, None)}


def test_nodes_of_trees_equal_those_read_from_the_parts_without_a_window(spark):
    xml = '<w:p xmlns:w="urn:w" w:id="1">head<w:r a="2">in<w:t/>after</w:r><w:t><w:b/>late</w:t></w:p>'
    parts = spark.createDataFrame([(1, "a", xml), (1, "b", "<w:t xmlns:w='urn:w'>x</w:t>"), (2, "a", "<w:p>bad")], "doc_id int, part string, xml string")
    nodes = trees.nodes(trees.trees_of(parts))
    order = ["doc_id", "part", "pre"]
    # Trees number texts as well, so only what numbers do not tell is equal.
    got, want = (d.where("doc_id = 1").orderBy(*order).select("part", "path", "depth", "name", "attrs", "text").collect() for d in (nodes, word_source.nodes_of(parts)))
    assert got == want and [r["text"] for r in got] == ["head", "in", None, None, None, "x"] and [r["name"] for r in nodes.where("doc_id = 2").collect()] == ["#error"]
    assert "Window" not in nodes._jdf.queryExecution().optimizedPlan().toString()
