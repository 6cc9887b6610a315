"""What a report says of each criterion, and small rules around jobs: who may do what, which forms hold, what PDFs need.

Remarks are built from counts and ordered lists, which the aggregates of `findings.assess_all` have not: locations of open findings
in their order, and who dismissed findings, by first mention. Lists are of one job and criterion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.text import squeezed
from folioworks.operators import findings
from folioworks.plans import catalog


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def remarks(assessed: DataFrame, found: DataFrame) -> DataFrame:
    """job_id, principle, ord, criterion, status, remarks. `found`: findings with seq, location, action, by."""
    mine = findings.with_criterion(found)
    ordered = lambda when, what: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("seq", what)))), lambda s: s[what])
    lists = mine.groupBy("job_id", "criterion").agg(
        ordered(findings.is_open(), "location").alias("where"), F.array_distinct(F.filter(ordered(findings.is_dismissed(), "by"), lambda n: F.coalesce(n, F.lit("")) != "")).alias("who")
    )
    rows = assessed.join(lists, ["job_id", "criterion"], "left")
    who = F.when(F.size("who") > 0, F.concat(F.lit(" by "), F.array_join("who", ", "))).otherwise("")
    judged = F.when(F.col("dismissed") > 0, F.concat(F.lit(" "), plural(F.col("dismissed"), "finding", "findings"), F.lit(" dismissed"), F.coalesce(who, F.lit("")), F.lit("."))).otherwise("")
    open_ = F.concat(plural(F.col("open"), "issue", "issues"), F.lit(" open: "), F.array_join("where", ", "), F.lit("."), judged)
    text = F.when(F.col("status") == findings.SUPPORTS, F.concat(F.lit("Nothing open."), judged)).when(F.col("status") == findings.REVIEW, "A reviewer has to look at it.").when(F.col("status") == findings.NOT_APPLICABLE, "Not asked of a document.").otherwise(open_)
    principle = F.create_map(*[F.lit(x) for kv in catalog.PRINCIPLES.items() for x in kv])[F.substring("criterion", 1, 1)]
    return rows.select("job_id", principle.alias("principle"), "ord", "criterion", "status", text.alias("remarks"))


def queue(found: DataFrame, fixable: tuple[str, ...]) -> DataFrame:
    """job_id, to_decide, decided, fixable, figures: the parts of a reviewer's queue, and figures to describe, decided or not."""
    open_ = findings.is_open()
    return found.groupBy("job_id").agg(
        F.count_if(open_ & F.col("action").isNull()).alias("to_decide"), F.count_if(F.col("action").isNotNull()).alias("decided"), F.count_if(open_ & F.col("kind").isin(*fixable)).alias("fixable"), F.count_if(F.col("kind") == "image-alt").alias("figures")
    )


def owner_of(account: Column, visitor: Column) -> Column:
    """`account:` or `visitor:` and the id; null for a job that nobody holds."""
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    return F.coalesce(named("account", account), named("visitor", visitor))


def may_claim(account: Column, visitor: Column, viewer_account: Column, viewer_visitor: Column) -> Column:
    """A browser's job can be claimed by the account that is signed in there."""
    return account.isNull() & visitor.isNotNull() & viewer_account.isNotNull() & F.coalesce(viewer_visitor == visitor, F.lit(False))


def may_review(viewer_account: Column) -> Column:
    """Reviews, and marking a document as controlled, need an account."""
    return viewer_account.isNotNull()


def form_problem(by: Column, action: Column, value: Column, note: Column) -> Column:
    """The first thing a decision's form lacks: name, action, value or note; null if it holds."""
    empty = lambda c: squeezed(F.coalesce(c, F.lit(""))) == ""
    known = F.coalesce(action.isin("apply", "decorative", "dismiss"), F.lit(False))
    return F.when(empty(by), "name").when(~known, "action").when((action == "apply") & empty(value), "value").when((action == "dismiss") & empty(note), "note")


def draftable(found: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, seq, reason (null: a description can be drafted). jobs: job_id, cui. Controlled documents are never sent anywhere."""
    met = found.join(jobs.select("job_id", "cui"), "job_id", "left")
    reason = F.when(F.col("cui").isNull(), "not-found").when(F.col("cui"), "cui").when(~findings.is_open() | (F.col("kind") != "image-alt"), "not-found")
    return met.select("job_id", "seq", reason.alias("reason"))


def pdf_edits(facts: DataFrame, fallback: Column, language: str = "en-US") -> DataFrame:
    """doc_id, entry, value: what is set in a PDF's catalogue and properties: Lang, Title (not a blank one), DisplayDocTitle."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    title = squeezed(fallback)
    entry = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("entry"), value.alias("value")))
    listed = F.array(entry(none(F.col("language")), "Lang", F.lit(language)), entry(none(F.col("title")) & (title != ""), "Title", title), entry(~F.coalesce("display_title", F.lit(False)), "DisplayDocTitle", F.lit("true")))
    return facts.select("doc_id", F.explode(F.filter(listed, lambda e: e.isNotNull())).alias("e")).select("doc_id", "e.*")


def pdf_descriptions(elements: DataFrame, decided: DataFrame) -> DataFrame:
    """doc_id, num, alt: descriptions that reviewers decided, by the number of the element; empty for a decorative figure."""
    said = F.trim(F.coalesce("value", F.lit("")))
    alt = F.when(F.col("action") == "decorative", "").when((F.col("action") == "apply") & (said != ""), said)
    rows = decided.where("kind = 'image-alt'").select("doc_id", F.regexp_extract("anchor", "^struct:([0-9]{1,18})$", 1).try_cast("long").alias("num"), alt.alias("alt")).where("num is not null and alt is not null")
    return rows.join(elements.select("doc_id", F.col("num").cast("long").alias("num")).distinct(), ["doc_id", "num"], "left_semi")


def figure_boxes(elements: DataFrame) -> DataFrame:
    """doc_id, num, page, box: the first box of an element, of at least one unit each way. elements: doc_id, num, page, boxes (arrays of four numbers)."""
    whole = F.filter("boxes", lambda b: (F.size(b) == 4) & (F.abs(b[2] - b[0]) >= 1) & (F.abs(b[3] - b[1]) >= 1))
    return elements.where("page is not null").select("doc_id", "num", "page", F.get(whole, F.lit(0)).alias("box")).where("box is not null")


def written_date(at: Column, as_given: Column | None = None) -> Column:
    """`March 5, 2024`; what can't be read stays as it was given."""
    out = F.date_format(F.try_to_timestamp(at), "MMMM d, yyyy")
    return out if as_given is None else F.coalesce(out, as_given)


def deadline_date(at: Column) -> Column:
    """`5 March 2024`."""
    return F.date_format(at, "d MMMM yyyy")


def minutes_left(until: Column, now: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil((until.cast("double") - now.cast("double")) / 60)).cast("long")


def retention_told(due: Column, which: Column, deleted: Column) -> Column:
    """One sentence on what becomes of a document."""
    on = lambda text, at: F.concat(F.lit(text), deadline_date(at), F.lit("."))
    return (
        F.when(deleted.isNotNull(), on("Deleted on ", deleted)).when(due.isNull(), "Kept while it is under review.").when(which == "downloaded", on("Downloaded; deleted on ", due))
        .when(which == "uncollected", on("Ready; to be collected by ", due)).otherwise(on("Assessed; deleted unless a review starts by ", due))
    )


def consumed(resets: DataFrame, attempts: DataFrame) -> DataFrame:
    """key, used_at: the first attempt spends a link, also one whose passphrase is refused. attempts: key, at."""
    first = attempts.where("at is not null").groupBy("key").agg(F.min("at").alias("at"))
    return resets.join(first, "key", "left").select(*[F.least("used_at", "at").alias("used_at") if c == "used_at" else F.col(c) for c in resets.columns])


def found_files(paths: DataFrame, ending: str = ".pdf", depth: int = 4) -> DataFrame:
    """Paths of files of a kind, at most `depth` folders down, none of them or their folders hidden. paths: root, path."""
    parts = F.split(F.regexp_replace(F.substring("path", F.length("root") + 1, F.lit(1 << 30)), "^/+", ""), "/+")
    return paths.where(F.startswith("path", "root") & (F.size(parts) <= depth + 1) & ~F.exists(parts, lambda p: p.startswith(".")) & F.endswith(F.lower("path"), F.lit(ending)))


def language_findings(pages: DataFrame, marked: DataFrame) -> DataFrame:
    """doc_id, page, detected, marked: pages in another language than the document's; whether that language is marked anywhere in it.

    pages: doc_id, page, text, expected; marked: doc_id, tag.
    """
    from folioworks.functions import language

    spoken = language.detect_language(pages, "text", F.col("expected")).where("detected is not null").select("doc_id", "page", "detected").distinct()
    tags = marked.select("doc_id", language.primary_subtag(F.col("tag")).alias("detected")).distinct().withColumn("marked", F.lit(True))
    return spoken.join(tags, ["doc_id", "detected"], "left").select("doc_id", "page", "detected", F.coalesce("marked", F.lit(False)).alias("marked"))


def prose_findings(blocks: DataFrame) -> DataFrame:
    """doc_id, page, kind, phrase, sentence: instructions by sense, and colour as a sign, once for a page. blocks: doc_id, page, text."""
    from folioworks.functions import phrases

    hits = F.concat(phrases.sensory_hits(F.col("text")), phrases.colour_hits(F.col("text")))
    return blocks.select("doc_id", "page", F.explode(hits).alias("h")).select("doc_id", "page", "h.kind", "h.phrase", "h.sentence").distinct()
