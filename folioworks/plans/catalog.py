"""Catalogues of the conformance rules, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Success criteria of WCAG 2.0, levels A and AA, in the standard's order.
CRITERIA = (
    ("1.1.1", "Non-text Content", "A"),
    ("1.2.1", "Audio-only and Video-only (Prerecorded)", "A"),
    ("1.2.2", "Captions (Prerecorded)", "A"),
    ("1.2.3", "Audio Description or Media Alternative (Prerecorded)", "A"),
    ("1.2.4", "Captions (Live)", "AA"),
    ("1.2.5", "Audio Description (Prerecorded)", "AA"),
    ("1.3.1", "Info and Relationships", "A"),
    ("1.3.2", "Meaningful Sequence", "A"),
    ("1.3.3", "Sensory Characteristics", "A"),
    ("1.4.1", "Use of Color", "A"),
    ("1.4.2", "Audio Control", "A"),
    ("1.4.3", "Contrast (Minimum)", "AA"),
    ("1.4.4", "Resize text", "AA"),
    ("1.4.5", "Images of Text", "AA"),
    ("2.1.1", "Keyboard", "A"),
    ("2.1.2", "No Keyboard Trap", "A"),
    ("2.2.1", "Timing Adjustable", "A"),
    ("2.2.2", "Pause, Stop, Hide", "A"),
    ("2.3.1", "Three Flashes or Below Threshold", "A"),
    ("2.4.1", "Bypass Blocks", "A"),
    ("2.4.2", "Page Titled", "A"),
    ("2.4.3", "Focus Order", "A"),
    ("2.4.4", "Link Purpose (In Context)", "A"),
    ("2.4.5", "Multiple Ways", "AA"),
    ("2.4.6", "Headings and Labels", "AA"),
    ("2.4.7", "Focus Visible", "AA"),
    ("3.1.1", "Language of Page", "A"),
    ("3.1.2", "Language of Parts", "AA"),
    ("3.2.1", "On Focus", "A"),
    ("3.2.2", "On Input", "A"),
    ("3.2.3", "Consistent Navigation", "AA"),
    ("3.2.4", "Consistent Identification", "AA"),
    ("3.3.1", "Error Identification", "A"),
    ("3.3.2", "Labels or Instructions", "A"),
    ("3.3.3", "Error Suggestion", "AA"),
    ("3.3.4", "Error Prevention (Legal, Financial, Data)", "AA"),
    ("4.1.1", "Parsing", "A"),
    ("4.1.2", "Name, Role, Value", "A"),
)
PRINCIPLES = {"1": "Perceivable", "2": "Operable", "3": "Understandable", "4": "Robust"}
# Criteria that documents need not meet, those that a check covers, those that a person must judge.
EXEMPT = ("2.4.1", "2.4.5", "3.2.3", "3.2.4")
CHECKED = ("1.1.1", "1.3.1", "1.3.2", "1.4.3", "2.4.2", "2.4.4", "3.1.1", "3.1.2", "4.1.1")
REVIEWER = ("1.3.3", "1.4.1", "1.4.5", "2.4.6")
FORMATS = ("docx", "pdf")

# Kinds of findings in catalogue order, with their criterion.
KINDS = (
    ("no-title", "2.4.2"),
    ("no-language", "3.1.1"),
    ("image-alt", "1.1.1"),
    ("table-header", "1.3.1"),
    ("heading-skip", "1.3.1"),
    ("no-headings", "1.3.1"),
    ("link-text", "2.4.4"),
    ("contrast", "1.4.3"),
    ("media", "1.2.1"),
    ("reading-order", "1.3.2"),
    ("layout-table", "1.3.2"),
    ("language-parts", "3.1.2"),
    ("sensory", "1.3.3"),
    ("colour-words", "1.4.1"),
    ("colour-only", "1.4.1"),
    ("chart", "1.4.1"),
    ("pdf-untagged", "1.3.1"),
    ("pdf-title-not-shown", "2.4.2"),
    ("pdf-no-text", "1.1.1"),
    ("forms", "3.3.2"),
)
# What a reviewer can enter for a kind (others are judged), and the kinds that need no person, by format.
REVIEW_INPUT = {"image-alt": "alt", "link-text": "text"}
FIXABLE = {
    "docx": ("no-title", "no-language", "table-header", "heading-skip", "contrast", "language-parts"),
    "pdf": ("no-language", "no-title", "pdf-title-not-shown"),
}


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def criteria(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, c, name, level, PRINCIPLES[c[0]], c in EXEMPT) for i, (c, name, level) in enumerate(CRITERIA)]
    return rows_of(spark, rows, "ord int, criterion string, name string, level string, principle string, document_exempt boolean")


def coverage(spark: SparkSession) -> DataFrame:
    rows = [(f, c, "checked" if c in CHECKED else "reviewer" if c in REVIEWER else "static") for f in FORMATS for c, _, _ in CRITERIA]
    return rows_of(spark, rows, "format string, criterion string, coverage string")


def kinds(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, k, c, REVIEW_INPUT.get(k, "judge"), k in FIXABLE["docx"], k in FIXABLE["pdf"]) for i, (k, c) in enumerate(KINDS)]
    return rows_of(spark, rows, "kind_ord int, kind string, criterion string, review_input string, fixable_docx boolean, fixable_pdf boolean")


def sql_values(rows: list[tuple], name: str, columns: str) -> str:
    """A catalogue as a common table expression, for oracles."""
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


CRITERIA_SQL = sql_values([(i + 1, c, PRINCIPLES[c[0]], c in EXEMPT, c in REVIEWER) for i, (c, _, _) in enumerate(CRITERIA)], "criteria", "ord, criterion, principle, exempt, reviewer")
KINDS_SQL = sql_values([(i + 1, k, c) for i, (k, c) in enumerate(KINDS)], "kinds", "kind_ord, kind, criterion")
