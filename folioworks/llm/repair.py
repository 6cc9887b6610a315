"""Repair of conversations by the cheapest edits, with Four-Russians tables.

A conversation is right if its roles are nothing, or one system turn at most and then pairs of user and assistant. Each
row can be kept (K, 0), given the role that is due (R, 3) or deleted (D, 4; rows that are blank or repeat an earlier one must
be), and a turn without text can be inserted anywhere (I, 3); a truncated row that is not deleted costs 3 more. Of the
cheapest ways the one with the ASCII-least letters is taken.

What is due is one of four states: at the start, after the system turn, after a user, after an assistant. The cost of the
rest from each state is a vector; less its minimum it is one of a few dozen that can occur at all. A row is one of nine
symbols. Tables give for every block of BLOCK symbols and every vector right of it the vector left of it; they are made
once, by composing the tables of single symbols. A segment of SEGMENT rows is a few lookups for each vector that can stand
right of it, so it is a map from vectors to vectors; maps are composed over the segments of a conversation
(`scans.carried`), and so are, once the vectors are known, the maps from the state on the left to that on the right. The
letters come from a second pass: each block is expanded backward from the vector on its right, and read forward with
the least letter that keeps the cost.

Rows are numbered by ranges of (conversation, turn), and segments are grouped by (conversation, segment), so no task holds a
conversation. Texts are only shuffled with rows, never gathered.

Defined cases: null roles and texts are one space; null turns come first, rows of one turn are ordered by role and text;
a null conversation is one of its own; roles other than those three can be given another role or deleted, by their first
letter as the contract of the query has it; an empty table has no rows; a conversation without rows has no edits; columns
that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.scans import carried, numbered
from folioworks.tables import stored

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
BLOCK, SEGMENT = 4, 4096
#: States, and by state the initial that is due and the state after it. Only the start takes a system turn as well.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}
#: Symbols: x must go; else the initial (o: another one), large if the row is truncated. The last one, no row, fills blocks.
SYMBOLS = "xsuaoSUAO-"
END_COSTS = (0, INSERT + INSERT, INSERT, 0)


def choices(state: int, symbol: str, after: tuple[int, ...]) -> list[tuple[int, str, int]]:
    """Cost of the rest, letter and next state of what can be done with a row in a state, but for insertions."""
    out = [(DELETE + after[state], "D", state)]
    if symbol != "x":
        due, to = DUE[state]
        cut, initial = CUT if symbol.isupper() else 0, symbol.lower()
        out.append((REROLE + cut + after[to], "R", to))
        if initial == due:
            out.append((KEEP + cut + after[to], "K", to))
        elif initial == "s" and state == START:
            out.append((KEEP + cut + after[SYSTEM], "K", SYSTEM))
    return out


def left_of(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """The vector left of a row, from that right of it. What is inserted leads on, from user to assistant and back."""
    if symbol == "-":
        return after
    costs = [min(c for c, _, _ in choices(s, symbol, after)) for s in range(4)]
    for _ in range(3):
        costs = [min(c, INSERT + costs[DUE[s][1]]) for s, c in enumerate(costs)]
    return tuple(costs)


def normalised(vector: tuple[int, ...]) -> tuple[int, ...]:
    least = min(vector)
    return tuple(c - least for c in vector)


class Blocks:
    """The tables. vectors: all normalised ones that can occur, the end's first; left: by vector and block, the vector left of the block."""

    def __init__(self):
        self.vectors, steps = [normalised(END_COSTS)], []
        known = {self.vectors[0]: 0}
        for vector in self.vectors:  # grows
            for symbol in SYMBOLS:
                to = normalised(left_of(symbol, vector))
                if to not in known:
                    known[to] = len(self.vectors)
                    self.vectors.append(to)
                steps.append(known[to])
        single = np.array(steps).reshape(-1, len(SYMBOLS))
        self.left = single
        for _ in range(BLOCK - 1):  # one more symbol, left of what a table has
            self.left = single[self.left].transpose(0, 2, 1).reshape(len(self.vectors), -1)
        self.digit = np.zeros(256, np.int64)
        self.digit[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
        self.read: dict[tuple[str, int, int], tuple[list[str], int]] = {}

    def of(self, symbols: str) -> tuple[str, np.ndarray]:
        """The symbols, filled on the left to whole blocks, and the blocks' numbers."""
        symbols = "-" * (-len(symbols) % BLOCK) + symbols
        digits = self.digit[np.frombuffer(symbols.encode(), np.uint8)].reshape(-1, BLOCK)
        return symbols, digits @ len(SYMBOLS) ** np.arange(BLOCK - 1, -1, -1)

    def vectors_left(self, symbols: str) -> np.ndarray:
        """By the vector right of the symbols, the vector left of them."""
        at = np.arange(len(self.vectors))
        for block in self.of(symbols)[1][::-1]:
            at = self.left[at, block]
        return at

    def expanded(self, symbols: str, right: int, state: int) -> tuple[list[str], int]:
        """A block, backward from the vector on its right, then forward from a state: letters of each row, and the state after it."""
        key = symbols, right, state
        if key not in self.read:
            after, out = [self.vectors[right]], []
            for symbol in reversed(symbols):
                after.append(left_of(symbol, after[-1]))
            for i, symbol in enumerate(symbols):
                letters, here, rest = "", after[-1 - i], after[-2 - i]
                while symbol != "-" and letters[-1:] in ("", "I"):
                    to = DUE[state][1]
                    options = [*choices(state, symbol, rest), (INSERT + here[to], "I", to)]
                    least = min(c for c, _, _ in options)
                    letter, state = min((x, to) for c, x, to in options if c == least)
                    letters += letter
                out.append(letters)
            self.read[key] = out, state
        return self.read[key]

    def edits(self, symbols: str, right: int, state: int) -> tuple[list[str], int]:
        """Letters of each row of a segment (insertions before it, then its own), and the state after the segment."""
        filled, numbers = self.of(symbols)
        rights = [right]
        for block in numbers[:0:-1]:
            rights.append(int(self.left[rights[-1], block]))
        out: list[str] = []
        for i, r in enumerate(reversed(rights)):
            letters, state = self.expanded(filled[i * BLOCK : (i + 1) * BLOCK], r, state)
            out += letters
        return out[len(filled) - len(symbols) :], state


def mapped(rows: DataFrame, name: str, kind: str, step: Callable) -> DataFrame:
    """The first two columns, and `step` of the tables and the other columns of a row under a new name."""
    arrow = {"array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}[kind]
    kept = rows.columns[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for batch in batches:
            told = [step(blocks, *values) for values in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(told, arrow)], [*kept, name])

    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + f", {name} {kind}")


SPACES = " \t\n\x0b\f\r"


def is_blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES)) == ""


def is_truncated(text: Column) -> Column:
    """The last character that is no white space ends no sentence."""
    return ~F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1).isin(".", "!", "?")


def conversation(conv_id: Column) -> Column:
    """A text that is unique to a conversation, never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def in_order(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, rank, total: rows of conversations (conv_id, turn, role, text), stored."""
    plain = rows.select(conversation(F.col("conv_id")).alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return stored(numbered(plain, ["conv"], ["turn", "role", "text"]), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """conv, rank, total, turn, initial, fault (blank, duplicate, truncated or null): the first that holds for a row of `in_order`."""
    said = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    rows = turns.select("conv", "rank", "total", "turn", F.substring("role", 1, 1).alias("initial"), is_blank(F.col("text")).alias("blank"), is_truncated(F.col("text")).alias("cut"), said.alias("said"))
    # Rows that say something for the first time; everything is keyed by the row from here on, however often it is said.
    firsts = rows.where(~F.col("blank")).groupBy("conv", "said").agg(F.min("rank").alias("rank")).select("conv", "rank", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("cut"), "truncated")
    return rows.join(firsts, ["conv", "rank"], "left").select("conv", "rank", "total", "turn", "initial", fault.alias("fault"))


def edited(found: DataFrame) -> DataFrame:
    """conv, rank, letters, state: what is done with each row of `faults`, insertions before it first, from the state before them.

    After the letter of a conversation's last row come those of what is inserted at the end.
    """
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    last = F.floor((F.col("total") - 1) / SEGMENT)
    rows = found.select("conv", F.floor(F.col("rank") / SEGMENT).alias("no"), last.alias("last"), "rank", symbol.alias("symbol"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "symbol"))), lambda r: r["symbol"]), "")
    segments = stored(rows.groupBy("conv", "no", "last").agg(listed.alias("symbols")), "segments")
    # Vectors come from the right: there, segments count from the last one.
    maps = mapped(segments.select("conv", (F.col("last") - F.col("no")).alias("no"), "symbols"), "map", "array<int>", lambda b, s: b.vectors_left(s).tolist())
    rights = carried(stored(maps, "vectors"), "conv", F.lit(0)).select("conv", F.col("no").alias("back"), F.col("entering").alias("right"))
    known = segments.withColumn("back", F.col("last") - F.col("no")).join(rights, ["conv", "back"])
    known = stored(known.select("conv", "no", "last", "symbols", "right"), "known")
    maps = mapped(known.select("conv", "no", "symbols", "right"), "map", "array<int>", lambda b, s, r: [b.edits(s, r, q)[1] for q in range(4)])
    states = carried(stored(maps, "states"), "conv", F.lit(START))
    entered = known.join(states, ["conv", "no"]).select("conv", "no", "symbols", "right", "entering", (F.col("no") == F.col("last")).alias("ends"))

    def letters(blocks: Blocks, symbols: str, right: int, state: int, ends: bool) -> list[str]:
        out, after = blocks.edits(symbols, right, state)
        if ends:
            out[-1] += "I" * (END_COSTS[after] // INSERT)
        told = []
        for row, symbol in zip(out, symbols, strict=True):
            roles = ""
            for x in row:
                roles += "-" if x in "DK" else DUE[state][0]
                state = state if x == "D" else SYSTEM if x == "K" and symbol in "sS" else DUE[state][1]
            told.append(f"{row}:{roles}")
        return told

    told = mapped(entered, "letters", "array<string>", letters).select("conv", "no", F.posexplode("letters").alias("i", "told"))
    part = lambda i: F.get(F.split("told", ":"), F.lit(i))
    return told.select("conv", (F.col("no") * SEGMENT + F.col("i")).alias("rank"), part(0).alias("letters"), part(1).alias("roles"))


def repaired(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, rank, place, letter, role, text: what becomes of each row of `in_order`, and what is inserted; role and text are null for what is deleted."""
    each = turns.join(edits, ["conv", "rank"]).select("conv", "rank", "role", "text", "letters", "roles", F.explode(F.sequence(F.lit(1), F.length("letters"))).alias("place"))
    of = lambda c: F.substring(c, F.col("place"), F.lit(1))
    letter, given = of("letters"), F.when(of("roles") == "u", ROLES["u"]).otherwise(ROLES["a"])
    role = F.when(letter == "K", F.col("role")).when(letter != "D", given)
    return each.select("conv", "rank", "place", letter.alias("letter"), role.alias("role"), F.when(letter == "I", "").when(letter != "D", F.col("text")).alias("text"))


def costs(found: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, cost: what the edits of each conversation cost."""
    count = lambda x: F.regexp_count("letters", F.lit(x))
    cut = F.when((F.col("fault") == "truncated") & ~F.contains("letters", F.lit("D")), CUT).otherwise(0)
    cost = REROLE * count("R") + DELETE * count("D") + INSERT * count("I") + cut
    return found.join(edits, ["conv", "rank"]).groupBy("conv").agg(F.sum(cost).cast("long").alias("cost"))


def report(found: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal: counts of `faults` by conversation; illegal: neighbours whose roles may not follow each other."""
    no = F.floor(F.col("rank") / SEGMENT)
    # A segment's first row is shown to the segment before it, too.
    shown = F.explode(F.when((F.col("rank") % SEGMENT == 0) & (F.col("rank") > 0), F.array(no, no - 1)).otherwise(F.array(no))).alias("part")
    rows = found.select("conv", "rank", "turn", "initial", "fault", no.alias("no"), shown)
    pair = F.concat(F.lag("initial").over(Window.partitionBy("conv", "part").orderBy("rank")), F.col("initial"))
    rows = rows.withColumn("illegal", ~pair.isin("su", "ua", "au"))
    of = lambda x: F.count_if((F.col("fault") == x) & (F.col("part") == F.col("no"))).alias(x)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    return rows.groupBy("conv").agg(gaps.alias("gaps"), *map(of, ("blank", "duplicate", "truncated")), F.count_if("illegal").alias("illegal"))


def rendered(rows: DataFrame) -> DataFrame:
    """conv, audit, repaired_sha256: letters of all edits, and the digest of `role:text` lines of `repaired` rows.

    A digest runs over its lines one after the other: a conversation's rows stream through one task, which keeps its audit
    and the digest's state.
    """
    placed = rows.repartition("conv").sortWithinPartitions("conv", "rank", "place").select("conv", "letter", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, lines = None, [], hashlib.sha256(), 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (conv, "".join(audit), sha.hexdigest())], ["conv", "audit", "repaired_sha256"])

        for batch in batches:
            for name, letter, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != conv:
                    if conv is not None:
                        yield done()
                    conv, audit, sha, lines = name, [], hashlib.sha256(), 0
                audit.append(letter)
                if letter != "D":
                    sha.update(("\n" * (lines > 0) + f"{role}:{text}").encode())
                    lines += 1
        if conv is not None:
            yield done()

    return placed.mapInArrow(run, "conv string, audit string, repaired_sha256 string")
