"""Hierarchical multi-length packing of documents into training sequences.

Documents are routed to tiers, the powers of two up to the longest window.
Whole longest windows are cut from a long document as they stand; what remains
goes to the shortest tier that holds it. Each tier is packed longest first into
windows of its length, and the gap a window still has is filled from the next
shorter tiers, cutting the filler where it doesn't fit. What is left over when
a block ends is cut at powers of two, so every sequence is exactly full.
A block's sequences of a tier are dealt to step groups, those of most pieces
first, each to the group with the fewest pieces so far that has room, so that
groups have like numbers of pieces and equally many sequences (but for a task's
last block, which may not fill its groups); a group is of one tier, and its id
is unique.

The packer runs inside the scan's own tasks, in blocks of bounded size (rests
shorter than a window, and pieces without their ids, so a task's memory does not
grow with the length of documents beyond the one at hand), and writes pieces only: there is no shuffle, so no hot key, and a task that is run
again after an executor is lost gives the same sequences, because partitions,
their row order and the packing are all fixed. Sequence ids are the partition's
number and a running number in it.

Defined cases: a null or empty text is the end token alone; rows with the same
id are separate documents; a null id stays null; an empty table has no pieces;
a very long text is cut into many windows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

END = 0
SPECIAL = "<|endoftext|>"
#: Runs that the fast encoder has no stack or no time for.
LONG_RUN = re.compile(r"\s{2000}|\S{20000}")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


def byte_bpe() -> Callable[[list[str]], list[list[int]]]:
    """Ids of the 50k byte-level vocabulary, without special tokens.

    The rank file of the same vocabulary gives the same ids at a quarter of the time; a text that spells the
    special token out, or has a very long run of white space or of other characters, goes through the JSON form.
    """
    import base64

    import public_tokenizers as files
    import tiktoken
    from tokenizers import Tokenizer

    with open(files.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(files.path("byte_bpe_50k.json"))

    def encode(texts: list[str]) -> list[list[int]]:
        return [exact.encode(t, add_special_tokens=False).ids if SPECIAL in t or LONG_RUN.search(t) else fast.encode_ordinary(t) for t in texts]

    return encode


class Packer:
    """Packs the rests of documents, held by tier until a block is full."""

    def __init__(self, window: int, hold: int, group: int):
        self.window, self.hold, self.group = window, hold, group
        self.tiers = [2**k for k in range(window.bit_length() - 1, -1, -1)]
        self.waiting: list[tuple[int, int, tuple]] = []  # length, start, rest
        self.block: dict[int, list[list[tuple]]] = {}  # by tier, sequences that have no step group yet, without their ids
        self.next = self.groups = self.held = 0
        self.out: list[tuple] = []

    def add(self, doc: tuple) -> None:
        """doc: id, ids. Whole windows are sequences at once; a copy of the rest, shorter than a window, waits."""
        doc_id, ids = doc
        total = len(ids)
        rest = total % self.window
        for start in range(0, total - rest, self.window):
            self.emit([self.piece((doc_id, ids, 0, total), start, self.window)])
        if rest:
            self.waiting.append((rest, total - rest, (doc_id, ids[total - rest :].copy(), total - rest, total)))
        if len(self.waiting) >= self.hold or self.held >= self.hold:
            self.pack()

    def piece(self, rest: tuple, start: int, n: int) -> tuple:
        """rest: id of the document, ids, the first one's place, ids of the document. What is kept of a piece has no ids."""
        doc_id, ids, first, total = rest
        return doc_id, start, n, zlib.crc32(ids[start - first : start - first + n].tobytes()), total

    def emit(self, pieces: list[tuple]) -> None:
        self.block.setdefault(sum(p[2] for p in pieces), []).append(pieces)
        self.held += 1

    def deal(self, last: bool) -> None:
        """Step groups of the block's sequences; what fills no group waits for the next block, if there is one."""
        for tier, sequences in self.block.items():
            count = len(sequences) // self.group
            whole = len(sequences) if last else count * self.group
            count += last and len(sequences) % self.group > 0
            loads = [(0, 0, self.groups + g) for g in range(count)]
            room = -(-whole // max(1, count))
            for pieces in sorted(sequences[:whole], key=len, reverse=True):
                load, n, group = heapq.heappop(loads)
                self.write(pieces, tier, group)
                if n + 1 < room:
                    heapq.heappush(loads, (load + len(pieces), n + 1, group))
            self.groups += count
            self.block[tier] = sequences[whole:]
        self.held = sum(map(len, self.block.values()))

    def write(self, pieces: list[tuple], tier: int, group: int) -> None:
        at = 0
        for told in pieces:
            self.out.append((*told, self.next, at, tier, group))
            at += told[2]
        self.next += 1

    def pack(self, last: bool = False) -> None:
        """Longest first: open a window of the piece's tier, then fill its gap with the longest piece that fits, else with a part of the next shorter one."""
        by_length: dict[int, list] = {}
        for n, start, doc in self.waiting:
            by_length.setdefault(n, []).append((start, doc))
        self.waiting = []
        lengths = np.zeros(self.window + 1, dtype=np.int64)
        for n, items in by_length.items():
            lengths[n] = len(items)

        def longest(most: int) -> int:
            held = np.nonzero(lengths[: most + 1])[0]
            return int(held[-1]) if len(held) else 0

        def take(n: int) -> tuple:
            lengths[n] -= 1
            return by_length[n].pop()

        def put(n: int, start: int, doc: tuple) -> None:
            lengths[n] += 1
            by_length.setdefault(n, []).append((start, doc))

        left = int(sum(n * len(items) for n, items in by_length.items()))
        while left:
            n = longest(self.window)
            # The tier that holds the longest piece; a shorter one once less than that remains.
            tier = next(t for t in reversed(self.tiers) if t >= n)
            tier = tier if tier <= left else next(t for t in self.tiers if t <= left)
            gap, pieces = tier, []
            while gap:
                if n := longest(gap):
                    start, doc = take(n)
                    used = n
                else:
                    n = longest(self.window)
                    start, doc = take(n)
                    used = gap
                    put(n - used, start + used, doc)
                pieces.append(self.piece(doc, start, used))
                gap -= used
            left -= tier
            self.emit(pieces)
        self.deal(last)


def pack_documents(
    docs: DataFrame,
    encode: Callable[[], Callable[[list[str]], list[list[int]]]] = byte_bpe,
    window: int = 1024,
    hold: int = 4096,
    group: int = 64,
) -> DataFrame:
    """The pieces of all documents (doc_id, text), as `PIECES`.

    `window` is the longest tier, a power of two; `hold` bounds the rests that a task keeps before it packs them;
    `group` is the sequences of one training step. start and offset count from 0, in the document and in the sequence.
    """
    names = [f.split()[0] for f in PIECES.split(", ")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encode()
        packer = Packer(window, hold, group)
        first = TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True)) or [[]] * len(names)
            packer.out = []
            arrays = [pa.array(c, pa.int64()) for c in columns]
            for name in ("sequence_id", "step_group"):
                i = names.index(name)
                arrays[i] = pa.array(np.asarray(columns[i], dtype=np.int64) + first)
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of(texts), strict=True):
                    packer.add((doc_id, np.array([*ids, END], dtype="<u4")))
                if len(packer.out) >= 8192:
                    yield flush()
        packer.pack(last=True)
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(packed, PIECES)
