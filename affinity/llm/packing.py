"""Best-fit packing of tokenised documents into sequences of fixed length.

Bulk-synchronous best fit. Documents are cut into pieces; lengths and gaps are whole numbers
up to the capacity, so pieces of one length, and open sequences of one gap, are
interchangeable and stand in the state as *classes*: runs of ranks and of sequences with
their counts. Rounds repeat four steps on executors:

* gaps and lengths are dealt out by ranges of size and sorted;
* every range sweeps its sizes downwards: a length takes its successor, the smallest gap
  that is large enough, and where pieces outnumber a gap's sequences their rank decides,
  longest first, the rest sweeping on; a sequence takes pieces of one length in a round;
* what found no gap in its range meets the gaps that other ranges left over;
* gaps are updated for the next round, and where pieces are longer than every gap, the
  longest of them open sequences: somewhat fewer than the tokens of all these would fill.

When few pieces are left (``TAIL``), which no longer depends on the corpus, best-fit
decreasing places them one class after the other. The pieces themselves are ranked where
they lie: each tokenising task numbers its pieces of each length, a task's offset is a
running sum over (task, length) counts, and a piece finds its sequence by binary search of
its rank among the placements.

Defined results: null or empty text is the end token alone, one piece of length 1; every
row is packed, repeated rows each; bytes that are no UTF-8 count as U+FFFD; an empty table
packs to nothing; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, raw

#: Words whose ids a worker remembers before it starts over.
REMEMBERED = 600_000
#: Pieces left at which the rounds end, and ranges of size that sweep side by side.
TAIL, RANGES = 1024, 8
#: Share of the sequences that pieces without a gap would fill, that a round opens.
OPENED = 0.9

# fixed values: the rules of a vocabulary whose ids of a text are those of its words
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TextIds:
    """The ids of texts as little-endian bytes, by any vocabulary of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def ids(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids, "<u4").tobytes()


def by_words(path: str) -> bool:
    """Whether the vocabulary's rules are those under which words can be told apart beforehand."""
    rules = json.loads(Path(path).read_text())
    model = rules["model"]
    return rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLITTER, BYTES]} and rules["post_processor"] is None and model["type"] == "BPE" and not model["dropout"] and all(re.fullmatch(r"<\|.*\|>", x["content"]) and not x["normalized"] for x in rules["added_tokens"])


class WordIds:
    """The ids of white-space separated words as little-endian bytes, remembered by word.

    The vocabulary's pattern never spans white space, so a text's ids are those of its
    words in order. A word of ASCII and precomposed Latin letters is cut at the same
    borders here and its parts go to the BPE model; any other goes through the tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # letters that lower-casing and composition treat one by one; no apostrophe, for contractions
        latin = "".join(chr(c) for c in [*range(0xC0, 0x180)] if c not in (0xD7, 0xF7, 0x130))
        self.plain = re.compile(rf"[!-&(-~{latin}]+").fullmatch
        self.parts = re.compile(rf"[a-z{latin}]+|[0-9]|[^a-z0-9{latin}]+").findall
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def miss(self, word: bytes) -> bytes:
        text = word.decode(errors="replace")
        if "<|" in text or not self.plain(text):
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            ids = b""
            for part in self.parts(text.lower()):
                if (known := self.pieces.get(part)) is None:
                    spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                    known = self.pieces[part] = np.array([x.id for x in self.model.tokenize(spelt)], "<u4").tobytes()
                ids += known
        self.words[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        if len(self.words) > REMEMBERED or len(self.pieces) > REMEMBERED:
            self.words, self.pieces = {}, {}
        words = text.split()
        get = self.words.get
        found = [get(w) for w in words]
        if None in found:
            found = [self.words.get(w) or self.miss(w) if x is None else x for w, x in zip(words, found)]
        return b"".join(found)


def word_ids(path: str) -> WordIds | TextIds:
    """One per worker process and vocabulary: later tasks of the worker find it again."""
    kept = sys.modules.setdefault("affinity_worker_cache", types.ModuleType("affinity_worker_cache"))
    if not hasattr(kept, path):
        setattr(kept, path, (WordIds if by_words(path) else TextIds)(path))
    return getattr(kept, path)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("place", pa.int64())])


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with the task that made it and its place among that task's pieces of its length."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words, seen, task = word_ids(vocabulary), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc, text in zip(part.column(0).to_pylist(), raw(part, "text")):
                    data = words.ids(text or b"") + end
                    for k, begin in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[begin : begin + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, k, begin // 4, n, zlib.crc32(own), task, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), PIECES.types)], schema=PIECES)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


#: A run of open sequences ``(gap, first sequence, how many)``, pieces ``(length, first rank, how many)`` and
#: placements ``(length, first rank, how many, first sequence, pieces a sequence, offset)``.
Run, Pieces, Placement = tuple[int, int, int], tuple[int, int, int], tuple[int, int, int, int, int, int]


def place_class(length: int, rank: int, left: int, run: Run, capacity: int) -> tuple[list[Placement], list[Run], int, Run]:
    """Put up to ``left`` pieces of a length, as many as fit each, into a run; what was placed, the runs filled, how many, and the rest of the run."""
    gap, first, n = run
    per, placed, filled, used = gap // length, [], [], 0
    for each, sequences in ((per, min(n, left // per)), (left % per, 1)):
        if each and sequences and first < run[1] + n and used < left:
            placed.append((length, rank + used, each * sequences, first, each, capacity - gap))
            filled.append((gap - each * length, first, sequences))
            used += each * sequences
            first += sequences
    return placed, filled, used, (gap, first, run[1] + n - first)


def sweep(runs: list[Run], pieces: list[Pieces], capacity: int) -> tuple[list[Placement], list[Run], list[Run], list[Pieces]]:
    """One round over sizes from large to small: placements, runs filled, runs not used, pieces left.

    The runs passed and not yet used are a stack, on whose top lies the smallest gap.
    """
    placed, filled, stack, left = [], [], [], []
    waiting = sorted(runs)
    for length, rank, n in sorted(pieces, key=lambda x: (-x[0], x[1])):
        while waiting and waiting[-1][0] >= length:
            stack.append(waiting.pop())
        while n and stack:
            new, gaps, used, rest = place_class(length, rank, n, stack.pop(), capacity)
            placed += new
            filled += gaps
            rank, n = rank + used, n - used
            if rest[2]:
                stack.append(rest)
        if n:
            left.append((length, rank, n))
    return placed, filled, waiting + stack, left


def open_sequences(runs: list[Run], pieces: list[Pieces], opened: int, capacity: int) -> tuple[list[Placement], list[Run], list[Pieces], int]:
    """Sequences for the longest of the pieces that no gap can hold; with all that half the capacity cannot hold twice."""
    widest = max((r[0] for r in runs), default=0)
    tokens = sum(length * n for length, _, n in pieces if length > widest)
    want = max(1, int(OPENED * tokens / capacity), sum(n for length, _, n in pieces if length > max(widest, capacity // 2)))
    placed, new, left = [], [], []
    for length, rank, n in sorted(pieces, key=lambda x: (-x[0], x[1])):
        use = min(want, n) if length > widest else 0
        if use:
            placed.append((length, rank, use, opened, 1, 0))
            new.append((capacity - length, opened, use))
        if n > use:
            left.append((length, rank + use, n - use))
        want, opened = want - use, opened + use
    return placed, new, left, opened


def best_fit(runs: list[Run], pieces: list[Pieces], opened: int, capacity: int) -> list[Placement]:
    """Best-fit decreasing of the pieces given, into the runs given and sequences opened from ``opened`` on."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    order: list[int] = []  # the gaps there are, ascending
    out: list[Placement] = []

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for run in runs:
        put(*run)
    for length, rank, left in sorted(pieces, key=lambda x: (-x[0], x[1])):
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            gap = order[at]
            run = (gap, *gaps[gap].pop())
            if not gaps[gap]:
                del gaps[gap], order[at]
            placed, filled, used, rest = place_class(length, rank, left, run, capacity)
            out += placed
            for r in [*filled, rest]:
                put(*r)
            rank, left = rank + used, left - used
    return out


#: Kinds of the state's rows; a gap that is filled in this round counts from the next round on.
GAP, FILLED, PIECES_LEFT, PLACED, OPENED_SO_FAR = range(5)
STATE = "kind int, size long, first long, n long, sequence long, per long, offset long"


def rows_of(table: pa.Table) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = defaultdict(list)
    for r in zip(*(table.column(c).to_pylist() for c in ("kind", "size", "first", "n", "sequence", "per", "offset"))):
        out[r[0]].append(r[1:])
    return out


def state_of(found: dict[int, list[tuple]]) -> pa.Table:
    rows = [(kind, *x, *[0] * (6 - len(x))) for kind, own in found.items() for x in own]
    names = ["kind", "size", "first", "n", "sequence", "per", "offset"]
    return pa.Table.from_arrays([pa.array(x, pa.int32() if i == 0 else pa.int64()) for i, x in enumerate(zip(*rows) if rows else [[]] * 7)], names=names)


def one_round(state: DataFrame, opened: int, capacity: int) -> DataFrame:
    """The state after a round of ``state``, with the placements made in it."""

    def in_range(table: pa.Table) -> pa.Table:
        rows = rows_of(table)
        placed, filled, unused, left = sweep([x[:3] for x in rows[GAP]], [x[:3] for x in rows[PIECES_LEFT]], capacity)
        return state_of({GAP: unused, FILLED: filled, PIECES_LEFT: left, PLACED: placed})

    def between(table: pa.Table) -> pa.Table:
        # placements only pass through
        rows = rows_of(table)
        placed, filled, unused, left = sweep([x[:3] for x in rows[GAP]], [x[:3] for x in rows[PIECES_LEFT]], capacity)
        runs = [x for x in [*unused, *filled, *(x[:3] for x in rows[FILLED])] if x[0]]
        more, new, left, now = open_sequences(runs, left, opened, capacity) if left else ([], [], [], opened)
        return state_of({GAP: runs + [x for x in new if x[0]], PIECES_LEFT: left, PLACED: rows[PLACED] + placed + more, OPENED_SO_FAR: [(now,)]})

    ranges = F.floor(F.col("size") * RANGES / (capacity + 1))
    swept = state.where(F.col("kind").isin(GAP, PIECES_LEFT)).groupBy(ranges.alias("range")).applyInArrow(in_range, STATE)
    # classes, at most the capacity's number of lengths and the runs they made: one task meets what ranges leave over
    return cut(swept.groupBy(F.lit(0).alias("all")).applyInArrow(between, STATE))


def placements(counts: DataFrame, capacity: int) -> dict[str, np.ndarray]:
    """Rounds of best fit over ``counts(length, n)``: the placements, sorted by length and rank."""
    state = counts.select(F.lit(PIECES_LEFT).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n"), *[F.lit(0).cast("long").alias(x) for x in ("sequence", "per", "offset")])
    of_kind = lambda kind: [tuple(r)[1:] for r in state.where(F.col("kind") == kind).collect()]
    out: list[Placement] = []
    opened, left = 0, counts.agg(F.sum("n")).first()[0] or 0
    while left > TAIL:
        state = one_round(state, opened, capacity)
        told = {r.kind: r for r in state.groupBy("kind").agg(F.sum("n").alias("n"), F.max("size").alias("size")).collect()}
        opened, left = told[OPENED_SO_FAR].size, told[PIECES_LEFT].n if PIECES_LEFT in told else 0
        out += of_kind(PLACED)
    if left:
        out += best_fit([x[:3] for x in of_kind(GAP)], [x[:3] for x in of_kind(PIECES_LEFT)], opened, capacity)
    out.sort()
    return dict(zip(("length", "rank", "n", "sequence", "per", "offset"), np.array(out, np.int64).reshape(-1, 6).T))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of ``docs(doc_id, text)``.

    The driver sees the placements of classes: a few for each of the at most ``capacity``
    lengths in each round, whose number grows with the logarithm of the corpus.
    """
    pieces = cut(tokenised_pieces(docs, vocabulary, capacity, end_id))
    dealt = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    plan = placements(cut(dealt.groupBy("length").agg(F.sum("n").alias("n"))), capacity)
    # one key of both, so that one search finds the placement
    step = np.int64((plan["rank"] + plan["n"]).max(initial=0) + 1)
    keys = plan["length"] * step + plan["rank"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            i = np.searchsorted(keys, length * step + rank, side="right") - 1
            sequence, place = np.divmod(rank - plan["rank"][i], plan["per"][i])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(plan["sequence"][i] + sequence), pa.array(plan["offset"][i] + place * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
