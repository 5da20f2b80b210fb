"""Vector codes: product quantisation whose codebooks are trained with Hamerly's bounds.

Components become integers and a vector is cut into equal consecutive parts; each part
position has a codebook of its own. A round assigns every part to the nearest entry and
moves each entry to its parts' mean, rounded down. All arithmetic is on integers, so the
result is that of the plain algorithm, whatever the order of the rows.

A part keeps two numbers between rounds: an upper bound of the distance to its own entry and
a lower bound of that to the nearest other one. Both are whole numbers, rounded away
from each other, and are loosened by what the entries moved. While the upper one is strictly
below the lower one (or below half of the gap to the next entry) no other entry can be as
near, so the part is not compared with all entries; a tie always is, and goes to the lower index.

Rows stay where they are: a round is one pass that writes the state to the checkpoint folder
and one that sums up the parts which changed their entry. What tasks send to each other is
at most a sum per entry and task; codebooks, of a size that the parameters fix, travel
with the tasks.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped; shorter vectors count as filled with zeros up to the longest, and its length
to the next multiple of ``parts``; null ids come last; repeated rows each get their code, and
rows with one id are in the order of their vectors; fewer rows than entries make a smaller
codebook; an empty table gives no row. Components of 2**30 and more after scaling, or so large that a squared distance
may pass 2**62, raise an error. Further columns, but for the label, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

STATE = "vec_id long, label int, v binary, code binary, upper binary, lower binary, was binary, scans long"
KINDS = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("v", pa.binary()), ("code", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("was", pa.binary()), ("scans", pa.int64())])
#: Scaled components stay below it, and squared distances of a part below the other.
LARGEST, SQUARED = 1 << 30, 1 << 62
FAR = 1 << 61
#: Rows that are compared with all entries at once.
AT_ONCE = 4096
#: One label's rows are joined with their sum in so many groups.
SALTS = 32


def floor_root(square: np.ndarray) -> np.ndarray:
    """The largest whole number whose square is not above."""
    root = np.sqrt(square.astype(np.float64)).astype(np.int64)
    root -= root * root > square
    root -= root * root > square
    return root + ((root + 1) * (root + 1) <= square)


def ceil_root(square: np.ndarray) -> np.ndarray:
    root = floor_root(square)
    return root + (root * root < square)


def whole_components(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, v, peak``: kept rows with ``floor(scale * x)`` as 32-bit integers, and the largest size of one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = batch.column("e")
        with np.errstate(over="ignore"):
            x = np.floor(scale * e.flatten().to_numpy(zero_copy_only=False))
        if (np.abs(x) >= LARGEST).any():
            raise ValueError(f"components of {LARGEST // scale} and more do not fit the distances")
        data, ends = x.astype("<i4").tobytes(), 4 * np.cumsum([0, *e.value_lengths().to_pylist()])
        own = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
        peak = np.full(len(own), int(np.abs(x).max(initial=0)))
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(own, pa.binary()), pa.array(peak)], names=["vec_id", "label", "v", "peak"])

    label = F.col("label") if "label" in vectors.columns else F.lit(None)
    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    fine = picked.where(F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return map_arrow(fine, run, "vec_id long, label int, v binary, peak long", rows=4096)


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A row of ``width`` numbers for each value; what a value lacks is zero."""
    data, size = column.to_pylist(), width * np.dtype(kind).itemsize
    return np.frombuffer(b"".join(x if len(x) == size else x.ljust(size, b"\0") for x in data), kind).reshape(len(data), width)


@dataclass
class Codebooks:
    """``entries[part, entry, position]``, and how far entries moved in the last round."""

    entries: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        parts, size, width = self.entries.shape
        self.squares = (self.entries * self.entries).sum(2)
        #: By part and entry, the distance to the nearest other entry, rounded down.
        self.gap = np.full((parts, size), FAR)
        for p in range(parts if size > 1 else 0):
            for k in range(size):
                apart = ((self.entries[p] - self.entries[p, k]) ** 2).sum(1)
                apart[k] = np.iinfo(np.int64).max
                self.gap[p, k] = floor_root(apart.min())
        # the most that an entry of each part moved, the most but for it, and which it is
        order = np.argsort(self.moved, axis=1)
        self.most = np.take_along_axis(self.moved, order[:, -1:], 1)
        self.second = np.take_along_axis(self.moved, order[:, -2:-1], 1) if size > 1 else self.most
        self.mover = order[:, -1]
        #: Whether products of parts are exact in doubles.
        self.small = 4 * width * int(np.abs(self.entries).max(initial=0) + 1) ** 2 < 1 << 53

    def others_moved(self, p: int, code: np.ndarray) -> np.ndarray:
        """The most that any entry but the own one moved."""
        return np.where(code == self.mover[p], self.second[p], self.most[p])

    def distances(self, p: int, x: np.ndarray) -> np.ndarray:
        """Squared distances of parts from all entries, exact."""
        entry = self.entries[p]
        if self.small and 4 * x.shape[1] * (int(np.abs(x).max(initial=0)) + 1) ** 2 < 1 << 53:
            cross = (x.astype(np.float64) @ entry.T.astype(np.float64)).astype(np.int64)
            return (x * x).sum(1)[:, None] - 2 * cross + self.squares[p]
        return np.stack([((x - e) ** 2).sum(1) for e in entry], 1)

    def assign(self, p: int, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Brings codes and bounds of part ``p`` up to date in place; returns which rows were compared with all entries."""
        known = code >= 0
        mine = code[known]
        upper[known] += self.moved[p, mine]
        lower[known] -= self.others_moved(p, mine)
        safe = np.zeros(len(code), bool)
        safe[known] = upper[known] < lower[known]
        safe[known] |= 2 * upper[known] < self.gap[p, mine]
        loose = np.flatnonzero(known & ~safe)
        mine = code[loose]
        upper[loose] = ceil_root(((x[loose] - self.entries[p, mine]) ** 2).sum(1))
        safe[loose] = (upper[loose] < lower[loose]) | (2 * upper[loose] < self.gap[p, mine])
        scan = np.flatnonzero(~safe)
        for begin in range(0, len(scan), AT_ONCE):
            rows = scan[begin : begin + AT_ONCE]
            far = self.distances(p, x[rows])
            best, at = far.argmin(1), np.arange(len(rows))  # the lowest index of equals
            code[rows], upper[rows] = best, ceil_root(far[at, best])
            far[at, best] = np.iinfo(np.int64).max
            lower[rows] = floor_root(far.min(1)) if far.shape[1] > 1 else FAR
        return ~safe


def assigned(state: DataFrame, books: Codebooks) -> DataFrame:
    """The state after one more assignment; ``was`` holds the codes before it."""
    parts, _, width = books.entries.shape

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column("v"), "<i4", parts * width).astype(np.int64).reshape(-1, parts, width)
        code, upper, lower = (matrix(batch.column(c), "<i8", parts).copy() for c in ("code", "upper", "lower"))
        was, scans = code.copy(), batch.column("scans").to_numpy().copy()
        for p in range(parts):
            own = [np.ascontiguousarray(a[:, p]) for a in (code, upper, lower)]
            scans += books.assign(p, x[:, p], *own)
            code[:, p], upper[:, p], lower[:, p] = own
        packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (code, upper, lower, was)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), *packed, pa.array(scans)], schema=KINDS)

    return map_arrow(state, run, STATE, rows=8192)


def changes(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """What the last assignment added to the sums and counts of all entries: one sum per entry and task is shuffled."""
    parts, size, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), "<i4", parts * width).astype(np.int64).reshape(-1, parts, width)
            code, was = (matrix(batch.column(c), "<i8", parts) for c in ("code", "was"))
            for p in range(parts):
                moved = np.flatnonzero(code[:, p] != was[:, p])
                for at, sign in ((code[moved, p], 1), (was[moved, p], -1)):
                    some = at >= 0
                    np.add.at(total[p], at[some], sign * x[moved[some], p])
                    np.add.at(count[p], at[some], sign)
        cell = np.concatenate([total, count[:, :, None]], 2).reshape(-1)
        at = np.flatnonzero(cell)
        yield pa.RecordBatch.from_pydict({"cell": at, "n": cell[at]})

    out = np.zeros(parts * size * (width + 1), np.int64)
    for r in state.select("v", "code", "was").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    out = out.reshape(parts, size, width + 1)
    return out[:, :, :width], out[:, :, width]


def trained(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """The state after ``rounds`` rounds and a last assignment, and the codebooks ``[part, entry, position]``."""
    rows = cut(whole_components(vectors, scale))
    facts = rows.agg(F.max(F.length("v")).alias("longest"), F.max("peak").alias("peak")).first()
    width = max(1, -(-(facts.longest or 0) // 4 // parts))
    if width * (2 * (facts.peak or 0) + 1) ** 2 >= SQUARED:
        raise ValueError(f"components of {facts.peak / scale} do not fit the distances")
    first = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    seeds = matrix(pa.array(first, pa.binary()), "<i4", parts * width).astype(np.int64).reshape(len(first), parts, width)
    blank = lambda x: F.lit(np.full(parts, x, "<i8").tobytes())
    state = rows.select("vec_id", "label", "v", blank(-1).alias("code"), blank(0).alias("upper"), blank(0).alias("lower"), blank(-1).alias("was"), F.lit(0).cast("long").alias("scans"))
    if not first:
        return state, seeds.transpose(1, 0, 2)
    books = Codebooks(seeds.transpose(1, 0, 2).copy(), np.zeros((parts, len(first)), np.int64))
    total, count = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
    for _ in range(rounds):
        state = cut(assigned(state, books))
        more, n = changes(state, books.entries.shape)
        total, count = total + more, count + n
        moved = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books.entries)
        books = Codebooks(moved, ceil_root(((moved - books.entries) ** 2).sum(2)))
    return cut(assigned(state, books)), books.entries


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256, scans`` of the kept rows of ``vectors(vec_id, embedding, label)``.

    ``code``: the parts' entries, two hex digits each (more where entries need them); ``error``:
    squared distance from them; ``label_error``: its sum over the rows of one label; ``scans``: how
    often a part of the row was compared with all entries.
    """
    state, books = trained(vectors, parts, entries, rounds, scale)
    digits, width = max(2, len(f"{max(entries - 1, 0):x}")), books.shape[2]
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column("v"), "<i4", parts * width).astype(np.int64).reshape(-1, parts, width)
        code = matrix(batch.column("code"), "<i8", parts)
        error = sum(((x[:, p] - books[p, code[:, p]]) ** 2).sum(1) for p in range(parts))
        text = ["".join(f"{c:0{digits}x}" for c in r) for r in code.tolist()]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64()), batch.column("scans")], names=["vec_id", "label", "code", "error", "scans"])

    coded = cut(map_arrow(state, run, "vec_id long, label int, code string, error long, scans long", rows=8192))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("of_salt"))
    met = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "scans")
