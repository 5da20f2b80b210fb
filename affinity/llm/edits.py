"""Document fingerprints by a randomised edit embedding.

A pointer walks over a text's characters. At step ``j`` it reads the character under it, and
a coin that all texts share, one for each step and character, says whether it moves on. What
it reads, step by step, is the embedding: an inserted or deleted character shifts the rest of
the text, but two pointers that are a few places apart soon meet again by their random
moves and then read the same until the next edit. So a few edits become a few differing steps:
edit distance turns into Hamming distance (Chakraborty, Goldenberg, Koucký 2016).

A fingerprint samples ``digits`` steps of the embedding, each as a hex digit that hashes the
step and the character read there. Digit ``k`` samples the step that is least in a random
order of its own among the steps of the text. Any step is as likely, and texts whose walks
are about as long sample the same steps. As only the minima so far are ever read, a walk
stores some thousand values however long it is. The share of equal digits, less what chance
makes equal, is the likeness of two texts.

Walks of many texts go in lockstep. A text longer than ``STRETCH`` characters is walked in
stretches of that size, each with coins of its own; digits are dealt to stretches in the same
way as to steps. Every character is read.

``near_duplicates`` deals fingerprints to bands of digits sampled from them; fingerprints that
meet in a band are verified by all digits.

Defined results: a null text is empty, and so is one walk of one step that reads the end; equal texts
have equal fingerprints; null ids come after all others, rows of one id are in the order of a hash of
their texts, repeated rows follow each other and each has its row; a table of one row is
its own next row; an empty table gives no row. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, raw, shuffle_partitions

#: Characters that one walk reads at most, steps after which coins repeat, and steps that a digit may sample.
STRETCH, PERIOD, STEPS = 1 << 15, 1 << 12, 1 << 17
#: Characters of texts that are walked in lockstep.
AT_ONCE = 16 << 20
#: Kinds of characters that coins and digits tell apart; the last one is the end of a text.
KINDS, END = 256, 255


@functools.cache
def coins(seed: int) -> np.ndarray:
    """For each step and kind of character, whether the pointer moves on; never at the end."""
    out = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (PERIOD, KINDS), np.uint8)
    out[:, END] = 0
    return out.astype(np.int32)


@functools.cache
def samples(seed: int, digits: int, most: int) -> dict[int, np.ndarray]:
    """By step, the digits that sample it if the walk ends before a later one of theirs: minima of random orders.

    In a random order, the minimum of ``j + 1`` steps lasts until step ``(j + 1) / u`` for a uniform ``u``.
    """
    draw = np.random.Generator(np.random.PCG64([seed, digits]))
    out: dict[int, list[int]] = {}
    for k in range(digits):
        j = 0
        while j < most:
            out.setdefault(j, []).append(k)
            j = max(j + 1, int(np.ceil((j + 1) / draw.uniform(1e-9, 1.0))))
    return {j: np.array(ks) for j, ks in out.items()}


@functools.cache
def nibbles(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, 16])).integers(0, 16, 1 << 16, np.uint8)


def kinds_of(text: str) -> np.ndarray:
    """A text's characters as numbers below ``END``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, points, 128 + points * np.uint32(2654435761) % np.uint32(END - 128)).astype(np.uint8)


def fingerprints(texts: list[str], digits: int = 256, seed: int = 1) -> np.ndarray:
    """A row of ``digits`` numbers below 16 for each text."""
    out = np.zeros((len(texts), digits), np.uint8)
    waiting, size = [], 0
    for i, text in enumerate(texts):
        kinds = kinds_of(text)
        for s, at in enumerate(range(0, max(1, len(kinds)), STRETCH)):
            waiting.append((i, s, kinds[at : at + STRETCH]))
            size += len(waiting[-1][2])
        if size >= AT_ONCE:
            settle(waiting, out, digits, seed)
            waiting, size = [], 0
    if waiting:
        settle(waiting, out, digits, seed)
    return out


def settle(waiting: list[tuple[int, int, np.ndarray]], out: np.ndarray, digits: int, seed: int) -> None:
    """Walks the waiting stretches and writes each into the digits that are its own."""
    found = walked([x for _, _, x in waiting], np.array([s for _, s, _ in waiting]), digits, seed)
    most = max(s for _, s, _ in waiting) + 1
    own = samples(seed + 1, digits, most) if most > 1 else {0: np.arange(digits)}
    for row, (i, s, _) in zip(found, waiting):
        if s in own:
            out[i, own[s]] = row[own[s]]


def looks(j: int) -> bool:
    """Whether walks at the end leave after ``j`` steps: at once in short ones, within a few hundredths of long ones."""
    return j < 64 or j < 1024 and j % 8 == 0 or j % 32 == 0


def walked(stretches: list[np.ndarray], number: np.ndarray, digits: int, seed: int) -> np.ndarray:
    """The fingerprints of stretches of texts, all walked in lockstep."""
    order = np.argsort([-len(x) for x in stretches], kind="stable")
    end = np.array([END], np.uint8)
    flat = np.concatenate([y for i in order for y in (stretches[i], end)])
    lengths = np.array([len(stretches[i]) for i in order])
    stop = np.cumsum(lengths + 1) - 1
    at = stop - lengths
    begin = number[order] * 977 % PERIOD  # stretches begin at different places of the coins
    coin, table, when = coins(seed), nibbles(seed), samples(seed, digits, STEPS)
    out = np.zeros((digits, len(order)), np.uint8)
    alive, j = np.arange(len(order)), 0
    shared = not begin.any()
    while len(alive):
        kind = flat[at]
        ks = when.get(j)
        if ks is not None:
            # kinds that are read at one step have different places in the table
            place = kind.astype(np.uint16) * np.uint16(251) + ((j * 40503 + ks * 60493) & 0xFFFF).astype(np.uint16)[:, None]
            if len(alive) == len(order):
                out[ks] = table[place]
            else:
                out[ks[:, None], alive] = table[place]
        at = at + (coin[j % PERIOD][kind] if shared else coin[(j + begin) % PERIOD, kind])
        j += 1
        if looks(j):
            going = at < stop
            if not going.all():
                alive, at, stop, begin = alive[going], at[going], stop[going], begin[going]
                shared = not begin.any()
    back = np.empty_like(out.T)
    back[order] = out.T
    return back


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The share of equal digits, 0 where it is what chance gives (one in sixteen)."""
    equal = (left == right).mean(-1)
    return np.maximum(0.0, (equal - 1 / 16) * 16 / 15)


def shown(fingerprint: np.ndarray) -> str:
    return bytes(fingerprint[0::2] << 4 | fingerprint[1::2]).hex()


def texts(batch: pa.RecordBatch) -> list[str]:
    return [(x or b"").decode("utf-8", "surrogateescape") for x in raw(batch, "text")]


def in_walks(batches: Iterator[pa.RecordBatch], digits: int) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Rows with ``text`` and their fingerprints, so many at once that they are walked together."""
    held, words, size = [], [], 0

    def done():
        found, at = fingerprints([t for w in words for t in w], digits), 0
        for b, w in zip(held, words):
            yield b, w, found[at : at + len(w)]
            at += len(w)

    for whole in batches:
        for begin in range(0, whole.num_rows, 256):
            held.append(whole.slice(begin, 256))
            words.append(texts(held[-1]))
            size += sum(map(len, words[-1]))
            if size >= AT_ONCE:
                yield from done()
                held, words, size = [], [], 0
    if held:
        yield from done()


def fingerprinted(docs: DataFrame, digits: int = 256) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` (hex digits) of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, found in in_walks(batches, digits):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_chars": pa.array([len(t) for t in words], pa.int64()), "fingerprint": pa.array(list(map(shown, found)), pa.string())})

    return picked(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: The order of documents: nulls last, then id, then text by its hash.
ORDER = ("none", "doc_id", "h")
#: Keys per range in the sample that bounds come from, ranges per shuffle partition, and most ranges.
SAMPLED, RANGES, MOST = 20, 4, 1 << 16


def ordered_bounds(keyed: DataFrame) -> list[tuple]:
    """The first keys of ranges of the documents' order, about as many documents in each."""
    facts = keyed.agg(F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("least")).first()
    if not facts.n:
        return []
    ranges = min(facts.n, RANGES * shuffle_partitions(keyed.sparkSession), MOST)
    share = min(1.0, SAMPLED * ranges / facts.n)
    drawn = sorted(map(key_of, (keyed if share == 1 else keyed.sample(share, 1)).select(*ORDER).collect()))
    return sorted({key_of(facts.least), *drawn[:: max(1, len(drawn) // ranges)]})


def key_of(row) -> tuple:
    return row.none, row.doc_id or 0, row.h


SENT = pa.schema([("range", pa.int32()), ("head", pa.int32()), ("none", pa.bool_()), ("doc_id", pa.int64()), ("h", pa.int64()), ("print", pa.binary()), ("data", pa.binary())])
PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame, digits: int = 256) -> DataFrame:
    """Every document of ``docs(doc_id, text)``, its text with the last half replaced, and its next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The edited text
    ends with as many characters of the next document as half of the text has (or all of them).

    Documents are dealt to ranges of their order; a range's first document also goes to the end of the
    range before it (that of the first range to the last one), so every document meets its next
    one while the rows of a range pass by in order, two at a time. A hot range costs time, not memory.
    """
    keyed = picked(docs).select("doc_id", "text", F.col("doc_id").isNull().alias("none"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    bounds = ordered_bounds(keyed)
    sent = docs.sparkSession.sparkContext.broadcast(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, squeezed = sent.value, zstandard.ZstdCompressor(3)
        for batch, words, found in in_walks(batches, digits):
            rows = []
            for none, doc, h, text, own in zip(*(batch.column(c).to_pylist() for c in ORDER), words, found):
                key = (none, doc or 0, h)
                r = bisect.bisect_right(bounds, key) - 1
                row = (none, doc, h, own.tobytes(), squeezed.compress(text.encode("utf-8", "surrogateescape")))
                rows.append((r, 0, *row))
                if bounds[r] == key:
                    rows.append(((r - 1) % len(bounds), 1, *row))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), SENT.types)], schema=SENT)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        held, size, before = [], 0, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("range", "head", "doc_id", "print", "data"))
            for r, head, doc, own, data in zip(*columns):
                if before is None and head:
                    continue  # a further copy of the next range's first document
                text = plain.decompress(data).decode("utf-8", "surrogateescape")
                if before is not None:
                    _, last, n, kept, was = before
                    held.append((last, n, kept + text[: n // 2], was, own))
                    size += len(held[-1][2])
                before = None if head else (r, doc, len(text), text[: len(text) - len(text) // 2], own)
                if size >= AT_ONCE:
                    yield compared(held, digits)
                    held, size = [], 0
        if held:
            yield compared(held, digits)

    dealt = keyed.mapInArrow(deal, "range int, head int, none boolean, doc_id long, h long, print binary, data binary")
    return dealt.repartition("range").sortWithinPartitions("range", "head", *ORDER).mapInArrow(meet, PAIRED)


def compared(rows: list[tuple], digits: int) -> pa.RecordBatch:
    ids, sizes, edited, own, following = zip(*rows)
    found = fingerprints(list(edited), digits)
    own, following = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, digits) for x in (own, following))
    hashes = [hashlib.sha256(t.encode("utf-8", "surrogateescape")).hexdigest() for t in edited]
    columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), *(pa.array(list(map(shown, x)), pa.string()) for x in (own, found)), *(pa.array(likeness(own, x), pa.float64()) for x in (found, following))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PAIRED.split(", ")])


#: Bands, digits that a band samples, and rows after it in a band's order that a fingerprint is compared with.
BANDS, ROWS, NEIGHBOURS = 32, 6, 8


def near_duplicates(docs: DataFrame, least: float = 0.8, digits: int = 256) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: the smallest id that is reachable by likenesses of ``least`` and more.

    Copies are one fingerprint from the start. Each band samples digits; fingerprints with the same ones are
    ordered by all digits, those of the band first, and each is verified with its neighbours after it. So a
    band of any size makes rows in proportion to its size. Rows without id get no component.
    """
    found = cut(fingerprinted(docs, digits))
    distinct = found.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    places = [np.random.Generator(np.random.PCG64([7, b])).permutation(digits).tolist() for b in range(BANDS)]
    band = lambda p: F.concat(*[F.substring("fingerprint", i + 1, 1) for i in p[:ROWS]])
    turned = F.array(*[F.struct(F.lit(b).alias("band"), band(p).alias("key")) for b, p in enumerate(places)])
    rows = distinct.select("node", "fingerprint", F.explode(turned).alias("at")).select("node", "fingerprint", "at.*")
    order = "partition by band, key order by substring(fingerprint, 8 * band + 1), fingerprint"
    near = rows.select("node", "fingerprint", F.expr(f"collect_list(struct(node, fingerprint)) over ({order} rows between 1 following and {NEIGHBOURS} following)").alias("others")).where("size(others) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                a, b, pairs = [], [], []
                for node, fp, others in zip(*(part.column(c).to_pylist() for c in ("node", "fingerprint", "others"))):
                    for o in others:
                        a.append(fp)
                        b.append(o["fingerprint"])
                        pairs.append((node, o["node"]))
                left, right = (np.frombuffer("".join(x).encode(), np.uint8).reshape(-1, digits) for x in (a, b))
                kept = np.array(pairs, np.int64).reshape(-1, 2)[likeness(left, right) >= least]
                yield pa.RecordBatch.from_pydict({"a": kept[:, 0], "b": kept[:, 1]})

    classes = connected_components(near.mapInArrow(run, "a long, b long").distinct())
    known = distinct.join(classes, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return found.join(known, "fingerprint", "left").select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
