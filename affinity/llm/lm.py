"""Language-model scoring with a weighted backoff automaton.

Tokens are a text's words plus one end token. Counted n-grams up to three tokens make the
automaton: its states are the empty history, the words and the word pairs of the training
texts, an n-gram is an arc from the state of its first tokens, and a state's failure arc,
taken where no arc matches, leads to the state that has forgotten the oldest token. One
pass from left to right carries the state and adds up log10 weights. Smoothing is
interpolated, which the arcs' weights hold ready::

    P(w | h) = (c(h, w) + t(h) * P(w | h')) / (c(h) + t(h)),   failure weight t(h) / (c(h) + t(h))
    P(w)     = (c(w) - d) / N,  d = max(n1, 1) / (V + 1)
    P(new)   = d * V / N        (one type for every word not in training)

``h'`` is ``h`` without its oldest token, N the training tokens, V the distinct ones, n1 those
seen once; each state's weights sum to one. ``t(h) = c(h)^beta`` stands for the number of
different arcs of a state; beta is solved per order so that all states together have as
many arcs as the corpus has distinct n-grams. Texts begin in the state of the end token.

Counting and scoring are spread by text blocks and n-gram buckets. A task's texts are
gathered into blocks of about ``block_bytes``, written down once. A block lists its
distinct words, pairs and triples with its own training counts, one row per bucket of the
hash; a bucket adds up the counts of all blocks and sends each block the totals in the
order that the block listed them; the block compiles them to its part of the automaton,
all the states and arcs that its texts can reach, and walks its texts. An n-gram costs one
entry per block that has it however often it occurs, so hot words do not skew, and no
vocabulary is ever broadcast or collected: only sums over the corpus are. Rows between
blocks and buckets are as many as their product, but never more than there are entries.

Words travel as they are and count exactly. Pairs and triples travel as keys whose bits grow
with the corpus (``KEY_MARGIN`` above its logarithm), so that one in sixteen million at
most shares its key, and count, with another, at any size.

Defined results: null text is empty (only the end token); every row is scored, repeated
rows each; an empty training set gives N = V = 0 and a base score of 0 for all (one
unknown type of probability 1); further columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped_shuffles, raw

END = b""
#: Bits of a key beyond the logarithm of the number of n-grams.
KEY_MARGIN = 24
#: Bytes of text per bucket: about a fifth as many n-grams.
BUCKET_BYTES = 16 << 20
CLASSES = 64


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a pair of 64-bit hashes, told from the pair in reverse."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeeze(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def to_bits(values: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :]


def pack(keys: np.ndarray, bits: int) -> bytes:
    """Ascending keys of ``bits`` bits: low bits as they are, the rest as gaps in unary (Elias-Fano)."""
    n = len(keys)
    low = max(0, bits - max(n, 1).bit_length())
    high = (keys >> np.uint64(low)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    unary[high] = 1
    return np.packbits(to_bits(keys, low)).tobytes() + np.packbits(unary).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    low = max(0, bits - max(n, 1).bit_length())
    flat, size = np.frombuffer(data, np.uint8), -(-n * low // 8)
    wide = np.zeros((n, 64), np.uint8)
    wide[:, 64 - low :] = np.unpackbits(flat[:size], count=n * low).reshape(n, low)
    high = np.flatnonzero(np.unpackbits(flat[size:]))[:n] - np.arange(n)
    return np.packbits(wide, axis=1).view(">u8").reshape(-1).astype(np.uint64) | high.astype(np.uint64) << np.uint64(low)


def narrow(counts: np.ndarray) -> bytes:
    """Counts as one byte each; larger ones, rare, as 255 and their value at the end; compressed."""
    large = counts[counts >= 255]
    return squeeze(np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<u8").tobytes())


def widen(data: bytes, n: int) -> np.ndarray:
    data = zstandard.decompress(data)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n)
    return out


@dataclass
class Keys:
    """How n-grams are named: ``bits`` of their hash, the first ``spread`` of which tell the bucket."""

    bits: int
    spread: int

    @classmethod
    def of(cls, size: int) -> Keys:
        spread = max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
        return cls(min(64, KEY_MARGIN + max(4, math.ceil(math.log2(size / 4 + 1)))), spread)

    @property
    def rest(self) -> int:
        return self.bits - self.spread

    def split(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of the hashes by key, and in this order buckets and what is left of the keys."""
        keys = hashes >> np.uint64(64 - self.bits)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        bucket = (keys >> np.uint64(self.rest)).astype(np.int64) if self.spread else np.zeros(len(keys), np.int64)
        return order, bucket, keys & np.uint64((1 << self.rest) - 1)


class Block:
    """The texts of a block as numbers: words, pairs and triples, and their order by bucket."""

    def __init__(self, texts: list[bytes], keys: Keys) -> None:
        ids: dict[bytes, int] = {END: 0}
        parts, sizes = [], np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = text.lower().split()
            for w in words:
                if w not in ids:
                    ids[w] = len(ids)
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
            sizes[k] = len(words) + 1
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.sizes, self.words = sizes, list(ids)
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        n = len(self.words)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, n)
        order = np.argsort(hashes, kind="stable")
        if (hashes[order][1:] == hashes[order][:-1]).any():  # two words with one hash: their own order decides
            order = np.array(sorted(range(n), key=lambda i: (hashes[i], self.words[i])))
        bucket = (hashes[order] >> np.uint64(64 - keys.spread)).astype(np.int64) if keys.spread else np.zeros(n, np.int64)
        # the state before a text's first word is the end token
        self.before = np.zeros_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        pairs, self.pair_of = np.unique(self.before * n + self.tokens, return_inverse=True)
        pair_hashes = mixed(hashes[pairs // n], hashes[pairs % n])
        # a triple begins with the pair before it; a text's first token has none
        self.inner = np.ones(len(self.tokens), bool)
        self.inner[self.first] = False
        at = np.flatnonzero(self.inner)
        triples, inverse = np.unique(self.pair_of[at - 1] * n + self.tokens[at], return_inverse=True)
        self.triple_of = np.full(len(self.tokens), -1)
        self.triple_of[at] = inverse
        triple_hashes = mixed(pair_hashes[triples // n], ~hashes[triples % n])
        #: By order of the n-grams: their places by bucket, and the buckets.
        self.orders = [order, None, None]
        self.buckets = [bucket, None, None]
        self.keys: list = [None, None, None]
        for k, h in ((1, pair_hashes), (2, triple_hashes)):
            self.orders[k], self.buckets[k], self.keys[k] = keys.split(h)

    def counts(self, trained: np.ndarray) -> list[np.ndarray]:
        """Of words, pairs and triples, in bucket order, over the texts marked as training."""
        use = np.repeat(trained, self.sizes)
        found = [(self.tokens, use), (self.pair_of, use), (self.triple_of, use & self.inner)]
        return [np.bincount(of[mask], minlength=len(order))[order] for (of, mask), order in zip(found, self.orders)]

    def slices(self, bucket: int) -> list[slice]:
        return [slice(*np.searchsorted(b, [bucket, bucket + 1])) for b in self.buckets]


def gathered(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A task's texts in blocks of about ``block_bytes``, each one compressed row; a longer text is a block of its own."""

    def run(batches):
        task, made, ids, trained, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            columns = [[task << 32 | made], [ids], [trained], [[len(x) for x in texts]], [squeeze(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, GATHERED.types)], schema=GATHERED)

        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                for doc, use, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw(part, "text")):
                    if texts and size + len(text) > block_bytes:
                        yield row()
                        made, ids, trained, texts, size = made + 1, [], [], [], 0
                    ids.append(doc)
                    trained.append(use)
                    texts.append(text)
                    size += len(text) + 1
        if texts:
            yield row()

    return docs.select("doc_id", "trained", "text").mapInArrow(run, "block long, doc_ids array<long>, trained array<boolean>, sizes array<int>, texts binary")


def texts_of(row: dict) -> list[bytes]:
    data, ends = zstandard.decompress(row["texts"]), np.cumsum(row["sizes"]).tolist()
    return [data[e - n : e] for e, n in zip(ends, row["sizes"])]


def list_block(row: dict, keys: Keys) -> pa.RecordBatch:
    """One row per bucket that the block has entries in."""
    block = Block(texts_of(row), keys)
    counts = block.counts(np.array(row["trained"], bool))
    rows = []
    for b in np.unique(np.concatenate([np.unique(x) for x in block.buckets])).tolist():
        own = block.slices(b)
        words = squeeze(b"\n".join(block.words[i] for i in block.orders[0][own[0]]))
        packed = [pack(block.keys[k][own[k]], keys.rest) for k in (1, 2)]
        rows.append((b, row["block"], [s.stop - s.start for s in own], words, *packed, *(narrow(c[s]) for c, s in zip(counts, own))))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), LISTED.types)], schema=LISTED)


def classes(counts: np.ndarray) -> list[int]:
    """How many counts above zero have each number of bits, and their sums."""
    counts = counts[counts > 0]
    kind = np.frexp(counts.astype(float))[1]
    return [*np.bincount(kind, minlength=CLASSES).tolist(), *np.bincount(kind, counts, minlength=CLASSES).astype(np.int64).tolist()]


def add_bucket(table: pa.Table, keys: Keys) -> pa.Table:
    """Totals of a bucket, returned to each block in the block's order; sums over the bucket in the first row."""
    rows = table.to_pylist()
    total: dict[bytes, int] = {}
    for r in rows:
        r["list"] = zstandard.decompress(r["words"]).split(b"\n") if r["n"][0] else []
        for w, c in zip(r["list"], widen(r["counts0"], r["n"][0]).tolist()):
            total[w] = total.get(w, 0) + c
    counts = np.fromiter(total.values(), np.int64, len(total))
    facts = [int(counts.sum()), int((counts > 0).sum()), int((counts == 1).sum())]
    back = [[narrow(np.fromiter(map(total.__getitem__, r["list"]), np.int64, r["n"][0])) for r in rows]]
    seen = [classes(counts)]
    for k in (1, 2):
        unique, inverse = np.unique(np.concatenate([unpack(r[f"keys{k}"], r["n"][k], keys.rest) for r in rows]), return_inverse=True)
        # sums of whole numbers, exact in a double
        sums = np.bincount(inverse, np.concatenate([widen(r[f"counts{k}"], r["n"][k]) for r in rows]), len(unique)).astype(np.int64)
        ends = np.cumsum([r["n"][k] for r in rows]).tolist()
        back.append([narrow(sums[inverse[e - r["n"][k] : e]]) for r, e in zip(rows, ends)])
        facts.append(int((sums > 0).sum()))
        seen.append(classes(sums))
    facts += seen[0] + seen[1]
    out = [(r["block"], r["bucket"], r["n"], *(x[i] for x in back), facts if i == 0 else None) for i, r in enumerate(rows)]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), ADDED.types)], schema=ADDED)


_binary, _longs = pa.binary(), pa.list_(pa.int64())
GATHERED = pa.schema([("block", pa.int64()), ("doc_ids", _longs), ("trained", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("texts", _binary)])
LISTED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", _longs), ("words", _binary), ("keys1", _binary), ("keys2", _binary), ("counts0", _binary), ("counts1", _binary), ("counts2", _binary)])
ADDED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", _longs), ("counts0", _binary), ("counts1", _binary), ("counts2", _binary), ("facts", _longs)])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean", _binary: "binary", _longs: "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


@dataclass
class Weights:
    """What the corpus gives to all states: tokens, types, types seen once, and beta of either order."""

    tokens: int
    types: int
    once: int
    beta: tuple[float, float] = (0.5, 0.5)

    @classmethod
    def of(cls, facts: list[int]) -> Weights:
        tokens, types, once, pairs, triples, *seen = facts
        kinds = [np.array(seen[i * CLASSES : (i + 1) * CLASSES], float) for i in range(4)]
        return cls(tokens, types, once, (beta_of(kinds[0], kinds[1], pairs), beta_of(kinds[2], kinds[3], triples)))

    @property
    def discount(self) -> float:
        return max(self.once, 1) / (self.types + 1)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(count))
        return np.where(count > 0, count - self.discount, self.discount * self.types) / self.tokens

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.types + 1))

    def failure(self, state_count: np.ndarray, order: int) -> np.ndarray:
        """Weight of the failure arc of states of that many tokens; 1 where there is no such state."""
        arcs = np.maximum(state_count, 1).astype(float) ** self.beta[order - 1]
        return np.where(state_count > 0, arcs / (state_count + arcs), 1.0)

    def arc(self, count: np.ndarray, state_count: np.ndarray, failure: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Weight of an arc: what its count gives, and what failing would."""
        return (1 - failure) * count / np.maximum(state_count, 1) + failure * lower


def beta_of(number: np.ndarray, total: np.ndarray, arcs: int) -> float:
    """The power at which states of these counts (how many of a class, and their sum) have ``arcs`` arcs together."""
    have = number > 0
    number, mean = number[have], total[have] / number[have]
    low, high = 0.05, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if (number * mean**mid).sum() < arcs else (low, mid)
    return (low + high) / 2


@dataclass
class Automaton:
    """The states and arcs that a block's texts can reach, compiled: arcs by their n-gram's number, log10 weights."""

    block: Block
    has: list[np.ndarray]  # by order: whether there is the arc
    weight: list[np.ndarray]  # by order: the arc's weight
    fail: list[np.ndarray]  # of the states of a word and of a pair: the failure arc's weight

    @classmethod
    def compile(cls, block: Block, counts: list[np.ndarray], weights: Weights) -> Automaton:
        words, pairs, triples = counts
        one = weights.unigram(words)
        fail = [weights.failure(words, 1), weights.failure(pairs, 2)]
        # arcs are looked up by an occurrence, the last of each, of their n-gram
        at = np.zeros(len(pairs), np.int64)
        at[block.pair_of] = np.arange(len(block.tokens))
        u, w = block.before[at], block.tokens[at]
        two = weights.arc(pairs, words[u], fail[0][u], one[w])
        inner = np.flatnonzero(block.inner)
        at = np.zeros(len(triples), np.int64)
        at[block.triple_of[inner]] = inner
        state, last = block.pair_of[at - 1], block.pair_of[at]
        three = weights.arc(triples, pairs[state], fail[1][state], two[last])
        return cls(block, [x > 0 for x in counts], [np.log10(x) for x in (one, two, three)], [np.log10(x) for x in fail])

    def walk(self) -> np.ndarray:
        """Log10 weight of every token, texts from left to right.

        The state before a token is the longest known history that the arc before led to:
        two tokens after an arc of two or three, one after that of a known word, else none. All
        texts move at once, as an arc's n-gram holds those of the arcs that failing would try.
        """
        b = self.block
        arcs = np.stack([np.ones(len(b.tokens), bool), self.has[0][b.tokens], self.has[1][b.pair_of], b.inner & self.has[2][b.triple_of] if len(self.has[2]) else np.zeros(len(b.tokens), bool)])
        taken = 3 - np.argmax(arcs[::-1], axis=0)  # the longest n-gram that has an arc; 0 for a new word
        state = np.ones(len(b.tokens), np.int64)  # a text begins in the state of the end token
        state[1:] = np.minimum(taken[:-1], 2)
        state[b.first] = 1 if len(self.has[0]) and self.has[0][0] else 0
        out = np.choose(taken, [self.weight[0][b.tokens], self.weight[0][b.tokens], self.weight[1][b.pair_of], self.weight[2][b.triple_of] if len(self.weight[2]) else 0.0])
        # failure arcs on the way down: from the state to the one whose arc is taken
        known = np.maximum(taken, 1)
        left = (state >= 2) & (known <= 2)
        at = np.flatnonzero(left)
        out[at] += self.fail[1][b.pair_of[at - 1]]
        left = (state >= 1) & (known <= 1)
        out[left] += self.fail[0][b.before[left]]
        return out


SCORED = pa.schema([("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_block(docs: pa.Table, added: pa.Table, keys: Keys, weights: Weights) -> pa.Table:
    out = []
    for row in docs.to_pylist():
        block = Block(texts_of(row), keys)
        counts = [np.zeros(len(x), np.int64) for x in block.orders]
        for r in added.select(["bucket", "n", "counts0", "counts1", "counts2"]).to_pylist():
            for k, own in enumerate(block.slices(r["bucket"])):
                counts[k][block.orders[k][own]] = widen(r[f"counts{k}"], r["n"][k])
        add = lambda x: np.add.reduceat(x, block.first)
        known = (counts[0] > 0).astype(np.int64)
        score = Automaton.compile(block, counts, weights).walk()
        columns = [row["doc_ids"], row["trained"], block.sizes, add(known[block.tokens]), add(weights.base(counts[0])[block.tokens]), add(score)]
        out.append(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, SCORED.types)], schema=SCORED))
    return pa.concat_tables(out) if out else SCORED.empty_table()


def score_documents(docs: DataFrame, trained, block_bytes: int = 5 << 20) -> DataFrame:
    """Score every row of ``docs(doc_id, text)`` by a model of the rows where ``trained`` holds.

    Returns ``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score``.
    ``block_bytes`` bounds what one task holds (about sixty times that in Python objects);
    blocks and buckets grow in number with the corpus.
    """
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(trained, F.lit(False)).alias("trained"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the listing is the largest shuffle; it goes before the next is written
    with dropped_shuffles(docs.sparkSession):
        blocks = cut(gathered(dealt, block_bytes))
        size = blocks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x + 1)"))).first()[0] or 0
        keys = Keys.of(size)

        def list_all(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    yield list_block(batch.slice(at, 1).to_pylist()[0], keys)

        added = cut(blocks.mapInArrow(list_all, ddl(LISTED)).groupBy("bucket").applyInArrow(lambda t: add_bucket(t, keys), ddl(ADDED)))
        facts = added.where("facts is not null").select(F.posexplode("facts")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()
    weights = Weights.of([r.n for r in facts] or [0] * (5 + 4 * CLASSES))
    out = blocks.groupBy("block").cogroup(added.drop("facts").groupBy("block")).applyInArrow(lambda d, a: score_block(d, a, keys, weights), ddl(SCORED))
    return out.withColumn("train_tokens", F.lit(weights.tokens).cast("long"))
