"""Reply trees as conversations.

Messages name the message they reply to. Self-joins that double tell every message's path to its root: round k joins
the table of 2^k-th ancestors with itself, so a tree of depth d takes log2(d) rounds of one row
per message. The rows carry what a branch is ranked by, the sum of the scores on the way. The branches of a
tree, one per leaf, are ranked by their mean score, and only the chosen ones are written out message by
message, by joining their paths with the ancestors of each round. Each becomes one conversation.

A turn is written ``<|turn|>role<|text|>text</s>``. Inside of roles and texts a backslash
is doubled and every control string gets a backslash behind its first character, so a
control string in the result is always the template's own, and removing the backslashes
gives the text back. The loss mask is the list of spans of the assistant's texts.

Defined results: null roles and texts are empty; of rows with one tree and message id the first by parent (null first), role,
text and score is the message, so repeated rows change nothing (``chain`` gives every row an id of its
own: there they are turns each); a message without an id is in no conversation; a message whose parent is missing is a
root; one that never reaches a root (a cycle) is in no conversation; a null tree id is a tree of its
own; equal scores rank by the smaller leaf; an empty table gives no conversations; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow

TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"
# fixed values: control strings of this and of common templates
CONTROL = [TURN, TEXT, END, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|user|>", "<|assistant|>", "<|system|>"]
ANY_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return ANY_CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def write_conversation(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss spans in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_conversation(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, text = part.split(TEXT)
        turns.append((unescape(role), unescape(text.removesuffix(END))))
    return turns


def read_loss(formatted: str, spans: list[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def climbs(nodes: DataFrame) -> list[DataFrame]:
    """``tree, node, above, sum, n`` by round: the 2^k-th ancestor of each node of ``nodes(tree, node, parent, score)``.

    ``sum`` and ``n`` are those of the scores from the node to before ``above``; without one it has come past its
    root, and they are those of its whole path. (tree, node) is unique, so each round has a row per
    node. The last round has none left to go on, but for cycles, which get as many rounds as the largest tree may need.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = cut(nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("above"), "score", F.lit(1).cast("long").alias("n")).withColumnRenamed("score", "sum"))
    rounds, size, step = [state], nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0, 1
    while step <= size and not state.where("above is not null").isEmpty():
        on = state.select("tree", F.col("node").alias("above"), F.col("above").alias("top"), F.col("sum").alias("more"), F.col("n").alias("further"))
        going = state.where("above is not null").join(on, ["tree", "above"]).select("tree", "node", F.col("top").alias("above"), (F.col("sum") + F.col("more")).alias("sum"), (F.col("n") + F.col("further")).alias("n"))
        state = cut(state.where("above is null").unionByName(going))
        rounds.append(state)
        step *= 2
    return rounds


def branches(rounds: list[DataFrame], chosen: DataFrame) -> DataFrame:
    """``tree, leaf, rank, node, up``: the paths from the leaves ``chosen(tree, leaf, rank)`` to their roots; up = steps above the leaf."""
    path = chosen.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, state in enumerate(rounds[:-1]):
        jump = state.where("above is not null").select("tree", "node", "above")
        further = path.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        path = cut(path.union(further))
    return path


def conversations(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """``tree, leaf, rank, n_turns, formatted, loss_spans`` for the best ``per_tree`` branches of each tree.

    ``messages(tree, node, parent, role, text, score)``; a branch's score is the mean of its messages' scores, null counting 0.
    """
    # the key of a tree must join with itself: a mark before every id tells them from none
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")).alias("tree")
    turn = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    keyed = cut(messages.where("node is not null").select(key, "node", turn.alias("turn")).groupBy("tree", "node").agg(F.min("turn").alias("turn")).select("tree", "node", "turn.*"))
    rounds = climbs(keyed.select("tree", "node", "parent", "score"))
    replied = rounds[0].where("above is not null").select("tree", F.col("above").alias("node"))
    scored = rounds[-1].where("above is null").join(replied, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("n")), "node")
    chosen = cut(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree).select("tree", F.col("node").alias("leaf"), "rank"))
    turns = branches(rounds, chosen).join(keyed.select("tree", "node", "role", "text"), ["tree", "node"])
    gathered = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct(F.negative("up").alias("at"), "role", "text"))).alias("turns"))

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [write_conversation([(x["role"], x["text"]) for x in t]) for t in batch.column(3).to_pylist()]
        spans = pa.array([[list(s) for s in x[1]] for x in found], pa.list_(pa.list_(pa.int64())))
        sizes = pa.array([len(t) for t in batch.column(3).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, pa.array([x[0] for x in found], pa.string()), spans], names=["tree", "leaf", "rank", "n_turns", "formatted", "loss_spans"])

    out = map_arrow(gathered.select("tree", "leaf", "rank", "turns"), write, "tree string, leaf long, rank int, n_turns long, formatted string, loss_spans array<array<long>>", rows=256)
    return out.withColumn("tree", F.when(F.col("tree") != "", F.expr("substring(tree, 2)")))


def chain(rows: DataFrame, tree: Column, order: list) -> DataFrame:
    """Linear conversations as trees: each row of a tree replies to the one before it in ``order``."""
    node = F.row_number().over(Window.partitionBy("tree").orderBy(*order)).cast("long")
    return rows.withColumn("tree", tree).withColumn("node", node).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.lit(0.0).alias("score"))


def digests(written: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, as digests."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            turns, loss = read_conversation(formatted), read_loss(formatted, spans)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        whole, string = pa.int64(), pa.string()
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), (whole, string, whole, string, whole))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    picked = written.select(F.col("tree").cast("long").alias("conv_id"), "formatted", "loss_spans")
    return map_arrow(picked, read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", rows=256)
