"""Chat formatting of reply trees.

Messages point to their parent. Jump pointers (a message to its ancestor 2, 4, 8, ... steps up, and the scores
on the way) come from iterative self-joins, so a tree of any depth takes a logarithmic number of them. From the
leaves they give the mean score of every root-to-leaf path; branches are ranked by it, the chosen ones are
followed message by message, and each is formatted as one conversation with a mask over the assistant's texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

#: The template: ``### <role>: <text></turn>`` and a newline. Control strings inside roles and texts are escaped.
_ESCAPES = (("\\", "\\\\"), ("</turn>", "\\e"), ("###", "\\h"), (": ", "\\c"))
_BACK = {"\\": "\\", "e": "</turn>", "h": "###", "c": ": "}
_TURN = re.compile(r"### (.*?): (.*?)</turn>\n", re.S)

_L = T.LongType()
FORMATTED = T.StructType([T.StructField("conv_id", _L), T.StructField("branch", _L), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(_L))])
DIGEST = T.StructType([T.StructField("conv_id", _L), T.StructField("n_turns", _L), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", _L), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", _L)])


def escape(text: str) -> str:
    for plain, sign in _ESCAPES:
        text = text.replace(plain, sign)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[int]]:
    """(formatted text, flat [start, end) spans of the texts to learn from)"""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role)}: ", escape(text)
        if role == learn:
            spans += [at + len(head), at + len(head) + len(body)]
        out.append(f"{head}{body}</turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def messages_once(messages: DataFrame, *said: str) -> DataFrame:
    """One row a message: of rows with the same conv_id and node_id the first by parent_id, score and what it says."""
    chosen = F.min(F.struct("parent_id", F.coalesce("score", F.lit(0.0)).alias("score"), *(F.coalesce(c, F.lit("")).alias(c) for c in said)))
    return messages.where("conv_id is not null and node_id is not null").groupBy("conv_id", "node_id").agg(chosen.alias("m")).select("conv_id", "node_id", "m.*")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, branch, step, node_id) of the ``branches`` best root-to-leaf paths of each conversation.

    ``messages``: conv_id, node_id, parent_id (null or absent from the conversation: a root), score (null: 0). A leaf
    is a message without replies. Ties go to the smaller leaf. Repeated node ids are one message, the first by parent
    and score; null ids are left out. Replies in a circle, and what hangs on one, have no root and so no path.
    """
    nodes = written(messages_once(messages), "nodes")
    up = nodes.select("conv_id", F.col("node_id").alias("parent_id"))
    jump = written(nodes.join(up, ["conv_id", "parent_id"]).select("conv_id", "node_id", F.col("parent_id").alias("up"), F.col("score").alias("gain")), "jump0")
    leaves = nodes.join(jump.select("conv_id", F.col("up").alias("node_id")).distinct(), ["conv_id", "node_id"], "left_anti").select("conv_id", "node_id")
    largest = nodes.groupBy("conv_id").count().agg(F.max("count")).head()[0] or 0
    jumps = []
    while not jump.isEmpty():
        if 1 << len(jumps) > largest:  # farther up than there are messages: these go round in a circle
            leaves = leaves.join(jump.select("conv_id", "node_id").distinct(), ["conv_id", "node_id"], "left_anti")
            break
        jumps.append(jump)
        far = jump.select("conv_id", F.col("node_id").alias("up"), F.col("up").alias("far"), F.col("gain").alias("more"))
        jump = written(jump.join(far, ["conv_id", "up"]).select("conv_id", "node_id", F.col("far").alias("up"), (F.col("gain") + F.col("more")).alias("gain")), f"jump{len(jumps)}")
    walk = leaves.select("conv_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("total"))
    for k in range(len(jumps) - 1, -1, -1):  # every leaf to its root, by the longest jumps first
        there = F.col("up").isNotNull()
        walk = walk.join(jumps[k], ["conv_id", "node_id"], "left").select("conv_id", "leaf", F.coalesce("up", "node_id").alias("node_id"), (F.col("depth") + F.when(there, 1 << k).otherwise(0)).alias("depth"), (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"))
    mean = (F.col("total") + F.col("score")) / (F.col("depth") + 1)
    ranked = walk.join(nodes.select("conv_id", "node_id", "score"), ["conv_id", "node_id"]).select("conv_id", "leaf", "depth", mean.alias("mean"))
    ranked = ranked.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("mean"), "leaf")).cast("long")).where(F.col("branch") <= branches)
    paths = written(ranked.select("conv_id", "branch", F.col("leaf").alias("node_id"), F.col("depth").alias("step")), "chosen")
    for k in range(len(jumps) - 1, -1, -1):  # distances with and without 2^k: every ancestor once
        far = paths.join(jumps[k], ["conv_id", "node_id"]).select("conv_id", "branch", F.col("up").alias("node_id"), (F.col("step") - (1 << k)).alias("step"))
        paths = written(paths.union(far), f"paths{k}")  # else the plan would double with every step
    return paths.select("conv_id", "branch", "step", "node_id")


def format_trees(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """Each chosen path of each conversation as one formatted text with the spans to learn from.

    ``messages``: conv_id, node_id, parent_id, score, role, text. Null role or text: empty. Empty table: no rows.
    Null ids are left out; repeated node ids and circles as in ``best_paths``. Extra columns are ignored. Very long
    texts are kept whole: a path is one text, so it must fit a task.
    """
    messages = written(messages_once(messages, "role", "text"), "messages")
    said = best_paths(messages, branches).join(messages.select("conv_id", "node_id", "role", "text"), ["conv_id", "node_id"])
    turns = said.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(F.struct("step", "role", "text"))).alias("turns")).select("conv_id", "branch", "turns.role", "turns.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                made = [format_turns(list(zip(r, t)), learn) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _ in made]), pa.array([x for _, x in made], pa.list_(pa.int64()))], schema=to_arrow_schema(FORMATTED))

    return turns.mapInArrow(run, FORMATTED)


def turn_chain(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a tree in which every message answers the one before; repeated turns follow one another."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node_id", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when read back: turns, and the text under the mask."""

    def of(conv, text, spans):
        turns = parse_turns(text)
        learnt = "".join(unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2]))
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return conv, len(turns), sha(said), len(learnt), sha(learnt), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(DIGEST)
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                rows = [of(*r) for r in zip(*(c.to_pylist() for c in batch.slice(i, 100).columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, DIGEST)
