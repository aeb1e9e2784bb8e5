"""Chat formatting from reply trees.

A tree is a set of nodes (node, parent, role, text, score). Iterative self-joins of the nodes work out each one's root, depth and
path score: after round k a node knows its 2^k-th ancestor, or its root, so a path of length d takes log2(d) rounds of one row a node.
Every leaf is then a root-to-leaf path. Branches of a root are ranked by the sum of their nodes' scores (ties: longer first, then the
smaller leaf), and only the best ``branches`` are unfolded, by the same rounds; each becomes one conversation.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Control strings inside a role or a text get
ESCAPE after their first character, and ESCAPE itself is doubled by a 0, so a text can never open or close a turn and
reading back restores it exactly. The loss mask is a list of [start, end) code point spans of the assistant's texts.

Defined cases: null role or text is empty; a null parent, or one that doesn't exist, makes a root; rows of a null node id are in no tree; nodes on or under a cycle hang from no root
and give no path; a repeated node id keeps its first row by (role, text), and ``repeated_nodes`` gives the others; texts of any length are whole; columns
other than the five are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidlake.llm.common import staged

ESCAPE = "␛"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>")
_CONTROL = re.compile(ESCAPE + "|" + "|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE + "0" if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}(0?)", lambda m: ESCAPE if m[1] else "", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask's spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace('\n', ESCAPE + '1')}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for piece in formatted.split(OPEN)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((unescape(role.replace(ESCAPE + "1", "\n")), unescape(rest[: rest.rindex(CLOSE)])))
    return turns


def repeated_nodes(nodes: DataFrame) -> DataFrame:
    """The rows that reply_paths passes over: all but the first of each node id, whole."""
    once = Window.partitionBy("node").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return nodes.withColumn("order_in_node", F.row_number().over(once)).where("order_in_node > 1").drop("order_in_node")


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(root, leaf, branch, position, role, text) of the best branches of each tree. nodes: node, parent, role, text, score."""
    nodes = nodes.select("node", "parent", "role", "text", "score")
    once = Window.partitionBy("node").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    nodes = staged(nodes.withColumn("rn", F.row_number().over(once)).where("rn = 1").drop("rn"))
    known = nodes.select(F.col("node").alias("top"))
    own = nodes.select("node", F.col("parent").alias("top"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    under = own.join(known, "top", "left_semi").select("node", "top", F.lit(1).cast("long").alias("depth"), "score", F.lit(True).alias("open"))
    roots = own.join(known, "top", "left_anti").select("node", F.col("node").alias("top"), F.lit(0).cast("long").alias("depth"), "score", F.lit(False).alias("open"))
    state, levels, left = staged(under.unionByName(roots)), [], None
    leaves = nodes.select("node").join(under.select(F.col("top").alias("node")), "node", "left_anti")
    while True:
        hop = state.where("open")
        n = hop.count()
        if n == 0 or n == left:  # depths have no gaps: where none ended in a round, the rest are on or under cycles
            break
        levels.append(hop.select(F.col("node").alias("member"), F.col("top").alias("next")))
        further = state.select(F.col("node").alias("top"), F.col("top").alias("over"), F.col("depth").alias("more"), F.col("score").alias("plus"), F.col("open").alias("still"))
        gone = hop.join(further, "top").select("node", F.col("over").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("plus")).alias("score"), F.col("still").alias("open"))
        state, left = staged(state.where(~F.col("open")).unionByName(gone)), n
    paths = state.where(~F.col("open")).join(leaves, "node").select(F.col("node").alias("leaf"), F.col("top").alias("root"), "depth", "score")
    order = F.struct((-F.col("score")).alias("s"), (-F.col("depth")).alias("d"), F.col("leaf"))
    if branches == 1:
        best = paths.groupBy("root").agg(F.min(order).alias("b")).select("root", F.col("b.leaf").alias("leaf"), (-F.col("b.d")).alias("depth"), F.lit(1).alias("branch"))
    else:
        best = paths.withColumn("branch", F.row_number().over(Window.partitionBy("root").orderBy(order))).where(F.col("branch") <= branches).select("root", "leaf", "depth", "branch")
    members = staged(best.select("root", "leaf", "branch", F.col("leaf").alias("member"), F.col("depth").alias("position")))
    for k, level in enumerate(levels):
        reached = members.join(level, "member").select("root", "leaf", "branch", F.col("next").alias("member"), (F.col("position") - (1 << k)).alias("position"))
        members = members.unionByName(staged(reached))
    told = nodes.select(F.col("node").alias("member"), "role", "text")
    return members.join(told, "member").select("root", "leaf", "branch", "position", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """(root, leaf, branch, formatted, spans): one conversation per chosen path."""
    turns = F.sort_array(F.collect_list(F.struct("position", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    grouped = paths.groupBy("root", "leaf", "branch").agg(turns.alias("turns"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [render([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"].to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in got]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["root"], batch["leaf"], batch["branch"], pa.array([f for f, _ in got], pa.string()), pa.array(spans, kind)], ["root", "leaf", "branch", "formatted", "spans"])

    kinds = {f.name: f.dataType.simpleString() for f in grouped.schema}
    return grouped.mapInArrow(write, f"root {kinds['root']}, leaf {kinds['leaf']}, branch int, formatted string, spans array<struct<start:bigint,end:bigint>>")


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    return format_paths(reply_paths(nodes, branches))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text itself holds: root, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch["formatted"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                sums = (hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()), hashlib.sha256(loss.encode()))
                for column, value in zip(out, (len(turns), sums[0].hexdigest(), len(loss), sums[1].hexdigest(), len(text)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["root"], *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["root", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["root"].dataType.simpleString()
    return formatted.mapInArrow(read, f"root {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Each conversation as a chain: a row's parent is the row before it by (turn, role, text), so no repeated turn is lost."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("place"))
    node = lambda p: F.struct(F.col("conv_id"), p.alias("place"))
    return rows.select(node(F.col("place")).alias("node"), F.when(F.col("place") > 1, node(F.col("place") - 1)).alias("parent"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))
