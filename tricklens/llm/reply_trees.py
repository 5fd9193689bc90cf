"""Conversations from reply trees: enumerate root-to-leaf paths, rank branches, format the chosen ones.

Paths are found by iterative self-joins that double their reach: round k
knows every node's 2^k-th ancestor and the score of the nodes up to it, so a
tree of depth d takes log2(d) rounds, each joined on (tree, node). Leaves are
ranked by their whole path's score; the chosen leaves are then led back up by
the same ancestor tables, from the widest stride to the narrowest, which
reaches every node of their paths once.

The format marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control
strings inside roles and texts are escaped by one backslash more after their
first character and unescape to exactly what they were. The loss mask covers
the (escaped) texts of the roles to learn.

Defined results: a null text or role is empty; a null tree id is a tree of
its own; a parent that does not exist makes a root; nodes on a cycle are on no
root-to-leaf path; ties in score go to the smaller leaf; repeated rows of a
linear conversation are turns of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tricklens.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>\n"
# Strings that chat templates and the public tokenizers give a meaning.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
LEARNED = ("assistant",)
_rest = lambda c: re.escape(c[1:])
ESCAPED = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)(?={_rest(c)})" for c in CONTROL))
TURN = re.compile(re.escape(START) + "(.*?)\n(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    """One backslash more between the first character and the rest of each control string."""
    return ESCAPED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][:-1] if m[0].endswith("\\") else m[0], text)


def escape_role(role: str) -> str:
    """A role is one line: its own backslashes and line feeds are spelled out, then control strings escaped."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_turns(turns: list[tuple[str, str]], learned: tuple[str, ...] = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and its loss mask as (start, end) code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role in learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def tree_key(tree: Column) -> Column:
    return F.when(tree.isNull(), "n").otherwise(F.concat(F.lit("v"), tree.cast("string")))


def linear(rows: DataFrame, tree: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """Rows ordered by turn as trees of one branch: (tree, id, node, parent, score, role, text)."""
    rows = rows.select(
        tree_key(F.col(tree)).alias("tree"), F.col(tree).alias("id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    node = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("node", node)
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("tree", "id", "node", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def strides(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestor tables (tree, node, up) for strides 1, 2, 4, ... and the finished (tree, node, total, depth)."""
    links = nodes.select("tree", "node", "parent", "score")
    known = links.select(F.col("tree").alias("p_tree"), F.col("node").alias("p_node"))
    first = links.join(known, (F.col("tree") == F.col("p_tree")) & (F.col("parent") == F.col("p_node")), "left")
    reach = stored(
        first.select("tree", "node", F.col("p_node").alias("up"), F.col("score").cast("double").alias("total"), F.lit(1).cast("long").alias("depth")), "tree-reach"
    )
    n = reach.count()
    tables, done, stride = [], reach.where(F.col("up").isNull()), 1
    active = reach.where(F.col("up").isNotNull())
    # A path is no longer than the nodes there are; what is still on its way then runs in a cycle.
    while stride <= n and not active.isEmpty():
        tables.append(active.select("tree", "node", "up"))
        further = reach.select(*[F.col(c).alias(f"a_{c}") for c in reach.columns])
        joined = active.join(further, (F.col("tree") == F.col("a_tree")) & (F.col("up") == F.col("a_node")))
        # ``reach`` holds the nodes still under way at this stride and those that have arrived.
        moved = stored(
            joined.select("tree", "node", F.col("a_up").alias("up"), (F.col("total") + F.col("a_total")).alias("total"), (F.col("depth") + F.col("a_depth")).alias("depth")),
            "tree-reach",
        )
        arrived = moved.where(F.col("up").isNull())
        done = done.unionByName(arrived)
        active = moved.where(F.col("up").isNotNull())
        reach = active.unionByName(done)
        stride *= 2
    return tables, done


def branches(nodes: DataFrame, top: int | None = 1, score: Callable[[Column, Column], Column] = lambda total, depth: total / depth) -> DataFrame:
    """(tree, leaf, score, offset, node): the nodes of each chosen path, offset 0 at the leaf.

    ``top`` paths of each tree by ``score(total, depth)``; None takes all.
    """
    tables, done = strides(nodes)
    parents = nodes.where(F.col("parent").isNotNull()).select(F.col("tree").alias("p_tree"), F.col("parent").alias("p_node"))
    leaves = done.join(parents, (F.col("tree") == F.col("p_tree")) & (F.col("node") == F.col("p_node")), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), score(F.col("total"), F.col("depth")).alias("score"))
    if top is not None:
        rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
        leaves = leaves.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")
    paths = leaves.withColumn("offset", F.lit(0).cast("long")).withColumn("node", F.col("leaf"))
    for k in range(len(tables) - 1, -1, -1):
        up = tables[k].select(F.col("tree").alias("u_tree"), F.col("node").alias("u_node"), "up")
        paths = paths.join(up, (F.col("tree") == F.col("u_tree")) & (F.col("node") == F.col("u_node")), "left")
        stay = F.struct("offset", "node")
        rise = F.struct((F.col("offset") + (1 << k)).alias("offset"), F.col("up").alias("node"))
        both = F.explode(F.when(F.col("up").isNull(), F.array(stay)).otherwise(F.array(stay, rise)))
        paths = paths.select("tree", "leaf", "score", both.alias("x")).select("tree", "leaf", "score", "x.offset", "x.node")
    return paths


def formatted(nodes: DataFrame, top: int | None = 1, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row per chosen path: id, leaf, score, formatted (string), loss (array of s, e in code points)."""
    nodes = stored(nodes, "tree-nodes")
    paths = branches(nodes, top).withColumnsRenamed({"tree": "c_tree", "node": "c_node", "score": "path_score"})
    told = nodes.join(paths, (F.col("tree") == F.col("c_tree")) & (F.col("node") == F.col("c_node")))
    turn = F.struct((-F.col("offset")).alias("place"), "role", "text")
    each = told.groupBy("tree", "leaf").agg(F.first("id").alias("id"), F.first("path_score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    id_type = nodes.schema["id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns.as_py()], learned) for turns in batch.column("turns")]
            loss = pa.array([[{"s": s, "e": e} for s, e in spans] for _, spans in made], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("leaf"), batch.column("score"), pa.array([t for t, _ in made], pa.string()), loss],
                ["id", "leaf", "score", "formatted", "loss"],
            )

    schema = f"id {id_type}, leaf long, score double, formatted string, loss array<struct<s:bigint,e:bigint>>"
    return each.select("id", "leaf", "score", "turns").mapInArrow(write, schema)
