"""Chat formatting from reply trees (DataFrame functions only).

A tree's nodes point to their parents. Root-to-leaf paths are found by repeated
self-joins that double the distance each time, so a path of d turns takes about
log2(d) joins; every round is kept in the shared folder. A leaf's path score is
the sum of its nodes' scores; the best leaf of a tree wins (then the longer
path, then the smaller leaf), its path is marked with the stored jumps, and the
path becomes one conversation.

The template marks turns as ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside
roles and texts a backslash is doubled and every opening of a control string
(of this template or of other usual ones) gets a backslash after its first
character; dropping one backslash before any character undoes both. The loss
mask is a list of character spans, one per assistant turn.

Null text or role counts as empty; a very long text is one turn whatever its
length; turns of equal number are ordered by role and text; repeated rows are turns
of their own; null conversation ids are one conversation; extra columns are
ignored, whatever their names; an empty table gives no rows. A node whose parent is
missing is a root; nodes on a cycle, or below one, belong to no path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Openings that are broken up inside texts: this template's and other usual ones.
CONTROL = r"([<\[])(?=\||/?s>|</?SYS>>|/?INST\]|/?TOOL_CALLS\]|/?(?:bos|eos|start_of_turn|end_of_turn)>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def best_paths(nodes: DataFrame) -> DataFrame:
    """(tree, node, depth) of the best root-to-leaf path of every tree.

    ``nodes`` has tree, node, parent (null for roots) and score (double). After k
    rounds the rows of all nodes less than 2**k steps from a root are done, so a
    round that ends no row has none but those that lead into a cycle left.
    """
    base = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known")).distinct()
    # Every row: (tree, node, anc = node 2**k steps up or null, hops, total). A row
    # whose anc is null has reached its root and leaves the rounds.
    state = base.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("anc"),
        F.lit(1).cast("long").alias("hops"), F.col("score").alias("total"),
    )
    state = materialize(state, "reply-jump")
    done = state.filter(F.col("anc").isNull())
    jumps = []
    left = None
    while True:
        open_ = state.filter(F.col("anc").isNotNull())
        before, left = left, open_.count()
        if left in (0, before):
            break
        jumps.append(open_)
        up = done.unionByName(open_).select(
            "tree", F.col("node").alias("anc"), F.col("anc").alias("up"), F.col("hops").alias("h2"), F.col("total").alias("t2")
        )
        state = materialize(
            open_.join(up, ["tree", "anc"]).select(
                "tree", "node", F.col("up").alias("anc"), (F.col("hops") + F.col("h2")).alias("hops"), (F.col("total") + F.col("t2")).alias("total")
            ),
            "reply-jump",
        )
        done = done.unionByName(state.filter(F.col("anc").isNull()))
    parents = base.select("tree", F.col("parent").alias("node")).dropna()
    leaves = done.join(parents, ["tree", "node"], "left_anti")
    rank = F.struct(F.col("total"), F.col("hops"), (-F.col("node")).alias("n"))
    path = leaves.groupBy("tree").agg(F.max(rank).alias("m")).select("tree", (-F.col("m.n")).alias("node"))
    for jump in reversed(jumps):
        step = jump.select("tree", "node", "anc")
        path = path.unionByName(path.join(step, ["tree", "node"]).select("tree", F.col("anc").alias("node"))).distinct()
        path = materialize(path, "reply-path")
    return path.join(done.select("tree", "node", F.col("hops").alias("depth")), ["tree", "node"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns``: tree, conv_id, depth, role, text (none null but conv_id) of chosen
    paths. One row per conversation: conv_id, formatted, loss spans."""
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    pieces = (
        turns.withColumn("head", head).withColumn("body", escape(F.col("text")))
        .withColumn("len", F.length("head") + F.length("body") + F.lit(len(END)))
    )
    upto = F.sum("len").over(Window.partitionBy("tree").orderBy("depth")) - F.col("len")
    pieces = pieces.withColumn("first", (upto + F.length("head")).cast("long")).withColumn(
        "span",
        F.when(F.col("role") == "assistant", F.struct(F.col("first").alias("start"), (F.col("first") + F.length("body")).alias("end"))),
    )
    rows = F.array_sort(F.collect_list(F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece"), "span")))
    return (
        pieces.groupBy("tree").agg(F.first("conv_id").alias("conv_id"), rows.alias("rows"))
        .select(
            "conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
            F.transform(F.filter("rows", lambda r: r["span"].isNotNull()), lambda r: r["span"]).alias("loss"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: a row each of counts and digests."""
    raw = F.split("formatted", r"<\|im_end\|>")
    parts = F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(0)))
    inner = F.transform(parts, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, SEP, 1)
        text = F.substring(p, F.length(role) + len(SEP) + 1, F.length(p))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    spoken = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return (
        formatted.withColumn("turns", F.transform(inner, turn))
        .withColumn("loss_text", F.array_join(spoken, ""))
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def chat(conversations: DataFrame) -> DataFrame:
    """Format every conversation of a (conv_id, turn, role, text) table, each turn
    the reply to the one before it, and read the written table back."""
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    rows = conversations.select(
        tree.alias("tree"), "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    with scratch() as keep:
        rows = materialize(rows.withColumn("node", F.row_number().over(order).cast("long")).drop("turn"), "reply-turns")
        nodes = rows.select(
            "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
            F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("double").alias("score"),
        )
        chosen = rows.join(best_paths(nodes), ["tree", "node"])
        written = keep(materialize(format_conversations(chosen), "formatted-conversations"))
    return read_back(written)
