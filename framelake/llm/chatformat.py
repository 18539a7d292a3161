"""Chat formatting of reply trees.

Messages point at the message they answer.  Repeated self-joins double the
distance each message looks back, so a tree of depth d takes log2(d) rounds to
know every message's depth and the score of its path.  Leaves are ranked by
the score of their path, and the same doubled pointers list the messages of
the chosen paths.  Each path becomes one conversation.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts and roles
``<|`` gets a backslash (``<\\|``, one more where there are some), so control
strings never occur there, and taking one away restores them.  Roles escape
backslash and newline as well.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ranked, stored

START, END = "<|im_start|>", "<|im_end|>"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def escaped_role(c: Column) -> Column:
    return escaped(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


_ESCAPE = re.compile(r"<\\(\\*)\|")


def plain(text: str) -> str:
    """Undo ``escaped``."""
    return _ESCAPE.sub(r"<\1|", text)


def plain_role(text: str) -> str:
    return plain(text).replace("\\n", "\n").replace("\\b", "\\")


def thread(turns: DataFrame) -> DataFrame:
    """A conversation by turns as a tree without branches: each turn answers the one before.

    Null turns come first; equal turns go by role and text.  A turn's score is
    the length of an assistant's text.
    """
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    n = F.row_number().over(w).cast("bigint")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return (turns.select(F.col("conv_id").alias("tree"), n.alias("node"), role.alias("role"), text.alias("text"))
            .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
            .withColumn("score", F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("double")))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def looked_back(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``tree, node, steps, total`` of the messages that reach a root, and the pointers of each doubling.

    Pointer tables hold ``tree, node, back, steps, total``: ``back`` is the
    message ``steps`` answers up, ``total`` adds the scores on the way.  Only
    messages that have not arrived take part in the next doubling.  A message
    whose parent is missing is a root; messages that answer each other in a
    circle never arrive.
    """
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    state = stored(nodes.join(known, _same(F.col("tree"), F.col("t")) & (F.col("parent") == F.col("p")), "left").select(
        "tree", "node", F.when(F.col("p").isNotNull(), F.col("parent")).alias("back"), F.lit(1).cast("bigint").alias("steps"), F.col("score").alias("total")))
    limit = math.ceil(math.log2(state.count() + 1)) + 1
    arrived, pointers = state.filter(F.col("back").isNull()), []
    going = state.filter(F.col("back").isNotNull())
    while len(pointers) <= limit and not going.isEmpty():
        pointers.append(going)
        up = going.union(arrived).select(F.col("tree").alias("t"), F.col("node").alias("b"), F.col("back").alias("far"), F.col("steps").alias("more"), F.col("total").alias("gain"))
        state = stored(going.join(up, _same(F.col("tree"), F.col("t")) & (F.col("back") == F.col("b"))).select(
            "tree", "node", F.col("far").alias("back"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("gain")).alias("total")))
        arrived = arrived.union(state.filter(F.col("back").isNull()))
        going = state.filter(F.col("back").isNotNull())
    return arrived.select("tree", "node", "steps", "total"), pointers


def paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """``tree, leaf, branch, place, node``: the messages of each chosen root-to-leaf path.

    Leaves of a tree are ranked by the mean score of their path, ties to the
    smaller leaf; the best ``branches`` (all by default) are kept.
    """
    arrived, pointers = looked_back(nodes)
    done = arrived.select("tree", "node", "steps", (-F.col("total") / F.col("steps")).alias("cost"))
    answered = nodes.filter(F.col("parent").isNotNull()).select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = stored(done.join(answered, _same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("p")), "left_anti"))
    placed = ranked(leaves, ["tree", "cost", "node"])
    first = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    begin = ranked(stored(first), ["tree"], "n").select(F.col("tree").alias("t"), F.col("before").alias("begin"))
    chosen = placed.join(begin, _same(F.col("tree"), F.col("t"))).withColumn("branch", F.col("position") - F.col("begin"))
    if branches is not None:
        chosen = chosen.filter(F.col("branch") < branches)
    out = chosen.select("tree", F.col("node").alias("leaf"), "branch", (F.col("steps") - 1).alias("place"), "node")
    for t in pointers:
        up = t.select(F.col("tree").alias("t"), F.col("node").alias("m"), "back", "steps")
        out = stored(out)
        further = out.join(up, _same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("m")))
        out = out.union(further.select("tree", "leaf", "branch", (F.col("place") - F.col("steps")).alias("place"), F.col("back").alias("node")))
    return out


def formatted(nodes: DataFrame, branches: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """``tree, leaf, branch, n_turns, formatted, loss_spans``, one row per chosen path.

    ``nodes``: ``tree, node, parent, role, text, score``, one row per message.
    ``loss_spans`` are the code point ranges of the texts of ``loss_role``.  A
    path's messages meet in one task, as its text is one value of the result.
    """
    said = nodes.select(F.col("tree").alias("t"), F.col("node").alias("m"), escaped_role(F.col("role")).alias("r"), escaped(F.col("text")).alias("x"), (F.col("role") == loss_role).alias("learn"))
    rows = paths(nodes, branches).join(said, _same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("m")))
    head = F.concat(F.lit(START), "r", F.lit("\n"))
    rows = rows.select("tree", "leaf", "branch", "place", "learn", F.length(head).alias("skip"), F.length("x").alias("size"), F.concat(head, "x", F.lit(END + "\n")).alias("piece"))
    keys = ["tree", "leaf", "branch"]
    before = F.coalesce(F.sum(F.length("piece")).over(W.partitionBy(*keys).orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("from", before + F.col("skip"))
    turns = F.array_sort(F.collect_list(F.struct("place", "piece", "learn", "from", "size")))
    whole = rows.groupBy(*keys).agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["from"].alias("start"), (t["from"] + t["size"]).alias("end")))
    return whole.select(*keys, F.size("turns").cast("bigint").alias("n_turns"), F.array_join(F.col("turns.piece"), "").alias("formatted"), spans.alias("loss_spans"))


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    out = []
    for part in text.split(START)[1:]:
        role, _, rest = part.partition("\n")
        out.append((plain_role(role), plain(rest[: -len(END) - 1])))
    return out


def digests(conversations: DataFrame) -> DataFrame:
    """Digests of what ``formatted`` wrote, read back from its text and loss spans."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b["formatted"].to_pylist(), b["loss_spans"].to_pylist()):
                turns = turns_of(text)
                loss = "".join(plain(text[s["start"]:s["end"]]) for s in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(text)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.record_batch({"conv_id": b["tree"]} | {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)})

    kind = conversations.schema["tree"].dataType.simpleString()
    return conversations.select("tree", "formatted", "loss_spans").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
