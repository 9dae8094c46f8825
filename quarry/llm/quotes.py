"""Chat formatting by quotation linking.

Each line's nested quote level is parsed from its leading ``>`` marks. Passages (lines,
paragraphs, whole runs of one level, and all of a level) are normalised and hashed; per conversation and
hash the earliest message whose own words hold the passage is its original, found by a
partial aggregate, so the join of quotes to originals is many-to-one and a passage that
thousands of messages quote makes no pairs. A message replies to the original of the
longest passage it quotes at its shallowest linked level. Threads and reply order follow
by pointer jumping (each round halves the distance to the end, and lineage is cut): a
message's root and depth over its parents, then its position in the depth-first order of
its thread (siblings by turn) as its rank in the list in which each message points to its
first reply, or else to the next sibling of itself or of its nearest ancestor that has
one. Messages come out without quotes, in the order of ``conv_id, root_turn, reply_pos``.
All built-in functions; no group is collected beyond one message, and no window is over
more than a range partition, so a conversation or a parent may hold a third of all rows.

Defined cases: null or empty text is an empty message, and very long ones are parsed
whole; a quote whose original isn't an earlier turn of the same conversation stays
unlinked, and is still taken off; a message that links to nothing has the lines that were
taken off it in ``unlinked`` (prompts and Markdown quotes look like quotes, so nothing is
lost without a trace); of several originals the earliest counts, and of passages of one
size at one level that of the latest original; a null ``conv_id`` or ``turn`` neither
links nor is linked to; rows that repeat a (conv_id, turn) share their links and place; an
unlinked message is its own root at depth and position 0; an empty table gives no rows;
other columns pass, whatever their names, but those named like the added ones in any case
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm._native import BLANKS, finished, inner_names, lower_ascii
from quarry.session import cut, drop

MAX_ROUNDS = 64
_PREFIX = r"^((?:[\x20\t]?>)+)[\x20\t]?"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(text), r"[\x20\x09-\x0D]+", " "), F.lit(BLANKS))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds ``_lines``: an array of (level, line) without marks, and ``own``: the unquoted text."""
    lines = F.transform(
        F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _PREFIX, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, _PREFIX, "").alias("line")),
    )
    own = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return messages.withColumn("_lines", lines).withColumn("own", F.trim(own, F.lit(BLANKS)))


def _keys(text: Column) -> Column:
    """Normalised lines, paragraphs and the whole of a text, distinct and not empty."""
    parts = F.concat(F.split(text, "\n", -1), F.split(text, r"\n[\x20\t]*\n", -1), F.array(text))
    return F.filter(F.array_distinct(F.transform(parts, _normal)), lambda k: F.length(k) > 0)


def texts(found: DataFrame) -> DataFrame:
    """``conv_id, turn, level, passage``: each run of lines of one level, and all lines of each level."""
    levels = F.transform("_lines", lambda x: x["level"])
    at = found.select("conv_id", "turn", "_lines", levels.alias("_levels"))
    starts = F.filter(F.sequence(F.lit(1), F.size("_levels")), lambda i: (i == 1) | (F.get("_levels", i - 1) != F.get("_levels", i - 2)))
    at = at.withColumn("_starts", starts)
    joined = lambda lines: F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    end = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_levels") + 1)
    runs = F.transform("_starts", lambda s, k: F.struct(F.get("_levels", s - 1).alias("level"), joined(F.slice("_lines", s, end(k) - s)).alias("passage")))
    whole = F.transform(F.array_distinct("_levels"), lambda v: F.struct(v.alias("level"), joined(F.filter("_lines", lambda x: x["level"] == v)).alias("passage")))
    return at.select("conv_id", "turn", F.inline(F.array_distinct(F.concat(runs, whole))))


def quotations(found: DataFrame) -> DataFrame:
    """``conv_id, turn, level, hash, size``: each quoted passage of each message."""
    leveled, text = texts(found).where("level > 0"), F.col("passage")
    passages = leveled.select("conv_id", "turn", "level", F.explode(_keys(text)).alias("key"))
    return passages.select("conv_id", "turn", "level", F.md5("key").alias("hash"), F.length("key").alias("size"))


def links(found: DataFrame) -> DataFrame:
    """``conv_id, turn, parent``: the turn that a message replies to; one row per linked turn."""
    known = found.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoted = quotations(known)
    originals = (
        texts(known).where("level = 0").select("conv_id", "turn", F.explode(_keys(F.col("passage"))).alias("key"))
        .groupBy(F.col("conv_id").alias("of"), F.md5("key").alias("original"))
        .agg(F.min("turn").alias("parent"))
    )
    matched = quoted.join(originals, (F.col("conv_id") == F.col("of")) & (F.col("hash") == F.col("original")) & (F.col("parent") < F.col("turn")))
    return matched.groupBy("conv_id", "turn").agg(F.max_by("parent", F.struct(-F.col("level"), F.col("size"), F.col("parent"))).alias("parent"))


def chase(at: DataFrame) -> DataFrame:
    """``conv_id, node, end, steps``: follows each ``end`` that is a node itself to where it leads, adding up steps."""
    at = before = cut(at.select("conv_id", "node", "end", "steps"))
    for _ in range(MAX_ROUNDS):
        up = at.select(F.col("conv_id").alias("of"), F.col("node").alias("at"), F.col("end").alias("further"), F.col("steps").alias("more"))
        moved = at.join(up, (F.col("conv_id") == F.col("of")) & (F.col("end") == F.col("at")), "left")
        after = cut(moved.select("conv_id", "node", F.coalesce("further", "end").alias("end"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("at").isNotNull().alias("moved")))
        drop(before)
        at, before = after.drop("moved"), after
        if not after.where("moved").limit(1).count():
            return at
    raise RuntimeError(f"links not followed to their ends after {MAX_ROUNDS} rounds")


def siblings(linked: DataFrame) -> DataFrame:
    """``conv_id, turn, parent, sibling``: the next turn with the same parent, null for the last."""
    order = ["conv_id", "parent", "turn"]
    placed = cut(linked.select(*order).orderBy(*order).withColumn("part", F.spark_partition_id()))
    row = F.struct(*order)
    # A row per partition: where each begins, for the last row of the one before.
    heads = cut(placed.groupBy("part").agg(F.min(row).alias("head")).select(F.col("part").alias("of"), F.lead("head").over(W.orderBy("part")).alias("head")))
    within = F.lead(row).over(W.partitionBy("part").orderBy(*order))
    after = F.coalesce(F.col("inner"), F.col("head"))
    found = placed.withColumn("inner", within).join(heads, F.col("part") == F.col("of"))
    return found.select(*order, F.when((after["conv_id"] == F.col("conv_id")) & (after["parent"] == F.col("parent")), after["turn"]).alias("sibling"))


def threads(linked: DataFrame) -> DataFrame:
    """``conv_id, turn, parent, root, depth, place`` of linked turns (``place`` in the depth-first order from the root)."""
    linked = cut(linked)
    tree = chase(linked.select("conv_id", F.col("turn").alias("node"), F.col("parent").alias("end"), F.lit(1).alias("steps")))
    known = cut(siblings(linked))
    last = known.where("sibling IS NULL").select("conv_id", F.col("turn").alias("node"), F.col("parent").alias("end"), F.lit(0).alias("steps"))
    # From a last sibling up to the first ancestor that has a next sibling; a root has none.
    up = chase(last).select("conv_id", "node", F.col("end").alias("turn"))
    after = known.where("sibling IS NOT NULL").select("conv_id", "turn", "sibling")
    over = after.withColumnRenamed("turn", "node").unionByName(up.join(after, ["conv_id", "turn"]).select("conv_id", "node", "sibling"))
    replies = linked.groupBy("conv_id", F.col("parent").alias("node")).agg(F.min("turn").alias("reply"))
    following = over.join(replies, ["conv_id", "node"], "full").select("conv_id", "node", F.coalesce("reply", "sibling").alias("end"), F.lit(1).alias("steps"))
    left = cut(chase(following).select("conv_id", "node", "steps"))
    of = lambda name, steps: left.select(F.col("conv_id").alias("of"), F.col("node").alias(name), F.col("steps").alias(steps))
    own, roots = of("mine", "behind"), of("top", "whole")
    placed = tree.join(own, (F.col("conv_id") == F.col("of")) & (F.col("node") == F.col("mine")), "left").drop("of")
    placed = placed.join(roots, (F.col("conv_id") == F.col("of")) & (F.col("end") == F.col("top")), "left").drop("of")
    placed = placed.select("conv_id", F.col("node").alias("turn"), F.col("end").alias("root"), F.col("steps").alias("depth"),
        (F.col("whole") - F.coalesce("behind", F.lit(0))).alias("place"))
    return cut(placed.join(linked, ["conv_id", "turn"]))


ADDED = ("reply_to", "root_turn", "depth", "reply_pos", "n_quoted", "unlinked")


def link_quotations(messages: DataFrame) -> DataFrame:
    """``messages`` with ``text`` freed of quotes, ``reply_to``, ``root_turn``, ``depth``,
    ``reply_pos`` (in its thread, from 0), ``n_quoted`` lines, and ``unlinked``: the
    quoted lines of a message that links to nothing, as they stood."""
    names = inner_names(messages.columns, "conv_id", "turn", "text")
    found = parsed(messages.toDF(*names))
    tree = threads(links(found)).select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parent", F.col("root").alias("_root"),
        F.col("depth").alias("_depth"), F.col("place").alias("_place"))
    joined = found.join(tree, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    taken = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_PREFIX)), "\n")
    added = (
        F.col("parent"),
        F.coalesce("_root", "turn"),
        F.coalesce("_depth", F.lit(0)).cast("long"),
        F.coalesce("_place", F.lit(0)).cast("long"),
        F.size(F.filter("_lines", lambda x: x["level"] > 0)).cast("long"),
        F.when(F.col("parent").isNull(), F.coalesce(taken, F.lit(""))).otherwise(F.lit("")),
    )
    return finished(joined, messages.columns, names, dict(zip(ADDED, added, strict=True)), text=F.col("own"))


def conversations(messages: DataFrame) -> DataFrame:
    """:func:`link_quotations` in reply order: a conversation's threads by their first
    turn, a thread depth-first. The order is a range partitioning of single messages."""
    linked = link_quotations(messages)
    return linked.orderBy("conv_id", "root_turn", "reply_pos", "turn")


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversations(messages)
