"""Trees of digests over ranges of offsets: two topics are compared from the root down.

A node stands for the messages of a partition whose offsets share their leading bits.  It holds how many
they are and an exclusive or of their prints, so nodes of several batches add up to those of all.  Only nodes
under which the topics differ are opened, down to one leaf per test, and only its payloads are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygauge.operators.archive import DESTINATION, SOURCE, test_roles
from relaygauge.operators.positions import TOPIC_KEY
from relaygauge.schemas import MESSAGE_KEY, NODE

# A leaf has 2^LEAF_BITS offsets, a node 2^FAN_BITS nodes below it; the root is at level LEVELS.
LEAF_BITS = 10
FAN_BITS = 10
LEVELS = 4
NODE_KEY = [*TOPIC_KEY, "partition", "level", "node"]
MISSING, EXTRA, CHANGED = "missing", "extra", "changed"


def tree_nodes(messages: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """The nodes of all levels that have messages.

    Each message is printed where it lies; prints combine before the shuffle, and a node of a level is
    made of those of the level below.  A message must come once: a copy with another payload
    would count as a message of its own.
    """
    text = F.coalesce("payload", F.lit(""))
    leaves = messages.select(
        *TOPIC_KEY,
        "partition",
        F.shiftright("offset", leaf_bits).alias("node"),
        F.xxhash64("offset", text).alias("print0"),
        F.xxhash64(F.lit(1), "offset", text).alias("print1"),
    )
    leaves = _combined(leaves.withColumns({"level": F.lit(0), "messages": F.lit(1).cast("bigint")}))
    # Levels unfold from the leaves, so each message is hashed and each leaf is shuffled once.
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    above = leaves.drop("level").select("*", levels.alias("level"))
    shifted = above.withColumn("node", F.expr(f"shiftright(node, level * {FAN_BITS})"))
    return _combined(shifted).select(*NODE.names)


def _combined(nodes: DataFrame) -> DataFrame:
    """Nodes of the same place as one."""
    return nodes.groupBy(*NODE_KEY).agg(
        F.sum("messages").alias("messages"), *[F.bit_xor(f"print{i}").alias(f"print{i}") for i in (0, 1)]
    )


def added_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of several batches as those of all their messages."""
    return _combined(nodes).select(*NODE.names)


def _sides(nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """Source and destination of each node side by side; a side that lacks it has no messages."""
    met = nodes.join(test_roles(tests), TOPIC_KEY)

    def side(role: str) -> Column:
        own = F.when(F.col("role") == role, F.struct("messages", "print0", "print1"))
        return F.max(own).alias(role)

    return met.groupBy("test_id", "partition", "level", "node").agg(side(SOURCE), side(DESTINATION))


def differing_nodes(nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """(test_id, partition, level, node) where source and destination differ, without opening any."""
    unequal = ~F.col(SOURCE).eqNullSafe(F.col(DESTINATION))
    return _sides(nodes, tests).where(unequal).select("test_id", "partition", "level", "node")


def children(nodes: DataFrame, opened: DataFrame, level: int) -> DataFrame:
    """The nodes of a level below the nodes (test_id, partition, node) of the level above that were opened."""
    parent = F.shiftright("node", FAN_BITS).alias("_parent")
    below = opened.select("test_id", "partition", F.col("node").alias("_parent"))
    here = nodes.where(F.col("level") == level).select("*", parent)
    return here.join(below, ["test_id", "partition", "_parent"], "left_semi").drop("_parent")


def first_differing(nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """(test_id, partition, node): of nodes of one level the first of each test in which its topics differ."""
    first = differing_nodes(nodes, tests).groupBy("test_id").agg(F.min(F.struct("partition", "node")).alias("_first"))
    return first.select("test_id", "_first.*")


def first_differences_in(leaves: DataFrame, messages: DataFrame, tests: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """The first message of each test in which its topics differ, in the order of partitions and offsets.

    (test_id, partition, offset, difference, source_payload, destination_payload), with nulls for a test without a leaf
    (test_id, partition, node).  ``difference`` tells whether the destination lacks the message, has one that
    the source lacks, or has another payload.
    """
    chosen = leaves_messages(messages, leaves, leaf_bits)
    met = chosen.join(test_roles(tests), TOPIC_KEY)
    text = F.struct(F.coalesce("payload", F.lit("")).alias("payload"))
    sides = met.groupBy("test_id", "partition", "offset").agg(
        *[F.max(F.when(F.col("role") == r, text)).alias(r) for r in (SOURCE, DESTINATION)]
    )
    kind = (
        F.when(F.col(DESTINATION).isNull(), MISSING)
        .when(F.col(SOURCE).isNull(), EXTRA)
        .when(F.col(SOURCE) != F.col(DESTINATION), CHANGED)
    )
    rows = sides.select(
        "test_id",
        F.struct(
            "partition",
            "offset",
            kind.alias("difference"),
            F.col(f"{SOURCE}.payload").alias("source_payload"),
            F.col(f"{DESTINATION}.payload").alias("destination_payload"),
        ).alias("_row"),
    ).where(F.col("_row.difference").isNotNull())
    first = rows.groupBy("test_id").agg(F.min("_row").alias("_row")).select("test_id", "_row.*")
    return tests.select("test_id").join(first, "test_id", "left")


def leaves_messages(messages: DataFrame, leaves: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """Messages of some leaves.  Bounds of all of them go to the scan, so that files and row groups beyond are left out."""
    bounds = leaves.agg(
        F.min("partition").alias("p0"), F.max("partition").alias("p1"), F.min("node").alias("n0"), F.max("node").alias("n1")
    ).first()
    if bounds["p0"] is None:
        return messages.where("false").select(*MESSAGE_KEY, "payload")
    within = F.col("partition").between(bounds["p0"], bounds["p1"]) & F.col("offset").between(
        bounds["n0"] << leaf_bits, ((bounds["n1"] + 1) << leaf_bits) - 1
    )
    located = messages.where(within).withColumn("node", F.shiftright("offset", leaf_bits))
    return located.join(leaves, ["test_id", "partition", "node"], "left_semi").select(*MESSAGE_KEY, "payload")
