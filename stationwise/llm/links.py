"""Links among members of buckets, without the pairs of a bucket, and their components.

A bucket holds nodes that may be linked; a link counts only once verified. Pairs
whose nodes are in one component already tell nothing new, so they are never made:

1. every bucket proposes its centre (the member that shares most bucket places)
   to its other members, which is linear in the members;
2. verified links are joined to components;
3. buckets with one component left are done; in the others, only pairs across
   components are open. The caller's bound may show that a node cannot be linked
   to any other component of its bucket; such nodes leave;
4. while open pairs are many and get fewer, another centre is tried; else all
   that the bound allows are verified, each in the first bucket it shares.

No pair across components that could be linked is left out, so the components
are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationwise.llm.common import BROADCAST_ROWS, SLIM_ROWS, with_small, written

#: Open pairs per member of a bucket that are verified without trying another centre.
PAIRS_PER_MEMBER = 2
LEAST_PAIRS = 50_000

Verify = Callable[[DataFrame], DataFrame]


class NoBound:
    """A bound that rules nothing out: the interface of what callers may pass."""

    #: Columns of open members that ``possible`` reads.
    columns: tuple[str, ...] = ()

    def measured(self, members: DataFrame, centres: DataFrame, found: DataFrame) -> DataFrame:
        """Members with what the checked pairs (``found``) say about them and their bucket's centre."""
        return members

    def narrowed(self, members: DataFrame) -> DataFrame:
        """Open members (bucket, node, mass, component) that may have a link to another component, with the columns."""
        return members

    def possible(self, left: str, right: str) -> Column:
        """Whether two open members, under these table aliases, may be linked; never false for a link."""
        return F.lit(True)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for nodes with a link.

    A round takes the smallest label among neighbours and the label's own label, in one written table.
    """
    links = written(links.select("a", "b"), "links")
    ends = 2 * links.count()
    both = written(links.union(links.select("b", "a")), "edges", ends)
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = written(least.select("node", F.least("node", "least").alias("component")), "labels", ends)
    hinted = F.broadcast if labels.count() <= BROADCAST_ROWS else lambda frame: frame
    while True:
        near = both.withColumnRenamed("b", "node").join(hinted(labels), "node")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        lower = labels.join(hinted(near), "node").join(hinted(roots), "component")
        lower = lower.select("node", F.col("component").alias("before"), F.least("least", "root").alias("component"))
        lower = written(lower, "labels", ends)
        labels = lower.select("node", "component")
        if lower.where(F.col("before") != F.col("component")).isEmpty():
            return labels


def shared_buckets(members: DataFrame) -> DataFrame:
    """The (bucket, node) rows of buckets with two nodes or more, with the node's mass.

    The mass is the number of bucket places that a node shares; the node in the midst of a group has most.
    """
    ends = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size"))
    several = written(ends.where("low < high").select("bucket", "size"), "buckets")
    most = several.agg(F.sum("size")).first()[0] or 0
    shared = written(with_small(members, several, ["bucket"], most=SLIM_ROWS).distinct(), "members", most)
    mass = written(shared.groupBy("node").agg(F.sum("size").alias("mass")), "mass", most)
    return written(with_small(shared.select("bucket", "node"), mass, ["node"]), "members", most)


def proposals(members: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Every bucket's centre, and its pairs with the bucket's other members across components."""
    centre = F.max(F.struct("mass", (-F.col("node")).alias("back"), "component")).alias("centre")
    centres = members.groupBy("bucket").agg(centre)
    centres = written(
        centres.select("bucket", (-F.col("centre.back")).alias("centre"), F.col("centre.component").alias("centred")), "centres", most
    )
    pairs = with_small(members.select("bucket", "node", "component"), centres, ["bucket"])
    pairs = pairs.where(F.col("component") != F.col("centred"))
    return centres, pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def cross_pairs(members: DataFrame, bound: NoBound) -> DataFrame:
    """The pairs across components that the bound allows, each from the first bucket that both share."""
    shared = members.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
    rows = written(with_small(members, written(shared, "shared"), ["node"]), "open")
    columns = ["bucket", "node", "component", "buckets", *bound.columns]
    left, right = rows.select(*columns).alias("l"), rows.select(*columns).alias("r")
    first = F.array_min(F.array_intersect("l.buckets", "r.buckets"))
    same = (
        (F.col("l.bucket") == F.col("r.bucket"))
        & (F.col("l.node") < F.col("r.node"))
        & (F.col("l.component") != F.col("r.component"))
        & bound.possible("l", "r")
        & (first == F.col("l.bucket"))
    )
    return left.join(right, same).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def open_members(members: DataFrame, labels: DataFrame | None, most: int) -> tuple[DataFrame, int, int]:
    """Members (at most so many) of buckets with several components, their number and that of pairs across components."""
    tagged = members.drop("component")
    if labels is None:
        tagged = tagged.withColumn("component", F.col("node"))
    else:
        tagged = with_small(tagged, labels, ["node"], "left")
        tagged = tagged.withColumn("component", F.coalesce("component", "node"))
    tagged = written(tagged, "tagged", most)
    parts = tagged.groupBy("bucket", "component").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = parts.groupBy("bucket").agg(
        F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("parts")
    )
    live = written(sums.where("parts > 1"), "live", most)
    total = live.agg(F.sum("size").alias("size"), F.sum((F.col("size") ** 2 - F.col("squares")) / 2).alias("pairs")).first()
    rows = written(with_small(tagged, live.select("bucket"), ["bucket"]), "open", most)
    return rows, int(total["size"] or 0), int(total["pairs"] or 0)


def linked_components(members: DataFrame, verify: Verify, bound: NoBound = NoBound()) -> DataFrame | None:
    """(node, component) of all nodes with a verified link; None where there is none.

    ``members`` are those of ``shared_buckets``; ``verify`` returns checked
    pairs (a, b, linked); pairs that it leaves out are not linked.
    """
    links, labels, before, most = None, None, None, members.count()
    while True:
        members, size, pairs = open_members(members, labels, most)
        if before is not None and pairs:
            members, size, pairs = open_members(bound.narrowed(members), labels, most)
        if not pairs:
            return labels
        all_pairs = pairs <= max(LEAST_PAIRS, PAIRS_PER_MEMBER * size) or (before is not None and pairs > before / 2)
        if all_pairs:
            if before is None:
                members = bound.narrowed(members)
            found = written(verify(cross_pairs(members, bound)), "links")
        else:
            centres, proposed = proposals(members, most)
            found = written(verify(proposed), "links")
            tried = centres.select("bucket", F.col("centre").alias("node"))
            members = bound.measured(members.join(tried, ["bucket", "node"], "left_anti"), centres, found)
            members = written(members, "members", most)
            before = pairs
        fresh = found.where("linked").select("a", "b")
        if not fresh.isEmpty():
            links = fresh if links is None else links.unionByName(fresh)
            labels = components(links)
        if all_pairs:
            return labels
