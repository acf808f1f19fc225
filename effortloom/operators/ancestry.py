"""Which commits a release brings: those reachable from its tag but not from the tag before it.

The history of a project is cut into chains, each commit followed by one of its parents. What a tag reaches of a chain is
a stretch down to the chain's end, so one number per tag and chain holds it, however long the chain. A walk hops from
chain to chain over the edges that leave them and takes as many rounds as a path changes chains, not as it has commits.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.session import pin


def chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``project``, ``sha``, ``chain`` (its oldest commit), ``depth`` (commits below it on the chain).

    ``nodes`` (project, sha) are distinct, ``edges`` (project, sha, parent, place) too. A commit asks for its parent of
    least ``place``, a parent takes the least of those that ask. Chain ends are found by pointer doubling: the rounds are
    the logarithm of the longest chain, and no two open pointers of a round meet in one commit.
    """
    asked = edges.groupBy("project", "sha").agg(F.min(F.struct("place", "parent")).alias("p"))
    links = asked.groupBy("project", F.col("p.parent").alias("parent")).agg(F.min("sha").alias("sha"))
    linked = F.col("parent").isNotNull()
    state = pin(
        nodes.join(links, ["project", "sha"], "left").select(
            "project", "sha", F.coalesce("parent", "sha").alias("chain"), linked.cast("long").alias("depth"), linked.alias("open")
        )
    )
    rounds = state.count().bit_length()
    for step in itertools.count():
        opened = state.where("open")
        if opened.isEmpty():
            return state.drop("open")
        if step > rounds:  # pointers are longer than any chain
            raise ValueError("some commit is its own ancestor")
        below = state.select(
            "project", F.col("sha").alias("chain"), F.col("chain").alias("end"), F.col("depth").alias("more"), F.col("open").alias("still")
        )
        moved = opened.join(below, ["project", "chain"]).select(
            "project", "sha", F.col("end").alias("chain"), (F.col("depth") + F.col("more")).alias("depth"), F.col("still").alias("open")
        )
        state = pin(state.where("NOT open").unionByName(moved))


def reach(starts: DataFrame, crossing: DataFrame) -> DataFrame:
    """The greatest depth at which each tag reaches each chain: ``project``, ``tag``, ``chain``, ``depth``.

    ``starts`` has these columns for the tags themselves; ``crossing`` (project, chain, depth, to_chain, to_depth) are
    the edges between chains. A round follows only edges that leave the stretches added by the round before.
    """
    name = ["project", "tag", "chain"]
    reached = pin(starts)
    added = reached.withColumn("above", F.lit(-1).cast("long"))
    while not added.isEmpty():
        edges = crossing.withColumnRenamed("depth", "leaves")
        hops = added.join(edges, ["project", "chain"]).where("leaves > above AND leaves <= depth")
        hops = hops.groupBy("project", "tag", F.col("to_chain").alias("chain")).agg(F.max("to_depth").alias("depth"))
        known = reached.withColumnRenamed("depth", "above")
        added = pin(hops.join(known, name, "left").withColumn("above", F.coalesce("above", F.lit(-1))).where("depth > above"))
        reached = pin(reached.unionByName(added.drop("above")).groupBy(*name).agg(F.max("depth").alias("depth")))
    return reached


def commits_of_ranges(tags: DataFrame, parents: DataFrame, width: int = 1024) -> DataFrame:
    """``project``, ``version``, ``sha`` of all commits reachable from a tag but not from the tag before it.

    ``tags`` (project, version, sha, previous_sha), the first of a project without ``previous_sha``; ``parents`` (project,
    sha, parent and, where known, the ``place`` of the parent among the parents). Parents that have no row of their own
    end a history. Rows without project or commit belong to none; equal rows count once. A chain that closes to
    a ring, as no history has it, raises ValueError. The state of the walk is one row per tag and chain that it reaches; stretches are
    listed in pieces of ``width`` commits, so a chain with most of all commits is many keys.
    """
    place = F.col("place") if "place" in parents.columns else F.lit(0)
    known = parents.where("project IS NOT NULL AND sha IS NOT NULL")
    edges = pin(known.where("parent IS NOT NULL").groupBy("project", "sha", "parent").agg(F.min(place).alias("place")))
    tags = tags.select("project", "version", "sha", "previous_sha").where("project IS NOT NULL AND sha IS NOT NULL").distinct()
    before = F.col("previous_sha").alias("sha")
    heads = tags.select("project", "sha").unionByName(tags.where("previous_sha IS NOT NULL").select("project", before)).distinct()
    nodes = known.select("project", "sha").unionByName(edges.select("project", F.col("parent").alias("sha"))).unionByName(heads)
    placed = chains(nodes.distinct(), edges)

    over = placed.select("project", F.col("sha").alias("parent"), F.col("chain").alias("to_chain"), F.col("depth").alias("to_depth"))
    crossing = pin(
        edges.join(placed, ["project", "sha"]).join(over, ["project", "parent"]).where("chain <> to_chain")
        .groupBy("project", "chain", "depth", "to_chain").agg(F.max("to_depth").alias("to_depth"))
    )
    starts = heads.join(placed, ["project", "sha"]).select("project", F.col("sha").alias("tag"), "chain", "depth")
    reached = reach(starts, crossing)

    upto = reached.withColumnsRenamed({"tag": "sha", "depth": "last"})
    lower = reached.withColumnsRenamed({"tag": "previous_sha", "depth": "first"})
    stretches = (
        tags.join(upto, ["project", "sha"]).join(lower, ["project", "previous_sha", "chain"], "left")
        .select("project", "version", "chain", (F.coalesce("first", F.lit(-1)) + 1).alias("first"), "last").where("first <= last")
        .withColumn("piece", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    )
    pieces = placed.withColumn("piece", F.floor(F.col("depth") / width))
    found = pieces.join(stretches, ["project", "chain", "piece"]).where("depth BETWEEN first AND last")
    return found.select("project", "version", "sha")
