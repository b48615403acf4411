"""Communities of a weighted graph by modularity: rounds of moves between neighbouring communities, then contraction, and again.

In a round every second node (by a hash of node and round) may go to the neighbouring community that gains most, so
that neighbours seldom move at once; of a level's rounds the one of greatest modularity counts. Then each community becomes a
node, its inner weight a loop, until no community moves. Moves, sums and contraction are joins and groupings; the driver sees
one modularity a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vecloom.session import checkpointed

#: Rounds without a gain after which a level ends.
IDLE = 4


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (modularity) of symmetric edges (src, dst, weight; a loop stands once, with twice its weight) and labels (node, label)."""
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    named = edges.join(a, "src").join(b, "dst")
    each = named.groupBy(F.col("a").alias("label")).agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inner"))
    total = each.agg(F.sum("all").alias("w"), F.sum("inner").alias("i"), F.sum(F.col("all") * F.col("all")).alias("s"))
    return total.select(F.coalesce(F.col("i") / F.col("w") - F.col("s") / (F.col("w") * F.col("w")), F.lit(0.0)).alias("modularity"))


def _moved(edges: DataFrame, nodes: DataFrame, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """(node, label, wants): labels after a round's moves, and whether the node would gain by a move. nodes: (node, k), the sums of weights at each."""
    own = labels.join(nodes, "node")
    sums = own.groupBy("label").agg(F.sum("k").alias("all"))
    near = edges.where("src <> dst").join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("weight").alias("w"))
    # a node's own community is a choice, too, also where no neighbour is in it
    choices = near.unionAll(labels.select("node", "label", F.lit(0.0))).groupBy("node", "label").agg(F.sum("w").alias("w"))
    choices = choices.join(sums, "label").join(own.select("node", "k", F.col("label").alias("old")), "node")
    others = F.col("all") - F.when(F.col("label") == F.col("old"), F.col("k")).otherwise(0.0)
    gain = F.col("w") - F.col("k") * others / total
    best = choices.groupBy("node").agg(F.max_by("label", F.struct(F.round(gain, 9), F.col("label") == F.col("old"), -F.col("label"))).alias("best"), F.min("old").alias("old"))
    free = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(2)) == 0
    return best.select("node", F.when(free, F.col("best")).otherwise(F.col("old")).alias("label"), (F.col("best") != F.col("old")).alias("wants"))


def communities(edges: DataFrame, rounds: int = 12, levels: int = 6) -> DataFrame:
    """(node, label) of symmetric edges (src, dst, weight): label is the least node of a node's community.

    At most `rounds` rounds a level and `levels` levels; a level ends early when no node would gain by a move, or IDLE rounds in a row gain nothing. Nodes that are
    in no edge are not known here. Ties go to the own community, then to the smaller label, so the result depends on the
    edges alone."""
    edges = checkpointed(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")
    total = edges.agg(F.sum("weight")).first()[0]
    names = edges.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label"))
    if not total:
        return names
    names = checkpointed(names, "labels")
    for level in range(levels):
        nodes = checkpointed(edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "nodes")
        labels = nodes.select("node", F.col("node").alias("label"))
        first = best = modularity(edges, labels).first()[0]
        top, idle = None, 0
        for turn in range(rounds):
            watch = Observation()
            moved = _moved(edges, nodes, labels, total, level * rounds + turn).observe(watch, F.count_if("wants").alias("wants"))
            labels = checkpointed(moved.select("node", "label"), "labels")
            if not watch.get["wants"]:
                break
            now = modularity(edges, labels).first()[0]
            idle = 0 if now > best + 1e-9 else idle + 1
            if not idle:
                best, top = now, labels
            elif idle == IDLE:
                break
        if top is None or best <= first + 1e-9:
            break
        to = top.select(F.col("node").alias("label"), F.col("label").alias("up"))
        names = checkpointed(names.join(to, "label").select("node", F.col("up").alias("label")), "labels")
        a, b = top.select(F.col("node").alias("src"), F.col("label").alias("a")), top.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        edges = checkpointed(edges.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "edges")
    least = names.groupBy("label").agg(F.min("node").alias("least"))
    return names.join(least, "label").select("node", F.col("least").alias("label"))
