"""Set and bag operators, and closure over an edges table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rowtide.plans.groups import collect_parts
from rowtide.session import Rounds, stored

CHAINED = 1 << 17  # nodes of chains that shortcuts are made for; of more, some are taken out first


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def union(*parts: DataFrame) -> DataFrame:
    """Distinct rows of all parts."""
    return union_all(*parts).distinct()


def batch_reads(reads: Sequence[DataFrame], order: Sequence[Sequence[str]], size: int) -> DataFrame:
    """2 to 32 reads answered together: (read, part, rows) with JSON arrays of up to `size` rows, `[]` for none."""
    if not 2 <= len(reads) <= 32:
        raise ValueError("a batch holds 2 to 32 reads")
    out = []
    for i, (df, by) in enumerate(zip(reads, order)):
        item = F.struct(*df.columns)
        tagged = df.withColumn("__read", F.lit(i))
        parts = collect_parts(tagged, ["__read"], list(by), item, size, "rows")
        parts = parts.select(F.col("__read").alias("read"), "part", F.to_json("rows", {"ignoreNullFields": "false"}).alias("rows"))
        # an empty read still answers with one empty array
        none = df.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
        out.append(parts.unionByName(none.select(F.lit(i).alias("read"), F.lit(0).alias("part"), F.lit("[]").alias("rows"))))
    return union_all(*out)


def symmetric_difference(a: DataFrame, b: DataFrame, side: str = "side") -> DataFrame:
    """Rows only one of two bags has, with the number of copies too many: empty when they agree."""
    both = a.withColumn("__w", F.lit(1)).unionByName(b.withColumn("__w", F.lit(-1)))
    net = both.groupBy(*a.columns).agg(F.sum("__w").alias("copies")).where("copies <> 0")
    return net.withColumn(side, F.when(F.col("copies") > 0, "left").otherwise("right")).withColumn("copies", F.abs("copies"))


def bag_difference(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Signed row changes that lead from one bag to the next: weight > 0 inserts, < 0 deletes."""
    both = previous.withColumn("__w", F.lit(-1)).unionByName(current.withColumn("__w", F.lit(1)))
    return both.groupBy(*current.columns).agg(F.sum("__w").alias("weight")).where("weight <> 0")


def union_refcount(sources: Mapping[str, DataFrame], key: Sequence[str], seq: str) -> DataFrame:
    """One collection over overlapping sources: a row stays while any source has it; the newest value wins."""
    tagged = union_all(*[df.withColumn("__source", F.lit(name)) for name, df in sources.items()])
    value = [c for c in tagged.columns if c not in key and c != "__source"]
    held = tagged.groupBy(*key).agg(
        F.count_distinct("__source").alias("sources"), F.max_by(F.struct(*value), F.col(seq)).alias("__v")
    )
    return held.select(*key, "__v.*", "sources")


def _taken_out(links: DataFrame, chains: DataFrame, seeds: DataFrame, chained: int) -> tuple[DataFrame, int, list[DataFrame]]:
    """Take nodes with one way on out of the graph until at most `chained` are left: (ways, chain nodes left, levels).

    Ways are (src, dst, chain); a seed is a way without src. A level takes out the nodes whose coin is up and whose next node's
    is not, so no two in a row: a quarter of them. Ways to such a node lead to its next node from there on, and `via` names it.
    Rows of all levels together are a multiple of the links, however long the chains.
    """
    kind = seeds.schema["node"].dataType
    only = chains.select("src", F.lit(True).alias("chain"))
    ways = links.join(only, "src", "left").select(F.col("src").cast(kind), F.col("dst").cast(kind), F.coalesce("chain", F.lit(False)).alias("chain"))
    ways = ways.unionByName(seeds.distinct().select(F.lit(None).cast(kind).alias("src"), F.col("node").alias("dst"), F.lit(False).alias("chain")))
    proper = "src IS NULL OR src <> dst"
    ways, levels = stored(ways.where(proper), "ways"), []
    while (left := ways.where("chain").count()) > chained:
        up = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(len(levels))), F.lit(2)) == 1
        goes = F.col("chain") & up("src") & ~up("dst")
        gone = ways.where(goes).select(F.col("src").alias("via"), F.col("dst").alias("_on"))
        rest = ways.where(~goes)
        moved = rest.where(up("dst")).join(gone, F.col("dst") == F.col("via"), "left").select("src", F.coalesce("_on", "dst").alias("dst"), "chain", "via")
        levels.append(stored(rest.where(~up("dst")).withColumn("via", F.lit(None).cast(kind)).unionByName(moved), "level"))
        ways = levels[-1].where(proper).drop("via")
    return ways, left, levels


def closure(edges: DataFrame, seeds: DataFrame, source: str = "src", target: str = "dst", steps: int = 3, chained: int = CHAINED) -> DataFrame:
    """Every node reachable from `seeds` (a single column `node`), the seeds included.

    A round takes newly reached nodes `steps` edges on and keeps what is new, so cycles and diamonds end. Nodes with one way on
    form chains; a round also doubles the chains' shortcuts, 2, 4, 8 … edges long, and follows all of them. So the number of
    rounds grows with the logarithm of the longest chain and with the branchings on a path, not with its length. Shortcuts
    have at most one row for each node of a chain and length, and no other pairs of nodes are formed. Of more than `chained`
    nodes in chains, a quarter at a time is taken out of the graph first, and put back, level by level, behind the reached nodes that led to it.
    """
    seeds = seeds.select("node")
    links = stored(edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).dropna().distinct(), "links")
    spark, schema = seeds.sparkSession, seeds.schema
    last = stored(links.groupBy("src").agg(F.count(F.lit(1)).alias("ways"), F.min("dst").alias("dst")).where("ways = 1").select("src", "dst"), "chains")
    nodes, length, levels = last.count(), 1, []
    starts = seeds.distinct()
    if nodes > chained:
        ways, nodes, levels = _taken_out(links, last, seeds, chained)
        links, last = ways.where("src IS NOT NULL").select("src", "dst"), ways.where("chain").select("src", "dst")
        starts = ways.where("src IS NULL").select(F.col("dst").alias("node")).distinct()
    rounds, shortcuts = Rounds(spark, "reached", schema), Rounds(spark, "shortcuts", links.schema)
    frontier = rounds.add(starts)
    while frontier.take(1):
        ways, reached, ends = links.unionByName(shortcuts.all()), [], frontier
        for _ in range(steps):
            ends = ends.join(ways, ends["node"] == ways["src"]).select(F.col("dst").alias("node")).distinct()
            reached.append(ends)
        frontier = rounds.add(union(*reached).join(rounds.all(), "node", "left_anti"))
        if 2 * length < nodes:  # there is no longer chain without a cycle
            on = last.select(F.col("src").alias("dst"), F.col("dst").alias("_on"))
            last, length = shortcuts.add(last.join(on, "dst").select("src", F.col("_on").alias("dst"))), 2 * length
            nodes = nodes if last.take(1) else 0
    for level in reversed(levels):  # a node taken out is reached where a way to it starts at a reached node or is a seed's
        through = level.where("via IS NOT NULL")
        led = through.join(rounds.all(), F.col("src") == F.col("node"), "left_semi").unionByName(through.where("src IS NULL"))
        rounds.add(led.select(F.col("via").alias("node")).distinct())
    return rounds.all()
