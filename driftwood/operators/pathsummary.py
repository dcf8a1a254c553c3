"""Sums over path hierarchies: every prefix, the top N as a partition, longest prefixes."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.sources.shared import checkpointed


def prefixes(path: Column, separator: str = "/") -> Column:
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def prefix_totals(rows: DataFrame, path: str, weight: Column) -> DataFrame:
    """``prefix, n, weight`` of every prefix. Paths are summed first, so a common path is
    exploded once a task and not once a row."""
    paths = rows.groupBy(F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"))
    return paths.select(F.explode(prefixes(F.col("path"))).alias("prefix"), "n", "weight").groupBy("prefix").agg(F.sum("n").alias("n"), F.sum("weight").cast("long").alias("weight"))


@dataclass
class _Node:
    prefix: str
    own_n: int = 0
    own: int = 0
    n: int = 0
    total: int = 0


class _Children:
    """The heaviest children of nodes, fetched from the table of prefix sums when a step
    needs them; at most ``most`` of a node, more of which no partition can name."""

    def __init__(self, table: DataFrame, most: int):
        self.table, self.most, self.known = table, most, {}

    def of(self, node: _Node, also: list[_Node]) -> list[_Node]:
        if node.prefix not in self.known:
            wanted = {x.prefix for x in [node, *also]} - self.known.keys()
            rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("weight"), "prefix"))
            rows = self.table.where(F.col("parent").isin(sorted(wanted))).withColumn("_rank", rank).where(F.col("_rank") <= self.most).orderBy("parent", "_rank").collect()
            self.known |= {p: [] for p in wanted}
            for r in rows:
                self.known[r["parent"]].append(_Node(r["prefix"], r["own_n"], r["own_weight"], r["n"], r["weight"]))
        return self.known[node.prefix]


def top_partition(rows: DataFrame, path: str, weight: Column, most: int) -> DataFrame:
    """``path, kind, n, weight``: at most ``most`` entries that share all rows among them.

    Starting from the whole, the heaviest entry that can be refined is replaced by two: a
    path's own value (``self``) and the rest, or its heaviest child (``subtree``) and the
    ``group`` of the others. Paths end with * unless they are a self. All prefixes are
    summed by Spark and stay there; the driver fetches the heaviest children of the few
    nodes that its steps meet, with those of the
    heaviest nodes seen so far, so it holds some ``most`` cubed small rows whatever the input.
    """
    totals = prefix_totals(rows, path, weight)
    own = rows.groupBy(F.col(path).alias("_path")).agg(F.count(F.lit(1)).alias("own_n"), F.sum(weight).cast("long").alias("own_weight"))
    joined = totals.join(own, F.col("prefix") == F.col("_path"), "left")
    slash = F.length("prefix") - F.length(F.substring_index("prefix", "/", -1))
    parent = F.when(slash > 0, F.substring(F.col("prefix"), F.lit(1), slash - 1)).otherwise(F.lit(None))
    table = joined.select(F.coalesce(F.concat(F.lit("/"), parent), F.lit("")).alias("parent"), "prefix", "n", "weight", F.coalesce("own_n", F.lit(0)).alias("own_n"), F.coalesce("own_weight", F.lit(0)).alias("own_weight"))
    table = checkpointed(table.repartitionByRange("parent").sortWithinPartitions("parent"))  # a fetch then reads few row groups
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0)).cast("long")).first()
    entries = _refine(_Children(table, most + 1), n, total, most)
    return rows.sparkSession.createDataFrame(sorted(entries), "path string, kind string, n long, weight long")


def _refine(children: _Children, n: int, total: int, most: int) -> list[tuple[str, str, int, int]]:
    """The greedy refinement. An entry is (weight, n, kind, node, how many of its heaviest
    children are out of it, whether its own value is in it); the root has the prefix "" of
    the table's parents and no own value, other nodes are parents as "/" and their prefix."""
    done, heap, serial = [], [], 0

    def below(node: _Node) -> list[_Node]:
        seen = heapq.nlargest(8 * most, (c for kids in children.known.values() for c in kids if "/" + c.prefix not in children.known), key=lambda c: c.total)
        return children.of(_Node("/" + node.prefix if node is not root else ""), [_Node("/" + c.prefix) for c in seen])

    def push(kind: str, node: _Node, skip: int, own: bool, n: int, w: int) -> None:
        nonlocal serial
        while n:
            has_own = own and node.own_n > 0
            if has_own and n == node.own_n:
                done.append(("self", node, n, w))
                return
            kids = below(node)[skip:]
            if kind == "group" or has_own or not kids or kids[0].n < n:
                heapq.heappush(heap, (-w, node.prefix, serial, n, kind, node, skip, own))
                serial += 1
                return
            node, skip, own = kids[0], 0, True  # an only child is the entry itself

    root = _Node("", n=n, total=total)
    push("subtree", root, 0, False, n, total)
    while heap and len(done) + len(heap) < most:
        w, _, _, n, kind, node, skip, own = heapq.heappop(heap)
        if own and node.own_n:
            done.append(("self", node, node.own_n, node.own))
            push(kind if kind == "group" else "subtree", node, skip, False, n - node.own_n, -w - node.own)
            continue
        first = below(node)[skip]
        push("subtree", first, 0, True, first.n, first.total)
        push("group", node, skip + 1, False, n - first.n, -w - first.total)
    out = [(node.prefix + ("" if kind == "self" else "*"), kind, n, w) for kind, node, n, w in done]
    return out + [(node.prefix + "*", kind, n, -w) for w, _, _, n, kind, node, _, _ in heap]


def longest_prefix(rows: DataFrame, path: str, entries: DataFrame, prefix: str) -> DataFrame:
    """``rows`` with the longest of the entries' prefixes that their path begins with. Paths
    are exploded into prefixes and joined by equality, so no pair is tried in vain."""
    hits = rows.select(path).distinct().select(path, F.explode(F.concat(F.array(F.lit("")), prefixes(F.col(path)))).alias("_p"))
    best = hits.join(entries.select(F.col(prefix).alias("_p")).distinct(), "_p").groupBy(path).agg(F.max_by("_p", F.length("_p")).alias("entry"))
    return rows.join(best, path, "left")
