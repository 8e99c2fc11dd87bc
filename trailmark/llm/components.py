"""Connected components of a graph given as pairs, and helpers for keys that hold very many rows."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.session import written

ROUNDS = 60  # far more than any graph needs; a run that does not settle is an error, not a result
GRAINS = 1024


def join_anew(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join in which both sides are shuffled for this join, so that adaptive execution can split a hot key.

    A side that a grouping by the same key has just dealt out would stay where it is, and then nothing can be split.
    The second key is a function of the first and changes no result.
    """
    grain = F.pmod(F.hash(key), F.lit(GRAINS))
    right = right.withColumn("_grain", grain)
    return left.withColumn("_grain", grain).join(right, [key, "_grain"], how).drop("_grain")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of `edges` (a, b): the smallest node of its component.

    Stars are formed in turn around the smallest neighbour among all and among the smaller ones, until every node hangs
    on the smallest one. The number of rounds grows with the logarithm of the size; each round ends in a written table.
    A hub with many neighbours is one minimum, folded before the shuffle, and a join whose hot key is split.
    """
    state = written(_tidy(edges.select("a", "b")), "edges")
    mark = None
    for _ in range(ROUNDS):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        state = written(_tidy(_star(both, both.where("b > a"))), "edges")
        state = written(_tidy(_star(state, state.unionByName(state.select("a", F.col("a").alias("b"))))), "edges")
        row = state.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("bigint")).alias("sum")).first()
        if (row["n"], row["sum"]) == mark:
            # Every node but the roots has one edge, to its root.
            roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        mark = (row["n"], row["sum"])
    raise RuntimeError("components did not settle")


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, the larger node first."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ordered.distinct()


def _star(neighbours: DataFrame, moved: DataFrame) -> DataFrame:
    """Hangs the far ends of `moved` (a, b) on the smallest of a and its neighbours."""
    least = neighbours.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return join_anew(moved, least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def spread(rows: DataFrame, key: str, node: str, most: int, copies: DataFrame) -> DataFrame:
    """Deals groups out so that no task sees more than about twice `most` rows of one, yet any two rows meet.

    `copies` has `key` and `n`, the size of each group. A group of more than `most` rows is cut into blocks by a hash of
    `node`; a row goes to every pair of blocks that has its own. Adds `low`, `high` (the pair) and `block` (its own).
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / most)).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit("block")), F.col("blocks")).cast("int")
    dealt = join_anew(rows, copies, key).withColumn("blocks", blocks).withColumn("block", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return dealt.drop("other", "blocks", "n")


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal `names`, each as one batch, from batches that are sorted by them."""
    import numpy as np

    held, held_key = [], None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in names]
        changed = np.zeros(len(batch) - 1, bool)
        for column in columns:
            changed |= column[1:] != column[:-1]
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(batch)]
        for start, end in zip(edges, edges[1:], strict=False):
            key = tuple(column[start] for column in columns)
            if held and key != held_key:
                yield pa.concat_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.concat_batches(held)


class Sets:
    """Disjoint sets of the numbers below `size`."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
