"""Near-duplicate embeddings by NN-descent.

Vectors with the same label and the same components are one node. Per label a graph of near neighbours is refined:

* It starts from random projections: nodes on the same side of some random planes compare themselves in small groups.
* In each round every node introduces its neighbours, and the nodes that have it as neighbour, to each other. Each node
  keeps the `NEAR` best it has met. Only pairs with a neighbour that is new since the last round are compared.
* A list whose `NEAR` entries are all above the threshold is saturated and grows to `WIDEST` while it finds links.
* Edges at or above the threshold are links, exact cosines in double precision; components follow from them.

Lists end at `WIDEST`. A met link that both its lists have cut has a full list on either side, so it lies in or between
components with a full list, and there nothing is left to chance. Such a component is held by a ball: its smallest node
and the largest angle to it. By the triangle inequality two components have a link only if their balls are no further apart
than the angle of the threshold. Components that can touch, directly or over others, are compared as one group in blocks, so
that links are counted exactly whatever the size of a group of copies, and components with a link between them become one;
only counts and a spanning forest of components leave a task.

Pairs far from all others share no neighbour, so only the start can bring them together, and how often it does falls with
the number of vectors. So the links found are audited: rows whose id is divisible by `AUDITED` are compared with all rows
of their label, in blocks. While fewer than `RECALL` of their links are found, the start is repeated with other planes,
what it finds joins the lists, and they are refined again. A label that is still short of links after `TRIES` times is
compared as a whole. The recall of the last audit is in the result.

Rows without label, and vectors that are null, zero, or hold null or non-finite components, link with nothing. Vectors of
unlike length do not compare. Repeated rows link with each other.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.components import Sets, components, groups, join_anew, spread
from trailmark.session import written

THRESHOLD = 0.98
NEAR = 10
WIDEST = 40
ROUNDS = 4  # of one refinement at most; the audit goes on from there
SETTLED = 0.001  # share of list entries that a round has to renew to be worth another
PLANES = 30
TABLES = 6
AUDITED = 100
RECALL = 0.99
TRIES = 6
GROUP = 48
BLOCK = 1024
SLACK = 1e-6  # radians; cosines near 1 are exact to about 1e-8 as angles

CANDIDATES = "node bigint, other bigint, sim double"


def is_sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(column: pa.Array):
    """The vectors of a list column as rows of length 1, in double precision."""
    import numpy as np

    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def codes(vector: Column, draw: int) -> Column:
    """For each table, the sides of `PLANES` random planes as bits; other planes for each `draw`."""

    @F.arrow_udf("array<int>")
    def sides(vectors: pa.Array) -> pa.Array:
        import numpy as np

        out = np.zeros((len(vectors), TABLES), np.int32)
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            here = np.flatnonzero(sizes == size)
            planes = np.random.default_rng([int(size), draw]).standard_normal((int(size), TABLES * PLANES))
            bits = (units(vectors.take(pa.array(here))) @ planes > 0).reshape(len(here), TABLES, PLANES)
            out[here] = bits @ (1 << np.arange(PLANES, dtype=np.int32))
        offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * TABLES)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return sides(vector)


def best_pairs(nodes, vectors, worst, fresh):
    """Pairs in a group that improve the list of their first node, at most as many as its list may hold."""
    import numpy as np

    sims = vectors @ vectors.T
    use = sims > worst[:, None]
    use &= fresh[:, None] | fresh[None, :]
    use &= nodes[:, None] != nodes[None, :]
    order = np.argsort(np.where(use, -sims, np.inf), axis=1, kind="stable")[:, :WIDEST]
    rows = np.repeat(np.arange(len(nodes)), order.shape[1])
    columns, rank = order.ravel(), np.tile(np.arange(order.shape[1]), len(nodes))
    keep = use[rows, columns] & ((rank < NEAR) | (sims[rows, columns] >= THRESHOLD))
    return nodes[rows[keep]], nodes[columns[keep]], sims[rows, columns][keep]


def introduce(batches, names):
    """Candidates from groups of rows (node, vector, worst, fresh)."""
    import numpy as np

    for group in groups(batches, names):
        if len(group) > 1:
            nodes = group.column("node").to_numpy()
            first = np.unique(nodes, return_index=True)[1]
            vectors = units(group.column("vector"))[first]
            worst = group.column("worst").to_numpy()[first]
            new = np.zeros(len(first), bool)
            np.logical_or.at(new, np.searchsorted(nodes[first], nodes), group.column("fresh").to_numpy(zero_copy_only=False).astype(bool))
            found = best_pairs(nodes[first], vectors, worst, new)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "other", "sim"])


def start(nodes: DataFrame, draw: int) -> DataFrame:
    """First candidates, from groups on the same side of random planes."""
    sizes = nodes.groupBy("kind").agg(F.count("*").alias("n"))
    sized = join_anew(nodes.withColumn("codes", codes(F.col("vector"), draw)), sizes, "kind")
    bits = F.least(F.lit(PLANES), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / GROUP)))).cast("int")
    dealt = sized.withColumn("bits", bits).select("node", "vector", "kind", "bits", F.posexplode("codes").alias("place", "code"))
    dealt = dealt.withColumn("key", F.xxhash64("kind", "place", F.expr(f"shiftright(code, {PLANES} - bits)"))).drop("code", "bits")
    # Groups are cut into blocks of about GROUP nodes, another way in each table.
    full = dealt.groupBy("key").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("node", "place", F.lit(draw)), F.ceil(F.col("n") / GROUP))
    dealt = join_anew(dealt, full, "key").withColumn("block", block)
    dealt = dealt.select("key", "block", "node", "vector", F.lit(-2.0).alias("worst"), F.lit(True).alias("fresh"))
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "node")
    return dealt.mapInArrow(lambda batches: introduce(batches, ["key", "block"]), CANDIDATES)


def keep_best(lists: DataFrame) -> DataFrame:
    """The best entries of each list, more of them while they are links. Old entries win against their copies."""
    once = lists.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "other"))
    ranked = once.withColumn("rank", rank).where(F.col("rank") <= WIDEST)
    return ranked.where((F.col("rank") <= NEAR) | (F.col("sim") >= THRESHOLD))


def refine(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """One round: lists with what neighbours of a node learn of each other."""
    last = F.when(F.count("*") >= F.when(F.min("sim") >= THRESHOLD, WIDEST).otherwise(NEAR), F.min("sim")).otherwise(-2.0)
    worst = lists.groupBy("node").agg(last.alias("worst"))
    forward = lists.select(F.col("node").alias("middle"), F.col("other").alias("node"), "fresh")
    order = Window.partitionBy("other").orderBy(F.desc("fresh"), F.xxhash64("node", "other"))
    reverse = lists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= NEAR)
    reverse = reverse.select(F.col("other").alias("middle"), "node", "fresh")
    known = written(nodes.select("node", "vector").join(worst, "node"), "lists")
    guests = join_anew(forward.unionByName(reverse), known, "node")
    guests = guests.select("middle", "node", "vector", "worst", "fresh")
    guests = guests.repartition("middle").sortWithinPartitions("middle", "node")
    found = guests.mapInArrow(lambda batches: introduce(batches, ["middle"]), CANDIDATES)
    old = lists.select("node", "other", "sim", F.lit(False).alias("fresh"))
    return keep_best(old.unionByName(found.withColumn("fresh", F.lit(True))))


def neighbours(nodes: DataFrame, known: DataFrame | None = None, draw: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """Rows (node, other, sim): the neighbour graph of `nodes` (node, kind, vector), on top of one that is known."""
    lists = start(nodes, draw).withColumn("fresh", F.lit(True))
    if known is not None:
        lists = lists.unionByName(known.withColumn("fresh", F.lit(False)))
    lists = written(keep_best(lists), "graph")
    for _ in range(rounds):
        lists = written(refine(nodes, lists), "graph")
        row = lists.agg(F.count("*").alias("n"), F.sum(F.col("fresh").cast("long")).alias("fresh")).first()
        if (row["fresh"] or 0) <= SETTLED * row["n"]:
            break
    return lists.select("node", "other", "sim")


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors of one length."""

    @F.arrow_udf("double")
    def of_pairs(ones: pa.Array, others: pa.Array) -> pa.Array:
        import numpy as np

        out = np.zeros(len(ones))
        sizes = ones.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            here = np.flatnonzero(sizes == size)
            out[here] = (units(ones.take(pa.array(here))) * units(others.take(pa.array(here)))).sum(axis=1)
        return pa.array(out)

    return of_pairs(a, b)


def forest_of(sets: Sets, names) -> pa.RecordBatch:
    """Edges (a, b) between the `names` of a set, one less than it has members."""
    pairs = [(place, sets.root(place)) for place in range(len(names)) if sets.root(place) != place]
    a, b = ([names[pair[side]] for pair in pairs] for side in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def touching(members: DataFrame) -> DataFrame:
    """Edges (a, b) that join the roots of `members` (kind, root, node, vector) between which there can be links."""

    def touch(batches):
        import numpy as np

        for group in groups(batches, ["kind", "low", "high"]):
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            names, block = group.column("root").to_pylist(), group.column("block").to_numpy()
            vectors, radius = units(group.column("vector")), group.column("radius").to_numpy()
            sets, (a, b) = Sets(len(names)), (np.flatnonzero(block == one) for one in (low, high))
            for at in range(0, len(a), BLOCK):
                part = a[at : at + BLOCK]
                apart = np.arccos(np.clip(vectors[part] @ vectors[b].T, -1, 1))
                near = apart <= radius[part][:, None] + radius[b][None, :] + np.arccos(THRESHOLD) + SLACK
                for x, y in np.argwhere(near).tolist():
                    sets.join(int(part[x]), int(b[y]))
            yield forest_of(sets, names)

    centres = members.where("node = root").select("root", F.col("vector").alias("centre"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("vector"), F.col("centre")))))
    radii = join_anew(members.select("root", "vector"), centres, "root").select("root", angle.alias("angle"))
    radii = radii.groupBy("root").agg(F.max("angle").alias("radius"))
    balls = written(join_anew(members.where("node = root").select("kind", "root", "vector"), radii, "root"), "balls")
    sizes = balls.groupBy("kind").agg(F.count("*").alias("n"))
    dealt = spread(balls, "kind", "root", BLOCK, sizes).select("kind", "low", "high", "block", "root", "vector", "radius")
    dealt = dealt.repartition("kind", "low", "high").sortWithinPartitions("kind", "low", "high", "root")
    return dealt.mapInArrow(touch, "a bigint, b bigint")


def count_links(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (node, links) of `members` (kind, root, node, vector, copies), and edges (a, b) between roots with links.

    All vectors of components that can touch are compared, in blocks.
    """

    def count(batches):
        import numpy as np

        for group in groups(batches, ["area", "low", "high"]):
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            nodes, block = group.column("node").to_numpy(), group.column("block").to_numpy()
            copies, vectors = group.column("copies").to_numpy(), units(group.column("vector"))
            names, own = np.unique(group.column("root").to_numpy(), return_inverse=True)
            sets = Sets(len(names))
            for one, other in {(low, high), (high, low)}:
                a, b = np.flatnonzero(block == one), np.flatnonzero(block == other)
                for at in range(0, len(a), BLOCK):
                    part = a[at : at + BLOCK]
                    linked = (vectors[part] @ vectors[b].T >= THRESHOLD) & (nodes[part][:, None] != nodes[b][None, :])
                    none = pa.nulls(len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(linked @ copies[b]), none, none], names_of)
                    if one == low and len(names) > 1:
                        x, y = np.nonzero(linked & (own[part][:, None] != own[b][None, :]))
                        for pair in np.unique(own[part][x] * len(names) + own[b][y]).tolist():
                            sets.join(*divmod(pair, len(names)))
            edges = forest_of(sets, names)
            none = pa.nulls(len(edges), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *edges.columns], names_of)

    names_of = ["node", "links", "a", "b"]
    areas = components(touching(members)).select(F.col("node").alias("root"), F.col("root").alias("area"))
    members = join_anew(members, areas, "root", "left").withColumn("area", F.coalesce("area", "root"))
    members = written(members, "areas")
    sizes = members.groupBy("area").agg(F.count("*").alias("n"))
    dealt = spread(members, "area", "node", BLOCK, sizes)
    dealt = dealt.repartition("area", "low", "high").sortWithinPartitions("area", "low", "high", "node")
    dealt = dealt.select("area", "low", "high", "block", "root", "node", "vector", "copies")
    counted = written(dealt.mapInArrow(count, ", ".join(f"{name} bigint" for name in names_of)), "counted")
    links = counted.where("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    return links, counted.where("a IS NOT NULL").select("a", "b")


def near_duplicates(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept, recall), one for each row; `recall` is that of the audit."""
    given = rows.select(F.col(id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    given = given.withColumn("sound", F.col("label").isNotNull() & is_sound(F.col("vector")))
    given = written(given.withColumn("key", F.xxhash64("label", "vector")), "vectors")
    same = given.where("sound").groupBy("key", "label", "vector")
    same = same.agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    kind = F.xxhash64("label", F.size("vector"))
    nodes = written(same.withColumn("kind", kind).withColumn("node", F.monotonically_increasing_id()), "nodes")
    graph, whole, recall = None, None, 0.0
    for draw in range(TRIES + 1):
        graph = neighbours(nodes.select("node", "kind", "vector"), graph, draw)
        found = written(links_of(given, nodes, graph, whole), "found")
        audited = audit(given, found, "vec_id", "vector", "label", AUDITED).where("true_links > 0")
        audited = written(audited.join(given.select("vec_id", F.xxhash64("label", F.size("vector")).alias("kind")), "vec_id"), "audited")
        sums = audited.agg(F.sum("n_links").alias("found"), F.sum("true_links").alias("true")).first()
        recall = sums["found"] / sums["true"] if sums["true"] else 1.0
        if recall >= RECALL:
            break
        if draw + 1 == TRIES:
            whole = audited.where("n_links < true_links").select("kind").distinct()
    return found.withColumn("recall", F.lit(recall))


def links_of(given: DataFrame, nodes: DataFrame, graph: DataFrame, whole: DataFrame | None) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) by the neighbour graph. Nodes of the kinds in `whole` are all compared."""
    edges = graph.where(F.col("sim") >= THRESHOLD).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))
    edges = written(edges.distinct(), "links")
    roots = written(components(edges), "components")

    # Links of every node in short lists; of components with a full list, and between these, by comparing all.
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = nodes.select(F.col("node").alias("b"), "copies")
    short = join_anew(both, copies, "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("links"))
    full = graph.where(F.col("sim") >= THRESHOLD).groupBy("node").count().where(F.col("count") >= WIDEST).select("node")
    if whole is not None:
        every = nodes.join(whole, "kind", "left_semi").select("node")
        alone = every.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
        roots, full = written(roots.unionByName(alone), "roots"), full.unionByName(every)
    full = roots.join(full.distinct(), "node").select("root").distinct().withColumn("dense", F.lit(True))
    rooted = written(join_anew(roots, full, "root", "left"), "rooted")
    members = rooted.where("dense").select("root", "node").join(nodes.select("node", "kind", "vector", "copies"), "node")
    exact, across = count_links(written(members, "dense"))
    sparse = rooted.where("dense IS NULL").select("node").join(short, "node")
    links = sparse.select("node", "links").unionByName(exact)
    merged = components(across).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    rooted = join_anew(rooted, merged, "root", "left").withColumn("root", F.coalesce("whole", "root"))

    known = nodes.join(rooted.select("node", "root"), "node", "left").join(links, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    known = written(known.select("key", "label", "vector", "copies", "first", "root", "links"), "known")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = join_anew(known, least, "root")
    total = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    named = named.select("key", F.col("label").alias("_label"), F.col("vector").alias("_vector"), "component_id", total.alias("n_links"))
    linked = join_anew(given.where("sound"), named, "key").where("label = _label AND vector = _vector")
    linked = linked.select("vec_id", "n_links", "component_id")
    alone = given.where("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(rows: DataFrame, found: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = AUDITED) -> DataFrame:
    """Rows (vec_id, n_links, true_links) for ids divisible by `every`, the latter by comparing them with all rows.

    An id that several rows have is one line with the sums over these.
    """

    def compare(batches):
        import numpy as np

        for group in groups(batches, ["kind", "block"]):
            asked = group.column("row").is_valid().to_numpy(zero_copy_only=False)
            if asked.any():
                vectors, numbers = units(group.column("vector")), group.filter(pa.array(asked)).column("row")
                links = (vectors[asked] @ vectors[~asked].T >= THRESHOLD).sum(axis=1)
                yield pa.RecordBatch.from_arrays([numbers, group.filter(pa.array(asked)).column("vec_id"), pa.array(links)], ["row", "vec_id", "links"])

    sound = rows.select(F.col(id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    sound = sound.where(F.col("label").isNotNull() & is_sound(F.col("vector")))
    sound = sound.withColumn("kind", F.xxhash64("label", F.size("vector"))).drop("label")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / (4 * BLOCK))).cast("int")
    sizes = sound.groupBy("kind").agg(F.count("*").alias("n")).withColumn("blocks", blocks).drop("n")
    sound = written(join_anew(sound, sizes, "kind").withColumn("row", F.monotonically_increasing_id()), "audit")
    all_rows = sound.withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int")).withColumn("row", F.lit(None).cast("bigint"))
    asked = sound.where(F.col("vec_id") % every == 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = all_rows.unionByName(asked).drop("blocks")
    dealt = dealt.repartition("kind", "block").sortWithinPartitions("kind", "block")
    links = dealt.mapInArrow(compare, "row bigint, vec_id bigint, links bigint")
    true = links.groupBy("row", "vec_id").agg((F.sum("links") - 1).alias("links")).groupBy("vec_id").agg(F.sum("links").alias("true_links"))
    return found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links")).join(true, "vec_id")
