"""Near-duplicates by SimHash fingerprints, found in BK-trees.

A fingerprint has a bit set where over half of the shingle hashes have it set. Equal fingerprints are one node. Two
fingerprints that differ in at most two bits agree in one of three bands, so nodes are sharded by band and value. A
shard with more than `MOST` nodes is sharded once more: of the four sixths outside the band two must agree as well. What
is still larger is cut into blocks, of which every pair meets in a task of its own.

In each shard a BK-tree holds the fingerprints: the children of a node are keyed by their Hamming distance to it, and a
search with radius r at distance d follows only the edges d - r to d + r. A search reports the links of a shard as a
spanning forest, so a group of n near-copies costs at most n edges and no link between its parts is lost. A tree travels
to the searches of its own shard only; broadcasting all trees would send every executor what grows with the input.

Null texts count as empty; texts without words have fingerprint zero. Rows are not merged: equal rows and equal ids
give one row each, and null ids are ignored where the smallest id is taken.
"""

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import utf8
from trailmark.llm.components import Sets, components, groups, join_anew, spread
from trailmark.session import written

WIDTH = 3
SEED = 42
RADIUS = 2
MOST = 512

# Six parts of the fingerprint: shift and number of bits. Two next to each other are a band.
PARTS = ((53, 11), (42, 11), (31, 11), (20, 11), (10, 10), (0, 10))


def shingle_hashes(data: bytes, width: int):
    """XXH64 of every run of `width` words, repeats included; of all words if there are fewer; empty without words."""
    import numpy as np
    import xxhash

    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, starts, at = b" ".join(words), [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    starts.append(at)
    one, ends = xxhash.xxh64_intdigest, starts[min(width, len(words)) :]
    return np.array([one(line[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)


def fingerprint_of(hashes) -> int:
    """The fingerprint as a signed 64-bit number."""
    import numpy as np

    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    @F.arrow_udf("bigint")
    def of_texts(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(shingle_hashes(data or b"", width)) for data in utf8(texts)], pa.int64())

    return of_texts(text)


class Tree:
    """A BK-tree over integers."""

    def __init__(self):
        self.values, self.children = [], []

    def add(self, value: int) -> int:
        place = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while place:
            distance = (self.values[at] ^ value).bit_count()
            below = self.children[at].setdefault(distance, place)
            if below == place:
                break
            at = below
        return place

    def search(self, value: int, radius: int):
        """Places of all values within the radius, with their distances."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at, distance
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    stack.append(child)


def part(number: int) -> Column:
    shift, bits = PARTS[number]
    return F.shiftrightunsigned("node", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("bigint")


def banded(nodes: DataFrame) -> DataFrame:
    """Rows (node, key): three keys for every node."""
    keys = [(F.lit(band) * (1 << 22) + part(2 * band) * (1 << 11) + part(2 * band + 1)) * (1 << 3) for band in range(3)]
    return nodes.select("node", F.explode(F.array(*[key * (1 << 22) for key in keys])).alias("key"))


def refined(rows: DataFrame) -> DataFrame:
    """Rows (node, key) of too large shards, with six narrower keys for each."""
    choice = F.shiftrightunsigned("key", 47)  # the band
    out = None
    for band in range(3):
        rest = [number for number in range(6) if number // 2 != band]
        pairs = [(a, b) for place, a in enumerate(rest) for b in rest[place + 1 :]]
        keys = [F.col("key") + (pair + 1) * (1 << 22) + part(a) * (1 << 11) + part(b) for pair, (a, b) in enumerate(pairs)]
        of_band = F.array(*keys)
        out = of_band if out is None else F.when(choice == band, of_band).otherwise(out)
    return rows.select("node", F.explode(out).alias("key"))


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def forest(batches, radius: int):
    """Edges of a spanning forest of the links in every group of (key, low, high)."""
    for group in groups(batches, ["key", "low", "high"]):
        nodes, blocks = group.column("node").to_pylist(), group.column("block").to_pylist()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        tree, places, sets = Tree(), [], Sets(len(nodes))
        words = [node & 0xFFFFFFFFFFFFFFFF for node in nodes]
        for place, word in enumerate(words):
            if low != high:
                if blocks[place] != low:
                    continue
            else:
                for found, _ in tree.search(word, radius):
                    sets.join(places[found], place)
            tree.add(word)
            places.append(place)
        if low != high:
            for place, word in enumerate(words):
                if blocks[place] == high:
                    for found, _ in tree.search(word, radius):
                        sets.join(places[found], place)
        pairs = [(nodes[place], nodes[sets.root(place)]) for place in range(len(nodes)) if sets.root(place) != place]
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(nodes: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Edges (a, b) that join exactly the fingerprints `node` which are linked, directly or over others."""
    if radius > 2:
        raise ValueError("three bands find fingerprints that differ in two bits at most")
    wide = banded(nodes)
    count = written(sizes(wide), "shards")
    narrow = refined(join_anew(wide, count.where(F.col("n") > most), "key").drop("n"))
    small = spread(wide, "key", "node", most, count.where(F.col("n") <= most))
    large = spread(narrow, "key", "node", most, sizes(narrow))
    dealt = small.unionByName(large).select("key", "low", "high", "block", "node")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return dealt.mapInArrow(lambda batches: forest(batches, radius), "a bigint, b bigint")


def classes(prints: DataFrame, id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Rows (id, node) with `component_id`, the smallest id among all rows whose fingerprints are linked."""
    distinct = written(prints.groupBy("node").agg(F.min(id).alias("first")), "fingerprints")
    roots = components(links(distinct.select("node"), radius))
    rooted = written(join_anew(distinct, roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(join_anew(rooted.select("node", "root"), firsts, "root").select("node", "component_id"), "classes")
    return prints.join(named, "node")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each document."""
    prints = docs.select(F.col(id).alias("doc_id"), fingerprint(F.col(text), width).alias("node"))
    named = classes(written(prints, "prints"), radius=radius)
    digits = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return named.select("doc_id", digits.alias("fingerprint"), "component_id")


# Near-copies by a measure of similarity
#
# Two texts are near-copies if the Jaccard similarity of their sets of shingles is at least `SIMILAR`. Such texts differ
# in more bits than bands can bridge, so shards are named by the smallest shingle hash under each of `KEYS` permutations:
# at similarity s, two texts miss each other with probability (1 - s) ** KEYS, which is 0.0003 at 0.8. Within a shard
# the BK-tree is asked with radius `NEAR`, and what it finds is compared shingle by shingle unless it is known to belong
# together already. So a large group costs about one comparison for each of its texts. Fingerprints are taken from the
# distinct shingles, since the measure does not count repeats either.
#
# The radius is a short cut, not a bound. Pairs of a shard that are not known to belong together after it are compared if
# they share one of their rarest shingles: with s similar or more, each of two sets has at least s of its shingles in
# the other, so that in any common order the first 1 - s of both, and one more, have a shingle in common.

COPY_WIDTH = 5
SIMILAR = 0.8
KEYS = 5
NEAR = 20  # bits; near-copies at 0.8 differ in 17 at most where this was measured
COPY_MOST = 1024
FEW = 8  # texts of a shard that are compared pair by pair at once
HANDED = 1_000_000  # row numbers that may be handed to all tasks; more are joined by shuffle
SIGNATURE = "struct<digest string, node bigint, keys array<bigint>>"


def signature(text: Column, width: int) -> Column:
    """Of each text: a digest of its words, its fingerprint, and its smallest shingle hashes."""

    @F.arrow_udf(SIGNATURE)
    def of_texts(texts: pa.Array) -> pa.Array:
        import numpy as np
        import xxhash

        mix = np.random.default_rng(SEED).integers(1, 2**63, (KEYS, 2), dtype=np.uint64) | np.uint64(1)
        digests, prints, keys, offsets = [], [], [], [0]
        for data in utf8(texts):
            data = data or b""
            hashes = shingle_hashes(data, width)
            digests.append(xxhash.xxh128_hexdigest(b" ".join(data.lower().split())))
            prints.append(fingerprint_of(np.unique(hashes)))
            for number, (times, more) in enumerate(mix if len(hashes) else []):
                mixed = hashes * times
                least = int(((mixed ^ (mixed >> np.uint64(29))) * more).min())
                keys.append((least >> 4 << 3 | number) - (1 << 62))
            offsets.append(len(keys))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.int64()))
        return pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.array(prints, pa.int64()), lists], ["digest", "node", "keys"])

    return of_texts(text)


def shingle_set(text: Column, width: int) -> Column:
    """The distinct shingles of each text as ascending 32-bit hashes."""

    @F.arrow_udf("binary")
    def of_texts(texts: pa.Array) -> pa.Array:
        import numpy as np

        return pa.array([np.unique(shingle_hashes(data or b"", width).astype("<u4")).tobytes() for data in utf8(texts)], pa.binary())

    return of_texts(text)


def similarity(a, b) -> float:
    """Jaccard similarity of two ascending arrays without repeats."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def candidates(shingles, sides, sets: Sets, similar: float):
    """Pairs of places, of different sides if there are any, that are in different sets and may be similar."""
    import numpy as np

    def apart(one: int, other: int) -> bool:
        return (sides is None or sides[one] != sides[other]) and sets.root(one) != sets.root(other)

    places = range(len(shingles))
    if all(sets.root(place) == sets.root(0) for place in places):
        return
    if len(shingles) <= FEW:
        yield from ((one, other) for other in places for one in range(other) if apart(one, other))
        return
    drawn = np.sort(np.concatenate(shingles))
    starts = np.flatnonzero(np.concatenate(([True], drawn[1:] != drawn[:-1])))
    counts = np.diff(np.append(starts, len(drawn)))
    shared, counts = drawn[starts[counts > 1]], counts[counts > 1]
    del drawn, starts
    holders = {}
    for place, own in enumerate(shingles if len(shared) else []):
        at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
        count = np.where(shared[at] == own, counts[at], 1)
        first = len(own) - math.ceil(similar * len(own) - 1e-9) + 1
        rarest = np.lexsort((own, count))[:first]
        met = set()
        for shingle in own[rarest[count[rarest] > 1]].tolist():
            before = holders.setdefault(shingle, [])
            for other in before:
                if other not in met:
                    met.add(other)
                    if apart(other, place):
                        yield other, place
            before.append(place)


def copy_forest(batches, similar: float):
    """Edges of a spanning forest of the near-copies in every group of (key, low, high)."""
    import numpy as np

    for group in groups(batches, ["key", "low", "high"]):
        rows, blocks = group.column("row").to_pylist(), group.column("block").to_pylist()
        words = [node & 0xFFFFFFFFFFFFFFFF for node in group.column("node").to_pylist()]
        shingles = [np.frombuffer(data, "<u4") for data in group.column("shingles").to_pylist()]
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        tree, places, sets, pairs = Tree(), [], Sets(len(rows)), []

        def compare(other: int, place: int) -> None:
            own = shingles[place]
            sizes = sorted((len(own), len(shingles[other])))
            if sizes[0] < similar * sizes[1] or sets.root(other) == sets.root(place):
                return
            if similarity(own, shingles[other]) >= similar:
                sets.join(other, place)
                pairs.append((rows[other], rows[place]))

        def ask(place: int) -> None:
            for found, _ in sorted(tree.search(words[place], NEAR), key=lambda hit: hit[1]):
                compare(places[found], place)

        for place in range(len(rows)):
            if low == high:
                ask(place)
            if low == high or blocks[place] == low:
                tree.add(words[place])
                places.append(place)
        if low != high:
            for place in range(len(rows)):
                if blocks[place] == high:
                    ask(place)
        for other, place in candidates(shingles, blocks if low != high else None, sets, similar):
            compare(other, place)
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def where_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by `row`; the texts stay where they are if there are few rows."""
    return docs.join(F.broadcast(rows) if rows.count() <= HANDED else rows, "row", how)


def copy_links(docs: DataFrame, nodes: DataFrame, text: str, width: int, similar: float) -> DataFrame:
    """Edges (a, b) between rows. `nodes` has row, node and keys, one for each different text."""
    asked = written(nodes.select("row", "node", F.explode("keys").alias("key")), "asked")
    dealt = spread(asked, "key", "row", COPY_MOST, sizes(asked))
    dealt = written(dealt.select("key", "low", "high", "block", "row", "node"), "shards")
    wanted = written(dealt.select("row").distinct(), "wanted")
    sets = where_row(docs.select("row", F.col(text).alias("text")), wanted, "semi")
    sets = written(sets.select("row", shingle_set(F.col("text"), width).alias("shingles")), "shingles")
    dealt = join_anew(dealt, sets, "row").repartition("key", "low", "high")
    dealt = dealt.sortWithinPartitions("key", "low", "high", "row")
    return dealt.mapInArrow(lambda batches: copy_forest(batches, similar), "a bigint, b bigint")


def drop_copies(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = COPY_WIDTH, similar: float = SIMILAR) -> DataFrame:
    """The documents without near-copies: of each group of linked ones, the one with the smallest id stays.

    The documents keep their columns, whatever their names. Null ids are last; of equal ids the first row stays. Texts
    that differ in case of A-Z or in white space are copies; texts without words are copies of each other.
    """
    names = [f"c{place}" for place in range(len(docs.columns))]
    plain = dict(zip(docs.columns, names, strict=True))
    held = written(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "documents")
    prints = held.select("row", F.col(plain[id]).alias("id"), signature(F.col(plain[text]), width).alias("s"))
    prints = written(prints.select("row", "id", "s.*"), "signatures")
    firsts = written(prints.groupBy("digest").agg(F.min("row").alias("first")), "texts")
    rows = written(join_anew(prints.select("row", "id", "digest"), firsts, "digest").select("row", "id", "first"), "rows")
    nodes = prints.join(firsts.select(F.col("first").alias("row")), "row")
    roots = components(copy_links(held, nodes.select("row", "node", "keys"), plain[text], width, similar))
    rows = join_anew(rows, roots.select(F.col("node").alias("first"), "root"), "first", "left")
    rows = written(rows.select("row", "id", F.coalesce("root", "first").alias("root")), "grouped")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    kept = rows.groupBy("root").agg(F.min(order).getField("row").alias("row"))
    dropped = written(rows.select("row").join(kept, "row", "anti"), "dropped")
    return where_row(held, dropped, "anti").select(*[F.col(new).alias(old) for old, new in plain.items()])
