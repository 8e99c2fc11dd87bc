"""Quality classifier by hierarchical empirical Bayes: evidence of a text on top of what its site leads to expect.

Two faults are judged alike: toxic and low quality.

* Evidence. Texts become sets of hashed features: words, their beginnings, and the shape of the text (capitals, symbols,
  repetition). A logistic regression weighs those whose shares among faulty and sound documents differ by `SIGNIFICANT`
  standard errors. It is fitted on at most `FIT_ROWS` labelled documents, drawn by a hash of the id, and has `FEATURES`
  weights for each fault, whatever the input.
* Sites. All labels count here, by grouped sums: the faulty share of a host is shrunk towards that of the whole table,
  and that of a path towards its host's. How strongly is estimated from the data: by moments, from how much sites differ
  more than chance makes them. A site with few labels keeps its parent's share, a site without labels is its parent.
* A document is faulty with the odds of its path times the odds of its evidence, and rejected above `REJECT`.

Here a host is the `source` of a document and a path its `lang` within; the columns are parameters. Null texts count as
empty, null hosts and paths are sites of their own. Labels that are null do not count; of several labels of a document
the worse holds. Without any labels nothing is rejected. Repeated documents are judged each, and alike. The columns of the
input are taken by their place, so other columns may have any name.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import once_per_worker, utf8
from trailmark.llm.components import join_anew
from trailmark.llm.vocab import Recent
from trailmark.session import written

FEATURES = 1 << 18
FIT_ROWS = 20_000
SIGNIFICANT = 3.0
SMOOTH = 0.5
STEPS = 200
PACE = 0.3
PENALTY = 1e-4
REJECT = {"toxic": 0.3, "low": 0.5}  # passing on a toxic text is worse than losing a sound one
FAULTS = ("toxic", "low")
WORDS = 150_000  # words whose features a worker remembers
STRIPPED = b".,;:!?\"'()[]{}|"
SYMBOLS = b"#*$%&|<>!@^~=+_\\/"


def word_features(word: bytes) -> bytes:
    """Places of a word and of its beginnings, as 32-bit integers."""
    import numpy as np
    import xxhash

    core = word.strip(STRIPPED)
    parts = [b"w" + core, *[b"p" + core[:size] for size in (4, 5, 6) if len(core) > size]] if core else []
    return np.array([xxhash.xxh32_intdigest(part) % FEATURES for part in parts], "<i4").tobytes()


def shape_features(data: bytes, words: list[bytes], distinct: int) -> bytes:
    """Places of a few bucketed measures of the whole text."""
    import numpy as np
    import xxhash

    size, count = max(1, len(data)), max(1, len(words))
    lines = data.split(b"\n")
    capitals = size - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = size - len(data.translate(None, SYMBOLS))
    measures = {
        "capitals": int(20 * capitals / size),
        "symbols": int(50 * symbols / size),
        "distinct": int(20 * (distinct / count) * min(1.0, count / 50) ** 0.25),
        "lines": int(10 * len(set(lines)) / len(lines)),
        "length": count.bit_length(),
        "word": min(15, size // count),
    }
    return np.array([xxhash.xxh32_intdigest(f"{k}={v}") % FEATURES for k, v in measures.items()], "<i4").tobytes()


def features(data: bytes):
    """Distinct features of a text."""
    import numpy as np

    recent = once_per_worker("features", lambda: Recent(word_features, WORDS))
    words = data.split()
    distinct = set(data.lower().split())
    return np.unique(np.frombuffer(b"".join(map(recent.__getitem__, distinct)) + shape_features(data, words, len(distinct)), "<i4"))


def label_table(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, toxic, low) with 0, 1 or null: one for each labelled document."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), (1 - F.min("quality")).alias("low"))


def drawn_rows(docs: DataFrame, labels: DataFrame, text: str, id: str, fit_rows: int) -> DataFrame:
    """Rows (text, toxic, low) of the documents to fit on: about, and at most, `fit_rows`."""
    known = labels.where("toxic IS NOT NULL OR low IS NOT NULL")
    share = min(1.0, 0.95 * fit_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(fit_rows)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return written(rows.join(F.broadcast(drawn), "doc_id").select("text", *FAULTS), "sample")


def telling(sample: DataFrame):
    """The features that differ significantly between faulty and sound documents, ascending."""
    import numpy as np

    def count(batches):
        import numpy as np

        # Documents with a feature, by fault: faulty ones, then sound ones; the last column is the number of documents.
        sums = np.zeros((4, FEATURES + 1), np.int64)
        for batch in batches:
            values = [batch.column(name).to_pylist() for name in FAULTS]
            for data, *faulty in zip(utf8(batch.column("text")), *values, strict=True):
                places = features(data or b"")
                for number, value in enumerate(faulty):
                    if value is not None:
                        row = 2 * number + (0 if value else 1)
                        sums[row, places] += 1
                        sums[row, FEATURES] += 1
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(row[used]) for row in sums]], ["place", "a", "b", "c", "d"])

    counted = sample.mapInArrow(count, "place bigint, a bigint, b bigint, c bigint, d bigint")
    rows = counted.groupBy("place").agg(*[F.sum(c).alias(c) for c in "abcd"]).toPandas()  # FEATURES + 1 rows at most
    sums = np.zeros((4, FEATURES + 1))
    sums[:, rows["place"].to_numpy()] = rows[list("abcd")].to_numpy().T
    told = np.zeros(FEATURES, bool)
    for bad, good in (sums[:2], sums[2:]):
        if bad[-1] and good[-1]:
            mean = (bad[:-1] + good[:-1] + SMOOTH) / (bad[-1] + good[-1] + 2 * SMOOTH)
            error = np.sqrt(mean * (1 - mean) * (1 / bad[-1] + 1 / good[-1]))
            told |= np.abs(bad[:-1] / bad[-1] - good[:-1] / good[-1]) > SIGNIFICANT * error
    return np.flatnonzero(told)


def regression(rows, columns, size: int, width: int, faulty):
    """Weights and intercept of a logistic regression on sparse 0/1 rows, by gradients with a step for each weight."""
    import numpy as np

    weights, seen, intercept, seen_intercept = np.zeros(width), np.full(width, 1e-8), 0.0, 1e-8
    for _ in range(STEPS):
        odds = np.bincount(rows, weights[columns], size) + intercept
        off = 1 / (1 + np.exp(-np.clip(odds, -40, 40))) - faulty
        slope = np.bincount(columns, off[rows], width) / size + PENALTY * weights
        seen += slope * slope
        weights -= PACE * slope / np.sqrt(seen)
        seen_intercept += off.mean() ** 2
        intercept -= PACE * off.mean() / seen_intercept**0.5
    return weights, intercept


def fit(docs: DataFrame, labels: DataFrame, text: str, id: str, fit_rows: int = FIT_ROWS):
    """Weights of the features, one row for each fault, and what to add: a document's odds against those of its table."""
    import numpy as np

    sample = drawn_rows(docs, labels, text, id, fit_rows)
    told = telling(sample)
    weights, added = np.zeros((len(FAULTS), FEATURES), np.float32), np.zeros(len(FAULTS))

    def sparse(batches):
        import numpy as np

        for batch in batches:
            lists = [np.flatnonzero(np.isin(told, features(data or b""))).astype(np.int32) for data in utf8(batch.column("text"))]
            places = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([places, *[batch.column(name).cast(pa.int32()) for name in FAULTS]], ["places", *FAULTS])

    matrix = sample.mapInArrow(sparse, "places array<int>, toxic int, low int").toArrow()  # at most fit_rows rows
    lists = matrix.column("places").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    columns, rows = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)
    for number, name in enumerate(FAULTS):
        values = np.array([np.nan if v is None else v for v in matrix.column(name).to_pylist()], float)
        known = ~np.isnan(values)
        if known.any() and 0 < values[known].sum() < known.sum():
            renumbered, use = np.cumsum(known) - 1, known[rows]
            found, intercept = regression(renumbered[rows[use]], columns[use], int(known.sum()), len(told), values[known])
            share = values[known].mean()
            weights[number, told], added[number] = found, intercept - np.log(share / (1 - share))
    return weights, added


def evidence(text: Column, weights, added, docs: DataFrame) -> Column:
    """By how much a text raises the log-odds of each fault."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, added))

    @F.arrow_udf("struct<toxic double, low double>")
    def score(texts: pa.Array) -> pa.Array:
        import numpy as np

        table, rest = shared.value
        sums = np.array([table[:, features(data or b"")].sum(axis=1) for data in utf8(texts)], np.float64).reshape(-1, 2) + rest
        return pa.StructArray.from_arrays([pa.array(sums[:, 0]), pa.array(sums[:, 1])], list(FAULTS))

    return score(text)


def strength(sites: DataFrame, fault: str) -> float:
    """Pseudo-labels of the parent in a site's share, by moments over `sites` (n_, bad_, parent_ of the fault)."""
    n, bad, parent = (F.col(f"{name}_{fault}") for name in ("n", "bad", "parent"))
    spread = n * (bad / n - parent) * (bad / n - parent)
    row = (
        sites.where(n > 0)
        .agg(
            F.sum(spread).alias("spread"),
            F.sum(parent * (1 - parent)).alias("chance"),
            F.sum(n).alias("n"),
            F.sum(n * n).alias("squares"),
            F.sum(n * parent * (1 - parent)).alias("within"),
        )
        .first()
    )
    if not row["n"]:
        return 1.0
    freedom = row["n"] - row["squares"] / row["n"]
    between = (row["spread"] - row["chance"]) / freedom if freedom > 0 else 0.0
    within = row["within"] / row["n"]
    return float(min(1e6, max(1.0, within / between - 1))) if between > 0 else 1e6


def shrunk(sites: DataFrame) -> DataFrame:
    """The sites with `share_` of each fault, shrunk towards `parent_`."""
    for fault in FAULTS:
        weight = strength(sites, fault)
        share = (F.col(f"bad_{fault}") + weight * F.col(f"parent_{fault}")) / (F.col(f"n_{fault}") + weight)
        sites = sites.withColumn(f"share_{fault}", share)
    return sites


def site_shares(docs: DataFrame, labels: DataFrame, id: str, host: str, path: str) -> DataFrame:
    """Rows (site, share_toxic, share_low) for every site of `docs`."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"))
    rows = rows.join(labels, "doc_id", "left")
    sums = [agg for f in FAULTS for agg in (F.count(f).alias(f"n_{f}"), F.coalesce(F.sum(f), F.lit(0)).alias(f"bad_{f}"))]
    paths = rows.groupBy("host", "path").agg(*sums)
    paths = paths.withColumn("site", F.to_json(F.struct("host", "path"))).withColumn("host", F.to_json(F.struct("host")))
    paths = written(paths.drop("path"), "sites")
    totals = [F.sum(f"{name}_{f}").alias(f"{name}_{f}") for f in FAULTS for name in ("n", "bad")]
    whole = paths.agg(*totals).first()
    hosts = paths.groupBy("host").agg(*totals)
    for f in FAULTS:
        # Without labels of a fault no document has it.
        overall = ((whole[f"bad_{f}"] or 0) + 0.5) / ((whole[f"n_{f}"] or 0) + 1.0) if whole[f"n_{f}"] else 1e-9
        hosts = hosts.withColumn(f"parent_{f}", F.lit(float(overall)))
    hosts = shrunk(written(hosts, "hosts")).select("host", *[F.col(f"share_{f}").alias(f"parent_{f}") for f in FAULTS])
    return written(shrunk(written(join_anew(paths, hosts, "host"), "paths")).select("site", "share_toxic", "share_low"), "shares")


def judged_rows(docs: DataFrame, labels: DataFrame, text: str, id: str, host: str, path: str) -> DataFrame:
    """The columns of the documents as `c0`, `c1` and so on, by their place, and `judged`."""
    known = written(label_table(labels), "labels")
    weights, added = fit(docs, known, text, id)
    shares = site_shares(docs, known, id, host, path)
    shares = shares.select("site", F.struct("share_toxic", "share_low").alias("shares"))
    rows = docs.toDF(*[f"c{place}" for place in range(len(docs.columns))])
    host, path, text = (F.col(f"c{docs.columns.index(name)}") for name in (host, path, text))
    joined = rows.withColumn("site", F.to_json(F.struct(host.alias("host"), path.alias("path")))).join(shares, "site")
    joined = joined.withColumn("evidence", evidence(text, weights, added, docs))
    odds = {f: F.col(f"evidence.{f}") + F.log(F.col(f"shares.share_{f}") / (1 - F.col(f"shares.share_{f}"))) for f in FAULTS}
    chance = {f: 1 / (1 + F.exp(-value)) for f, value in odds.items()}
    kept = (chance["toxic"] <= REJECT["toxic"]) & (chance["low"] <= REJECT["low"])
    chances = [chance[f].alias(f"p_{f}") for f in FAULTS]
    judged = F.struct(*chances, "shares.share_toxic", "shares.share_low", kept.alias("kept"))
    return joined.select(*rows.columns, judged.alias("judged"))


def judge_documents(
    docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", path: str = "lang"
) -> DataFrame:
    """The documents with one more column `judged`: probabilities of both faults, shares of the site, and `kept`.

    `labels` has doc_id, quality and toxic. A column named `judged` is replaced.
    """
    rows = judged_rows(docs, labels, text, id, host, path)
    own = [F.col(f"c{place}").alias(name) for place, name in enumerate(docs.columns) if name != "judged"]
    return rows.select(*own, "judged")


def keep_documents(
    docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", path: str = "lang"
) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    rows = judged_rows(docs, labels, text, id, host, path).where("judged.kept")
    return rows.select(*[F.col(f"c{place}").alias(name) for place, name in enumerate(docs.columns)])
