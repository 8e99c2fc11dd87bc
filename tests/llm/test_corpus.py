"""Operators on whole tables, against brute force on small ones."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from trailmark.llm import components, ctw, descent, evidence, simhash, urls
from trailmark.llm.queries import URL_RULES

FOLDER = "/root/testdata/sf0.001"


class Groups:
    def __init__(self, size):
        self.up = list(range(size))

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


# Components


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    draw = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(50, i) for i in range(80) if i != 50],
        "random": [(draw.randrange(90), draw.randrange(90)) for _ in range(60)],
        "none": [],
    }[shape]
    want = Groups(100)
    for a, b in edges:
        want.join(a, b)
    got = components.components(spark.createDataFrame(edges + edges[:5], "a bigint, b bigint")).collect()
    nodes = {x for edge in edges if edge[0] != edge[1] for x in edge}
    assert {row["node"]: row["root"] for row in got} == {x: want.root(x) for x in nodes} and len(got) == len(nodes)


# Urls

ODD_URLS = [None, "", "no scheme/at all", "http://", "HTTP://Example.ORG/es/1", "x://a.example.org?q=/en/", "https://org", "http://a.com/fr/x#y"]


def test_urls(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    more = [(10_000 + i, url) for i, url in enumerate(ODD_URLS)] + [(None, "http://b.com/de/1"), (1, "http://b.com/de/1")]
    pages = pages.unionByName(spark.createDataFrame(more, "page_id bigint, url string"))
    pages = pages.withColumn("host", F.lit("other")).withColumn("n", F.lit(1)).withColumn("template", F.lit(2))
    labels = [(i, i % 3 > 0 if i % 5 else None) for i in range(60)] + [(None, True), (1, True)]
    labels = spark.createDataFrame(labels, "page_id bigint, good boolean")
    got = urls.filter_urls(pages, labels, URL_RULES).collect()

    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        path = rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path

    def rule(host, path):
        fits = []
        for verdict, text in URL_RULES:
            domain, _, rest = text.partition("/")
            if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
                fits.append((len(text), text, verdict))
        return max(fits)[1:] if fits else (None, None)

    want = Counter((row["page_id"], *parts(row["url"])) for row in pages.select("page_id", "url").collect())
    assert Counter((row["page_id"], row["host"], row["path"]) for row in got) == want
    for row in got:
        text, verdict = rule(row["host"], row["path"])
        assert row["rule"] == text and row["verdict"] == (verdict or ("block" if row["purity"] < urls.LEAST else "allow"))


def test_bad_templates_are_rejected(spark):
    rows, labels = [], []
    for i in range(300):
        section = ("news", "spam", "wiki")[i % 3]
        rows.append((i, f"http://site.net/{section}/{i * 7919}/view.html"))
        rows.append((i + 1000, f"http://people.net/u{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'xyz'[i // 100]}/page"))
        labels += [(i, section != "spam")] * (i % 2) + [(i + 1000, True)] * (i % 4 == 0)
    pages, labels = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, good boolean")
    got = {row["page_id"]: row for row in urls.filter_urls(pages, labels, []).collect()}
    assert {got[i]["verdict"] for i in range(1, 300, 3)} == {"block"}
    assert {got[i]["verdict"] for i in range(0, 300, 3)} == {"allow"} == {got[i + 1000]["verdict"] for i in range(300)}
    assert {got[i]["template"] for i in range(0, 300, 3)} == {got[i]["template"] for i in range(2, 300, 3)} != {got[1]["template"]}
    assert {got[i + 1000]["template"] for i in range(300)} == {"/*/page"}
    none = spark.createDataFrame([], "page_id bigint, good boolean")
    assert {row["verdict"] for row in urls.filter_urls(pages, none, []).collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0), labels, URL_RULES).count() == 0


def test_unlike_branches_stay_apart(spark):
    rows, labels = [], []

    def add(host, section, good, labelled, n):
        for i in range(n):
            number = len(rows)
            rows.append((number, f"http://{host}/{section}/{i}"))
            labels.extend([(number, i < good)] * (i < labelled))

    add("glued.net", "spam", 0, 100, 100)  # a branch without labels between a bad and a good one
    add("glued.net", "misc", 0, 0, 50)
    add("glued.net", "news", 150, 150, 150)
    for good in (0, 3, 6, 9):  # each like the one before it
        add("chain.net", "abcdefghij"[good], good, 10, 10)
    add("one.net", "a", 20, 20, 20)
    add("one.net", "b", 0, 0, 20)
    pages, labels = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, good boolean")
    got = {(r["host"], r["path"].split("/")[1]): r for r in urls.filter_urls(pages, labels, []).collect()}
    assert {k: (r["template"], r["verdict"]) for k, r in got.items()} == {
        ("glued.net", "spam"): ("/spam/<n>", "block"),
        ("glued.net", "misc"): ("/misc/<n>", "allow"),
        ("glued.net", "news"): ("/news/<n>", "allow"),
        ("chain.net", "a"): ("/*0/<n>", "block"),
        ("chain.net", "d"): ("/*0/<n>", "block"),
        ("chain.net", "g"): ("/*1/<n>", "allow"),
        ("chain.net", "j"): ("/*1/<n>", "allow"),
        ("one.net", "a"): ("/*/<n>", "allow"),
        ("one.net", "b"): ("/*/<n>", "allow"),
    }
    assert 0.59 < got["glued.net", "misc"]["purity"] < 0.61


# SimHash


def plain_fingerprint(text, width=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    more = [(5000, None), (5001, ""), (None, "\n"), (5002, "one"), (5003, "ONE"), (5004, "one two"), (5004, "one two"), (5005, "É é"), (None, "x y z " * 9000)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string")).withColumn("node", F.lit(1)).withColumn("key", F.lit("k"))
    rows = [(row["doc_id"], plain_fingerprint(row["text"] or "")) for row in docs.collect()]
    sets = Groups(len(rows))
    for i, (_, a) in enumerate(rows):
        for k, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= 2:
                sets.join(i, k)
    least = defaultdict(list)
    for i, (number, _) in enumerate(rows):
        least[sets.root(i)].append(number)
    want = Counter((n, f"{p:016x}", min((x for x in least[sets.root(i)] if x is not None), default=None)) for i, (n, p) in enumerate(rows))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((row["doc_id"], row["fingerprint"], row["component_id"]) for row in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_dense_shards(spark):
    """Fingerprints around a few centres, so that shards are refined and cut into blocks."""
    draw = random.Random(8)
    centres = [draw.getrandbits(64) for _ in range(3)]
    values = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))) for c in centres for _ in range(150)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    sets = Groups(len(values))
    for i, a in enumerate(values):
        for k in range(i):
            if ((a ^ values[k]) & (1 << 64) - 1).bit_count() <= 2:
                sets.join(i, k)
    nodes = spark.createDataFrame([(v,) for v in values], "node bigint")
    got = components.components(simhash.links(nodes, most=8)).collect()
    want = {values[i]: values[sets.root(i)] for i in range(len(values)) if sum(sets.root(k) == sets.root(i) for k in range(len(values))) > 1}
    assert {row["node"]: row["root"] for row in got} == want


def test_tree_finds_all_within_the_radius():
    draw, tree = random.Random(2), simhash.Tree()
    values = [draw.getrandbits(10) for _ in range(200)]
    for value in values:
        tree.add(value)
    for value in values[:40]:
        assert sorted(place for place, _ in tree.search(value, 2)) == [i for i, v in enumerate(values) if (v ^ value).bit_count() <= 2]


def kept_by_hand(rows, width=5, similar=0.8):
    shingles = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        shingles.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})
    sets = Groups(len(rows))
    for i, a in enumerate(shingles):
        for k in range(i):
            if len(a & shingles[k]) >= similar * len(a | shingles[k]):
                sets.join(i, k)
    best = {}
    for i, (number, _) in enumerate(rows):
        best.setdefault(sets.root(i), []).append(number)
    return Counter(min(numbers, key=lambda n: (n is None, n)) for numbers in best.values())


def test_drop_copies(spark):
    draw = random.Random(4)
    lexicon = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    base = [draw.choice(lexicon) for _ in range(200)]
    rows = [(7, None), (8, " "), (None, "alone in the world"), (4, "short text"), (3, "Short  TEXT")]
    for i in range(60):  # near-copies at one to ten changed words
        words = list(base)
        for place in draw.sample(range(200), 1 + i % 10):
            words[place] = draw.choice(lexicon)
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:60] + [draw.choice(lexicon) for _ in range(140)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).withColumn("row", F.lit(1)).withColumn("c0", F.lit(2))
    got = simhash.drop_copies(docs)
    assert got.columns == docs.columns
    assert Counter(row["doc_id"] for row in got.collect()) == kept_by_hand(rows)
    assert simhash.drop_copies(docs.limit(0)).count() == 0


def test_copies_that_repeat_a_line(spark):
    draw = random.Random(11)
    rows = []
    for i in range(20):
        words = ["".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(308)]
        rows += [(4 * i, " ".join(words)), (4 * i + 1, " ".join(words + 19 * words[300:]))]
        rows += [(4 * i + 2, " ".join(words[:200] + 6 * words[7:8])), (4 * i + 3, " ".join(words[:200] + 150 * words[7:8]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = kept_by_hand(rows)
    assert len(want) == 40
    assert Counter(row["doc_id"] for row in simhash.drop_copies(docs).collect()) == want


@pytest.mark.parametrize("blocks", [[0], [0, 1]])
def test_copies_beyond_the_radius(blocks):
    draw = np.random.default_rng(12)
    common = draw.integers(0, 2**32, 300, dtype=np.uint32)  # a long line that all texts share
    sets = []
    for _ in range(20):
        base = draw.integers(0, 2**32, 100, dtype=np.uint32)
        sets += [np.unique(np.concatenate([common[:150], base])), np.unique(np.concatenate([common[:150], base[n:]])) if (n := draw.integers(0, 90)) else common]
    prints = [int(x) for x in draw.integers(-(2**63), 2**63 - 1, len(sets))]  # far from each other
    own = [i % len(blocks) for i in range(len(sets))]
    columns = {"key": [1] * len(sets), "low": [0] * len(sets), "high": [blocks[-1]] * len(sets), "block": own, "row": list(range(len(sets))), "node": prints}
    columns["shingles"] = [x.tobytes() for x in sets]
    got, want = Groups(len(sets)), Groups(len(sets))
    for edges in simhash.copy_forest([pa.RecordBatch.from_pydict(columns)], 0.8):
        for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True):
            got.join(a, b)
    for i in range(len(sets)):
        for k in range(i):
            if (len(blocks) == 1 or own[i] != own[k]) and simhash.similarity(sets[i], sets[k]) >= 0.8:
                want.join(i, k)
    roots = [want.root(i) for i in range(len(sets))]
    assert [got.root(i) for i in range(len(sets))] == roots and 20 < len(set(roots)) < 40


# NN-descent


def embeddings(spark):
    draw = np.random.default_rng(6)
    rows = [(i, draw.standard_normal(16), i % 3) for i in range(900)]
    for k in range(12):  # copies at all distances around the threshold
        rows += [(1000 + 20 * k + i, rows[k][1] + draw.standard_normal(16) * 0.012 * i, rows[k][2]) for i in range(20)]
    dense = draw.standard_normal(16)
    rows += [(2000 + i, dense + draw.standard_normal(16) * 0.06, 1) for i in range(300)]
    rows += [(3000 + i, rows[5][1] * (1 + i % 2), 2) for i in range(30)]
    rows = [(i, [float(x) for x in v.astype("float32")], label) for i, v, label in rows]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(5000 + i, v, 0) for i, v in enumerate(odd)] + [(5100, rows[0][1], None), (5101, rows[0][1], None), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("node", F.lit("x"))
    return df, rows


def test_nn_descent(spark):
    df, rows = embeddings(spark)
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in descent.near_duplicates(df).collect())
    sound = [v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in range(len(rows)) if sound[i]}
    sets, degree, close = Groups(len(rows)), Counter(), 0
    for i in unit:
        for k in unit:
            if k < i and rows[i][2] == rows[k][2] and len(unit[i]) == len(unit[k]):
                cosine = float(unit[i] @ unit[k])
                close += abs(cosine - 0.98) < 1e-9
                if cosine >= 0.98:
                    sets.join(i, k)
                    degree[i] += 1
                    degree[k] += 1
    assert not close and max(degree.values()) > descent.WIDEST
    least = {}
    for i, row in enumerate(rows):
        least[sets.root(i)] = min(least.get(sets.root(i), row[0]), row[0])
    want = Counter((row[0], degree[i], least[sets.root(i)], row[0] == least[sets.root(i)]) for i, row in enumerate(rows))
    links = sum(n * degree for (_, degree, _, _), n in got.items())
    assert 0.99 * sum(degree.values()) <= links <= sum(degree.values())
    assert sum((got & want).values()) >= 0.99 * len(rows)
    assert descent.near_duplicates(df.limit(0)).count() == 0


def test_links_between_dense_groups(spark):
    draw = np.random.default_rng(9)
    axes = np.linalg.qr(draw.standard_normal((64, 64)))[0]
    centres = [axes[0], 0.985 * axes[0] + math.sqrt(1 - 0.985**2) * axes[1], axes[2]]
    rows = [(300 * k + i, centre + draw.standard_normal(64) * math.sqrt(0.001 / 64), 1) for k, centre in enumerate(centres) for i in range(100)]
    rows = [(i, [float(x) for x in v.astype("float32")], label) for i, v, label in rows]
    units = np.array([v for _, v, _ in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    linked = units @ units.T >= 0.98
    assert linked[:200, :200].all() and not linked[:200, 200:].any()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in descent.near_duplicates(df).collect()}
    assert got == {(row[0], int(linked[i].sum()) - 1, 0 if i < 200 else 600, i in (0, 200)) for i, row in enumerate(rows)}


def test_audit_of_recall(spark):
    df, _ = embeddings(spark)
    found = descent.near_duplicates(df)
    row = descent.audit(df, found, every=20).agg(F.sum("n_links").alias("found"), F.sum("true_links").alias("true")).first()
    assert 0 < 0.9 * row["true"] <= row["found"] <= row["true"]


# Classifier


def labelled(spark):
    draw = random.Random(9)
    lexicon = ["".join(draw.choice("abcdefghijklm") for _ in range(draw.randint(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(1200):
        words = [draw.choice(lexicon) for _ in range(draw.randint(40, 90))]
        toxic, low = i % 9 == 0, i % 7 == 0
        if toxic:
            words[10:10] = draw.sample(["vilest", "scorner", "hatemonger", "loathing", "cretinous"], 3)
        if low:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), f"site{i % 5}" if i % 50 else "rare", "en" if i % 2 else None))
        labels.append((i, 0 if low else 1, 1 if toxic else 0))
    return docs, labels


def test_classifier_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    frame = spark.createDataFrame(docs + [(None, None, None, None), (1, docs[1][1], "new", "xx")], "doc_id bigint, text string, source string, lang string")
    frame = frame.withColumn("host", F.lit(1)).withColumn("site", F.lit(2)).withColumn("toxic", F.lit(3))
    known = [row for row in labels if row[0] % 4] + [(None, 1, 1), (3, None, None), (3, 1, None)]
    known = spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
    got = evidence.judge_documents(frame, known)
    assert set(got.columns) == {*frame.columns, "judged"} and got.count() == len(docs) + 2
    kept = {row["doc_id"]: row["kept"] for row in got.select("doc_id", "judged.kept").collect()}
    tested = [(number, quality == 1 and toxic == 0) for number, quality, toxic in labels if number % 4 == 0]
    assert sum(kept[number] == good for number, good in tested) >= 0.98 * len(tested)
    passed = evidence.keep_documents(frame, known)
    assert passed.columns == frame.columns and passed.count() < len(docs)


def test_sites_shift_the_verdict(spark):
    """Documents without a telling word follow their site, and a site with few labels follows the table."""
    rows, labels = [], []
    for i in range(3000):
        site = "bad" if i < 600 else "few" if i < 604 else f"s{i % 6}"
        rows.append((i, f"plain words number {i % 13}", site, "en"))
        labels.append((i, int(not (i < 570 or site == "few" or (i > 604 and i % 40 == 0))), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    shares = evidence.site_shares(docs, evidence.label_table(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")), "doc_id", "source", "lang")
    share = {row["site"]: row["share_low"] for row in shares.collect()}
    bad, few, usual = (share[f'{{"host":"{name}","path":"en"}}'] for name in ("bad", "few", "s1"))
    assert bad > 0.85 and usual < 0.1 and usual < few < 0.999


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "some text", "a", "en"), (2, None, None, None)], "doc_id bigint, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert evidence.keep_documents(docs, none).count() == 2
    assert evidence.keep_documents(docs.limit(0), none).count() == 0


# Context-tree weighting


def weighted_by_hand(train, texts, depth):
    """log10 probabilities by the recursion over a dictionary of contexts."""
    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        line = bytes([ctw.START]) * depth + text + bytes([ctw.END])
        for at in range(depth, len(line)):
            for choice in range(8):
                yield line[at - depth : at], (choice, line[at] >> (8 - choice)), line[at] >> (7 - choice) & 1

    for text in train:
        for context, place, bit in steps(text):
            for d in range(depth + 1):
                counts[context[depth - d :], place][bit] += 1
    own, log = {}, {}
    children = defaultdict(list)
    for node in sorted(counts, key=lambda node: -len(node[0])):
        context, place = node
        a, b = counts[node]
        own[node] = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        longer = sum(log[child] for child in children[node])
        log[node] = own[node] if len(context) == depth else np.logaddexp(own[node], longer) - math.log(2)
        if context:
            children[context[1:], place].append(node)
    scores = []
    for text in texts:
        total = 0.0
        for context, place, bit in steps(text):
            mixed, left, best = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                node = context[depth - d :], place
                if node not in counts:
                    break
                one = (counts[node][1] + 0.5) / (sum(counts[node]) + 1)
                best = mixed + left * one
                weight = math.exp(own[node] - math.log(2) - log[node]) if d < depth else 1.0
                mixed, left = mixed + left * weight * one, left * (1 - weight)
            total += math.log10(best if bit else 1 - best)
        scores.append(total)
    return scores


def test_context_tree(spark):
    draw = random.Random(11)
    lexicon = ["the", "tree", "there", "Then", "a", "éa", "naïve", "x1", "\t\n"]
    rows = [(i, " ".join(draw.choice(lexicon) for _ in range(draw.randint(1, 25)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "never seen ÿ before 日本"), (3, rows[3][1]), (None, "tree the")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("block", F.lit(1)).withColumn("keys", F.lit(2))
    got = Counter()
    for row in ctw.score(docs).collect():
        values = [row[n] for n in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")]
        got[(*values, round(row["base_score"], 6), round(row["score"], 2))] += 1
    held = [zlib.crc32(str("" if n is None else n).encode()) % 7 == 2 for n, _ in rows]
    data = [(text or "").encode().lower() for _, text in rows]
    scores = weighted_by_hand([d for d, h in zip(data, held, strict=True) if not h], data, ctw.DEPTH)
    tokens = [[*d.split(), None] for d in data]
    counts = Counter(t for ts, h in zip(tokens, held, strict=True) if not h for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for (number, _), h, ts, score in zip(rows, held, tokens, scores, strict=True):
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in ts)
        want[number, h, len(ts), sum(counts[t] > 0 for t in ts), total, round(base, 6), round(score, 2)] += 1
    assert got == want
    assert ctw.score(docs.limit(0)).count() == 0


def test_model_beats_the_unigrams(spark):
    rows = ctw.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out")
    row = rows.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert row["score"] > row["base"]


# Pipeline


def test_pipeline_stages(spark):
    from trailmark.session import written

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, FOLDER), name)
        if name == "near_duplicates":
            assert Counter(row["doc_id"] for row in after.select("doc_id").collect()) == kept_by_hand(docs.select("doc_id", "text").collect())
        if name != "packing":
            assert after.columns == docs.columns and 0 < after.count() <= docs.count()
            docs = after
    assert {row["doc_id"] for row in after.collect()} == {row["doc_id"] for row in docs.collect()}


def test_entry_has_all_queries():
    names = entry.queries()
    assert "pipeline" in names and all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 11))
