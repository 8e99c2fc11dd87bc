"""URL filter by rules and by path templates with labelled purity.

Rules come first: the longest rule that fits a url decides. All other urls are judged by the template of their path.

* Per host, paths form a tree of segments. A segment that looks like a number, id or slug is variable at once and
  becomes a wildcard that keeps its file ending (`<n>.html`, `<x>`, `<s>`). The tree is then gone down level by level: a
  place with more than `NAMES` different segments below one parent is variable as a whole (`*`), but for segments that
  hold far more rows than their share. Where a place has become a wildcard, what lies below its segments is counted
  together, so the level below sees one parent. Segments behind the first `DEPTH` are variable by their looks only.
* Branches that have the same parent and go on alike are merged, level by level from the leaves up. They are ordered by
  purity, and each joins the cluster before it as long as its labels do not differ from the sums of that cluster: a
  chi-square of at most `ALIKE`. All of them in one are `*`, several clusters are `*0`, `*1` and so on. Branches without
  labels join the cluster if there is only one; else they stay alone, with the purity of all branches that go on alike.
* The purity of a template is its share of good labels, smoothed by `STRENGTH` pseudo-labels at the purity of its host,
  which in turn is smoothed by as many at the purity of the whole table. Below `LEAST` the template is rejected.

All statistics are sums by host, parent or template over the whole table, folded before the shuffle; a host with a third of
all pages is one row per distinct path after the first step. No table is cut or sampled.

Null urls and urls without `://` have an empty host and path, and share one template. Null labels do not count; of
several labels of a page all count. Empty tables give no rows. Repeated pages are judged each, and alike.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trailmark.llm.common import lower_ascii
from trailmark.llm.components import join_anew
from trailmark.session import written

ALLOW, BLOCK = "allow", "block"
DEPTH = 16  # levels of the tree; what lies behind is part of a template segment by segment
NAMES = 24  # different siblings up to which a place holds names
FACTOR = 20.0  # times the rows of an average sibling that a name has beyond that
ALIKE = 3.84  # chi-square with one degree of freedom at 5 %
STRENGTH = 8.0
LEAST = 0.5


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z in lower case; empty without `://`."""
    return F.coalesce(lower_ascii(F.regexp_extract(after(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, 2147483647)).otherwise("")


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the (verdict, rule) that fit, and its verdict; null if none fits. Equal lengths: the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = text.partition("/")
        domain = domain.lower()
        fits = (host == domain) | host.endswith("." + domain)
        fits = fits & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    """A segment with its variable part as a wildcard, or as it is. The ending of a file name stays."""
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    ending = F.substring(segment, F.length(stem) + 1, F.lit(6))
    wild = (
        F.when(stem.rlike(r"^[0-9]+$"), "<n>")
        .when(stem.rlike(r"[0-9]") & (F.length(stem) > 3), "<x>")
        .when(stem.rlike(r"^[^-_]+([-_][^-_]+){2,}$"), "<s>")
    )
    return F.when(wild.isNotNull(), F.concat(wild, ending)).otherwise(segment)


def shaped(path: Column) -> Column:
    """The segments of a path, shaped."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), shape)


def joined(steps: str) -> Column:
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def with_key(df: DataFrame, *names: str) -> DataFrame:
    """One hashable key of several columns, none of them null."""
    return df.withColumn("_key", F.to_json(F.struct(*names)))


def with_place(steps: Column, place: int, step: Column) -> Column:
    """A list with one element changed."""
    return F.transform(steps, lambda old, at: F.when(at == place, step).otherwise(old))


def templates(paths: DataFrame) -> DataFrame:
    """Rows (host, path, steps) for distinct rows (host, path, n), `path` an array of shaped segments.

    A round decides the steps of one level, below parents that are steps already; its rows are the paths that go as deep.
    """
    rows = paths.withColumn("steps", F.col("path"))
    depth = min(DEPTH, paths.agg(F.max(F.size("path"))).first()[0] or 0)
    ended = None
    for place in range(depth):
        here = rows.where(F.size("path") > place)
        short = rows.where(F.size("path") <= place)
        ended = short if ended is None else ended.unionByName(short)
        parent = F.array_join(F.slice("steps", 1, place), "/")
        here = with_key(here.withColumns({"parent": parent, "segment": F.get("path", F.lit(place))}), "host", "parent")
        siblings = here.groupBy("_key", "segment").agg(F.sum("n").alias("rows"))
        parents = siblings.groupBy("_key").agg(F.count("*").alias("kinds"), F.sum("rows").alias("all_rows"))
        judged = join_anew(siblings, parents, "_key")
        is_name = (F.col("kinds") <= NAMES) | (F.col("rows") * F.col("kinds") >= FACTOR * F.col("all_rows"))
        is_name = is_name | F.col("segment").startswith("<") | (F.col("segment") == "")
        judged = judged.select("_key", "segment", F.when(is_name, F.col("segment")).otherwise("*").alias("step"))
        judged = with_key(judged.withColumnRenamed("_key", "key"), "key", "segment").select("_key", "step")
        named = join_anew(with_key(here.withColumnRenamed("_key", "key"), "key", "segment"), judged, "_key")
        rows = written(named.withColumn("steps", with_place(F.col("steps"), place, F.col("step"))).select(*rows.columns), "level")
    ended = rows if ended is None else ended.unionByName(rows)
    return ended.select("host", "path", "steps")


def clusters(batches):
    """Adds `cluster` to labelled branches in the order of `_key` and purity; only the sums of the last one are held."""
    key, cluster, good, labelled = None, 0, 0, 0
    for batch in batches:
        out = []
        for of, g, n in zip(*(batch.column(name).to_pylist() for name in ("_key", "good", "labelled")), strict=True):
            if of != key:
                key, cluster, good, labelled = of, 0, 0, 0
            if labelled:
                both = (good + g + 0.5) / (labelled + n + 1.0)
                gap = g / n - good / labelled
                if gap * gap > ALIKE * both * (1 - both) * (1 / n + 1 / labelled):
                    cluster, good, labelled = cluster + 1, 0, 0
            good, labelled = good + g, labelled + n
            out.append(cluster)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "cluster"])


def merged_level(rows: DataFrame, place: int) -> DataFrame:
    """Rows (host, steps, own_steps, good, labelled, pool_good, pool_labelled) after merging branches at one place."""
    is_name = (F.size("steps") > place + 1) & ~F.get("steps", F.lit(place)).startswith("<") & ~F.get("steps", F.lit(place)).isin("*", "")
    branches = rows.where(is_name).groupBy("host", "steps").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    branches = with_key(branches.withColumn("alike", with_place(F.col("steps"), place, F.lit("*"))), "host", "alike")
    pools = branches.groupBy("_key").agg(F.sum("good").alias("sum_good"), F.sum("labelled").alias("sum_labelled"), F.count("*").alias("all"))
    pooled = join_anew(branches, pools.where("all > 1"), "_key")
    share = (F.col("sum_good") + 0.5) / (F.col("sum_labelled") + 1.0)
    pooled = pooled.withColumn("own", (F.col("good") + share) / (F.col("labelled") + 1.0))
    pooled = written(pooled.withColumn("name", F.array_join("steps", "/")), "forms")
    ordered = pooled.where("labelled > 0").repartition("_key").sortWithinPartitions("_key", "own", "name")
    clustered = ordered.mapInArrow(clusters, StructType([*ordered.schema, StructField("cluster", LongType())]))
    found = clustered.unionByName(pooled.where("labelled = 0").withColumn("cluster", F.lit(None).cast("bigint")))
    parts = F.coalesce(F.max("cluster").over(Window.partitionBy("_key")) + 1, F.lit(1))
    members = F.count("*").over(Window.partitionBy("_key", "cluster"))
    step = F.when(F.col("parts") == 1, F.lit("*")).when(F.col("cluster").isNull() | (F.col("members") == 1), F.get("steps", F.lit(place)))
    step = step.otherwise(F.concat(F.lit("*"), F.col("cluster").cast("string")))
    found = found.withColumn("parts", parts).withColumn("members", members).withColumn("new", with_place(F.col("steps"), place, step))
    found = with_key(found.select("host", "steps", "new", "sum_good", "sum_labelled"), "host", "steps")
    named = join_anew(with_key(rows, "host", "steps"), found.select("_key", "new", "sum_good", "sum_labelled"), "_key", "left")
    # A template without labels keeps those of the first pool that has some.
    lacks = (F.col("labelled") == 0) & (F.col("pool_labelled") == 0)
    pool = {f"pool_{c}": F.when(lacks, F.coalesce(f"sum_{c}", F.lit(0))).otherwise(F.col(f"pool_{c}")) for c in ("good", "labelled")}
    return written(named.withColumns({**pool, "steps": F.coalesce("new", "steps")}).select(*rows.columns), "merged")


def purities(counts: DataFrame) -> DataFrame:
    """Rows (host, template, merged, purity) for rows (host, steps, good, labelled): a template after merging."""
    zero = F.lit(0).cast("bigint")
    rows = counts.select("host", "steps", F.col("steps").alias("own_steps"), "good", "labelled", zero.alias("pool_good"), zero.alias("pool_labelled"))
    rows = written(rows, "branches")
    depth = min(DEPTH, rows.agg(F.max(F.size("steps"))).first()[0] or 0)
    for place in reversed(range(depth - 1)):
        rows = merged_level(rows, place)
    rows = rows.select("host", joined("own_steps").alias("template"), joined("steps").alias("merged"), "good", "labelled", "pool_good", "pool_labelled")
    total = rows.agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")).first()
    overall = ((total["good"] or 0) + 1.0) / ((total["labelled"] or 0) + 1.0)  # without any label nothing is rejected

    def smoothed(prior):
        return (F.sum("good") + STRENGTH * prior) / (F.sum("labelled") + STRENGTH)

    hosts = rows.groupBy("host").agg(smoothed(F.lit(overall)).alias("host_purity"))
    # Without labels of its own, a template has those of its pool.
    sums = [F.when(F.sum("labelled") > 0, F.sum(c)).otherwise(F.max(f"pool_{c}")).alias(c) for c in ("good", "labelled")]
    pooled = rows.groupBy("host", "merged").agg(*sums)
    pooled = join_anew(pooled, hosts, "host")
    purity = (F.col("good") + STRENGTH * F.col("host_purity")) / (F.col("labelled") + STRENGTH)
    pooled = with_key(pooled.withColumn("purity", purity), "host", "merged").select("_key", "purity")
    return join_anew(with_key(rows, "host", "merged"), pooled, "_key").select("host", "template", "merged", "purity")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], url: str = "url", id: str = "page_id") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, template, purity), one for each page.

    `labels` has `id` and `good`, a boolean. `rules` are (verdict, host and path). Every url has a template; the rule
    wins where there is one.
    """
    rows = pages.select(F.col(id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rows = written(rows.withColumn("shape", shaped(F.col("path"))), "urls")
    label = labels.where("good IS NOT NULL").groupBy(F.col(id).alias("page_id"))
    label = label.agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("labelled"))
    known = rows.join(label, "page_id", "left")
    paths = known.groupBy("host", F.col("shape").alias("path")).agg(
        F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "labelled")]
    )
    paths = written(paths, "paths")
    named = with_key(templates(paths.select("host", "path", "n")), "host", "path").select("_key", "steps")
    judged = written(join_anew(with_key(paths, "host", "path"), named, "_key").withColumn("template", joined("steps")), "templates")
    counts = judged.groupBy("host", "steps").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    purity = with_key(purities(counts), "host", "template").select("_key", "merged", "purity")
    by_path = join_anew(with_key(judged, "host", "template").select("_key", "host", "path"), purity, "_key")
    by_path = with_key(by_path.withColumnRenamed("path", "shape"), "host", "shape").select("_key", "merged", "purity")
    out = join_anew(with_key(rows, "host", "shape"), by_path, "_key")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("purity") < LEAST, BLOCK).otherwise(ALLOW)
    return out.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, learned).alias("verdict"),
        F.col("merged").alias("template"),
        "purity",
    )
