"""Sampling, masking, leak scans, constraint checks, erasure and review transitions."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trailmark import schemas as S
from trailmark.functions import text as X
from trailmark.functions.times import HOUR_MS
from trailmark.operators.slices import with_previous
from trailmark.operators.tables import lookup


def sampled(session_id: Column, rate: Column) -> Column:
    """One decision per session, the same everywhere and always: the session's digest falls below the rate or not."""
    draw = F.conv(F.substring(F.md5(session_id), 1, 8), 16, 10).cast("bigint")
    return draw < rate * 2**32


def sample_sessions(events: DataFrame, sites: DataFrame) -> DataFrame:
    """Events of the sessions that fall into the sampling rate of their site."""
    rates = sites.select(F.col("id").alias("site_id"), "sampling_rate")
    return events.join(rates, "site_id").filter(sampled(F.col("session_id"), F.col("sampling_rate"))).drop("sampling_rate")


def mask_columns(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Applies `mask` (star per character), `mask_text` (all but white space) or `sensitive` to the named columns.

    A column whose name is sensitive is always masked as `sensitive`, whatever its rule says, and also without a rule.
    """
    actions = {"mask": X.mask, "mask_text": X.mask_text, "sensitive": X.mask_sensitive}
    texts = {field.name for field in df.schema if isinstance(field.dataType, StringType)}
    forced = {name: "sensitive" for name in df.columns if name in {*texts, *rules} and X.names_secret(name)}
    chosen = {name: action for name, action in {**rules, **forced}.items() if action != "unmask"}
    return df.withColumns({name: actions[action](F.col(name)) for name, action in chosen.items()})


def sensitive_fields(names: DataFrame, name: str = "name") -> DataFrame:
    """Adds `sensitive` to a table of field names."""
    return names.withColumn("sensitive", X.is_sensitive_name(F.col(name)))


ANCHOR = 8
ANCHORS = 100_000  # anchors looked for in one pass over a table


def leak_scan(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], secrets: DataFrame) -> DataFrame:
    """For every table and secret, the rows with the secret in any text column, and the rows with its masked form.

    `tables` gives each table with its text columns, `secrets` has `name` and `secret`. A secret is anchored at its first
    `ANCHOR` characters (all, if it has fewer). One pattern finds the places of a text where an anchor begins, character by
    character along the tree of all anchors. Only those pieces leave the row; they meet their secrets in a join, and only
    then is the text searched for the whole secret. So a text is gone through once however many secrets there are, in a time
    that grows with its length. Anchors are few characters each and are handed to the scan, `ANCHORS` to a pass.

    A masked form is a run of stars at least as long as the secret: the longest run of each row says it for all secrets.
    Secrets that are found nowhere are reported with zero; null and empty ones are found nowhere.
    """
    known = secrets.select("name", F.coalesce("secret", F.lit("")).alias("secret"))
    known = known.withColumn("anchor", F.substring("secret", 1, ANCHOR)).filter("anchor <> ''")
    anchors = sorted(row[0] for row in known.select("anchor").distinct().collect())
    found = None
    for name, (table, texts) in tables.items():
        rows = table.select(F.array(*[F.coalesce(text, F.lit("")) for text in texts]).alias("texts"))
        parts = [_with_secret(rows, known, anchors[at : at + ANCHORS]) for at in range(0, len(anchors), ANCHORS)]
        counts = _with_stars(rows, known)
        for part in parts:
            counts = counts.unionByName(part)
        counts = counts.groupBy("name").agg(F.sum("rows_with_secret").alias("rows_with_secret"), F.sum("rows_masked").alias("rows_masked"))
        zero = F.lit(0).cast("bigint")
        all_names = secrets.select("name").distinct().join(counts, "name", "left").select(
            F.lit(name).alias("table"),
            F.col("name").alias("secret"),
            F.coalesce("rows_with_secret", zero).alias("rows_with_secret"),
            F.coalesce("rows_masked", zero).alias("rows_masked"),
        )
        found = all_names if found is None else found.unionByName(all_names)
    return found


def _with_secret(rows: DataFrame, secrets: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """How many rows hold each of the secrets with these anchors."""
    sizes = F.array(*[F.lit(size) for size in sorted({len(anchor) for anchor in anchors})])
    pattern = F.lit(f"(?s)(?={_any_of(anchors)})(?=(.{{1,{ANCHOR}}}))")
    # What begins at each place where an anchor does: all anchors there are beginnings of it.
    begun = F.transform("texts", lambda text: F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(1))))
    pieces = F.flatten(F.transform(F.flatten(begun), lambda piece: F.transform(sizes, lambda size: F.substring(piece, F.lit(1), size))))
    hits = rows.select("texts", F.explode(F.array_distinct(pieces)).alias("anchor")).join(secrets, "anchor")
    hits = hits.filter(F.exists("texts", lambda text: F.contains(text, F.col("secret"))))
    return hits.groupBy("name").agg(F.count("*").alias("rows_with_secret"), F.lit(0).cast("bigint").alias("rows_masked"))


def _any_of(words: Sequence[str]) -> str:
    """A pattern for places where one of the words begins: their tree of characters, so common beginnings are tried once."""
    tree: dict = {}
    for word in sorted(words):  # one that continues another comes behind it, and is not needed
        node = tree
        for char in word:
            if char in node and not node[char]:
                break
            node = node.setdefault(char, {})

    def quoted(char: str) -> str:
        return f"\\{char}" if char.isascii() and not char.isalnum() else char

    def branch(node: dict) -> str:
        if len(node) == 1:
            return "".join(quoted(char) + branch(below) for char, below in node.items())
        ends = "".join(quoted(char) for char, below in node.items() if not below)
        ways = [quoted(char) + branch(below) for char, below in node.items() if below] + ([f"[{ends}]"] if ends else [])
        return f"(?:{'|'.join(ways)})" if ways else ""

    return f"(?=[{''.join(map(quoted, tree))}]){branch(tree)}"


def _with_stars(rows: DataFrame, secrets: DataFrame) -> DataFrame:
    """How many rows hold a run of stars as long as each secret."""
    runs = F.transform("texts", lambda text: F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(\*+)"), F.lit(1)), F.length)))
    longest = rows.select(F.coalesce(F.array_max(runs), F.lit(0)).alias("stars")).filter("stars > 0")
    # One row per length of a run and of a secret.
    most = secrets.agg(F.max(F.length("secret"))).first()[0] or 0
    by_length = longest.groupBy(F.least("stars", F.lit(most)).alias("stars")).agg(F.count("*").alias("n"))
    enough = by_length.select(F.explode(F.sequence(F.lit(1), "stars")).alias("size"), "n").groupBy("size").agg(F.sum("n").alias("n"))
    masked = secrets.withColumn("size", F.length("secret")).join(enough, "size")
    return masked.select("name", F.lit(0).cast("bigint").alias("rows_with_secret"), F.col("n").alias("rows_masked"))


def check_constraints(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule: the row's key and the rule's name. A rule that is null counts as kept."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()])
    )
    return df.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))


def erasure_sessions(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Session ids that the open requests cover: named ones, and all of a named visitor."""
    open_requests = requests.filter(F.col("status") != "COMPLETED")
    by_session = open_requests.filter("subject_type = 'SESSION'").select("tenant_id", F.col("subject_id").alias("id"))
    by_user = open_requests.filter("subject_type = 'END_USER'").select("tenant_id", F.col("subject_id").alias("end_user_id"))
    of_users = sessions.join(by_user, ["tenant_id", "end_user_id"], "left_semi").select("tenant_id", "id")
    return by_session.unionByName(of_users).distinct()


def erase(
    tables: Mapping[str, DataFrame], requests: DataFrame, session_column: Mapping[str, str] | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the erased sessions and visitors, and a progress table `table, erased`.

    `tables` needs `sessions` (key `id`); `end_users` (key `id`) is optional; all others hold `tenant_id` and a session
    id. While the erased ids are few the tables are filtered in place, without a shuffle.
    """
    columns = {"sessions": "id", **(session_column or {})}
    doomed = erasure_sessions(tables["sessions"], requests)
    users = requests.filter((F.col("status") != "COMPLETED") & (F.col("subject_type") == "END_USER")).select(
        "tenant_id", F.col("subject_id").alias("id")
    )
    users = users.distinct()
    kept, progress = {}, None
    for name, table in tables.items():
        column = columns.get(name, "session_id")
        if name == "end_users":
            targets, keys = users, ["tenant_id", "id"]
        else:
            targets, keys = doomed.withColumnRenamed("id", column), ["tenant_id", column]
        kept[name] = table.join(targets, keys, "left_anti")
        gone = table.join(targets, keys, "left_semi").agg(F.count("*").alias("erased"))
        line = gone.select(F.lit(name).alias("table"), "erased")
        progress = line if progress is None else progress.unionByName(line)
    return kept, progress


def illegal_transitions(review_events: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Status changes that are not allowed, or that do not start where the change before ended.

    Wants `tenant_id, session_id, id, from_status, to_status, created_at`.
    """
    legal = [f"{a}>{b}" for a, b in S.ANALYSIS_TRANSITIONS]
    step = F.concat(F.col("from_status"), F.lit(">"), F.col("to_status"))
    keys = ["tenant_id", "session_id"]
    marked = with_previous(review_events, keys, ["created_at", "id"], ["to_status"], width_ms)
    fault = F.when(~step.isin(legal), F.lit("illegal")).when(
        F.col("prev_to_status").isNotNull() & (F.col("prev_to_status") != F.col("from_status")), F.lit("broken_chain")
    )
    return marked.withColumn("fault", fault).filter("fault IS NOT NULL").drop("prev_to_status")


def review_history(review_events: DataFrame, tenant_id: str | None, session_id: str) -> DataFrame:
    """The reviews of a tenant's session, oldest first."""
    return lookup(review_events, tenant_id, session_id=session_id).orderBy("created_at", "id")


def redact_traits(end_users: DataFrame, hashed: Sequence[str] = ("email",)) -> DataFrame:
    """Traits named in `hashed` become SHA-256 digests; the others are redacted like free text."""

    def clean(name: Column, value: Column) -> Column:
        return F.when(name.isin(list(hashed)), F.sha2(value, 256)).otherwise(X.redact_text(value))

    return end_users.withColumn("traits", F.transform_values("traits", clean))
