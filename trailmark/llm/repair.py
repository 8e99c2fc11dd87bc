"""Repair of the turn structure of conversations by weighted CYK parsing.

A conversation is sound if the initials of its roles read `(s?(ua)+)?` and no row has a fault. Faults, the first that
applies: blank (no character other than white space), duplicate (role and text of an earlier row), truncated (the last
such character is not one of `.!?`). Edits and costs: keep a row (0), rerole it to user or assistant (3), delete it (4;
a must for blank and duplicate rows), insert an empty user or assistant row anywhere (3); a truncated row that stays adds 3.

The grammar in Chomsky normal form has a nonterminal for each way in which repaired rows of a span can begin and end:
nothing, a system row alone, and alternating rows from u or a to u or a, the former with or without a system row ahead. Its
binary rules join two neighbours where the first one's end and the second one's beginning differ. A cell holds, for each
nonterminal, the least cost, and for each length of the audit at that cost the ASCII-least audit (the initials of the edits:
D, I, K, R). One audit for each cell would not do: of a shorter and a longer one, which is less can hang on what follows.
Every cell is closed under insertion: rows inserted at either side, until nothing gets cheaper.

Charts are filled bottom-up by the length of the span, over at most `SPAN` cells. A longer conversation is parsed in levels:
the root cells of its charts are the leaves of further charts. As a nonterminal says all that a neighbour needs to know, any
split of a span gives the same cell, so levels change no result, and the work grows with the rows, not with their cube.

How it is spread. A conversation may hold any share of all rows. Rows are range-partitioned by conversation and place, so a
long one is cut into slices; each slice is parsed where it lies into one root cell and its counts, and a conversation is
joined from one row per slice. Texts do not travel for this. The repaired rows need the texts in order beside the audit:
they stream through the task of their conversation batch by batch, and nothing but the audit is held. A digest over a whole
conversation is one chain by its nature, so for that the rows of one conversation do meet in one task.

Ties and odd rows. Rows go by turn, null first; rows of one turn by role and a digest of role and text, so that repeated
rows are neighbours. Null roles and texts count as one space. A null conversation id is a conversation like others. A
conversation that has lost all its rows has zeros, an empty audit and no repaired rows. Other columns are not looked at.
"""

import hashlib
from collections import OrderedDict
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import once_per_worker
from trailmark.session import written

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPAN = 8
KEPT_CHARTS = 50_000

# Nonterminals: first and last initial of the rows that stay, behind "s" if a system row is ahead.
NAMES = ["", "s", "uu", "ua", "au", "aa", "suu", "sua"]
EMPTY, SYSTEM, ASSISTANT_END = 0, 1, (0, 3, 7)
WORD = "[^\\x20\\x09-\\x0D]"
LAST = "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*+\\z"


def joined(left: str, right: str) -> str | None:
    """The nonterminal of two neighbours, if they may be neighbours."""
    if not left or not right:
        return left + right
    if right.startswith("s") or left[-1] == right[0] or left + right[0] == "sa":
        return None
    return left[:-1] + right[-1] if left != "s" else "s" + right


RULES = [
    (x, y, NAMES.index(joined(left, right))) for x, left in enumerate(NAMES) for y, right in enumerate(NAMES) if joined(left, right) is not None
]

Cell = list  # for each nonterminal None or (cost, {length of the audit: least audit})


def better(one, other):
    """The cheaper of two entries; of equal ones the least audit of each length."""
    if one is None or (other is not None and other[0] < one[0]):
        return other
    if other is None or one[0] < other[0]:
        return one
    audits = dict(one[1])
    for size, audit in other[1].items():
        if size not in audits or audit < audits[size]:
            audits[size] = audit
    return one[0], audits


def combine(left: Cell, right: Cell) -> Cell:
    out: Cell = [None] * len(NAMES)
    for x, y, name in RULES:
        one, other = left[x], right[y]
        if one is not None and other is not None:
            cost, known = one[0] + other[0], out[name]
            if known is None or cost <= known[0]:
                audits = {}
                for first in one[1].values():
                    for second in other[1].values():
                        audit = first + second
                        if len(audit) not in audits or audit < audits[len(audit)]:
                            audits[len(audit)] = audit
                out[name] = better(known, (cost, audits))
    return out


def either(one: Cell, other: Cell) -> Cell:
    return [better(a, b) for a, b in zip(one, other, strict=True)]


def inserted() -> Cell:
    cell: Cell = [None] * len(NAMES)
    for name in ("uu", "aa"):
        cell[NAMES.index(name)] = (INSERT, {1: "I"})
    return cell


INSERTED = inserted()


def closed(cell: Cell) -> Cell:
    """With rows inserted at either side wherever that makes a nonterminal possible, cheaper or its audit less."""
    while True:
        wider = either(cell, either(combine(INSERTED, cell), combine(cell, INSERTED)))
        if wider == cell:
            return cell
        cell = wider


def leaf(symbol: str) -> Cell:
    """The cell of one row: its role's initial, or ``-`` if it must go; upper case if it is truncated."""
    cell: Cell = [None] * len(NAMES)
    cell[EMPTY] = (DELETE, {1: "D"})
    if symbol != "-":
        cost = TRUNCATED * symbol.isupper()
        for name in ("uu", "aa"):
            cell[NAMES.index(name)] = (cost + REROLE, {1: "R"})
        kept = {"s": "s", "u": "uu", "a": "aa"}.get(symbol.lower())
        if kept:
            name = NAMES.index(kept)
            cell[name] = better(cell[name], (cost, {1: "K"}))
    return closed(cell)


NOTHING = closed([(0, {0: ""}), *[None] * (len(NAMES) - 1)])


def chart(cells: list[Cell]) -> Cell:
    """The root cell of a CYK chart over neighbouring cells."""
    spans = {(at, at + 1): cell for at, cell in enumerate(cells)}
    for size in range(2, len(cells) + 1):
        for start in range(len(cells) - size + 1):
            stop = start + size
            cell: Cell = [None] * len(NAMES)
            for split in range(start + 1, stop):
                cell = either(cell, combine(spans[start, split], spans[split, stop]))
            spans[start, stop] = closed(cell)
    return spans[0, len(cells)]


def parse(cells: list[Cell]) -> Cell:
    while len(cells) > 1:
        cells = [chart(cells[at : at + SPAN]) for at in range(0, len(cells), SPAN)]
    return cells[0] if cells else NOTHING


def symbol_cell(symbols: str) -> Cell:
    """The root cell of at most `SPAN` rows; most conversations repeat a few patterns, so recent ones are remembered."""
    known = once_per_worker("charts of repair", OrderedDict)
    if symbols not in known:
        known[symbols] = chart([leaf(symbol) for symbol in symbols])
        if len(known) > KEPT_CHARTS:
            known.popitem(last=False)
    return known[symbols]


def best(cell: Cell) -> tuple[int, str]:
    """Least cost and least audit of a whole conversation."""
    return min((cell[name][0], min(cell[name][1].values())) for name in ASSISTANT_END if cell[name] is not None)


# What a slice of a conversation says of itself. Cells are one text per nonterminal: cost and audits, one behind the other.
COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint"
SLICES = f"conv_id {{}}, part int, rows bigint, first_turn bigint, last_turn bigint, first_role string, last_role string, {COUNTS}, cells array<string>"
PARSES = "conv_id {}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
LEGAL = ("su", "ua", "au")


def packed(cell: Cell) -> list:
    return [None if entry is None else " ".join([str(entry[0]), *entry[1].values()]) for entry in cell]


def unpacked(texts: list) -> Cell:
    out: Cell = []
    for text in texts:
        cost, *audits = (text or "").split(" ")
        out.append(None if text is None else (int(cost), {len(audit): audit for audit in audits}))
    return out


def rows_of(batches, names):
    """Rows of Arrow batches as tuples, few of them as Python objects at a time."""
    for batch in batches:
        for start in range(0, len(batch), 1024):
            part = batch.slice(start, 1024)
            yield from zip(*(part.column(name).to_pylist() for name in names), strict=True)


def batches_of(rows, schema: pa.Schema, most: int = 1024):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def slice_of(conv, part, rows) -> tuple:
    """Counts and root cell of neighbouring rows (turn, role initial, symbol) of a conversation."""
    count = dict.fromkeys("bdt", 0)
    number = illegal = turns = 0
    first_turn = last_turn = first_role = last_role = None
    levels: list[list[Cell]] = [[]]
    held = ""

    def push(cell: Cell) -> None:
        at = 0
        levels[0].append(cell)
        while len(levels[at]) == SPAN:  # a full level is one cell of the next
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(chart(levels[at]))
            levels[at] = []
            at += 1

    for turn, role, fault, symbol in rows:
        if number:
            illegal += last_role + role not in LEGAL
        else:
            first_role = role
        if turn is not None and turn != last_turn:
            first_turn, last_turn, turns = turn if first_turn is None else first_turn, turn, turns + 1
        last_role, number = role, number + 1
        if fault:
            count[fault] += 1
        held += symbol
        if len(held) == SPAN:
            push(symbol_cell(held))
            held = ""
    cells = [cell for level in reversed(levels) for cell in level] + ([symbol_cell(held)] if held else [])
    root = packed(parse(cells))
    return conv, part, number, first_turn, last_turn, first_role, last_role, count["b"], count["d"], count["t"], illegal, turns, root


def whole_of(conv, slices: list) -> tuple:
    """The row of a conversation from its slices in order, each as `slice_of` made it."""
    slices = [one for one in slices if one[2]]
    blank, duplicate, truncated, illegal, turns = (sum(one[at] for one in slices) for at in range(7, 12))
    with_turn = [one for one in slices if one[3] is not None]
    illegal += sum(one[6] + other[5] not in LEGAL for one, other in zip(slices, slices[1:], strict=False))
    turns -= sum(one[4] == other[3] for one, other in zip(with_turn, with_turn[1:], strict=False))
    gaps = with_turn[-1][4] - with_turn[0][3] + 1 - turns if with_turn else 0
    cost, audit = best(parse([unpacked(one[12]) for one in slices]))
    return conv, gaps, blank, duplicate, truncated, illegal, cost, audit


def ordered(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (id, conv_id, turn, role, text, key) in a written table. A row whose text and role are dropped as a whole has
    `there` false and says only that the conversation exists."""
    there = F.col("there") if "there" in conversations.columns else F.lit(True)
    space = F.lit(" ")
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        there.alias("there"),
    )
    key = F.sha2(F.concat(F.length("role").cast("string"), space, "role", "text"), 256)
    rows = rows.withColumn("key", key).withColumn("id", F.monotonically_increasing_id())
    return written(rows, "conversations")


def symbols(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, key, id, initial, fault, symbol) without texts."""
    place = F.struct("turn", "id")
    firsts = rows.where("there").groupBy("conv_id", "key").agg(F.min(place).alias("first")).select(F.col("first.id").alias("id"), F.lit(True).alias("first"))
    blank = ~F.col("text").rlike(WORD)
    open_end = ~F.regexp_extract("text", LAST, 1).isin(".", "!", "?")
    said = rows.select("conv_id", "turn", "role", "key", "id", "there", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), open_end.alias("open"))
    marked = said.join(firsts, "id", "left")
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("open"), "t")
    # Other initials than s, u and a are alike, and none of them is to look like a truncated or lost row.
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    symbol = F.when(F.col("fault").isin("b", "d"), "-").when(F.col("fault") == "t", F.upper(known)).otherwise(known)
    return marked.withColumn("fault", fault).withColumn("symbol", symbol).drop("blank", "open", "first")


def parses(rows: DataFrame) -> DataFrame:
    """One row per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of `ordered` rows."""
    kind = dict(rows.dtypes)["conv_id"]
    slices, whole = SLICES.format(kind), PARSES.format(kind)
    place = ["conv_id", "turn", "role", "key", "id"]
    marked = written(symbols(rows), "symbols").repartitionByRange(*place).sortWithinPartitions(*place)
    spark = rows.sparkSession
    slices_as, whole_as = (arrow_schema(spark, ddl) for ddl in (slices, whole))

    def sliced(batches):
        part = TaskContext.get().partitionId()
        found = rows_of(batches, ["conv_id", "turn", "initial", "fault", "symbol", "there"])
        made = (slice_of(conv, part, (row[1:5] for row in own if row[5])) for conv, own in groupby(found, lambda row: row[0]))
        yield from batches_of(made, slices_as)

    def joined_up(batches):
        found = rows_of(batches, slices_as.names)
        made = (whole_of(conv, list(own)) for conv, own in groupby(found, lambda row: row[0]))
        yield from batches_of(made, whole_as)

    of_parts = marked.mapInArrow(sliced, slices).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return of_parts.mapInArrow(joined_up, whole)


def arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def repaired_rows(audit: str, rows):
    """Rows (role, text, edit) that a conversation is left with, from its audit and its rows (role, text) in order."""
    rows, number = iter(rows), None
    for edit in audit:
        role, text = next(rows) if edit != "I" else (None, "")
        if edit == "D":
            continue
        if number is None:  # a system row ahead is not counted
            if edit == "K" and role[:1] == "s":
                yield role, text, edit
                number = 0
                continue
            number = 0
        if edit != "K":
            role = ("user", "assistant")[number % 2]
        number += 1
        yield role, text, edit


def beside(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows in order, the parse of their conversation ahead of them, so that both stream through one task."""
    heads = parsed.withColumn("head", F.lit(True))
    tails = rows.where("there").select("conv_id", "turn", "role", "key", "id", "text", F.lit(False).alias("head"))
    both = heads.unionByName(tails, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.desc("head"), "turn", "role", "key", "id")


def by_conversation(batches, names):
    """(parse, repaired rows) of each conversation; the latter are to be taken before the next one."""
    found = rows_of(batches, ["conv_id", *names, "role", "text"])
    for _, own in groupby(found, lambda row: row[0]):
        head = next(own)
        yield head[:-2], repaired_rows(head[names.index("audit") + 1], (row[-2:] for row in own))


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations as rows (conv_id, place, role, text, edit)."""
    rows = ordered(conversations, conv, turn, role, text)
    ddl = f"conv_id {dict(rows.dtypes)['conv_id']}, place bigint, role string, text string, edit string"
    schema = arrow_schema(rows.sparkSession, ddl)

    def listed(batches):
        made = ((head[0], place, *row) for head, own in by_conversation(batches, ["audit"]) for place, row in enumerate(own))
        yield from batches_of(made, schema, 256)

    return beside(rows, parses(rows)).mapInArrow(listed, ddl)


def repair_digests(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The parse of each conversation and the SHA-256 of its repaired rows as lines `role:text`."""
    rows = ordered(conversations, conv, turn, role, text)
    ddl = PARSES.format(dict(rows.dtypes)["conv_id"]) + ", repaired_sha256 string"
    schema = arrow_schema(rows.sparkSession, ddl)

    def hashed(head, own):
        digest = hashlib.sha256()
        for place, (role, text, _) in enumerate(own):
            digest.update(("\n" * (place > 0) + f"{role}:{text}").encode())
        return *head, digest.hexdigest()

    def digests(batches):
        yield from batches_of((hashed(head, own) for head, own in by_conversation(batches, schema.names[1:-1])), schema)

    return beside(rows, parses(rows)).mapInArrow(digests, ddl)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, there) of conversations with faults that follow from a checksum of id and turn."""
    space = F.lit(" ")

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), space)

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    role = F.when(kind == 4, "user").otherwise(plain("role"))
    copies = F.when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(kind != 0))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("there"))
