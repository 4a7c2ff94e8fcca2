"""Conversation structure repair: costs-to-go over turns and grammar states, walked forward by the least tight edit."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinspark.llm.shared import cut_lineage, release

INFINITE = float("inf")
#: Grammar states of `(s?(ua)+)?`: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that an insertion or a new role has to have in each state, and the state after it.
WANTED = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
#: What it costs to delete, insert, give a new role, and keep a truncated row.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Cost-to-go after the last turn: what is still open is closed by insertions.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Rows that are given back together.
BATCH_ROWS = 8192
#: Symbols of turns: absent (a dropped row), one that must go, else the initial (s, u, a, another) and whether truncated.
ABSENT, MUST_GO, FIRST_SYMBOL = -1, 0, 1


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, gone) of `turns` after damage by the hash of conversation and turn.

    Of every 20 hashes one drops the row (which stays as a `gone` one, so that its conversation is
    known), one empties the text, one takes its sentence marks, one repeats the row, and one makes
    the role user.  Nulls are one space, in the hash as well; extra columns are not read.
    """
    space = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"), (F.col("code") == 0).alias("gone"))


@functools.cache
def _before(after: tuple[float, ...], symbol: int) -> tuple[tuple[float, ...], float, tuple[tuple[str, int], ...]]:
    """One step back: the cost-to-go before a turn, less its least value, that value, and each state's edits and next state.

    `after` is the cost-to-go behind the turn, also less its least value.  Such vectors are few, as
    no two states differ by more than some insertions, so that the steps are kept in a table.
    """
    taken = []
    for state in range(4):
        options = [(DELETE + after[state], "D", state)]
        if symbol != MUST_GO:
            initial, more = (symbol - FIRST_SYMBOL) // 2, (symbol - FIRST_SYMBOL) % 2 * TRUNCATED
            following = {0: SYSTEM if state == START else None, 1: USER if AFTER[state] == USER else None, 2: ASSISTANT if AFTER[state] == ASSISTANT else None}.get(initial)
            if following is not None:
                options.append((more + after[following], "K", following))
            options.append((REROLE + more + after[AFTER[state]], "R", AFTER[state]))
        taken.append(options)
    cost = [min(o)[0] for o in taken]
    for _ in range(4):  # insertions before the turn
        cost = [min(c, INSERT + cost[AFTER[s]]) for s, c in enumerate(cost)]
    edits = []
    for state in range(4):
        inserted = ""
        while cost[state] < INFINITE:
            tight = [(e, to) for c, e, to in taken[state] if c == cost[state]]
            if cost[state] == INSERT + cost[AFTER[state]]:
                tight.append(("I", AFTER[state]))
            edit, state = min(tight)
            inserted += edit
            if edit != "I":
                break
        edits.append((inserted, state))
    least = min(cost)
    return tuple(c - least for c in cost), least, tuple(edits)


def costs_to_go(symbols: list[int], after: tuple[float, ...]) -> tuple[float, ...]:
    """The cost-to-go of each state before the first of `symbols`."""
    base = min(after)
    now = tuple(c - base for c in after)
    for symbol in reversed(symbols):
        if symbol >= 0:
            now, least, _ = _before(now, symbol)
            base += least
    return tuple(c + base for c in now)


def edits_of(symbols: list[int], after: tuple[float, ...], state: int) -> tuple[list[str], int]:
    """The edits of each symbol on the least of the cheapest ways from `state`, and the state at the end."""
    base = min(after)
    now, tables = tuple(c - base for c in after), []
    for symbol in reversed(symbols):
        table = None
        if symbol >= 0:
            now, _, table = _before(now, symbol)
        tables.append(table)
    out = []
    for table in reversed(tables):
        edits, state = table[state] if table else ("", state)
        out.append(edits)
    return out, state


def _joined(product: tuple[tuple[float, ...], ...], after: tuple[float, ...]) -> tuple[float, ...]:
    """Costs before a run of turns from those after it: product[t][s] is the cost from state s before it to t after it."""
    return tuple(min(product[t][s] + after[t] for t in range(4)) for s in range(4))


def _runs(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, object, list[list]]]:
    """(partition, conversation, columns) for each run of rows of one conversation; a partition's runs are bounded by the partition."""
    part, conv, held = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, convs = batch.column("part").to_pylist(), batch.column("conv_id").to_pylist()
        values = [batch.column(c).to_pylist() for c in columns]
        start = 0
        for k in range(1, len(convs) + 1):
            if k < len(convs) and convs[k] == convs[start] and parts[k] == parts[start]:
                continue
            if held is not None and (part, conv) == (parts[start], convs[start]):
                for h, v in zip(held, values, strict=True):
                    h.extend(v[start:k])
            else:
                if held is not None:
                    yield part, conv, held
                part, conv, held = parts[start], convs[start], [v[start:k] for v in values]
            start = k
    if held is not None:
        yield part, conv, held
    release()


def _edges(runs: Iterator[tuple[int, object, list[list]]]) -> Iterator[tuple[int, object, list]]:
    """(partition, conversation, symbols) of a partition's first run and of its last."""
    part, last = None, None
    for p, conv, (symbols,) in runs:
        if p != part:
            if last:
                yield last
            part, last = p, None
            yield p, conv, symbols
        else:
            last = p, conv, symbols
    if last:
        yield last


def _split_runs(turns: DataFrame) -> dict[tuple[int, object], tuple[tuple[float, ...], int]]:
    """(costs behind it, state before it) of each run, by partition and conversation, that is not a whole conversation.

    Only the first and the last run of a partition can be such, so two rows a partition come to the
    driver: first the (min, +) products of their turns, whose composition gives the costs behind
    each run; then the state in which each run ends, for each that it may begin in.
    """
    conv = turns.select("conv_id").schema.fields
    shape = T.StructType([*conv, *T.StructType.fromDDL("part int, costs array<double>").fields])
    unit = [tuple(0.0 if s == t else INFINITE for s in range(4)) for t in range(4)]

    def edge_rows(batches: Iterable[pa.RecordBatch], found) -> Iterator[pa.RecordBatch]:
        types = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for batch in batches:
                types = pa.schema([batch.schema.field("conv_id"), ("part", pa.int32()), ("costs", pa.list_(pa.float64()))])
                yield batch

        for part, name, symbols in _edges(_runs(seen(), ["symbol"])):
            row = found(part, name, symbols)
            if row is not None:
                yield pa.RecordBatch.from_pylist([{"conv_id": name, "part": part, "costs": row}], schema=types)

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return edge_rows(batches, lambda part, name, symbols: [c for u in unit for c in costs_to_go(symbols, u)])

    chains: list[list] = []
    for edge in sorted(turns.mapInArrow(products, shape).collect(), key=lambda r: r["part"]):  # a stable sort: the first run of a partition stays first
        if chains and chains[-1][-1]["conv_id"] == edge["conv_id"]:
            chains[-1].append(edge)
        else:
            chains.append([edge])
    chains = [c for c in chains if len(c) > 1]
    behind = {}
    for chain in chains:
        after = tuple(map(float, AT_END))
        for edge in reversed(chain):
            behind[edge["part"], edge["conv_id"]] = after
            after = tuple(min(edge["costs"][4 * t + s] + after[t] for t in range(4)) for s in range(4))
    if not behind:
        return {}

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return edge_rows(batches, lambda part, name, symbols: [float(edits_of(symbols, behind[part, name], s)[1]) for s in range(4)] if (part, name) in behind else None)

    end = {(r["part"], r["conv_id"]): r["costs"] for r in turns.mapInArrow(ends, shape).collect()}
    out = {}
    for chain in chains:
        state = START
        for edge in chain:
            at = edge["part"], edge["conv_id"]
            out[at] = behind[at], state
            state = int(end[at][state])
    return out


def _edited(turns: DataFrame) -> DataFrame:
    """`turns` (sorted, with their partition, their place in it and their symbol) with each row's edits."""
    split, names = _split_runs(turns.select("conv_id", "part", "symbol")), turns.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([*batch.schema, ("edits", pa.string())])
                yield batch

        held: dict[str, list] = {c: [] for c in (*names, "edits")}
        for part, conv, columns in _runs(seen(), names):
            rows = dict(zip(names, columns, strict=True))
            after, state = split.get((part, conv), (AT_END, START))
            rows["edits"] = edits_of(rows["symbol"], after, state)[0]
            for c, values in rows.items():
                held[c].extend(values)
            if len(held["edits"]) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pydict(held, schema=schema)
                held = {c: [] for c in held}
        if held["edits"]:
            yield pa.RecordBatch.from_pydict(held, schema=schema)

    return turns.mapInArrow(run, T.StructType([*turns.schema.fields, T.StructField("edits", T.StringType())]))


def _initial(role: str) -> str:
    return role[:1]


class _Account:
    """What is told of one conversation, taken up turn by turn; of its text only a running hash is held."""

    def __init__(self) -> None:
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audit, self.state, self.hash, self.lines = [], START, hashlib.sha256(), 0
        self.least = self.most = None
        self.turns, self.before = 0, None

    def write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

    def insert(self) -> None:
        self.audit.append("I")
        self.count["cost"] += INSERT
        self.write(WANTED[self.state], "")

    def add(self, turn: int | None, role: str, fault: str, truncated: bool, n: int, edits: str, text: str | None) -> None:
        count = self.count
        if turn is not None and turn != self.most:  # in order, so a turn that is not the last one is new
            self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        initial = _initial(role)
        if self.before is not None:
            count["illegal"] += self.before + initial not in ("su", "ua", "au")
        count["illegal"] += n - 1
        self.before = initial
        for edit in edits:
            if edit == "I":
                self.insert()
                continue
            self.audit.append(edit)
            if edit == "D":
                count["cost"] += DELETE
            else:
                count["cost"] += (edit == "R") * REROLE + truncated * TRUNCATED
                self.write(WANTED[self.state] if edit == "R" else role, text or "")
        if fault in ("blank", "duplicate"):
            count[fault] += n
        else:
            count["truncated"] += truncated
            count["duplicate"] += n - 1
        self.audit.append("D" * (n - 1))
        count["cost"] += DELETE * (n - 1)

    def row(self) -> dict:
        while self.state in (SYSTEM, USER):
            self.insert()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"gaps": gaps, **self.count, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _faults(rows: DataFrame) -> DataFrame:
    """Distinct turns (conv_id, turn, role, text_key) with their number and first fault, dropped rows as one without a fault."""
    text, some = F.col("text"), r"[^\x20\x09-\x0D]"
    light = rows.select(
        "conv_id",
        F.when(~F.col("gone"), F.col("turn")).alias("turn"),
        F.when(F.col("gone"), "").otherwise(F.col("role")).alias("role"),
        F.when(F.col("gone"), "").otherwise(_text_key(text)).alias("text_key"),
        "gone",
        "copies",
        (~text.rlike(some)).alias("blank"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    ).withColumns({c: F.col(c) & ~F.col("gone") for c in ("blank", "truncated")})
    keys = ["conv_id", "turn", "role", "text_key", "gone", "blank", "truncated"]
    turns = cut_lineage(light.groupBy(*keys).agg(F.sum("copies").alias("n")))
    # Nulls first: a struct's fields compare so.
    first = turns.where("not gone and not blank").groupBy("conv_id", "role", "text_key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("several"))
    first = cut_lineage(first.where("several > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text_key").alias("k"), F.col("first.turn").alias("first"), F.lit(True).alias("seen")))
    same = turns["conv_id"].eqNullSafe(F.col("c")) & (turns["role"] == F.col("r")) & (turns["text_key"] == F.col("k"))
    joined = turns.hint("merge").join(first.hint("merge"), same, "left").drop("c", "r", "k")
    later = F.coalesce(F.col("seen"), F.lit(False)) & ~F.col("gone") & ~F.col("turn").eqNullSafe(F.col("first"))
    fault = F.when(F.col("gone"), "gone").when(F.col("blank"), "blank").when(later, "duplicate").otherwise("")
    return joined.select("conv_id", "turn", "role", "text_key", "n", fault.alias("fault"), "truncated")


def _text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, REPORT) of every conversation of `rows` (conv_id, turn, role, text, copies, gone).

    The turns of a conversation are taken by turn, nulls first, and where turns tie by role and by
    the SHA-256 of the text, so that repeated rows follow each other.  A turn's first fault counts:
    blank, duplicate (role and text seen before), truncated (the last character that is not blank
    is no sentence mark).  Blank and duplicate turns are deleted; others are kept, get the role of
    a user or an assistant, or are deleted; empty turns may be inserted, until the roles' initials
    are `(s?(ua)+)?`.  Of the cheapest ways the one whose edits are least in ASCII is taken.
    Conversations without rows have zeros, no edits and the hash of nothing; a null conv_id is a
    conversation; an empty table gives an empty one.  Texts are told apart by SHA-256.

    Only keys, faults and counts are sorted, by ranges of conversation and turn, so a large
    conversation lies in many partitions.  Each partition's turns give (min, +) products that say
    what every state costs; from these each run gets the costs behind it and the state before it,
    and walks forward by itself.  Texts then meet their edits, and each conversation's turns flow
    through one task, in order, into a running hash: nothing but the edits is held there.
    """
    turns = _faults(rows)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.col("fault") == "gone", ABSENT).when(F.col("fault") != "", MUST_GO).otherwise(FIRST_SYMBOL + 2 * kind + F.col("truncated").cast("int"))
    order = ["conv_id", "turn", "role", "text_key"]
    ranged = turns.withColumn("symbol", symbol).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    edited = _edited(ranged)
    texts = rows.where("not gone").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), _text_key(F.col("text")).alias("k"), "text")
    texts = texts.dropDuplicates(["c", "t", "r", "k"])
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("text_key") == F.col("k")) & F.col("edits").rlike("[KR]")
    told = edited.join(texts, same, "left").select("conv_id", "place", "turn", "role", "fault", "truncated", "n", "edits", "text")
    told = told.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    fields = rows.select("conv_id").schema.fields + T.StructType.fromDDL(REPORT).fields

    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of, schema = None, None, None
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), *((f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in REPORT.split(", "))])
            done = []
            for conv, turn, role, fault, truncated, n, edits, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault", "truncated", "n", "edits", "text")), strict=True):
                if now is None or conv != of:
                    if now is not None:
                        done.append({"conv_id": of, **now.row()})
                    now, of = _Account(), conv
                if fault != "gone":
                    now.add(turn, role, fault, truncated, n, edits, text)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": of, **now.row()}], schema=schema)
        release()

    return told.mapInArrow(report, T.StructType(fields))
