"""Conversation repair by weighted finite-state composition.

A conversation's rows are an input acceptor, a chain of symbols: the role's initial and whether the row must go or
is truncated. An edit transducer turns each into another (Keep, Rerole, Delete) or makes one of nothing (Insert), at a
cost; a grammar acceptor takes the role initials that a conversation may have, `(s?(ua)+)?`. Their composition is
made lazily, only the arcs out of states that are reached, and once for each symbol; its shortest path is over
weights (cost, label string), compared in that order. States are visited in reverse topological order, as
a label in front keeps the order of two strings, while one behind need not. Out of one state every label leads to
one arc at most, so of two paths of equal cost the lesser first label decides.

What a task keeps of a conversation is a byte a row and its edits. Rows come to it sorted, in batches; the texts pass
once more beside the finished edits, to make the repaired rows. Rows of a conversation that are equal in turn, role
and text are one row with a count from the start, and copies over turns are found by an aggregate and a join, so
neither is a hot key. A digest over a whole conversation in order is one task's work by its nature.

Order of rows: by turn, nulls first, then role, then the digest of the text. Defined cases: a null role, text, turn or conv_id counts
as one space where it is written, and rows without conv_id are one conversation; a row with a text of spaces is
blank; roles go by their first character as it is; very long conversations and texts pass in batches; no rows give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm.common import materialise, table

DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
TRUNCATED = 1
ROLES = {"u": "user", "a": "assistant"}
#: Grammar acceptor: state -> symbol -> next state; it may end in 0 and 3.
GRAMMAR: dict[int, dict[str, int]] = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
FAULTS = ["blank", "duplicate", "truncated"]
SPACES = " \t\n\x0b\x0c\r"


def edit_arcs(symbol: str | None) -> Iterator[tuple[str, str | None, int]]:
    """The edit transducer's arcs for an input symbol, or for no input: (label, output or none, cost).

    A symbol is an initial and a mark: `!` must go, `~` truncated, `.` neither.
    """
    if symbol is None:
        yield from ((INSERT, r, COST[INSERT]) for r in ROLES)
        return
    initial, mark = symbol[:-1], symbol[-1]
    yield DELETE, None, COST[DELETE]
    if mark != "!":
        more = TRUNCATED if mark == "~" else 0
        yield KEEP, initial, COST[KEEP] + more
        yield from ((REROLE, r, COST[REROLE] + more) for r in ROLES)


class Composed:
    """Input symbol by symbol, edit transducer and grammar; arcs out of a state are composed when first asked for."""

    def __init__(self) -> None:
        self._arcs: dict[tuple[str | None, int], list[tuple[int, str, int]]] = {}

    def arcs(self, symbol: str | None, state: int) -> list[tuple[int, str, int]]:
        """(cost, label, next grammar state), one a label."""
        if (symbol, state) not in self._arcs:
            self._arcs[symbol, state] = [(cost, label, state if made is None else GRAMMAR[state][made]) for label, made, cost in edit_arcs(symbol) if made is None or made in GRAMMAR[state]]
        return self._arcs[symbol, state]


class Path:
    """Shortest path of one conversation, symbols in order; `tables` are shared by all conversations of a task."""

    def __init__(self, composed: Composed, known: list[str], tables: dict):
        self.composed, self.known, self.tables, self.symbols = composed, known, tables, bytearray()

    def add(self, symbol: str, n: int = 1) -> None:
        if symbol not in self.known:
            self.known.append(symbol)  # four initials with three marks at most
        self.symbols += bytes([self.known.index(symbol)]) * n

    def solve(self) -> tuple[int, str]:
        """(cost, labels). Costs behind a row are kept relative to the least, so that long runs of rows meet few tables."""
        now, last, base = self._table(-1, ())
        seen = []
        for at in reversed(self.symbols):
            now, choice, low = self._table(at, now)
            base += low
            seen.append(choice)
        state, labels = 0, []
        for choice in [*reversed(seen), last]:
            moving = True
            while moving:
                label, state = choice[state]
                labels.append(label)
                moving = label == INSERT
        return base + now[0], "".join(labels)

    def _table(self, at: int, behind: tuple[int, ...]) -> tuple[tuple[int, ...], dict[int, tuple[str, int]], int]:
        """Relative costs before a row (before the end: -1) from those behind it, each state's choice (label, next state), and the least cost."""
        if (at, behind) not in self.tables:
            if at < 0:
                best = {s: (0, "", s) for s in FINAL}
            else:
                best = {s: min((cost + behind[to], label, to) for cost, label, to in self.composed.arcs(self.known[at], s)) for s in GRAMMAR}
            for _ in GRAMMAR:  # insertions before it, each costs, so no circle is ever better
                for s in GRAMMAR:
                    for cost, label, to in self.composed.arcs(None, s):
                        if to in best and (s not in best or (cost + best[to][0], label) < best[s][:2]):
                            best[s] = (cost + best[to][0], label, to)
            low = min(v[0] for v in best.values())
            self.tables[at, behind] = tuple(best[s][0] - low for s in GRAMMAR), {s: v[1:] for s, v in best.items()}, low
        return self.tables[at, behind]


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: conv_id, turn, role, text, n (1 or 2: how often the row stands there), of what is not dropped."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"), (kind == 0).alias("gone")).where("NOT gone").drop("gone")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, n) -> one row for all that are equal, with n, text_key, initial, `fault` of the first (or
    null) and `again`: how many of them are duplicates."""
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    own = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    small = rows.select("conv_id", "turn", "role", key.alias("text_key"), "n", own.alias("own"))
    one = small.groupBy("conv_id", "turn", "role", "text_key").agg(F.sum("n").alias("n"), F.first("own").alias("own"))
    # the place of each role and text within its conversation: its least turn, nulls first
    turn = F.struct(F.col("turn").isNotNull().cast("int").alias("known"), F.col("turn").alias("turn"))
    first = one.where(F.col("own").isNull() | (F.col("own") != "blank")).groupBy("conv_id", "role", "text_key").agg(F.min(turn).alias("first"))
    same = one["conv_id"].eqNullSafe(first["conv_id"]) & (one["role"] == first["role"]) & (one["text_key"] == first["text_key"])
    met = one.join(first, same, "left").select(one["*"], "first")
    late = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(turn)
    blank = F.col("own") == "blank"
    fault = F.when(blank, "blank").when(late, "duplicate").otherwise(F.col("own"))
    again = F.when(F.coalesce(blank, F.lit(False)), 0).when(late, F.col("n")).otherwise(F.col("n") - 1)
    return met.select("conv_id", "turn", "role", "text_key", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), again.cast("long").alias("again"))


_ORDER = ["conv_id", "turn", "role", "text_key"]
_AUDIT = "conv_id long, illegal long, cost long, audit string"


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> a row a conversation; rows that are equal stand as one with a count."""
    schema = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    composed, known, tables = Composed(), [], {}
    path, at, illegal, before, out = None, None, 0, "", []

    def ended() -> None:
        cost, labels = path.solve()
        out.append((at, illegal, cost, labels))

    for b in batches:
        for conv, initial, fault, n in zip(*[b.column(c).to_pylist() for c in ("conv_id", "initial", "fault", "n")], strict=True):
            if path is None or conv != at:
                if path is not None:
                    ended()
                path, at, illegal, before = Path(composed, known, tables), conv, 0, ""
            # initials that the grammar does not know are alike
            sort = initial if initial in ("s", "u", "a") else "x"
            if before:
                illegal += before + sort not in ("su", "ua", "au")
            illegal += (n - 1) * (sort + sort not in ("su", "ua", "au"))
            before = sort
            path.add(sort + ("!" if fault in ("blank", "duplicate") else "~" if fault == "truncated" else "."))
            path.add(sort + "!", n - 1)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if path is not None:
        ended()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def audits(faults: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit of what `with_faults` gives."""
    rows = faults.select(*_ORDER, "initial", "fault", F.col("n").cast("long"))
    return rows.repartition("conv_id").sortWithinPartitions(*_ORDER).select("conv_id", "initial", "fault", "n").mapInArrow(_audit, _AUDIT)


def _rows_of(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(label, role, text) of what stays, for an audit and its rows in order."""
    state = 0
    for label in audit:
        if label == INSERT:
            new, text = next(x for x in ROLES if x in GRAMMAR[state]), ""
            role = ROLES[new]
        else:
            role, text = next(rows)
            if label == DELETE:
                continue
            new = role[:1] if label == KEEP else next(x for x in ROLES if x in GRAMMAR[state])
            role = role if label == KEEP else ROLES[new]
        state = GRAMMAR[state][new]
        yield label, role, text


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, Iterator[tuple[str, str]]]]:
    """(conv_id, audit, rows) of partitions where each conversation's audit stands before its rows."""

    def flat() -> Iterator[tuple]:
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "n")], strict=True):
                yield row

    todo = flat()
    held: list[tuple] = [next(todo, None)]

    def of(conv: int | None) -> Iterator[tuple[str, str]]:
        while True:
            held[0] = next(todo, None)
            if held[0] is None or held[0][1] is not None:
                return
            for _ in range(held[0][4]):
                yield held[0][2], held[0][3]

    while held[0] is not None:
        conv, audit = held[0][:2]
        rows = of(conv)
        yield conv, audit, rows
        for _ in rows:  # what follows the last edit, none as a rule
            pass


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, partitions by conversation."""
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    lines = rows.select("conv_id", F.lit(1).alias("_kind"), "turn", "role", key.alias("text_key"), "text", F.lit(None).cast("string").alias("audit"), F.col("n").cast("int"))
    head = found.select("conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("text_key"), F.lit(None).cast("string").alias("text"), "audit", F.lit(1).alias("n"))
    both = head.unionByName(lines.withColumn("turn", F.col("turn").cast("long")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_kind", "turn", "role", "text_key").select("conv_id", "audit", "role", "text", "n")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    made = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    for conv, audit, rows in _streams(batches):
        h = hashlib.sha256()
        for i, (_, role, text) in enumerate(_rows_of(audit, rows)):
            h.update((("\n" if i else "") + f"{role}:{text}").encode())
        out.append((conv, h.hexdigest()))
        if len(out) >= 4096:
            yield made()
            out.clear()
    if out:
        yield made()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    out: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    for conv, audit, rows in _streams(batches):
        for i, (label, role, text) in enumerate(_rows_of(audit, rows)):
            out.append((conv, i, label, role, text))
            if len(out) >= 1024:
                yield made()
                out.clear()
    if out:
        yield made()


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit (I, K or R), role, text: the rows of each repaired conversation of rows(conv_id, turn, role, text)."""
    said = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("n"))
    return _with_audits(said, audits(with_faults(said))).mapInArrow(_repaired, "conv_id long, place long, edit string, role string, text string")


def report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of `original`: gaps, faults, illegal, cost, audit and the digest of its repaired `rows`."""
    faults = materialise(with_faults(rows), "faults")
    found = materialise(audits(faults), "audits")
    n = F.col("n").cast("long")
    first = [F.coalesce(F.sum(F.when(F.col("fault") == f, F.lit(1) if f == "truncated" else n)), F.lit(0)) for f in FAULTS]
    turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    # copies of a row that is no duplicate itself are
    again = F.coalesce(F.sum(F.when(F.coalesce(F.col("fault") != "duplicate", F.lit(True)), F.col("again"))), F.lit(0))
    counts = faults.groupBy("conv_id").agg(turns.alias("gaps"), first[0].cast("long").alias("blank"), (first[1] + again).cast("long").alias("duplicate"), first[2].cast("long").alias("truncated"))
    digests = _with_audits(rows, found).mapInArrow(_digest, "conv_id long, repaired_sha256 string")
    ids = original.select("conv_id").distinct().alias("o")
    out = ids
    for name, side in (("c", counts), ("f", found), ("d", digests)):
        out = out.join(side.alias(name), F.col("o.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("o.conv_id", *[zero(c) for c in ("gaps", *FAULTS, "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_fst_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return report(rows, damaged(rows))


QUERIES = {"op13_fst_repair": op13_fst_repair}
ORACLES: dict[str, str] = {}
