"""Repairing conversations: the cheapest edits after which the roles alternate and no row is faulty.

The edits of a conversation are a path through a lattice of (rows read, last role written), whose
arcs are the edits and have whole costs. The path is found by Bertsekas' auction algorithm: every
node has a price, never above what the way from it to the end costs; a path grows from its origin
along the arc that is best at the prices, and where none is as good as the price of its last node,
that price rises and the path loses the node. The prices that it leaves behind are exact along the
path, and an arc whose cost is the difference of two exact prices is on a cheapest way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.llm.tables import SPACES, scratch, stored

# What an edit costs, and what a truncated row that is not deleted adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# Faults of a row, in the order in which the first one counts; and what a role can begin with.
SOUND, CUT, BLANK, DUPLICATE = range(4)
_INITIALS = "sua"
# The last role written: none, system, user, assistant.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
# Rows whose prices settle before those of the rows in front of them are looked at.
_SETTLED_AT_ONCE = 16
# Rows of a piece of a conversation, as a power of two.
PIECE_BITS = 10


def _next(state: int) -> int:
    """The role that an insertion or a change of role writes."""
    return _ASSISTANT if state == _USER else _USER


def _written(state: int, initial: int) -> int | None:
    """The last role after a row with that initial is kept, or None where it may not follow."""
    if initial == 0:
        return _SYSTEM if state == _NONE else None
    if initial == 1:
        return _USER if state != _USER else None
    return _ASSISTANT if initial == 2 and state == _USER else None


def _arcs() -> list[list[list[tuple[str, int, int, int]]]]:
    """By symbol of a row and last role: edits by letter, as (letter, cost, rows read, last role)."""
    table = []
    for symbol in range(16):
        initial, fault = symbol & 3, symbol >> 2
        extra = TRUNCATED if fault == CUT else 0
        by_state = []
        for state in range(4):
            arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, _next(state))]
            if fault in (SOUND, CUT):
                kept = _written(state, initial)
                if kept is not None:
                    arcs.append(("K", extra, 1, kept))
                arcs.append(("R", REROLE + extra, 1, _next(state)))
            by_state.append(arcs)
        table.append(by_state)
    return table


_ARCS = _arcs()
_ENDING = [[("I", INSERT, 0, _next(state))] for state in range(4)]


class _Lattice:
    """Prices of the nodes of one conversation, whose rows are bytes: a role's initial and a fault."""

    def __init__(self, rows: bytes):
        self.rows = rows
        self.price = [0] * (4 * len(rows) + 4)
        self.exact = bytearray(len(self.price))
        for state in (_NONE, _ASSISTANT):
            self.exact[4 * len(rows) + state] = 1

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        row, state = node >> 2, node & 3
        found = _ARCS[self.rows[row]][state] if row < len(self.rows) else _ENDING[state]
        return [(letter, cost, ((row + read) << 2) + after) for letter, cost, read, after in found]

    def settle(self, origin: int) -> int:
        """The exact price of a node: the path from it is extended and contracted until it meets a
        node whose price is exact; then the prices of all its nodes are."""
        price, exact, path = self.price, self.exact, [origin]
        while not exact[path[-1]]:
            end = path[-1]
            best, to = min((cost + price[node], node) for _, cost, node in self.arcs(end))
            if price[end] < best:
                price[end] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            exact[node] = 1
        return price[origin]

    def solve(self) -> tuple[int, str, list[int]]:
        """The least cost, the ASCII-least of the cheapest paths as letters, and the last role
        written before each letter.

        Rows far from the end start at the least exact price behind them, which no way undercuts,
        so that prices rise only by what a few rows cost.
        """
        last = len(self.rows)
        settled = last
        while settled > 0:
            first = max(0, settled - _SETTLED_AT_ONCE)
            floor = min(self.settle((settled << 2) + state) for state in range(4))
            self.price[first << 2 : settled << 2] = [floor] * ((settled - first) << 2)
            settled = first
        node, letters, states = _NONE, [], []
        total = self.settle(node)
        while not (node >> 2 == last and node & 3 in (_NONE, _ASSISTANT)):
            for letter, cost, to in self.arcs(node):
                if self.price[node] == cost + self.price[to] and self.price[node] == cost + self.settle(to):
                    letters.append(letter)
                    states.append(node & 3)
                    node = to
                    break
        return total, "".join(letters), states


def _lawful(before: int, after: int) -> bool:
    """Whether two adjacent roles may begin so: su, ua or au."""
    return (before, after) in ((0, 1), (1, 2), (2, 1))


def _said() -> Column:
    """A role and a text in 128 bits."""
    return F.md5(F.concat(F.char_length("role"), F.lit(":"), "role", "text").cast("binary"))


def _same(one: str, other: str) -> Column:
    return F.col(one).eqNullSafe(F.col(other))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows (`conv`, `turn`, `role`, `text`) with their faults and their place: stored, one for all
    copies of a row, with `copies` and with `symbols`, a letter for each copy.

    `place` grows by conversation and in it by turn (nulls first), role and text. Copies are counted
    before anything moves; a row's first fault is blank, a duplicate of an earlier one, cut short.
    Sorted by range, so that a very long conversation is spread over tasks.
    """
    rows = rows.select("conv", "turn", *[F.coalesce(F.col(name), F.lit(" ")).alias(name) for name in ("role", "text")])
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    bare = F.rtrim(F.translate("text", SPACES[1:], " " * (len(SPACES) - 1)))
    rows = rows.select("*", F.right(bare, F.lit(1)).alias("last"), _said().alias("said"))
    rows = stored(rows, "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("first"))
    spoken = rows.where("last <> ''").groupBy(F.col("conv").alias("c"), F.col("said").alias("s")).agg(F.min(when).alias("f"))
    spoken = spoken.select("c", "s", "f.first")
    found = rows.join(spoken, _same("conv", "c") & (F.col("said") == F.col("s")) & _same("turn", "first"), "left")
    initial = F.instr(F.lit(_INITIALS), F.left("role", F.lit(1)))
    initial = F.when((F.length("role") > 0) & (initial > 0), initial - 1).otherwise(3)
    sound = F.when(F.instr(F.lit(".!?"), F.col("last")) > 0, SOUND).otherwise(CUT)
    fault = F.when(F.col("last") == "", BLANK).when(F.col("s").isNull(), DUPLICATE).otherwise(sound)
    again = F.when(F.col("last") == "", BLANK).otherwise(DUPLICATE)
    letter = lambda fault: F.substring(F.lit(_LETTERS), initial + 4 * fault + 1, F.lit(1))
    symbols = F.concat(letter(fault), F.repeat(letter(again), (F.col("copies") - 1).cast("int")))
    found = found.select("conv", "turn", "role", "text", symbols.alias("symbols"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    found = found.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(found.withColumn("place", F.monotonically_increasing_id()), "ordered-turns")


_LETTERS = "abcdefghijklmnop"
_FIRST = ord(_LETTERS[0])


def pieces_of(ordered: DataFrame) -> DataFrame:
    """Up to 2**PIECE_BITS consecutive rows of a conversation in one: `piece` says which, `rows` are
    they in order, `symbols` theirs together, `low`, `high` and `turns` the turns among them."""
    piece = F.shiftrightunsigned("place", PIECE_BITS).alias("piece")
    one = F.struct("place", "turn", "role", "text", "symbols")
    gathered = ordered.groupBy("conv", piece).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    known = F.array_compact(F.array_distinct("rows.turn"))
    return gathered.select(
        "conv", "piece", "rows", F.array_join("rows.symbols", "").alias("symbols"),
        F.array_min(known).alias("low"), F.array_max(known).alias("high"), F.size(known).cast("bigint").alias("turns"),
    )


_PLAN = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "parts array<struct<piece:bigint,letters:string,state:int>>"
)


def planned(pieces: DataFrame) -> DataFrame:
    """One row a conversation: `conv`, its faults by kind, `illegal` adjacent roles, `gaps` between
    turns, the least `cost`, the edits as `audit`, and `parts` of that by piece.

    What is gathered for a conversation is a letter a row, as much as its audit is.
    """
    one = F.struct("piece", "symbols", "low", "high", "turns")
    source = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(one)).alias("pieces"))
    # A letter is little to move and much to compute, so tasks are not joined by their bytes.
    source = source.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv")

    def plan(found: list[dict]) -> tuple:
        rows = bytes(letter - _FIRST for piece in found for letter in piece["symbols"].encode())
        cost, audit, states = _Lattice(rows).solve()
        known = [piece for piece in found if piece["turns"]]
        distinct = sum(piece["turns"] for piece in known)
        distinct -= sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)
        faults = [row >> 2 for row in rows]
        illegal = sum(not _lawful(a & 3, b & 3) for a, b in zip(rows, rows[1:]))
        parts, at = [], 0
        for k, piece in enumerate(found):
            begin, left = at, len(piece["symbols"])
            while at < len(audit) and (left > 0 or k == len(found) - 1):
                left -= audit[at] != "I"
                at += 1
            state = states[begin] if begin < len(states) else _NONE
            parts.append({"piece": piece["piece"], "letters": audit[begin:at], "state": state})
        return gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, cost, audit, parts

    schema = T.StructType([source.schema["conv"], *T.StructType.fromDDL(_PLAN).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.struct([("piece", pa.int64()), ("letters", pa.string()), ("state", pa.int32())]))]
        for batch in batches:
            found = [plan(value.as_py()) for value in batch.column(1)]
            columns = [pa.array(column, type_) for column, type_ in zip(zip(*found) if found else [[]] * 8, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return source.mapInArrow(run, schema)


def repaired_pieces(pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired conversations: by `conv` and `piece` the `turns` that are left, in order, as
    (role, text)."""
    parts = plan.select(F.col("conv").alias("c"), F.explode("parts").alias("part")).select("c", "part.*")
    source = pieces.select("conv", "piece", "rows").join(
        parts.withColumnRenamed("piece", "p"), (F.col("piece") == F.col("p")) & _same("conv", "c")
    )
    rows = F.transform("rows", lambda r: F.struct(r["role"], r["text"], F.length(r["symbols"]).alias("n")))
    source = source.select("conv", "piece", "letters", "state", rows.alias("rows"))

    def repair(letters: str, state: int, rows: list[dict]) -> list[dict]:
        out, at, used = [], 0, 0
        for letter in letters:
            if letter == "I":
                state = _next(state)
                out.append({"role": _ROLES[state], "text": ""})
                continue
            row = rows[at]
            if letter == "K":
                state = _written(state, _INITIALS.index(row["role"][0]))
                out.append({"role": row["role"], "text": row["text"]})
            elif letter == "R":
                state = _next(state)
                out.append({"role": _ROLES[state], "text": row["text"]})
            used += 1
            if used == row["n"]:
                at, used = at + 1, 0
        return out

    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    schema = T.StructType(
        [source.schema["conv"], source.schema["piece"], *T.StructType.fromDDL("turns array<struct<role:string,text:string>>").fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repair(*(batch.column(k)[i].as_py() for k in (2, 3, 4))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, turns)], schema.names)

    return source.mapInArrow(run, schema)


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The edits of every conversation, as `planned` gives them, and the repaired turns, as
    `repaired_pieces` does; both stored.

    Rows of a conversation are read by turn (nulls first), then role and text, which ties of turn go
    by. A null role or text is one space; a null id is a conversation like any other. A row is blank
    without a character other than space and 0x09 to 0x0D, else a duplicate if its role and text
    stood earlier, else cut if its last such character is none of `.!?`. Edits in order: K keeps a
    row, R makes it user or assistant (cost 1), D deletes it (2, and required for the blank and the
    duplicate), I puts in an empty one (5); a cut row that stays costs 5 more. What is left has the
    initials `(s?(ua)+)?`. Of the cheapest lists of edits the ASCII-least is taken. A conversation
    without rows is not there, an empty table gives empty ones, other columns are not looked at.

    Rows are sorted by range and cut into pieces; what meets in one place of a whole conversation is
    a letter for each of its rows, its audit being as long. Gaps past 64 bits wrap.
    """
    named = [F.col(f"`{name}`").alias(to) for name, to in ((conv, "conv"), (turn, "turn"), (role, "role"), (text, "text"))]
    with scratch():
        pieces = pieces_of(ordered_rows(rows.select(*named)))
        plan = stored(planned(pieces.drop("rows")), "edits", keep=True)
        return plan, stored(repaired_pieces(pieces, plan), "repaired", keep=True)


def written_digest(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of the turns as `role:text`, joined by newlines.

    Pieces are read in order and hashed as they pass, so that no conversation is held in memory.
    """
    source = repaired.select("conv", "piece", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])).alias("lines"))
    source = source.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "piece")
    schema = T.StructType([source.schema["conv"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        own, digest, some, first = None, None, False, True
        kind = None
        for batch in batches:
            kind, ready = batch.schema.field(0).type, []
            for i in range(batch.num_rows):
                conv, lines = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if first or conv != own:
                    if not first:
                        ready.append((own, digest.hexdigest()))
                    own, digest, some, first = conv, hashlib.sha256(), False, False
                for line in lines:
                    digest.update((("\n" if some else "") + line).encode())
                    some = True
            yield _digests(ready, kind, schema.names)
        if not first:
            yield _digests([(own, digest.hexdigest())], kind, schema.names)

    return source.mapInArrow(run, schema)


def _digests(ready: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([row[0] for row in ready], kind), pa.array([row[1] for row in ready], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names)
