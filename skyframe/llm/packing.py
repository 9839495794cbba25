"""Packing documents into training sequences of several permitted lengths, by best fit.

Best-fit decreasing looks only at lengths, and lengths are small integers. So the packing is
planned from the number of pieces of each length, a table with as many rows as the longest
sequence has tokens, whatever the corpus: bins that hold the same are one entry with a count. The
plan is exactly what best-fit decreasing over all pieces would give. Pieces then find their places
by their rank among those of their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyframe.llm.tables import stored, with_row
from skyframe.llm.words import words_of

CAPACITIES = (1024, 2048, 4096)
# Pieces of one length that are ranked in one task.
RANKED = 500


@dataclass(frozen=True)
class Group:
    """`count` bins that hold the same. `holds` lists (length, pieces a bin, offset, rank of the
    first bin's first piece)."""

    count: int
    capacity: int
    used: int
    holds: tuple[tuple[int, int, int, int], ...]

    def part(self, begin: int, count: int) -> Group:
        """Some of these bins, from the one numbered `begin`."""
        return Group(count, self.capacity, self.used, tuple((s, n, at, rank + begin * n) for s, n, at, rank in self.holds))

    def with_pieces(self, length: int, each: int, rank: int) -> Group:
        return Group(self.count, self.capacity, self.used + each * length, (*self.holds, (length, each, self.used, rank)))


def _filled(counts: dict[int, int], capacities: tuple[int, ...], cost: Callable[[int], float]) -> list[Group]:
    """Best-fit decreasing: longest first, each into the open bin with the least room that does.

    Where none has room, the bin is opened whose cost for a token of such pieces is least; of
    equals, the largest, whose gaps later pieces fill best.
    """
    rooms: list[int] = []  # the rooms that open bins have, ascending
    by_room: dict[int, list[Group]] = defaultdict(list)

    def keep(group: Group) -> None:
        room = group.capacity - group.used
        if room not in by_room:
            insort(rooms, room)
        by_room[room].append(group)

    def place(group: Group, length: int, rank: int, left: int) -> int:
        """Puts pieces into a group, bin by bin, and keeps all its bins; the pieces placed."""
        each = (group.capacity - group.used) // length
        full = min(group.count, left // each)
        done = full * each
        if full:
            keep(group.part(0, full).with_pieces(length, each, rank))
        if full < group.count:
            more = left - done
            if more:
                keep(group.part(full, 1).with_pieces(length, more, rank + done))
                done += more
                full += 1
            if full < group.count:
                keep(group.part(full, group.count - full))
        return done

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                break
            groups = by_room.pop(rooms.pop(at))
            for number, group in enumerate(groups):
                if not left:
                    keep(group)
                    continue
                done = place(group, length, rank, left)
                rank, left = rank + done, left - done
        if left:
            capacity = min(
                (c for c in capacities if c >= length), key=lambda c: (cost(c) / (c // length * length), -c)
            )
            each = capacity // length
            place(Group(-(-left // each), capacity, 0, ()), length, rank, left)
    return [group for groups in by_room.values() for group in groups]


def plan_packing(
    counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = float
) -> list[Group]:
    """The cheapest packing over every choice of permitted lengths that takes the longest piece.

    At the end each bin gets the least permitted length that its contents need, and the cost is
    that of those. Ties go to fewer bins, then to the choice listed first.
    """
    longest = max(counts, default=0)
    best = None
    for size in range(1, len(capacities) + 1):
        for chosen in combinations(sorted(capacities), size):
            if chosen[-1] < longest:
                continue
            groups = [
                Group(g.count, min(c for c in capacities if c >= g.used), g.used, g.holds)
                for g in _filled(counts, chosen, cost)
            ]
            price = (sum(g.count * cost(g.capacity) for g in groups), sum(g.count for g in groups))
            if best is None or price < best[0]:
                best = (price, groups)
    if best is None:
        raise ValueError("no permitted length takes the longest piece")
    return best[1]


def _pieces(longest: int):
    """Of each text its pieces of `longest` tokens, and the rest: tokens, and where it stands in
    the text, in code points. Spaces before a word belong to its piece; the end is a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, tokens, begins, ends = [], [], [], [], []
            for at, value in enumerate(batch.column(1)):
                text = value.as_py() or b""
                words = words_of([text])
                n = len(words.starts) + 1
                letters = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                # A piece ends where its last word does, the last one where the text does.
                inner = words.ends[longest - 1 : n - 1 : longest] - 1
                cuts = [0, *letters[inner].tolist(), int(letters[-1]) if text else 0]
                for piece in range(len(cuts) - 1):
                    rows.append(at)
                    numbers.append(piece)
                    tokens.append(min(longest, n - piece * longest))
                    begins.append(cuts[piece])
                    ends.append(cuts[piece + 1])
            ints = [pa.array(column, pa.int64()) for column in (numbers, tokens, begins, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *ints], ["row", "piece", "n_tokens", "text_start", "text_end"]
            )

    return run


def pack(
    documents: DataFrame,
    text: str = "text",
    capacities: tuple[int, ...] = CAPACITIES,
    cost: Callable[[int], float] = float,
) -> DataFrame:
    """A place in a training sequence for every piece of every row of `documents`.

    Returns `row` (a struct of the columns but the text), `piece` (0 onwards), `n_tokens`,
    `text_start` and `text_end` (code points; the pieces of a text make it up, in order),
    `bin_id` (0 onwards), `bin_capacity` (a permitted length) and `bin_offset`. Pieces of a bin
    never overlap nor pass its capacity. A token is a word, or the end of a text: a null or empty
    text is one token. Texts longer than the largest capacity are cut into pieces of that, and a
    rest. Repeated rows are packed each. Pieces of equal length stand in no particular order. An
    empty table packs nothing.

    The driver holds one count a length, and the plan made of them: at most a few entries a length.
    Ranks are taken within parts of RANKED pieces, so a length that a third of all pieces have is
    many parts.
    """
    capacities = tuple(sorted(set(capacities)))
    longest = capacities[-1]
    columns = [F.col(f"`{name}`") for name in documents.columns if name != text]
    source = documents.select(F.struct(*columns).alias("row"), F.col(f"`{text}`").cast("binary").alias("text"))
    schema = with_row(source, "piece bigint, n_tokens bigint, text_start bigint, text_end bigint")
    pieces = source.mapInArrow(_pieces(longest), schema)
    pieces = stored(pieces.withColumn("__at", F.monotonically_increasing_id()), "pieces")

    counts = {row["n_tokens"]: row["count"] for row in pieces.groupBy("n_tokens").count().collect()}
    groups = plan_packing(counts, capacities, cost)
    first_bin, places = 0, []
    for group in groups:
        for length, each, offset, rank in group.holds:
            places.append((length, rank, each, offset, first_bin, group.capacity))
        first_bin += group.count
    places.sort()
    table = np.array(places, np.int64).reshape(-1, 6)
    # Lengths have at most so many ranks; together they sort as the places do.
    ranks = max(counts.values(), default=0) + 1
    keys = table[:, 0] * ranks + table[:, 1]

    spark = documents.sparkSession
    parts = spark.createDataFrame([(n, -(-count // RANKED)) for n, count in counts.items()], "n_tokens long, parts long")
    part = F.pmod(F.xxhash64("__at"), F.col("parts")).alias("part")
    dealt = pieces.join(F.broadcast(parts), "n_tokens").select("n_tokens", part, "__at", "row", "piece", "text_start", "text_end")
    sizes = dealt.groupBy("n_tokens", "part").count()
    before = F.sum("count").over(Window.partitionBy("n_tokens").orderBy("part")) - F.col("count")
    begins = stored(sizes.select("n_tokens", "part", before.alias("before")), "rank-parts")
    own = F.row_number().over(Window.partitionBy("n_tokens", "part").orderBy("__at"))
    ranked = dealt.withColumn("own", own - 1).join(begins, ["n_tokens", "part"])
    ranked = ranked.select("row", "piece", "n_tokens", "text_start", "text_end", (F.col("before") + F.col("own")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("n_tokens", "rank"))
            found = table[np.searchsorted(keys, length * ranks + rank, "right") - 1]
            nth = rank - found[:, 1]
            each = found[:, 2]
            own = [found[:, 4] + nth // each, found[:, 5], found[:, 3] + nth % each * length]
            names = ["row", "piece", "n_tokens", "text_start", "text_end"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), *map(pa.array, own)], [*names, "bin_id", "bin_capacity", "bin_offset"]
            )

    more = "piece bigint, n_tokens bigint, text_start bigint, text_end bigint, bin_id bigint, bin_capacity bigint, bin_offset bigint"
    return ranked.mapInArrow(run, with_row(source, more))
