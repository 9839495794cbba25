"""Stretches of words that repeat with a period, found in one pass over each text.

A run of smallest period q is a diagonal of matches at lag q: word after word equals the one q
before it. Of a word's earlier occurrences, only the last one with the same 2**k words after it can
have a lag in 2**k .. 2**(k+1)-1 that is a smallest period (a primitive word is found in its own
powers at whole multiples of its length alone). So a word increments one lag for every k, and
words whose next 2**k words are nowhere else in the text, which is most of them, none at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.tables import with_row
from skyframe.llm.words import mixed, stretches, words_of

# A run is that many words at least, and that many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _followed(at: np.ndarray, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of grams of `width` words at sorted places, those that another follows, as grams twice as wide."""
    next_ = np.searchsorted(at, at + width)
    next_[next_ == len(at)] = 0
    whole = np.flatnonzero(at[next_] == at + width)
    return at[whole], mixed(keys[whole] * _STEP + keys[next_[whole]])


def _last_occurrences(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the lag to the last one with its key (0: none), and whether its key repeats."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    lag, repeats = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    lag[order[1:][same]] = at[order[1:][same]] - at[order[:-1][same]]
    repeats[order[1:][same]] = True
    repeats[order[:-1][same]] = True
    return lag, repeats


def find_runs(keys: np.ndarray, texts: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """(runs, 3) of first word, length and period, over the words of many texts one after the other.

    `keys` tells words apart and `texts` is each word's text. A diagonal of lag q that has matched m
    words is m + q words of period q; it is a run once it ends, if that is long enough.
    """
    keys = mixed(keys ^ mixed(texts.astype(np.uint64) + _STEP))
    at, width, found = np.arange(len(keys)), 1, []
    at, keys = _followed(at, keys, width)
    # Grams may not cross into the next text, whose words have other keys: they only seem not to repeat.
    while len(at):
        lag, repeats = _last_occurrences(at, keys)
        live = np.flatnonzero((lag >= width) & (lag < 2 * width))
        if len(live):
            place, own = at[live], lag[live]
            # A diagonal ends where the next word does not have its lag.
            ends = np.flatnonzero((np.diff(place) != 1) | (np.diff(own) != 0))
            begins, ends = np.concatenate(([0], ends + 1)), np.concatenate((ends, [len(live) - 1]))
            period = own[begins]
            matched = place[ends] - place[begins] + 2 * width
            long_enough = matched + period >= np.maximum(least, periods * period)
            rows = np.stack((place[begins] - period, matched + period, period), axis=1)
            found.append(rows[long_enough])
        at, keys = at[repeats], keys[repeats]
        width *= 2
        at, keys = _followed(at, keys, width)
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def collapse_runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """Every row of `documents`, its columns as they are in a struct `row`, with `n_words`, its
    `runs` (start, length, period; by start, then period) and the `collapsed` text.

    Words are what space and 0x09 to 0x0D leave, compared as written. A run is a stretch of the
    smallest period q, of max(6, 4 * q) words or more, that neither neighbour extends; runs may
    overlap. `collapsed` keeps of every run its first period, and joins what is kept by one space. A
    null or wordless text has no words, no runs and an empty `collapsed`. Repeated rows come out as
    often as they are there, an empty table gives an empty one. Texts are read whole, about a
    megabyte of them at a time (a longer one by itself), with a few numbers a word; nothing is shuffled.
    Words are told apart by 61 bits of a hash within their own text.
    """
    source = documents.select(F.struct("*").alias("row"), F.col(f"`{text}`").cast("binary").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in stretches(batch.column(1)):
                own = [value or b"" for value in texts]
                words = words_of(own, lower=False)
                counts = words.counts()
                numbers = np.repeat(np.arange(len(own)), counts)
                runs = find_runs(words.hashes(), numbers)
                cuts = np.searchsorted(runs[:, 0], words.first)
                collapsed = []
                for k, value in enumerate(own):
                    kept = value.split()
                    if cuts[k] < cuts[k + 1]:
                        mine = runs[cuts[k] : cuts[k + 1]]
                        mine[:, 0] -= words.first[k]
                        kept = [word for word, gone in zip(kept, _repeated(mine, len(kept))) if not gone]
                    collapsed.append(b" ".join(kept))
                columns = [pa.array(runs[:, j]) for j in range(3)]
                lists = pa.ListArray.from_arrays(
                    pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "length", "period"])
                ).cast(run_type)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(own)),
                        pa.array(counts, pa.int64()),
                        lists,
                        pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False),
                    ],
                    ["row", "n_words", "runs", "collapsed"],
                )

    runs_ddl = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return source.mapInArrow(run, with_row(source, f"n_words bigint, runs {runs_ddl}, collapsed string"))

