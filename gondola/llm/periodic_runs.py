"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words that repeats its smallest period at least
``copies`` times and that no neighbouring word extends.

* Periods up to ``SHORT`` are found by direct lag scans: words equal to the word ``q``
  places on, in stretches that are long enough.
* Longer periods are found per scale. Scale ``K`` covers periods above K/2 up to K. Its
  units are the K-word grams, hashed by doubling the grams of the scale before, and a
  window of K/2 of them marks its smallest. Two windows one period apart inside a run
  hold the same grams, so both mark the same one; a gram as long as the period returns
  inside a run at multiples of the period only. So the two are neighbours among the
  equal marks of the scale, and their distance is the period.
* Each such pair is a seed: the words themselves are compared from it to both sides,
  once per stretch and lag, so hashes choose seeds but decide nothing.
* Of a stretch with several periods the smallest counts: with four copies or more, a
  smaller one divides the larger, and shows in the first period alone.

Windows of one scale mark about four grams per K words, so the work of a text grows
with its length times the number of scales. Texts are independent: one pass, no
shuffle, memory in proportion to one text.

Defined results: null and blank texts have no words and no runs; null ids and repeated
rows are rows like others; an empty table gives no rows; columns to keep come back as
the fields of ``doc``, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.llm.staging import kept_columns, slices, text_or_empty

#: Periods found by direct lag scans; the first scale starts above.
SHORT = 8
#: Least words of a run, and least copies of its period (four at least, see above).
WORDS, COPIES = 6, 4

_U = np.uint64
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _equal_ahead(w: np.ndarray, a: int, b: int) -> int:
    """How many words from a < b on are equal, compared in growing pieces."""
    done, piece = 0, 64
    while b + done < len(w):
        m = min(piece, len(w) - b - done)
        differ = np.flatnonzero(w[a + done : a + done + m] != w[b + done : b + done + m])
        if len(differ):
            return done + int(differ[0])
        done, piece = done + m, 2 * piece
    return done


def _equal_behind(w: np.ndarray, a: int, b: int) -> int:
    """How many words before a < b are equal."""
    done, piece = 0, 64
    while a - done > 0:
        m = min(piece, a - done)
        differ = np.flatnonzero(w[a - done - m : a - done] != w[b - done - m : b - done])
        if len(differ):
            return done + m - 1 - int(differ[-1])
        done, piece = done + m, 2 * piece
    return done


def _primitive(w: np.ndarray, start: int, period: int) -> bool:
    """No proper divisor of ``period`` is a period of the stretch that starts here."""
    left, factor = period, 2
    while left > 1:
        if factor * factor > left:
            factor = left
        if left % factor:
            factor += 1
            continue
        while left % factor == 0:
            left //= factor
        p = period // factor
        if np.array_equal(w[start : start + period], w[start + p : start + p + period]):
            return False
    return True


def _short(w: np.ndarray, period: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches of at least ``least`` words with this lag."""
    same = w[:-period] == w[period:]
    if np.count_nonzero(same) < least - period:
        return
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    for k in np.flatnonzero(ends - starts >= least - period):
        yield int(starts[k]), int(ends[k] - starts[k]) + period


def _window(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each window; ``width`` is a power of two."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _seeds(grams: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(lag, place) of neighbouring equal marks at a distance this scale covers."""
    width = scale // 2
    least = _window(grams, width, np.minimum)
    low = np.zeros(width - 1, _U)
    marked = np.flatnonzero(_window(np.concatenate((low, least, low)), width, np.maximum) == grams)
    order = np.argsort(grams[marked], kind="stable")
    at, value = marked[order], grams[marked[order]]
    lag = np.diff(at)
    pairs = np.flatnonzero((value[1:] == value[:-1]) & (lag > scale // 2) & (lag <= scale))
    return sorted(zip(lag[pairs].tolist(), at[pairs].tolist(), strict=True))


def runs(w: np.ndarray, words: int = WORDS, copies: int = COPIES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers ``w``, by start, then period."""
    found: list[tuple[int, int, int]] = []
    n = len(w)
    for q in range(1, min(SHORT, n // copies) + 1):
        least = max(words, copies * q)
        found += [(s, m, q) for s, m in _short(w, q, least) if _primitive(w, s, q)]
    grams, scale = w.astype(_U), 1
    with np.errstate(over="ignore"):
        grams = _mix(grams + _U(0x9E3779B97F4A7C15))
        while copies * (scale + 1) <= n:
            grams = _mix(grams[:-scale] * _U(0xC2B2AE3D27D4EB4F) + grams[scale:])
            scale *= 2
            if scale <= SHORT:
                continue
            covered = (0, -1)  # lag, and where its last stretch ends
            for lag, at in _seeds(grams, scale):
                if covered[0] == lag and at < covered[1]:
                    continue
                ahead, behind = _equal_ahead(w, at, at + lag), _equal_behind(w, at, at + lag)
                covered = (lag, at + ahead)
                start, length = at - behind, behind + ahead + lag
                if length >= max(words, copies * lag) and _primitive(w, start, lag):
                    found.append((start, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64)


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def _kernel(words: int, copies: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            every, best, left = [], [], []
            for text in batch.column("text").to_pylist():
                own = text.encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
                found = runs(numbered(own), words, copies) if len(own) >= words else []
                every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                if found:
                    own = [own[i] for i in np.flatnonzero(collapsed(len(own), found))]
                left.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array(every, pa.list_(_RUN)),
                    pa.array(best, _RUN),
                    pa.array(left, pa.binary()).cast(pa.string()),
                ],
                ["doc", "runs", "strongest", "collapsed"],
            )

    return kernel


def find_runs(docs: DataFrame, keep: list[str], words: int = WORDS, copies: int = COPIES) -> DataFrame:
    """(doc, runs, strongest, collapsed): one row per row of ``docs`` (text).

    ``runs`` are by start, then period; ``strongest`` has the greatest length per period
    (ties: smallest start, then period), null without runs; ``collapsed`` holds the words
    that stay when every run keeps its first period, joined by single blanks.
    """
    if copies < 4:
        raise ValueError("the scales cover runs of four copies or more")
    rows = docs.select(kept_columns(keep).alias("doc"), text_or_empty().alias("text"))
    run = "struct<start:long,length:long,period:long>"
    made = T.StructType([rows.schema["doc"]])
    for name, kind in (("runs", f"array<{run}>"), ("strongest", run), ("collapsed", "string")):
        made.add(name, T.DataType.fromDDL(kind))
    return rows.mapInArrow(_kernel(words, copies), made)
