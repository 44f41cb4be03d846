"""Exact quantiles of a few columns by narrowing intervals, and sketches.

``radix`` is what the cleaning steps use; this way has fewer passes over huge tables when
intervals from a sample already hold few enough rows.

A quantile is an interpolation between two order statistics.  Each one is
pinned down by narrowing an interval around it:

* a sketch of a random sample proposes an interval;
* a count pass measures exactly how many rows lie below and inside it, and moves
  the interval if the wanted rank turned out to be outside;
* once few enough rows are strictly inside, their (value, count) pairs are
  gathered and the rank is read off a running count.

Sampling only decides where to look: the counts and the gathered values come
from all rows, so the result is exact however good or bad a proposal was.  All
passes are map-side aggregates with a few numbers of state per task.  Only rows
inside an interval are ever shuffled, equal values are merged before that, and a
value holding most of the table is one entry.  The number of passes grows with
the logarithm of the row count: three below some 10^8 rows, five at 10^11.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowcascade.functions import nan_to_null, quoted

DEFAULT_ACCURACY = 10_000
DEFAULT_SAMPLE_ROWS = 4_000_000
DEFAULT_GATHER_ROWS = 1_000_000
SMALLEST_SAMPLE = 20_000
SKETCH_ROWS = 65_536        # sampled rows per sketch
SAMPLE_SEED = 20_181


@dataclass
class _Search:
    """Interval around the order statistics ``rank`` and ``next_rank`` of a column.

    ``[low, high]`` is the current proposal; ``[floor, ceiling]`` is the
    smallest interval proven to hold both ranks.
    """

    column: str
    share: float
    rows: int = 0           # values in the column
    floor: float = 0.0
    ceiling: float = 0.0
    low: float = 0.0
    high: float = 0.0
    below: int = 0          # rows smaller than ``low``
    inside: int = 0         # rows in [low, high]
    at_low: int = 0         # rows equal to ``low``
    at_high: int = 0        # rows equal to ``high``, when that differs
    misses: int = 0
    counted: bool = False
    settled: bool = False
    split_at: float | None = None
    split_left_closed: bool = False

    @property
    def position(self) -> float:
        return self.share * (self.rows - 1)

    @property
    def rank(self) -> int:
        return math.floor(self.position)

    @property
    def next_rank(self) -> int:
        return min(self.rank + 1, self.rows - 1)

    @property
    def interior(self) -> int:
        return self.inside - self.at_low - self.at_high

    def at_edge(self, rank: int) -> float | None:
        """The value of ``rank`` if it is one of the two edges."""
        if rank < self.below + self.at_low:
            return self.low
        return self.high if rank >= self.below + self.inside - self.at_high else None

    def propose(self, low: float, high: float) -> None:
        self.low, self.high, self.counted = low, high, False

    def judge(self, gather_rows: int) -> None:
        """Use fresh counts: settle, tighten the proof, or move the proposal.

        Every outcome but the first leaves a strictly smaller interval to search.
        """
        self.counted = True
        end = self.below + self.inside
        if self.below <= self.rank and self.next_rank < end:
            self.floor, self.ceiling = max(self.floor, self.low), min(self.ceiling, self.high)
            self.settled = self.interior <= gather_rows
        elif self.next_rank < self.below:
            self.misses += 1
            self.propose(self.floor, math.nextafter(self.low, -math.inf))
        elif self.rank >= end:
            self.misses += 1
            self.propose(math.nextafter(self.high, math.inf), self.ceiling)
        else:
            # one rank on either side of an edge: they are its two neighbours
            self.split_at = self.low if self.rank < self.below else self.high
            self.split_left_closed = self.rank >= self.below
            self.settled = True

    def halve(self) -> None:
        largest = sys.float_info.max
        middle = max(self.floor, -largest) / 2 + min(self.ceiling, largest) / 2
        self.propose(self.floor, middle)

    def interpolate(self, a: float, b: float) -> float:
        """Linear interpolation, evaluated the way numpy evaluates it."""
        t = self.position - self.rank
        span = b - a
        return b - span * (1 - t) if t >= 0.5 else a + span * t


def _double(c: str) -> Column:
    return nan_to_null(quoted(c).cast("double"))


def _lit(x: float) -> Column:
    return F.lit(float(x))


def _inside(s: _Search) -> Column:
    c = _double(s.column)
    return (c >= _lit(s.low)) & (c <= _lit(s.high))


def _extent(cols: list[str]) -> list[Column]:
    aggs = []
    for i, c in enumerate(cols):
        v = _double(c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    return aggs


def _use_extent(row, cols: list[str], searches: list[_Search]) -> None:
    position = {c: i for i, c in enumerate(cols)}
    for s in searches:
        i = position[s.column]
        s.rows, s.floor, s.ceiling = row[f"n{i}"], row[f"min{i}"], row[f"max{i}"]


def _sample_size(rows: int, sample_rows: int, gather_rows: int) -> float:
    """Enough rows for the interval to come out below ``gather_rows``, within bounds.

    An interval is ten standard errors wide, at most 5 * rows / sqrt(sample).
    """
    enough = (10 * rows / max(gather_rows, 1)) ** 2
    return min(max(enough, SMALLEST_SAMPLE), sample_rows)


def _propose(df: DataFrame, searches: list[_Search], accuracy: int, sample_rows: int,
             gather_rows: int, rows: int | None) -> None:
    """Propose intervals a little wider than the sampling error around each rank.

    ``rows`` is the size of the table for the first proposal; later ones look
    inside the intervals proven so far.
    """
    smallest = rows if rows is not None else min(s.inside for s in searches)
    wanted = _sample_size(smallest, sample_rows, gather_rows)
    fraction = min(1.0, wanted / max(smallest, 1))
    data = df
    if fraction < 1.0:
        # few rows are left, so they are brought to few sketches
        data = df.sample(fraction, SAMPLE_SEED).select(
            *[quoted(c) for c in dict.fromkeys(s.column for s in searches)]
        ).repartition(math.ceil(wanted / SKETCH_ROWS))
    aggs = []
    for i, s in enumerate(searches):
        v = _double(s.column)
        if rows is None:
            v = F.when(_inside(s), v)
            last = max(s.inside - 1, 1)
            start, end = (s.rank - s.below) / last, (s.next_rank - s.below) / last
        else:
            start = end = s.share
        sampled = max((rows if rows is not None else s.inside) * fraction, 1.0)
        spread = 0.0 if fraction == 1.0 else 5 * math.sqrt(
            max(start * (1 - start), 1 / sampled) / sampled)
        slack = (1.5 / accuracy + spread) * 2 ** min(s.misses, 6)
        marks = [min(max(start - slack, 0.0), 1.0), min(max(end + slack, 0.0), 1.0)]
        aggs.append(F.percentile_approx(v, marks, accuracy).alias(f"q{i}"))
    row = data.agg(*aggs).first()
    for i, s in enumerate(searches):
        found = row[f"q{i}"]
        if rows is not None:
            s.propose(*(found or (-math.inf, math.inf)))
        elif found is None or tuple(found) == (s.floor, s.ceiling):
            s.halve()
        else:
            s.propose(*found)


def _count_pass(df: DataFrame, searches: list[_Search], gather_rows: int, first: bool) -> None:
    cols = list(dict.fromkeys(s.column for s in searches))
    aggs = _extent(cols) if first else []
    for i, s in enumerate(searches):
        c = _double(s.column)
        aggs += [
            F.count_if(c < _lit(s.low)).alias(f"below{i}"),
            F.count_if(_inside(s)).alias(f"inside{i}"),
            F.count_if(c == _lit(s.low)).alias(f"low{i}"),
            F.count_if((c == _lit(s.high)) & (c > _lit(s.low))).alias(f"high{i}"),
        ]
    row = df.agg(*aggs).first()
    if first:
        _use_extent(row, cols, searches)
    for i, s in enumerate(searches):
        s.below, s.inside = row[f"below{i}"], row[f"inside{i}"]
        s.at_low, s.at_high = row[f"low{i}"], row[f"high{i}"]
        if s.rows:
            s.judge(gather_rows)
        else:
            s.settled = True


def _gather_pass(df: DataFrame, searches: list[_Search]) -> list[tuple[float, float]]:
    """Both order statistics of every search: an edge, or off a bounded running count."""
    edges = [(s.at_edge(s.rank), s.at_edge(s.next_rank)) for s in searches]
    open_ids = [i for i, pair in enumerate(edges) if None in pair]
    read: dict[int, tuple[float, float]] = {}
    if open_ids:
        wanted = {i: _gathered(searches[i]) for i in open_ids}
        in_any = None
        for condition in wanted.values():
            in_any = condition if in_any is None else in_any | condition
        picks = F.array(*[
            F.when(condition, F.struct(F.lit(i).alias("search"),
                                       _double(searches[i].column).alias("value")))
            for i, condition in wanted.items()
        ])
        per_value = (
            df.filter(in_any)
            .select(F.explode(F.filter(picks, lambda p: p.isNotNull())).alias("p"))
            .groupBy("p.search", "p.value").agg(F.count(F.lit(1)).alias("n"))
        )
        # a group holds at most ``gather_rows`` values
        order = Window.partitionBy("search").orderBy("value")
        upto = F.sum("n").over(order)

        def rank_of(pick) -> Column:
            pairs = [x for i in open_ids for x in
                     (F.lit(i), F.lit(pick(searches[i]) - searches[i].below - searches[i].at_low))]
            return F.create_map(*pairs)[F.col("search")]

        def value_at(rank: Column) -> Column:
            here = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
            return F.max(F.when(here, F.col("value")))

        found = per_value.withColumn("upto", upto).groupBy("search").agg(
            value_at(rank_of(lambda s: s.rank)).alias("a"),
            value_at(rank_of(lambda s: s.next_rank)).alias("b"))
        read = {r["search"]: (r["a"], r["b"]) for r in found.collect()}
    pairs = []
    for i, (a, b) in enumerate(edges):
        found_a, found_b = read.get(i, (None, None))
        pairs.append((found_a if a is None else a, found_b if b is None else b))
    return pairs


def _gathered(s: _Search) -> Column:
    c = _double(s.column)
    return (c > _lit(s.low)) & (c < _lit(s.high))


def _split_pass(df: DataFrame, searches: list[_Search]) -> list[tuple[float, float]]:
    """Largest value on the left and smallest on the right of each split."""
    aggs = []
    for i, s in enumerate(searches):
        c = _double(s.column)
        left = c <= _lit(s.split_at) if s.split_left_closed else c < _lit(s.split_at)
        aggs += [F.max(F.when(left, c)).alias(f"a{i}"), F.min(F.when(~left, c)).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    return [(row[f"a{i}"], row[f"b{i}"]) for i in range(len(searches))]


def exact_quantiles(df: DataFrame, cols: list[str], shares: list[float],
                    accuracy: int = DEFAULT_ACCURACY, sample_rows: int = DEFAULT_SAMPLE_ROWS,
                    gather_rows: int = DEFAULT_GATHER_ROWS) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles; nulls and NaN are ignored.

    ``gather_rows`` bounds how many rows strictly inside one interval are ever
    shuffled.  A column without values gets ``None`` for every share.
    """
    if not cols:
        return {}
    rows = df.count()
    searches = [_Search(c, p) for c in cols for p in shares]
    _propose(df, searches, accuracy, sample_rows, gather_rows, rows)
    _count_pass(df, searches, gather_rows, first=True)
    while open_searches := [s for s in searches if not s.settled]:
        # proven but still too wide; a moved proposal is counted again first
        wide = [s for s in open_searches if s.counted]
        if wide:
            _propose(df, wide, accuracy, sample_rows, gather_rows, None)
        _count_pass(df, open_searches, gather_rows, first=False)
    filled = [s for s in searches if s.rows]
    gathered = [s for s in filled if s.split_at is None]
    split = [s for s in filled if s.split_at is not None]
    pairs = {id(s): pair for part, read in ((gathered, _gather_pass), (split, _split_pass))
             if part for s, pair in zip(part, read(df, part))}
    result: dict[str, list[float | None]] = {c: [] for c in cols}
    for s in searches:
        result[s.column].append(s.interpolate(*pairs[id(s)]) if s.rows else None)
    return result


def approx_quantiles(df: DataFrame, cols: list[str], shares: list[float],
                     accuracy: int = DEFAULT_ACCURACY) -> dict[str, list[float | None]]:
    """One-pass sketch quantiles (rank error at most 1/accuracy)."""
    if not cols:
        return {}
    row = df.agg(*[
        F.percentile_approx(_double(c), shares, accuracy).alias(f"q{i}")
        for i, c in enumerate(cols)
    ]).first()
    return {c: list(row[f"q{i}"] or [None] * len(shares)) for i, c in enumerate(cols)}
