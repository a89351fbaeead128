"""Order-dependent folds that stream: rows of a key pass through a task in order, and a small machine keeps what can still matter.

Keys are cut into chains first, at stretches of time in which no state can be
carried over; a chain of any length is read from its sorted shuffle, never
gathered.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

Names = Sequence[str]
#: Rows of an output batch.
BATCH = 4096


def chained(df: DataFrame, keys: Names, t: str, gap, chain: str = "_chain") -> DataFrame:
    """df with the number of its chain: rows of a key that may lie ``gap`` or less apart share one.

    Keys are cut at empty cells of time. Cells are counted before they meet, so a key takes as many rows
    in the window as its time has cells, however many rows it has. Rows without a time go.
    """
    width = max(gap, 1) if isinstance(gap, int) else gap
    placed = df.withColumn("_cell", F.floor(F.col(t) / F.lit(width)).cast("long"))
    cells = placed.select(*[F.col(k).alias("_of_" + k) for k in keys], F.col("_cell").alias("_of_cell")).where("_of_cell IS NOT NULL").distinct()
    in_time = Window.partitionBy(*["_of_" + k for k in keys]).orderBy("_of_cell")
    fresh = F.when(F.col("_of_cell") - F.lag("_of_cell").over(in_time) <= 1, 0).otherwise(1)
    numbered = cells.withColumn("_fresh", fresh).withColumn(chain, F.sum("_fresh").over(in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("_fresh")
    same = F.col("_cell") == F.col("_of_cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_of_" + k))
    return placed.join(numbered, same).select(*[f"`{c}`" for c in df.columns], chain)


def streamed(df: DataFrame, keys: Names, inner: Names, order: Names, columns: Names, out: str, make: Callable[[], Machine]) -> DataFrame:
    """``(keys, out)``: what a machine of its own gives for each value of keys and inner, fed with the columns of its rows in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    given = df.select(*keys, *inner, *columns)
    parts = [*keys, *inner]
    schema = T.StructType([*[given.schema[k] for k in keys], *T._parse_datatype_string(out).fields])
    arrow, n, m = to_arrow_schema(schema), len(keys), len(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, machine, held = None, None, []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
            held.clear()
            return made

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if machine is None or row[:m] != at:
                    if machine is not None:
                        held += [(*at[:n], *x) for x in machine.close()]
                    at, machine = row[:m], make()
                for x in machine.feed(*row[m:]):
                    held.append((*at[:n], *x))
                if len(held) >= BATCH:
                    yield flush()
        if machine is not None:
            held += [(*at[:n], *x) for x in machine.close()]
        if held:
            yield flush()

    return given.repartition(*parts).sortWithinPartitions(*parts, *order).mapInArrow(run, schema)


class Machine:
    """Gets rows in order; gives result rows as soon as they are certain."""

    def feed(self, *row) -> Iterator[tuple]:
        raise NotImplementedError

    def close(self) -> Iterator[tuple]:
        return iter(())


class Peaks(Machine):
    """Hysteresis: armed above the threshold, the top is given once a value falls under valley times it."""

    def __init__(self, threshold: float, valley: float):
        self.threshold, self.valley, self.top = threshold, valley, None

    def feed(self, t, value):
        if value is None:
            return
        if self.top is None:
            if value > self.threshold:
                self.top = (t, value)
        elif value > self.top[1]:
            self.top = (t, value)
        elif value < self.top[1] * self.valley:
            yield self.top
            self.top = None

    def close(self):
        if self.top is not None:
            yield self.top


class Matching(Machine):
    """References (side 0) and predictions (side 1) by time: a prediction takes the earliest free reference within the tolerance, once all of those have passed."""

    def __init__(self, tolerance):
        self.tolerance, self.refs, self.preds = tolerance, deque(), deque()

    def feed(self, t, side, ident):
        while self.preds and t > self.preds[0][0] + self.tolerance:
            yield from self._settle()
        (self.preds if side else self.refs).append((t, ident))
        oldest = (self.preds[0][0] if self.preds else t) - self.tolerance
        while self.refs and self.refs[0][0] < oldest:
            self.refs.popleft()

    def _settle(self):
        t, ident = self.preds.popleft()
        while self.refs and self.refs[0][0] < t - self.tolerance:
            self.refs.popleft()
        if self.refs and self.refs[0][0] <= t + self.tolerance:
            ref_t, ref = self.refs.popleft()
            yield ref, ident, ref_t, t

    def close(self):
        while self.preds:
            yield from self._settle()


class Confirming(Machine):
    """Events (side 0) and candidates (side 1) by time: an event takes the nearest candidate within snap after the last one taken (the earlier of equals)."""

    def __init__(self, snap):
        self.snap, self.events, self.times, self.idents, self.begin = snap, deque(), [], [], 0

    def feed(self, t, side, ident):
        while self.events and t > self.events[0][0] + self.snap:
            yield self._settle()
        if side:
            self.times.append(t), self.idents.append(ident)
        else:
            self.events.append((t, ident))
        if self.begin < len(self.times):
            oldest = (self.events[0][0] if self.events else t) - self.snap
            self.begin = bisect_left(self.times, oldest, self.begin)
        if self.begin > 1024 and 2 * self.begin > len(self.times):
            del self.times[: self.begin], self.idents[: self.begin]
            self.begin = 0

    def _settle(self):
        t, ident = self.events.popleft()
        i = bisect_left(self.times, t, self.begin)
        found = [j for j in (bisect_left(self.times, self.times[i - 1], self.begin) if i > self.begin else -1, i) if 0 <= j < len(self.times) and abs(self.times[j] - t) <= self.snap]
        if not found:
            return ident, t, None, None
        best = min(found, key=lambda j: (abs(self.times[j] - t), j))
        self.begin = best + 1
        return ident, t, self.idents[best], self.times[best]

    def close(self):
        while self.events:
            yield self._settle()


class Merging(Machine):
    """Rows by time: one nearer than gap to the row held replaces it if it is stronger, else goes; a row farther off is held instead."""

    def __init__(self, gap):
        self.gap, self.held = gap, None

    def feed(self, t, ident, score):
        if self.held is not None and t - self.held[0] >= self.gap:
            yield self.held
            self.held = None
        if self.held is None or score > self.held[2]:
            self.held = (t, ident, score)

    def close(self):
        if self.held is not None:
            yield self.held


class Suppressing(Machine):
    """Greedy suppression by score over rows by time. A row's fate is certain once all rows near it have passed and those above it are certain.

    Held are rows whose fate isn't; they are judged anew whenever there are twice as many as were left, so a row is judged a few times on average.
    """

    def __init__(self, gap):
        self.gap, self.kept, self.open, self.limit, self.now = gap, [], [], 1024, None

    def feed(self, t, score, ident):
        self.now = t
        self.open.append((-score, ident, t))
        if len(self.open) >= self.limit:
            yield from self._judge(t)
            self.limit = max(1024, 2 * len(self.open))

    def _near(self, times: list, t) -> bool:
        i = bisect_left(times, t)
        return (i < len(times) and times[i] - t < self.gap) or (i > 0 and t - times[i - 1] < self.gap)

    def _judge(self, now):
        left, unsure = [], []
        for row in sorted(self.open):
            t = row[2]
            if self._near(self.kept, t):
                continue
            if (now is not None and t + self.gap > now) or self._near(unsure, t):
                left.append(row)
                insort(unsure, t)
            else:
                insort(self.kept, t)
                yield row[1], t, -row[0]
        self.open = left
        oldest = min([r[2] for r in left], default=self.now) if now is not None else None
        if oldest is not None:
            del self.kept[: bisect_left(self.kept, oldest - self.gap)]

    def close(self):
        yield from self._judge(None)


class Tracks(Machine):
    """Items ``x, y, h`` of frames to tracks: each item, in order, goes to the nearest open track that it fits and that has none in this frame yet, else opens one.

    A track is its running means; it closes when it hasn't been seen for longer than gap. The state can be taken out and put back between any two items.
    """

    def __init__(self, gap, across: tuple[float, float] = (1.5, 12.0), down: tuple[float, float] = (0.6, 6.0), drift: float = 0.35, state: Sequence[tuple] = ()):
        self.gap, self.across, self.down, self.drift = gap, across, down, drift
        self.open = [list(s) for s in state]  # ident, x, y, h, items, last frame

    def feed(self, frame, ident, x, y, h):
        if self.open and self.open[0][5] != frame:
            self.open = [s for s in self.open if s[5] == frame or frame - s[5] <= self.gap]
        best = None
        for s in self.open:
            if s[5] == frame or abs(y - s[2]) > max(self.down[0] * s[3], self.down[1]) or abs(x - s[1]) > max(self.across[0] * s[3], self.across[1]) or abs(h - s[3]) > self.drift * s[3]:
                continue
            d = abs(x - s[1]) + abs(y - s[2])
            if best is None or d < best[0]:
                best = (d, s)
        if best is None:
            self.open.append([ident, x, y, h, 1, frame])
            yield frame, ident, ident, 1
            return
        s = best[1]
        n = s[4]
        s[1:] = [(s[1] * n + x) / (n + 1), (s[2] * n + y) / (n + 1), (s[3] * n + h) / (n + 1), n + 1, frame]
        yield frame, ident, s[0], n + 1


class Leaders(Machine):
    """Samples of packed bits to prototypes: the nearest (the older of equals) takes a sample that differs in at most ``reach`` of its bits, else the sample begins one, while there are fewer than most.

    A prototype's bits are the majority of its members', ties set. Prototypes are all that is kept.
    """

    def __init__(self, bits: int, reach: float, most: int):
        self.bits, self.reach, self.most = bits, reach, most
        self.made: list[list] = []  # first sample, packed bits, members, members that set each bit

    def feed(self, ident, sample):
        best = min(((bits ^ sample).bit_count(), i) for i, (_, bits, _, _) in enumerate(self.made)) if self.made else None
        if best is not None and best[0] <= self.reach * self.bits:
            one = self.made[best[1]]
            one[2] += 1
            one[3] = [n + (sample >> j & 1) for j, n in enumerate(one[3])]
            one[1] = sum(1 << j for j, n in enumerate(one[3]) if 2 * n >= one[2])
        elif len(self.made) < self.most:
            self.made.append([ident, sample, 1, [sample >> j & 1 for j in range(self.bits)]])
        return iter(())

    def close(self):
        for ident, bits, members, _ in self.made:
            yield ident, members, f"{bits:0{self.bits}b}"[::-1]


class Spaced(Machine):
    """Times that come at least gap after the last one taken."""

    def __init__(self, gap):
        self.gap, self.last = gap, None

    def feed(self, t, *_):
        if self.last is None or t - self.last >= self.gap:
            self.last = t
            yield (t,)


class Rightward(Machine):
    """Rows (side, x, y, h, ident) of a cell from the right, asking items (side 0) before places (side 1) of the same x: an asking item gets
    the nearest place that it reaches, of equals that of the smallest ident. Of places of equal height, only the nearest is held."""

    def __init__(self, reach: float, drift: float):
        self.reach, self.drift, self.held = reach, drift, {}

    def feed(self, side, x, y, h, ident):
        if side:
            at, known = self.held.pop(y, (None, None))
            self.held[y] = x, min(ident, known) if at == x else ident  # the last is the nearest
            return
        best = None
        for other, (at, right) in reversed(self.held.items()):
            if at - x > self.reach * h or best and at > best[0]:
                break
            if abs(other - y) <= self.drift * h:
                best = min(best, (at, right)) if best else (at, right)
        if best:
            yield ident, *best
