"""Order-dependent decisions per key: greedy spacing, sessions, token buckets, sliding windows.

Each decision depends on the previous ones of its key, and one key may hold a third of all rows.
Keys with more rows than fit one task are therefore cut into time chunks:

1. hot keys are looked for and cut at time slots so that a chunk holds about `chunk_rows` rows;
2. every chunk is summarised in parallel (what state leaves it, given what state enters);
3. the summaries of a key, one short row per chunk, stream by in order to find each entry state;
4. all chunks are replayed in parallel from their true entry states.

For spacing, sessions and token buckets a summary is the complete entry-to-exit function, as a
short piecewise map, so one walk over the summaries is exact. A sliding window's state is a list of
times, and a summary is its exit from no state, with a flag: whether the chunk forgets its entry,
because some row of it has a state that is known whatever came before (after a pause of one window,
or after a window with fewer arrivals than the limit). Chunks behind one that forgets have a known
entry. What is left are stretches of chunks that don't forget; those are run once, each stretch in
order and all stretches in parallel. The rows are read three times, however the chunks fall.
Cold keys are one chunk each and go straight to the replay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import MICROS
from ..session import cut_lineage, small_side, written

CHUNK_ROWS = 1_000_000
Rows = dict[str, np.ndarray]        # the needed columns of one chunk, in order
NONE = np.iinfo(np.int64).min       # "no state yet"
KEEP = NONE + 1                     # "the entry state passes through"
BLOCK_ROWS = 1 << 16                # rows whose maps are composed in one tree


def hot_keys(df: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """Keys with more than `chunk_rows` rows: at most total rows / chunk_rows of them."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") > chunk_rows).drop("_n")


def hot_slots(df: DataFrame, keys: list[str], us: str, chunk_rows: int) -> DataFrame:
    """(keys, slot, width, chunk) of the hot keys, one row per occupied time slot in microseconds.

    A slot is a second; seconds of a key with more than `chunk_rows` rows are cut into milliseconds, and
    milliseconds with more than that into microseconds. Rows of one microsecond stay together.
    """
    hot_rows = df.join(hot_keys(df, keys, chunk_rows), keys, "left_semi")
    counts, width = None, MICROS
    while True:
        slot = F.expr(f"`{us}` div {width} * {width}")
        found = hot_rows.groupBy(*keys, slot.alias("_slot")).agg(F.count("*").alias("_n"))
        if width == 1:
            return _chunked(counts.unionByName(found.withColumn("_width", F.lit(1))), keys, chunk_rows)
        found = cut_lineage(found.withColumn("_width", F.lit(width)))
        dense = found.filter(F.col("_n") > chunk_rows)
        sparse = found.filter(F.col("_n") <= chunk_rows)
        counts = sparse if counts is None else counts.unionByName(sparse)
        if dense.isEmpty():
            return _chunked(counts, keys, chunk_rows)
        hot_rows = hot_rows.withColumn("_slot", slot).join(dense.select(*keys, "_slot"), [*keys, "_slot"], "left_semi").drop("_slot")
        width //= 1000


def _chunked(counts: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0))
    placed = counts.select(*keys, "_slot", "_width", start.alias("_before"))
    return placed.select(*keys, "_slot", "_width", F.expr(f"_before div {chunk_rows}").alias("_chunk"))


def with_chunks(df: DataFrame, keys: list[str], us: str, slots: DataFrame) -> DataFrame:
    """Adds `_chunk`: the slot's chunk for hot keys, null for cold ones. A row lies in one slot of one width."""
    slots = cut_lineage(slots)
    widths = [r["_width"] for r in slots.select("_width").distinct().collect()]
    out = df.withColumn("_chunk", F.lit(None).cast("bigint"))
    for width in widths:
        own = small_side(slots.filter(F.col("_width") == width).select(*keys, "_slot", F.col("_chunk").alias("_of")))
        slotted = out.withColumn("_slot", F.expr(f"`{us}` div {width} * {width}")).join(own, [*keys, "_slot"], "left")
        out = slotted.withColumn("_chunk", F.coalesce("_chunk", "_of")).drop("_slot", "_of")
    return out


@dataclass(frozen=True)
class Fold:
    """One kind of ordered decision.

    `summarize(rows)` gives the summary of a chunk (a list of longs), `follow(summary, state)` the
    state after it, `replay(rows, entry)` the output columns. A state is a list of longs; the empty
    list means "nothing before". With `run`, a chunk's summary may hold for one entry only:
    `summarize` then gives [whether the chunk forgets its entry, *exit from no state], and
    `run(rows, entry)` the exit from any.
    """
    inputs: list[str]
    summarize: Callable[[Rows], list[int]]
    follow: Callable[[list[int], list[int]], list[int]]
    replay: Callable[[Rows, list[int]], Rows]
    outputs: T.StructType
    run: Callable[[Rows, list[int]], list[int]] | None = None


def _longs(value) -> list[int]:
    return [] if value is None else [int(v) for v in value]


def _arrays(table: pa.Table, names: list[str]) -> Rows:
    return {n: table.column(n).to_numpy() for n in names}


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of every run of equal keys."""
    change = np.zeros(len(table), dtype=bool)
    change[0] = True
    for key in keys:
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups; a group cut by a batch edge waits for its rest."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if waiting:
            seam = pa.concat_tables([waiting[-1].slice(len(waiting[-1]) - 1), table])
            starts = _starts(seam, keys) - 1
            starts = starts[starts >= 0]
        else:
            starts = _starts(table, keys)
        cut = int(starts[-1]) if len(starts) else 0
        if cut or (waiting and len(starts)):
            yield pa.concat_tables([*waiting, table.slice(0, cut)]).combine_chunks()
            waiting = [table.slice(cut)]
        else:
            waiting.append(table)
    if waiting:
        yield pa.concat_tables(waiting).combine_chunks()


def run_fold(df: DataFrame, keys: list[str], order: list[str], fold: Fold, us: str = "us",
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All rows of `df` with the fold's output columns; `order` must start with `us`.

    Looking for hot keys is one counting job; without any, the rows go through one shuffle.
    """
    if order[0] != us:
        raise ValueError("rows must be ordered by event time first")
    if hot_keys(df, keys, chunk_rows).isEmpty():
        ready = df.withColumns({"_chunk": F.lit(-1).cast("bigint"), "_entry": F.lit(None).cast("array<bigint>")})
    else:
        chunked = with_chunks(df, keys, us, hot_slots(df, keys, us, chunk_rows))
        entries = _entries(chunked.filter(F.col("_chunk").isNotNull()), keys, order, fold)
        ready = chunked.withColumn("_chunk", F.coalesce("_chunk", F.lit(-1).cast("bigint")))
        ready = ready.join(entries, [*keys, "_chunk"], "left")
    group = [*keys, "_chunk"]
    arrow = {T.BooleanType(): pa.bool_(), T.LongType(): pa.int64()}
    names, added = df.columns, [(f.name, arrow[f.dataType]) for f in fold.outputs.fields]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, group):
            starts = [*_starts(table, group).tolist(), len(table)]
            cols = _arrays(table, fold.inputs)
            entry = table.column("_entry")
            cold = entry.null_count == len(entry)
            parts = []
            for lo, hi in zip(starts, starts[1:]):
                state = [] if cold else _longs(entry[lo].as_py())
                parts.append(fold.replay({n: c[lo:hi] for n, c in cols.items()}, state))
            result = table.select(names)
            for name, kind in added:
                result = result.append_column(name, pa.array(np.concatenate([p[name] for p in parts]), kind))
            yield from result.to_batches()

    out = T.StructType([*df.schema.fields, *fold.outputs.fields])
    return ready.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(replay, out)


def _entries(hot: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """(keys, chunk, entry state) of the hot keys."""
    key_fields = [hot.schema[k] for k in keys]
    longs = T.ArrayType(T.LongType())
    used = list(dict.fromkeys([*keys, *order, *fold.inputs, "_chunk"]))
    group = [*keys, "_chunk"]
    hot = written(hot.select(*used), "hot-rows")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, group):
            starts = [*_starts(table, group).tolist(), len(table)]
            cols = _arrays(table, fold.inputs)
            found = [fold.summarize({n: c[lo:hi] for n, c in cols.items()}) for lo, hi in zip(starts, starts[1:])]
            heads = table.select(group).take(pa.array(starts[:-1])).append_column("_summary", pa.array(found, pa.list_(pa.int64())))
            yield from heads.to_batches()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Summaries arrive in (key, chunk) order; only the current state is held.
        # Behind a chunk that doesn't forget its entry the state is not known (null).
        current, state, before, stretch = None, [], None, 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*keys, "_chunk", "_summary"]]
            entries, previous, stretches = [], [], []
            for *key, chunk, summary in zip(*columns):
                if key != current:
                    current, state, before, stretch = key, [], None, 0
                entries.append(None if state is None else list(state))
                previous.append(before)
                stretches.append(stretch)
                before = chunk
                if fold.run and not summary[0]:
                    state = None
                else:
                    state = summary[1:] if fold.run else fold.follow(summary, state)
                    stretch += bool(fold.run)
            out = batch.append_column("_entry", pa.array(entries, pa.list_(pa.int64())))
            yield out.append_column("_before", pa.array(previous, pa.int64())).append_column("_stretch", pa.array(stretches, pa.int64()))

    summary_type = T.StructType([*key_fields, T.StructField("_chunk", T.LongType()), T.StructField("_summary", longs)])
    walk_type = T.StructType([*summary_type.fields, T.StructField("_entry", longs), T.StructField("_before", T.LongType()), T.StructField("_stretch", T.LongType())])
    summed = hot.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(summaries, summary_type)
    walked = summed.repartition(*keys).sortWithinPartitions(*group).mapInArrow(walk, walk_type)
    if not fold.run:
        return walked.select(*group, "_entry")
    walked = written(walked, "hot-chunks")
    if not walked.where("_entry is null").head(1):
        return walked.select(*group, "_entry")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Chunks of a stretch one after the other, each from the state that the one before left; one chunk is held.
        current, state = None, []
        for table in _whole_groups(batches, [*keys, "_stretch", "_chunk"]):
            starts = [*_starts(table, [*keys, "_stretch", "_chunk"]).tolist(), len(table)]
            cols, exits = _arrays(table, fold.inputs), []
            for lo, hi in zip(starts, starts[1:]):
                key = [table.column(k)[lo].as_py() for k in [*keys, "_stretch"]]
                if key != current:
                    current, state = key, _longs(table.column("_entry")[lo].as_py())
                state = fold.run({n: c[lo:hi] for n, c in cols.items()}, state)
                exits.append(state)
            heads = table.select(group).take(pa.array(starts[:-1])).append_column("_exit", pa.array(exits, pa.list_(pa.int64())))
            yield from heads.to_batches()

    # a stretch: the chunks that don't forget, between two that do; its first chunk has a known entry
    forgetting = F.col("_summary")[0] == 1
    held = walked.where(~forgetting).select(*group, "_stretch", "_entry")
    dealt = hot.join(held, group).repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "_chunk", *order)
    exit_type = T.StructType([*key_fields, T.StructField("_chunk", T.LongType()), T.StructField("_exit", longs)])
    exits = dealt.mapInArrow(in_order, exit_type).select(*keys, F.col("_chunk").alias("_before"), "_exit")
    joined = walked.select(*group, "_before", "_entry").join(exits, [*keys, "_before"], "left")
    return written(joined.select(*group, F.coalesce("_entry", "_exit").alias("_entry")), "hot-entries")


# ---- step functions ---------------------------------------------------------------------------

def _pack(uppers: list[int], exits: list[int], fresh: int) -> list[int]:
    """Exit without entry state, then (exclusive upper bound of the entry, exit) pairs, merged by exit."""
    packed = [fresh]
    for i, (u, e) in enumerate(zip(uppers, exits)):
        if i + 1 < len(exits) and exits[i + 1] == e:
            continue
        packed += [u, e]
    return packed


def _step_of(steps: list[int], state: list[int]) -> int:
    """Which exit serves the state: 0 for no state, else the first pair whose bound is above it."""
    if not state:
        return 0
    return 1 + int(np.searchsorted(np.asarray(steps[1::2], dtype=np.int64), state[0], side="right"))


def _follow_steps(steps: list[int], state: list[int]) -> list[int]:
    exit_ = steps[2 * _step_of(steps, state)]
    if exit_ == KEEP:
        return state
    return [] if exit_ == NONE else [exit_]


END = np.iinfo(np.int64).max


def spacing(gap_us: int, us: str = "us") -> Fold:
    """Greedy spacing: a row is kept when at least `gap_us` have passed since the last kept row."""

    def next_kept(t: np.ndarray) -> np.ndarray:
        return np.searchsorted(t, t + gap_us, side="left")

    def exits(t: np.ndarray) -> np.ndarray:
        """Last kept time of the chunk when row i is kept."""
        nxt, n = next_kept(t), len(t)
        out = np.empty(n, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            out[i] = t[i] if nxt[i] >= n else out[nxt[i]]
        return out

    def summarize(rows: Rows) -> list[int]:
        t = rows[us].astype(np.int64, copy=False)
        out = exits(t)
        # An entry x keeps the first row with t >= x + gap, so row i serves x <= t[i] - gap.
        # No entry is later than the first row, so rows behind the first one past t[0] + gap never serve.
        reach = int(np.searchsorted(t, t[0] + gap_us, side="right")) + 1
        distinct = np.flatnonzero(np.r_[True, t[1:] != t[:-1]][:reach])
        uppers = [int(t[i]) - gap_us + 1 for i in distinct] + [END]
        return _pack(uppers, [int(out[i]) for i in distinct] + [KEEP], int(out[0]))

    def replay(rows: Rows, entry: list[int]) -> Rows:
        t = rows[us].astype(np.int64, copy=False)
        kept = np.zeros(len(t), dtype=bool)
        leader = np.empty(len(t), dtype=np.int64)
        i = int(np.searchsorted(t, entry[0] + gap_us, side="left")) if entry else 0
        leader[:i] = entry[0] if entry else 0
        while i < len(t):
            j = int(np.searchsorted(t, t[i] + gap_us, side="left"))
            kept[i] = True
            leader[i:j] = t[i]
            i = j
        return {"kept": kept, "leader_us": leader}

    outputs = T.StructType([T.StructField("kept", T.BooleanType()), T.StructField("leader_us", T.LongType())])
    return Fold([us], summarize, _follow_steps, replay, outputs)


def hit_windows(width_us: int, us: str = "us") -> Fold:
    """Windows that open with their first row and last `width_us`: each row's place (`hit`) in its window.

    The state is (opening time, rows so far).
    """
    base = spacing(width_us, us)

    def summarize(rows: Rows) -> list[int]:
        t = rows[us].astype(np.int64, copy=False)
        steps = base.summarize(rows)
        exits = [steps[0], *steps[2::2]]
        counts = [len(t) if e == KEEP else len(t) - int(np.searchsorted(t, e, side="left")) for e in exits]
        return [len(exits), *counts, *steps]

    def follow(summary: list[int], state: list[int]) -> list[int]:
        k = summary[0]
        counts, steps = summary[1:1 + k], summary[1 + k:]
        at = _step_of(steps, state[:1])
        exit_ = ([steps[0], *steps[2::2]])[at]
        return [state[0], state[1] + counts[at]] if exit_ == KEEP else [exit_, counts[at]]

    def replay(rows: Rows, entry: list[int]) -> Rows:
        t = rows[us].astype(np.int64, copy=False)
        led = base.replay(rows, entry[:1])
        place = np.arange(len(t), dtype=np.int64)
        opened = np.maximum.accumulate(np.where(led["kept"], place, -1))
        before = entry[1] if entry else 0
        return {"leader_us": led["leader_us"], "hit": np.where(opened < 0, before + place + 1, place - opened + 1)}

    outputs = T.StructType([T.StructField("leader_us", T.LongType()), T.StructField("hit", T.LongType())])
    return Fold([us], summarize, follow, replay, outputs)


def sessions(idle_us: int, active_us: int, us: str = "us", closes: str = "closes", side: str | None = None,
             size: str | None = None, last_sizes: int = 100, last_gaps: int = 1000, gap_limit_us: int = 60 * MICROS) -> Fold:
    """Session name per row: cut after a closing row, after an idle gap, and by the active timeout.

    The row that passes the active timeout still belongs to the session it closes. A session is
    named by its first row: time and place among rows of the same time.

    With `side` (which end of the key sent the row) and `size` more is said per row: `forward` (same
    side as the session's first row), `gap_us` (time since the previous row of the session, -1 where
    it does not count) and whether the size and the gap are among the chunk's last ones of the
    session, so that bounded histories can be gathered from few rows.
    """
    # The state is (start time, part, time of the last row): the last shows an idle gap at a chunk edge.
    # A part is twice the first row's place among rows of its time, plus its side.

    def cuts(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = rows[us].astype(np.int64, copy=False)
        idle = np.zeros(len(t), dtype=bool)     # this row starts a session
        idle[1:] = np.diff(t) > idle_us
        stop = rows[closes].astype(bool, copy=False)  # the next row starts one
        return t, idle, stop

    def parts(t: np.ndarray, rows: Rows) -> np.ndarray:
        place = np.arange(len(t)) - np.searchsorted(t, t, side="left")
        return place * 2 + (rows[side].astype(np.int64) if side else 0)

    def alive(state: list[int], first: int) -> bool:
        return bool(state) and first - state[2] <= idle_us

    def limits(t: np.ndarray, idle: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """First row after i that a cut independent of the start forces into a new session."""
        n = len(t)
        hard = np.full(n + 1, n, dtype=np.int64)
        forced = idle.copy()
        forced[1:] |= stop[:-1]
        nxt = n
        for i in range(n - 1, -1, -1):
            hard[i] = nxt
            if forced[i]:
                nxt = i
        hard[n] = nxt                           # the first forced row of the chunk
        return hard

    def step(t: np.ndarray, start: int, after: int) -> tuple[int, bool]:
        """Row after the session that began at time `start`; `after` is the row it may end before."""
        over = int(np.searchsorted(t, start + active_us, side="right"))
        return (over + 1, True) if over + 1 <= after and over < len(t) else (after, False)

    def exits(t: np.ndarray, hard: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """First row of the session that is open at the end when row i starts one."""
        n = len(t)
        out = np.empty(n + 1, dtype=np.int64)
        out[n] = NONE
        for i in range(n - 1, -1, -1):
            nxt, closed = step(t, int(t[i]), int(hard[i]))
            if nxt < n:
                out[i] = out[nxt]
            else:
                out[i] = NONE if closed or stop[n - 1] else i
        return out

    def summarize(rows: Rows) -> list[int]:
        t, idle, stop = cuts(rows)
        hard = limits(t, idle, stop)
        out = exits(t, hard, stop)
        n, first = len(t), int(hard[len(t)])
        # Entry start s: row j is the first with t > s + active, if it lies before the forced row.
        uppers, values = [], []
        reach = int(np.searchsorted(t, t[0] + active_us, side="right")) + 1
        for j in range(min(first, reach)):
            if j and t[j] == t[j - 1]:
                continue
            uppers.append(int(t[j]) - active_us)
            values.append(int(out[j + 1]) if j + 1 < n else NONE)
        last = int(out[first]) if first < n else (NONE if stop[n - 1] else KEEP)
        steps, part = _pack([*uppers, END], [*values, last], int(out[0])), parts(t, rows)
        opened = [x for i in steps[::2] for x in ((int(t[i]), int(part[i])) if i >= 0 else (0, 0))]
        return [int(t[0]), int(t[-1]), len(steps), *steps, *opened]

    def follow(summary: list[int], state: list[int]) -> list[int]:
        steps, opened = summary[3:3 + summary[2]], summary[3 + summary[2]:]
        at = _step_of(steps, state[:1] if alive(state, summary[0]) else [])
        row = steps[2 * at]
        if row == KEEP:
            return [*state[:2], summary[1]]
        return [] if row == NONE else [*opened[2 * at:2 * at + 2], summary[1]]

    def replay(rows: Rows, entry: list[int]) -> Rows:
        t, idle, stop = cuts(rows)
        hard = limits(t, idle, stop)
        n, part = len(t), parts(t, rows)
        begin = np.full(n, -1, dtype=np.int64)  # first row of the session; -1: it began in an earlier chunk
        starts = [0]
        i = 0
        if alive(entry, int(t[0])):
            i, _ = step(t, entry[0], int(hard[n]))
        while i < n:
            nxt, _ = step(t, int(t[i]), int(hard[i]))
            begin[i:nxt] = i
            if i:
                starts.append(i)
            i = nxt
        began, part_of = (np.where(begin < 0, entry[k] if entry else 0, x[begin]) for k, x in enumerate((t, part)))
        out = {"session_us": began, "session_part": part_of // 2}
        if side:
            gap = np.diff(t, prepend=entry[2] if entry else t[0])
            first_rows = np.asarray(starts)[1:] if begin[0] < 0 else np.asarray(starts)
            gap[first_rows] = -1
            gap[(gap <= 0) | (gap >= gap_limit_us)] = -1
            heads, lengths = np.asarray(starts), np.diff([*starts, n])
            out |= {"forward": rows[side].astype(np.int64) == part_of % 2, "gap_us": gap,
                    "late_gap": _among_last(gap >= 0, heads, lengths, last_gaps),
                    "late_size": _among_last(~np.isnan(rows[size].astype(np.float64)), heads, lengths, last_sizes)}
        return out

    fields = [("session_us", T.LongType()), ("session_part", T.LongType())]
    if side:
        fields += [("forward", T.BooleanType()), ("gap_us", T.LongType()), ("late_gap", T.BooleanType()), ("late_size", T.BooleanType())]
    inputs = [us, closes, *([side, size] if side else [])]
    return Fold(inputs, summarize, follow, replay, T.StructType([T.StructField(n, k) for n, k in fields]))


def _among_last(counts: np.ndarray, heads: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Counted rows that are among the last n counted ones of their segment."""
    total = np.cumsum(counts)
    ends = total[heads + lengths - 1]
    return counts & (np.repeat(ends, lengths) - total < n)


# ---- piecewise maps ---------------------------------------------------------------------------

@dataclass
class Maps:
    """Functions of an integer in [0, full], one a node: from `start` on, x + value (slope 1) or value (slope 0)."""
    node: np.ndarray
    start: np.ndarray
    slope: np.ndarray
    value: np.ndarray

    def at(self, some: np.ndarray) -> Maps:
        return Maps(self.node[some], self.start[some], self.slope[some], self.value[some])

    def merged(self) -> Maps:
        """Without the pieces that go on as the one before."""
        new = np.ones(len(self.node), bool)
        new[1:] = (self.node[1:] != self.node[:-1]) | (self.slope[1:] != self.slope[:-1]) | (self.value[1:] != self.value[:-1])
        return self.at(new)


def bucket_maps(refill: np.ndarray, cost: np.ndarray, full: int) -> Maps:
    """For each row, the level after it from the level after the row before: refilled up to `full`, then lowered by the
    cost if it suffices."""
    n = len(refill)
    capped = np.maximum(full - refill, 0)                     # from here on the bucket is full
    enough = np.clip(cost - refill, 0, None)                  # from here on the row is allowed
    allowed = enough < capped
    start = np.stack([np.zeros(n, np.int64), np.where(allowed, enough, 0), capped], axis=1)
    slope = np.broadcast_to(np.array([1, 1, 0]), (n, 3))
    top = np.where(cost <= full, full - cost, full)
    value = np.stack([refill, refill - cost, top], axis=1)
    there = np.stack([np.where(allowed, enough > 0, capped > 0), allowed, np.ones(n, bool)], axis=1).ravel()
    return Maps(np.repeat(np.arange(n), 3)[there], start.ravel()[there], slope.ravel()[there], value.ravel()[there]).merged()


def _after(first: Maps, second: Maps, full: int) -> Maps:
    """`second` after `first`, node by node; both have the same nodes."""
    ends = np.r_[np.where(first.node[1:] != first.node[:-1], full + 1, first.start[1:]), full + 1] if len(first.node) else first.start
    low = np.where(first.slope == 1, first.start + first.value, first.value)
    high = np.where(first.slope == 1, ends - 1 + first.value, first.value)
    place = second.node * (full + 1) + second.start
    begin = np.searchsorted(place, first.node * (full + 1) + low, side="right") - 1
    count = np.searchsorted(place, first.node * (full + 1) + high, side="right") - begin
    row = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    hit = begin[row] + offset
    start = np.where(offset == 0, first.start[row], second.start[hit] - first.value[row])
    value = second.value[hit] + np.where(second.slope[hit] == 1, first.value[row], 0)
    return Maps(first.node[row], start, first.slope[row] & second.slope[hit], value).merged()


def composed(maps: Maps, nodes: int, full: int) -> Maps:
    """All nodes' functions one after the other, as a tree of pairs."""
    while nodes > 1:
        paired = maps.node < nodes - nodes % 2
        even, odd = maps.at(paired & (maps.node % 2 == 0)), maps.at(paired & (maps.node % 2 == 1))
        even.node, odd.node = even.node // 2, odd.node // 2
        rest, joined = maps.at(~paired), _after(even, odd, full)
        rest.node = rest.node // 2
        maps = Maps(*(np.concatenate([getattr(joined, f), getattr(rest, f)]) for f in ("node", "start", "slope", "value")))
        nodes = (nodes + 1) // 2
    return maps


def bucket_map(refill: np.ndarray, cost: np.ndarray, full: int) -> Maps:
    """The level after all rows from the level before them. Rows before the last that finds the bucket full whatever came
    before do not matter."""
    sure = np.flatnonzero(refill >= full)
    first = int(sure[-1]) if len(sure) else 0
    step = max(1, min(BLOCK_ROWS, 2**62 // (full + 1)))
    whole = None
    for i in range(first, len(refill), step):
        part = slice(i, i + step)
        block = composed(bucket_maps(refill[part], cost[part], full), len(refill[part]), full)
        whole = block if whole is None else _after(whole, block, full)
    return whole


# ---- state-carrying folds ---------------------------------------------------------------------

def token_bucket(rate: int | str, burst: int | str, us: str = "us", cost: str | None = None) -> Fold:
    """Token bucket with integer rate (tokens per second) and burst; a denied row takes nothing.

    Levels are exact integers in millionths of a token. `rate`, `burst` and `cost` may name columns
    (constant per key for the first two). The state is (level, time). A chunk's summary is the map from the level that
    its first row finds to the level that its last row leaves.
    """

    def numbers(rows: Rows) -> tuple[np.ndarray, np.ndarray, int, int]:
        t = rows[us].astype(np.int64, copy=False)
        c = rows[cost].astype(np.int64, copy=False) * MICROS if cost else np.full(len(t), MICROS, dtype=np.int64)
        r = int(rows[rate][0]) if isinstance(rate, str) else rate
        b = int(rows[burst][0]) if isinstance(burst, str) else burst
        return t, c, r, b * MICROS

    def replay(rows: Rows, entry: list[int]) -> Rows:
        t, c, r, full = numbers(rows)
        level, at = (entry[0], entry[1]) if entry else (full, int(t[0]))
        allowed = np.zeros(len(t), dtype=bool)
        for i, (ti, ci) in enumerate(zip(t.tolist(), c.tolist())):
            level += (ti - at) * r
            at = ti
            if level > full:
                level = full
            if level >= ci:
                level -= ci
                allowed[i] = True
        return {"allowed": allowed}

    def summarize(rows: Rows) -> list[int]:
        t, c, r, full = numbers(rows)
        pause = np.minimum(np.diff(t, prepend=t[0]), full // r + 1) if r else np.zeros(len(t), np.int64)
        found = bucket_map(np.minimum(pause * r, full), c, full)
        return [int(t[0]), int(t[-1]), r, full, *found.start.tolist(), *found.slope.tolist(), *found.value.tolist()]

    def follow(summary: list[int], state: list[int]) -> list[int]:
        first, last, r, full = summary[:4]
        k = (len(summary) - 4) // 3
        start, slope, value = (summary[4 + i * k:4 + (i + 1) * k] for i in range(3))
        level = min(full, state[0] + (first - state[1]) * r) if state else full
        at = int(np.searchsorted(start, level, side="right")) - 1
        return [level * slope[at] + value[at], last]

    named = [c for c in (rate, burst, cost) if isinstance(c, str)]
    return Fold([us, *named], summarize, follow, replay, T.StructType([T.StructField("allowed", T.BooleanType())]))


def _exits(play: Callable[[Rows, list[int]], tuple[np.ndarray, list[int]]], forgets: Callable[[Rows], bool], inputs: list[str], output: str) -> Fold:
    """A fold whose chunks say whether they forget their entry."""
    return Fold(inputs, lambda rows: [int(forgets(rows)), *play(rows, [])[1]], lambda summary, state: summary[1:],
                lambda rows, entry: {output: play(rows, entry)[0]}, T.StructType([T.StructField(output, T.BooleanType())]), run=lambda rows, entry: play(rows, entry)[1])


def sliding_window(window_us: int, limit: int | str, us: str = "us") -> Fold:
    """At most `limit` admitted rows in the trailing window; a row exactly as old as the window still counts.

    Denied rows are not recorded. The state is the times of the admitted rows still in the window.
    """

    def most_of(rows: Rows) -> int:
        return int(rows[limit][0]) if isinstance(limit, str) else limit

    def play(rows: Rows, entry: list[int]) -> tuple[np.ndarray, list[int]]:
        t, most = rows[us].astype(np.int64, copy=False), most_of(rows)
        admitted = list(entry)
        head, i = 0, 0
        allowed = np.zeros(len(t), dtype=bool)
        while i < len(t):
            while head < len(admitted) and admitted[head] < t[i] - window_us:
                head += 1
            room = most - (len(admitted) - head)
            if room > 0:  # so many rows are admitted whatever leaves meanwhile
                allowed[i:i + room] = True
                admitted += t[i:i + room].tolist()
                i += room
            elif most <= 0:
                break
            else:  # none before the oldest leaves
                i = max(i + 1, int(np.searchsorted(t, admitted[head] + window_us, side="right")))
        last = int(t[-1])
        return allowed, [x for x in admitted[head:] if x >= last - window_us]

    def forgets(rows: Rows) -> bool:
        t = rows[us].astype(np.int64, copy=False)
        if most_of(rows) <= 0:
            return True
        place = np.arange(len(t))
        begin = np.searchsorted(t, t - window_us, side="left")  # first row of each trailing window
        # sure to be admitted: no entry reaches the window, and it has fewer arrivals than the limit
        sure = (t >= t[0] + window_us) & (place - begin < most_of(rows))
        unsure = np.maximum.accumulate(np.where(sure, -1, place))
        return bool((begin > unsure).any())

    return _exits(play, forgets, [us, *([limit] if isinstance(limit, str) else [])], "allowed")


def spacing_with_quota(gap_us: int, window_us: int, quota: int, us: str = "us") -> Fold:
    """Greedy spacing that also admits at most `quota` rows per trailing window (strictly younger ones count).

    Where so many spaced rows never fit into a window, spacing alone decides.
    """
    if gap_us * quota >= window_us:
        spaced = spacing(gap_us, us)
        return Fold([us], spaced.summarize, spaced.follow, lambda rows, entry: {"kept": spaced.replay(rows, entry)["kept"]},
                    T.StructType([T.StructField("kept", T.BooleanType())]))

    def play(rows: Rows, entry: list[int]) -> tuple[np.ndarray, list[int]]:
        t = rows[us].astype(np.int64, copy=False)
        admitted = list(entry)
        head, i = 0, 0
        kept = np.zeros(len(t), dtype=bool)
        while i < len(t):
            now = int(t[i])
            while head < len(admitted) and admitted[head] <= now - window_us:
                head += 1
            if admitted and now - admitted[-1] < gap_us:
                i = max(i + 1, int(np.searchsorted(t, admitted[-1] + gap_us, side="left")))
            elif len(admitted) - head < quota:
                admitted.append(now)
                kept[i] = True
                i += 1
            elif quota <= 0:
                break
            else:
                i = max(i + 1, int(np.searchsorted(t, admitted[head] + window_us, side="left")))
        last = int(t[-1])
        left = [x for x in admitted[head:] if x > last - window_us]
        return kept, left or admitted[-1:]

    def forgets(rows: Rows) -> bool:
        t = rows[us].astype(np.int64, copy=False)
        n, place = len(t), np.arange(len(t))
        pause = np.diff(t, prepend=t[0])
        if quota <= 0 or (pause >= max(gap_us, window_us)).any():  # such a row is kept, and nothing else counts any more
            return True
        # kept whatever came before: after a pause, with a window that no entry reaches and fewer arrivals than the quota.
        # From there on spacing alone decides while windows have fewer arrivals, and one window later the state is known.
        begin = np.searchsorted(t, t - window_us, side="right")
        open_ = (place - begin < quota) & (t >= t[0] + window_us)
        known = np.flatnonzero(open_ & (pause >= gap_us))
        closed = np.r_[np.flatnonzero(~open_), n]
        until = closed[np.searchsorted(closed, known)]
        settled = np.searchsorted(t, t[known] + window_us, side="left")
        return bool((settled < until).any())

    return _exits(play, forgets, [us], "kept")


# ---- previous row of a key --------------------------------------------------------------------

def lag_by_chunks(df: DataFrame, keys: list[str], order: list[str], values: list[str], us: str = "us",
                  chunk_rows: int = CHUNK_ROWS, prefix: str = "prev_") -> DataFrame:
    """Previous row's values per key without sorting a hot key in one task.

    Cold keys use `lag`. Inside a chunk of a hot key so does every row but the first, which takes the
    last row of the key's previous chunk, found over one row per chunk.
    """
    packed = F.struct(*values)
    if hot_keys(df, keys, chunk_rows).isEmpty():
        lagged = df.withColumn("_p", F.lag(packed).over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        chunked = with_chunks(df, keys, us, hot_slots(df, keys, us, chunk_rows))
        tails = chunked.filter(F.col("_chunk").isNotNull()).groupBy(*keys, "_chunk").agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
        carried = tails.select(*keys, "_chunk", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"))
        filled = chunked.withColumn("_chunk", F.coalesce("_chunk", F.lit(-1).cast("bigint")))
        inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
        local = filled.withColumn("_prev", F.lag(packed).over(inside)).join(carried, [*keys, "_chunk"], "left")
        lagged = local.withColumn("_p", F.coalesce("_prev", "_carry"))
    return lagged.select(*df.columns, *[F.col(f"_p.{v}").alias(prefix + v) for v in values])
