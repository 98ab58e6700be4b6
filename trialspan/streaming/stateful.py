"""Operators with keyed state: stores with reference holds, lifetimes, timers that can be cancelled, layouts that grow.

Each is a processor for one key; its state is kept by Spark, in maps and values of that key, and
leaves it as soon as nothing more can come of it. Within a micro-batch the rows of a key are taken
in the order stated; micro-batches follow each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

from trialspan.session import by_value

_MICROS = 1_000_000


def _named(stream: DataFrame, key: str) -> str:
    return f"`{key}` {stream.schema[key].dataType.simpleString()}"


def _processed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str, time: str) -> DataFrame:
    """The rows of each key through the processor."""
    with by_value(__name__):
        return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, time)


class _Map:
    """A map state read once and written back once a micro-batch."""

    def __init__(self, state):
        self.state, self.now, self.touched = state, {}, set()

    def get(self, k):
        if k not in self.now:
            self.now[k] = tuple(self.state.getValue((k,))) if self.state.containsKey((k,)) else None
        return self.now[k]

    def put(self, k, value) -> None:
        self.now[k] = value
        self.touched.add(k)

    def flush(self) -> None:
        for k in self.touched:
            if self.now[k] is not None:
                self.state.updateValue((k,), self.now[k])
            elif self.state.containsKey((k,)):
                self.state.removeKey((k,))


class _Holds(StatefulProcessor):
    """Rounds with the tick they were stored at and how many hold them; holders with the rounds they name."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rounds = handle.getMapState("rounds", "round long", "stored long, held long")
        self.holders = handle.getMapState("holders", "holder string", "rounds string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rounds, holders, freed = _Map(self.rounds), _Map(self.holders), []

        def attach(names, tick) -> None:
            for r in names:
                stored, held = rounds.get(r) or (-1, 0)
                rounds.put(r, (stored, held + 1))

        def detach(names, tick) -> None:
            for r in names:
                stored, held = rounds.get(r)
                rounds.put(r, (stored, held - 1))
                settle(r, tick)

        def settle(r, tick) -> None:
            stored, held = rounds.get(r)
            if held == 0:  # nobody needs it: a round that is there goes, one that is not is forgotten
                rounds.put(r, None)
                if stored >= 0:
                    freed.append((key[0], r, stored, tick))

        def named(holder) -> list[int]:
            value = holders.get(holder)
            return [int(r) for r in value[0].split(",") if r] if value else []

        for op in pd.concat(rows).sort_values(["tick", "place"]).itertuples():
            names = [] if op.rounds is None else [int(r) for r in op.rounds]
            if op.op == "store":
                rounds.put(names[0], (op.tick, (rounds.get(names[0]) or (-1, 0))[1]))
            elif op.op == "register":
                holders.put(op.holder, (",".join(map(str, names)),))
                attach(names, op.tick)
            elif op.op == "replace":
                before = named(op.holder)
                holders.put(op.holder, (",".join(map(str, names)),))
                attach([r for r in names if r not in before], op.tick)
                detach([r for r in before if r not in names], op.tick)
            elif op.op == "transfer":
                holders.put(op.other, holders.get(op.holder))
                holders.put(op.holder, None)
            elif op.op == "release":
                before = named(op.holder)
                holders.put(op.holder, None)
                detach(before, op.tick)
            elif op.op == "drop" and rounds.get(names[0]):
                settle(names[0], op.tick)
        rounds.flush()
        holders.flush()
        yield pd.DataFrame(freed, columns=[self.key, "round", "stored", "freed"])

    def close(self) -> None:
        pass


def round_holds(ops: DataFrame, key: str) -> DataFrame:
    """(key, round, stored, freed): rounds of a store as their last hold lets them go.

    ops (key, tick, place, op, holder, other, rounds): `store` puts the first of rounds there;
    `register` makes a holder hold rounds, stored yet or not; `replace` points it to others;
    `transfer` moves its hold to the holder in other, and frees nothing; `release` ends it; `drop`
    frees the first of rounds if nobody holds it. Ops of a key are taken by tick and place, and
    micro-batches must come in that order. State is what is stored or held now, so a store whose
    holds are all released is empty. A holder that holds nothing may be released; it frees nothing.
    """
    return _processed(ops, key, _Holds(key), f"{_named(ops, key)}, round long, stored long, freed long", "append", "None")


def hold_lifetimes(stream: DataFrame, key: str, kind: Column, time: str, idle_ms: int, late: str) -> DataFrame:
    """(key, lifetime): from the first row whose kind is 0 (stored) to the last whose kind is 1 (released), in microseconds; null where one is missing, absent where negative.

    The rows of a key are a session that ends where none comes for idle_ms and as long as rows may be late; it is given and
    forgotten once the watermark is past that. Rows without a key are left out.
    """
    rows = stream.withWatermark(time, late).select(key, time, kind.cast("int").alias("kind"), F.unix_micros(time).alias("tick"))
    gap = F.when(F.col(key).isNotNull(), f"{late} {idle_ms} milliseconds").otherwise("0 seconds")  # Spark drops sessions of no length, after they moved the watermark
    first, last = F.min(F.when(F.col("kind") == 0, F.col("tick"))), F.max(F.when(F.col("kind") == 1, F.col("tick")))
    out = rows.groupBy(key, F.session_window(time, gap)).agg((last - first).alias("lifetime"))
    return out.select(key, "lifetime").where("lifetime is null or lifetime >= 0")


def fired_timers(timers: DataFrame, cancels: DataFrame, key: str, made: str, due: str, at: str, late: str, keep_ms: int) -> DataFrame:
    """(key, due): timers of a stream (key, made, due) that no row of the stream cancels (key, at) stops before they are due.

    Both have a watermark, and the earlier one counts. A timer is a session from when it is made until just before it is due, and
    a cancel one of keep_ms: sessions of a key that meet are one, in which the timer made last counts and the first cancel stops
    it. So a timer that is set anew before it is due takes the place of the first, a cancel may come before its timer and is
    remembered for keep_ms, and a timer fires when the watermark passes the end of its session. Rows without a key are left out.
    """
    nothing = F.lit(None).cast("long")
    sets = timers.withWatermark(made, late).select(key, F.col(made).alias("t"), F.unix_millis(due).alias("due"), nothing.alias("at"), F.greatest(F.unix_micros(due) - F.unix_micros(made) - 1, F.lit(1)).alias("life"))
    ends = cancels.withWatermark(at, late).select(key, F.col(at).alias("t"), nothing.alias("due"), F.unix_millis(at).alias("at"), F.lit(keep_ms * 1000).cast("long").alias("life"))
    life = F.when(F.col(key).isNotNull(), F.coalesce("life", F.lit(0))).otherwise(0)  # Spark drops sessions of no length, after they moved the watermark
    session = F.session_window("t", F.concat(life.cast("string"), F.lit(" microseconds")))
    last = F.max(F.when(F.col("due").isNotNull(), F.struct("t", "due")))["due"]
    out = sets.union(ends).groupBy(key, session).agg(last.alias("due"), F.min("at").alias("at"))
    return out.where("due is not null and (at is null or at >= due)").select(key, F.timestamp_millis("due").alias("due"))


class _Layout(StatefulProcessor):
    def __init__(self, key: str, first: int, most: int):
        self.key, self.first, self.most = key, first, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "next long, region long, lo long, length long")
        self.ahead = handle.getMapState("ahead", "round long", "cut boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, region, lo, n = self.head.get() if self.head.exists() else (self.first, 0, self.first, 0)
        came = {int(r): bool(c) for frame in rows for r, c in zip(frame["round"], frame["cut"], strict=True) if r >= at}
        laid = []
        while True:
            if at in came:
                cut = came.pop(at)
            elif self.ahead.containsKey((at,)):
                cut = self.ahead.getValue((at,))[0]
                self.ahead.removeKey((at,))
            else:
                break
            lo, n = (at, 1) if n == 0 else (lo, n + 1)
            closed = cut or n == self.most
            if closed:
                laid.append((key[0], region, lo, at, True))
                region, n = region + 1, 0
            at += 1
        if n:
            laid.append((key[0], region, lo, at - 1, False))
        for r, cut in came.items():
            self.ahead.updateValue((r,), (cut,))
        self.head.update((at, region, lo, n))
        yield pd.DataFrame(laid, columns=[self.key, "region", "lo", "hi", "closed"])

    def close(self) -> None:
        pass


def growing_regions(stream: DataFrame, key: str, index: str, cut: Column, most: int, first: int = 0) -> DataFrame:
    """(key, region, lo, hi, closed): regions of up to `most` rounds laid while the stream grows, each ended early by a round with a cut.

    A region is given when it begins to be filled, and again, longer, as it grows; closed when a
    cut or its length ends it, after which it never changes. Keep the longest of each region. Rounds may come in any
    order and more than once: state is the open region and the rounds beyond a gap.
    """
    rows = stream.select(key, F.col(index).cast("long").alias("round"), F.coalesce(cut, F.lit(False)).alias("cut"))
    return _processed(rows, key, _Layout(key, first, most), f"{_named(stream, key)}, region long, lo long, hi long, closed boolean", "append", "None")


def _packed(frame: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


class _Bucket(StatefulProcessor):
    """Many keys as one: two frames of them are the state, and one timer is set for what is due first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "one binary, other binary")

    def _due(self, one: pd.DataFrame, other: pd.DataFrame) -> int | None:
        raise NotImplementedError

    def _known(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        one, other = map(_unpacked, self.state.get())
        return one, other

    def _keep(self, one: pd.DataFrame, other: pd.DataFrame, timer: int | None) -> None:
        """Keeps what there is, with a timer in place of the one that is set."""
        due = self._due(one, other)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.state.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.state.update((_packed(one), _packed(other)))

    def close(self) -> None:
        pass


#: What a bucket is for rows without a key.
_KEYLESS = -1


def _bucketed(stream: DataFrame, key: str, buckets: int) -> list[Column]:
    """(__bucket, key) of rows; keys that are whole numbers without nulls, with which pandas makes them floats."""
    kind = stream.schema[key].dataType
    bucket = F.when(F.col(key).isNull(), _KEYLESS).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    return [bucket.alias("__bucket"), F.coalesce(key, F.lit(0).cast(kind)).alias(key) if isinstance(kind, IntegralType) else F.col(key)]


class _Releases(_Bucket):
    """Windows (key, lo, hi, met) and facts (key, lo, hi, fact) of one bucket: both stay until the watermark is past hi."""

    def __init__(self, key: str):
        self.key = key

    def _due(self, windows: pd.DataFrame, facts: pd.DataFrame) -> int | None:
        ends = [int(x["hi"].min()) for x in (windows, facts) if len(x)]
        return min(ends) // 1000 + 1 if ends else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(rows)
        begun = came["fact"].isna()
        windows, facts = came.loc[begun, [self.key, "lo", "hi"]].assign(met=False), came.loc[~begun, [self.key, "lo", "hi", "fact"]]
        if key[0] == _KEYLESS:  # nothing is a fact about them
            facts = facts[:0]
        held, timer, met = 0, None, []
        if self.state.exists():
            known, kept = self._known()
            held, timer = len(known), self._due(known, kept)
            met.append(self._met(known, facts))
            windows, facts = pd.concat([known, windows]), pd.concat([kept, facts])
        windows = windows.reset_index(drop=True)
        met.append(self._met(windows[held:], facts))
        for pairs in met:
            windows.loc[pairs["index"], "met"] = True
            yield pairs[[self.key, "fact"]]
        self._keep(windows, facts, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        windows, facts = self._known()
        past = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        lost = windows[(windows["hi"] < past) & ~windows["met"]]
        self._keep(windows[windows["hi"] >= past], facts[facts["hi"] >= past], None)
        yield pd.DataFrame({self.key: None if key[0] == _KEYLESS else lost[self.key], "fact": None}, index=lost.index)

    def _met(self, windows: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        pairs = windows.reset_index().merge(facts, on=self.key, suffixes=("", "_fact"))
        return pairs[(pairs["lo_fact"] >= pairs["lo"]) & (pairs["lo_fact"] <= pairs["hi"])]


def pending_releases(windows: DataFrame, facts: DataFrame, key: str, begun: str, at: str, value: str, kind: str, within: str, before: str, late: str, buckets: int = 512) -> DataFrame:
    """(key, kind, value): what came of each held window, one row for each fact about it, and one of nulls if its time went by without any.

    An outer join of two watermarked streams: facts (key, at, kind, value) count from `before` ahead of
    the window's begin to `within` after it, so both sides leave the state when the watermark is past that. Keys are
    joined a bucket at a time, by columns, as Spark's own join of streams goes to its state several times for each row:
    the state of a bucket must fit into a task.
    """
    early, long, never = F.expr(f"interval {before}"), F.expr(f"interval {within}"), F.lit(1 << 62)
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    w = windows.withWatermark(begun, late).select(*_bucketed(windows, key, buckets), F.col(begun).alias("t"), F.coalesce(F.unix_micros(F.col(begun) - early), never).alias("lo"), F.coalesce(F.unix_micros(F.col(begun) + long), never).alias("hi"), F.lit(None).cast("string").alias("fact"))
    f = facts.withWatermark(at, late).where(F.col(at).isNotNull()).select(*_bucketed(facts, key, buckets), F.col(at).alias("t"), F.unix_micros(at).alias("lo"), F.unix_micros(F.col(at) + early).alias("hi"), F.to_json(F.struct(F.col(kind).alias("kind"), F.col(value).alias("value")), exact).alias("fact"))
    out = _processed(w.union(f), "__bucket", _Releases(key), f"{_named(windows, key)}, fact string", "append", "EventTime")
    fact = F.from_json("fact", f"kind {facts.schema[kind].dataType.simpleString()}, value {facts.schema[value].dataType.simpleString()}", exact)
    return out.select(key, fact.alias("f")).select(key, F.col("f.kind").alias(kind), F.col("f.value").alias(value))


class _Assembly(_Bucket):
    """Keys of one bucket: of each what it needs, when its time is over and whether it is done, and the fragments of those that are not."""

    def __init__(self, key: str, patience: int):
        self.key, self.patience = key, patience

    def _due(self, heads: pd.DataFrame, parts: pd.DataFrame) -> int | None:
        return int(heads["due"].min()) if len(heads) else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == _KEYLESS:  # they only move the watermark
            return
        came = pd.concat(rows)
        heads = came.groupby(self.key, sort=False).agg(need=("total", "max"), due=("at", "max")).reset_index()
        heads["due"] += self.patience
        heads["done"] = False
        parts, timer = came.loc[came["whole"], [self.key, "fragment"]], None
        if self.state.exists():
            known, kept = self._known()
            timer = self._due(known, kept)
            heads = pd.concat([known, heads]).groupby(self.key, sort=False).max().reset_index()
            parts = pd.concat([kept, parts]) if len(kept) else parts
        parts = parts[~parts[self.key].isin(heads[self.key][heads["done"]])].drop_duplicates()
        have = self._have(heads, parts)
        full = ~heads["done"] & (have >= heads["need"])
        heads["done"] |= full
        self._keep(heads, parts[~parts[self.key].isin(heads[self.key][full])], timer)
        yield self._given(heads, have, full, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        heads, parts = self._known()
        over = heads["due"] <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        have = self._have(heads, parts)
        self._keep(heads[~over], parts[~parts[self.key].isin(heads[self.key][over])], None)
        yield self._given(heads, have, over & ~heads["done"], False)

    def _have(self, heads: pd.DataFrame, parts: pd.DataFrame) -> pd.Series:
        return heads[self.key].map(parts.groupby(self.key).size()).fillna(0).astype("int64")

    def _given(self, heads: pd.DataFrame, have: pd.Series, which: pd.Series, complete: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: heads[self.key][which], "have": have[which], "need": heads["need"][which], "complete": complete})


def assembled(stream: DataFrame, key: str, fragment: str, total: str, time: str, late: str, patience_ms: int, buckets: int = 512) -> DataFrame:
    """(key, have, need, complete): a key as soon as so many different fragments have come as any of its rows says, once.

    Its fragments leave the state then; a mark that it is done, and what is incomplete, leave it when the watermark
    is patience_ms past the key's latest row, and incomplete keys are given then. Keys are taken a bucket at a time, by columns:
    its state and the rows it gets in a micro-batch must fit into a task.
    """
    whole = F.col(fragment).isNotNull()
    rows = stream.withWatermark(time, late).select(*_bucketed(stream, key, buckets), time, whole.alias("whole"), F.coalesce(F.col(fragment).cast("long"), F.lit(0)).alias("fragment"), F.coalesce(F.col(total).cast("long"), F.lit(0)).alias("total"), F.unix_millis(time).alias("at"))
    return _processed(rows, "__bucket", _Assembly(key, patience_ms), f"{_named(stream, key)}, have long, need long, complete boolean", "append", "EventTime")


class _Bounded(StatefulProcessor):
    """What is stored, how much room that takes, and a line of what waits, by its place from head to tail."""

    def __init__(self, key: str, room: int):
        self.key, self.room = key, room

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getMapState("stored", "round long", "bits long")
        self.line = handle.getMapState("line", "place long", "round long, bits long, arrived long")
        self.place = handle.getMapState("place", "round long", "place long")
        self.ends = handle.getValueState("ends", "taken long, head long, tail long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken, head, tail = self.ends.get() if self.ends.exists() else (0, 0, 0)
        stored, line, place, out = _Map(self.stored), _Map(self.line), _Map(self.place), []
        for op in pd.concat(rows).sort_values(["tick", "place"]).itertuples():
            if op.op == "store":
                line.put(tail, (int(op.round), int(op.bits), int(op.tick)))
                place.put(op.round, (tail,))
                tail += 1
            elif stored.get(op.round) is not None:
                taken -= stored.get(op.round)[0]
                stored.put(op.round, None)
            elif place.get(op.round) is not None:  # let go before there was room for it
                line.put(place.get(op.round)[0], None)
                place.put(op.round, None)
            while head < tail:  # the line moves in order; who does not fit holds up all behind
                first = line.get(head)
                if first is not None:
                    r, bits, arrived = first
                    if taken + bits > self.room:
                        break
                    taken += bits
                    stored.put(r, (bits,))
                    line.put(head, None)
                    place.put(r, None)
                    out.append((key[0], r, arrived, int(op.tick)))
                head += 1
        for state in (stored, line, place):
            state.flush()
        if taken or head < tail:
            self.ends.update((taken, head, tail))
        elif self.ends.exists():
            self.ends.clear()
        yield pd.DataFrame(out, columns=[self.key, "round", "arrived", "admitted"])

    def close(self) -> None:
        pass


def bounded_store(ops: DataFrame, key: str, room: int) -> DataFrame:
    """(key, round, arrived, admitted): rounds as a store of so many bits takes them in; the difference is how long they were held back.

    ops (key, tick, place, op, round, bits): `store` brings a round, which waits in line while it
    does not fit; `release` frees it, and the line moves up at that tick. A round that is released
    while it waits leaves the line. Ops of a key are taken by tick and place, and micro-batches must come in that order.
    """
    return _processed(ops, key, _Bounded(key, room), f"{_named(ops, key)}, round long, arrived long, admitted long", "append", "None")
