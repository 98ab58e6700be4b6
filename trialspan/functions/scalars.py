"""Scalar expressions: ticks and clocks, spans, decibel bins, keys, units, rates, frames.

One tick is a picosecond; ticks are longs and turn into microseconds only at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_A_MICROSECOND = 1_000_000

#: Unit, dimension, factor to the base unit (ticks, cycles, decibels, hertz, bits).
UNITS = {
    "ps": ("time", 1.0),
    "ns": ("time", 1e3),
    "us": ("time", 1e6),
    "ms": ("time", 1e9),
    "s": ("time", 1e12),
    "cycles": ("cycles", 1.0),
    "cycle": ("cycles", 1.0),
    "dB": ("level", 1.0),
    "Hz": ("rate", 1.0),
    "kHz": ("rate", 1e3),
    "MHz": ("rate", 1e6),
    "GHz": ("rate", 1e9),
    "bits": ("size", 1.0),
    "bytes": ("size", 8.0),
}


def to_microseconds(ticks: Column) -> Column:
    return ticks / F.lit(float(TICKS_A_MICROSECOND))


def to_ticks(microseconds: Column) -> Column:
    """Rounded half up."""
    return F.floor(microseconds * TICKS_A_MICROSECOND + 0.5).cast("long")


def span_microseconds(end: Column, start: Column) -> Column:
    return to_microseconds(end - start)


def clock_edge(now: Column, period: Column | int, cycles: Column | int = 0) -> Column:
    """The clock edge at or after now, and so many cycles later."""
    period = F.lit(period) if isinstance(period, int) else period
    cycles = F.lit(cycles) if isinstance(cycles, int) else cycles
    return (F.ceil(now / period).cast("long") + cycles) * period


def cycles_over(span: Column, period: Column | int) -> Column:
    """Whole cycles that cover a span."""
    period = F.lit(period) if isinstance(period, int) else period
    return F.ceil(span / period).cast("long")


def decibels_to_nats(x: Column) -> Column:
    return x * F.lit(math.log(10.0) / 10.0)


def nats_to_decibels(x: Column) -> Column:
    return x * F.lit(10.0 / math.log(10.0))


def decibel_bin(gap_nats: Column, step: float = 0.1) -> Column:
    """Low edge of the bin; infinity keeps its own bin and null stays null."""
    per = round(1.0 / step)
    infinite = F.abs(gap_nats) == F.lit(float("inf"))
    return F.when(infinite, gap_nats).otherwise(F.floor(F.when(~infinite, nats_to_decibels(gap_nats)) * per) / F.lit(float(per)))


def edge_bin(x: Column, edges: list[float]) -> Column:
    """Index of the half-open bin of ascending edges that holds x, closed at a last infinite edge; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        upper = (x <= F.lit(edges[k + 1])) if math.isinf(edges[k + 1]) and k == len(edges) - 2 else (x < F.lit(edges[k + 1]))
        out = F.when((x >= F.lit(edges[k])) & upper, F.lit(k)).otherwise(out)
    return out


def hop(path: Column, source_window: Column) -> Column:
    """`boundary` where the relation names a source window, else the path."""
    return F.when(source_window.isNotNull(), F.lit("boundary")).otherwise(path)


def waiting_window(path: Column, source_window: Column, destination: Column, owner: Column) -> Column:
    return F.when(source_window.isNotNull(), destination).otherwise(owner)


def request_ordinal(source_window: Column, ordinal: Column) -> Column:
    return F.when(source_window.isNull(), ordinal)


def hop_start(delivery: Column, total_delay: Column) -> Column:
    return delivery - total_delay


def is_copy(copy_into: Column) -> Column:
    return copy_into.isNotNull()


def within(round_index: Column, first: int | None, last: int | None) -> Column:
    """Whether a round lies in a closed interval with open ends for None."""
    out = F.lit(True)
    if first is not None:
        out = out & (round_index >= first)
    if last is not None:
        out = out & (round_index <= last)
    return out


def holds(selection: dict[str, str]) -> Column:
    """All columns equal the given text."""
    out = F.lit(True)
    for name, text in selection.items():
        out = out & (F.col(name).cast("string") == text)
    return out


def whole(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def bit_text(bits: Column) -> Column:
    """Bits as `0101`, which a JSON string keeps with its leading zeros."""
    return F.array_join(F.transform(bits, lambda b: b.cast("string")), "")


def json_cell(entries: Column) -> Column:
    """A map as compact JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def identity_bytes(kind: Column, value: Column) -> Column:
    """A type-tagged, length-framed text of an identity, so that 1 and "1" differ."""
    return F.concat(kind, F.lit(":"), F.length(value).cast("string"), F.lit(":"), value)


def nested_identity(*parts: Column) -> Column:
    """An identity made of identities: how many, then each with its length, so that no two nestings have one text. A null part is `-`."""
    framed = (F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts)
    return F.concat(F.lit(f"tuple:{len(parts)}:"), *framed)


def identity_parts(identity: Column) -> Column:
    """The parts of a nested identity as an array, null for what is no nested identity."""
    head = F.regexp_extract(identity, r"^tuple:(\d+):", 0)
    begin = F.struct(F.substring(identity, F.length(head) + 1, F.length(identity)).alias("rest"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, _: Column) -> Column:
        absent = a["rest"].startswith("-")
        size = F.regexp_extract(a["rest"], r"^(\d+):", 1)
        n, at = size.try_cast("int"), F.length(size) + 2
        part = F.when(~absent, F.substring(a["rest"], at, n))
        rest = F.when(absent, F.substring(a["rest"], F.lit(2), F.length(a["rest"]))).otherwise(F.substring(a["rest"], at + n, F.length(a["rest"])))
        return F.struct(rest.alias("rest"), F.concat(a["parts"], F.array(part)).alias("parts"))

    many = F.regexp_extract(identity, r"^tuple:(\d+):", 1).try_cast("int")
    return F.when(head != "", F.when(many > 0, F.aggregate(F.sequence(F.lit(1), many), begin, step)["parts"]).otherwise(F.array().cast("array<string>")))


def content_id(**columns: Column) -> Column:
    """sha256 of the columns' compact JSON, keys in the order of names whatever the order they are given in."""
    return F.sha2(F.to_json(F.struct(*(columns[name].alias(name) for name in sorted(columns)))), 256)


def range_of(text: Column) -> tuple[Column, Column]:
    """(low, high) of `lo..hi`; one number is both."""
    low = F.regexp_extract(text, r"^(-?\d+)", 1)
    high = F.regexp_extract(text, r"(-?\d+)$", 1)
    return low.try_cast("long"), high.try_cast("long")


def covers(ranges: Column, key: Column, index: Column) -> Column:
    """Whether a map key -> `lo..hi` covers index under key."""
    low, high = range_of(F.try_element_at(ranges, key))
    return F.coalesce(low <= index, F.lit(False)) & F.coalesce(index <= high, F.lit(False))


def requests_window(request: Column, key: Column) -> Column:
    return request.startswith(F.concat(key, F.lit(":")))


def unit_value(text: Column, dimension: str) -> Column:
    """`29ns`, `3 cycles`, `20dB` in the base unit of the dimension; null for another dimension or no number."""
    number = F.regexp_extract(text, r"^\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([A-Za-z]+)\s*$", 1)
    factor = F.lit(None).cast("double")
    for name, (of, scale) in UNITS.items():
        if of == dimension:
            factor = F.when(unit == name, F.lit(scale)).otherwise(factor)
    return number * factor


def floored_line(intercept: Column, per_iteration: Column, fastest: Column, iterations: Column) -> Column:
    return F.greatest(intercept + per_iteration * iterations, fastest)


def per_round_rate(shot_rate: Column, rounds: Column) -> Column:
    """The rate e of independent flips whose odd count has the shot rate; above one half by the complement."""
    low = lambda p: -F.expm1(F.log1p(-2.0 * p) / rounds) / 2.0
    return F.when(shot_rate <= 0.5, low(F.least(shot_rate, F.lit(0.5 - 1e-300)))).otherwise(1.0 - low(F.least(1.0 - shot_rate, F.lit(0.5))))


def merged_probability(p: Column, q: Column) -> Column:
    return p * (1.0 - q) + q * (1.0 - p)


def link_price(bits: Column, latency: Column, bits_a_cycle: Column, setup: Column, header_bits: Column) -> Column:
    """Cycles that a transfer takes: latency, set-up and the whole words of payload and header."""
    return latency + setup + F.ceil((bits + header_bits) / bits_a_cycle).cast("long")


def over_base(override: Column, base: Column) -> Column:
    return F.coalesce(override, base)


def frames(kind: str, bits: Column, width: int = 64, header: int = 0, payload: int = 256) -> Column:
    """Bits of the frames that a message is cut into.

    whole: one frame with a header. flits: one frame of whole flits, at least one. pcie: chunks of
    payload bytes padded to 4 and 24 bytes more. ethernet: chunks of payload bytes, 46 at least,
    and 38 bytes more. udp: ethernet chunks that hold 28 header bytes too. aurora: one frame of
    66-bit blocks of 8 bytes, with one block more.
    """
    octets = F.ceil(bits / 8).cast("long")

    def chunked(room: int, size) -> Column:
        n = F.greatest(F.ceil(octets / room).cast("long"), F.lit(1).cast("long"))
        return F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: size(F.least(F.lit(room).cast("long"), octets - (k - 1) * room)))

    if kind == "whole":
        return F.array(bits + header)
    if kind == "flits":
        return F.array(F.greatest(F.ceil(bits / width).cast("long"), F.lit(1).cast("long")) * width)
    if kind == "pcie":
        return chunked(payload, lambda b: (F.ceil(b / 4).cast("long") * 4 + 24) * 8)
    if kind == "ethernet":
        return chunked(payload, lambda b: (F.greatest(b, F.lit(46).cast("long")) + 38) * 8)
    if kind == "udp":
        return chunked(payload - 28, lambda b: (F.greatest(b + 28, F.lit(46).cast("long")) + 38) * 8)
    if kind == "aurora":
        return F.array((F.floor(octets / 8).cast("long") + 1) * 66)
    raise ValueError(f"no framing {kind}")


def seed_of(*parts: Column) -> Column:
    """A seed for a row, the same on every run: the first 15 hex digits of a sha256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")


def json_number(text: Column) -> Column:
    """A number as JSON holds it, and any other number as its exact text in quotes, so no two values share an identity."""
    return F.when(text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), text).when(text.isNotNull(), F.concat(F.lit('"'), text, F.lit('"')))
