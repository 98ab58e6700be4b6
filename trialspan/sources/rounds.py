"""A source of synthetic rounds, bounded or streaming: seeded bits of a declared width for each stream and round.

Streaming, a micro-batch takes the next `step` rounds of all streams. Its offset is one number, the
last round; rows are made in the tasks, a partition for each group of `group` streams and for each
`chunk` rounds of it, so the driver holds no row however many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "stream_id long, round_index long, bits long"


def bits_of(seed: int, stream: int, index: int, width: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}|{stream}|{index}".encode()).digest()[:8], "big") >> (64 - width)


class Part(InputPartition):
    """Streams and rounds, both from the first to the last."""

    def __init__(self, streams: tuple[int, int], rounds: tuple[int, int]):
        self.streams, self.rounds = streams, rounds


class _Options:
    def __init__(self, options: dict[str, str]):
        self.streams, self.rounds = int(options.get("streams", 1)), int(options.get("rounds", 10))
        self.width, self.seed, self.step = int(options.get("width", 8)), int(options.get("seed", 0)), int(options.get("step", 4))
        self.group, self.chunk = int(options.get("group", 16)), int(options.get("chunk", 100_000))

    def parts(self, first: int, last: int) -> list[Part]:
        """The rounds first to last of all streams."""
        return [Part((s, min(s + self.group, self.streams) - 1), (r, min(r + self.chunk - 1, last))) for s in range(0, self.streams, self.group) for r in range(first, last + 1, self.chunk)]

    def read(self, part: Part) -> Iterator[tuple[int, int, int]]:
        for stream in range(part.streams[0], part.streams[1] + 1):
            yield from self.rows(stream, *part.rounds)

    def rows(self, stream: int, first: int, last: int) -> Iterator[tuple[int, int, int]]:
        for k in range(first, last + 1):
            yield stream, k, bits_of(self.seed, stream, k, self.width)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = _Options(options)

    def partitions(self) -> list[Part]:
        return self.o.parts(1, self.o.rounds)

    def read(self, part: Part) -> Iterator[tuple[int, int, int]]:
        yield from self.o.read(part)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.o, self.at = _Options(options), 0

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        """A step further than the last partitions asked for, until all rounds are out."""
        return {"round": min(self.at + self.o.step, self.o.rounds)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = max(self.at, end["round"])
        return self.o.parts(start["round"] + 1, end["round"])

    def read(self, part: Part) -> Iterator[tuple[int, int, int]]:
        yield from self.o.read(part)

    def commit(self, end: dict) -> None:
        """Nothing waits for this: a round can be made again at any time."""
        self.at = max(self.at, end["round"])


class RoundSource(DataSource):
    """format("rounds") with options streams, rounds, width, seed, and for streaming step, group and chunk."""

    @classmethod
    def name(cls) -> str:
        return "rounds"

    def schema(self) -> str | StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))
