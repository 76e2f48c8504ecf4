"""Diverse assignment over a stream of prompts: state per song, in line order.

Of a song are kept: the line expected next and the last videos (one value), the clip ranges used so far (a map by video and minute,
whose entries hold the disjoint ranges that reach into the minute), and lines that came early (a map by line). A batch reads and
writes only the entries it touches, so neither its work nor any value grows with the song.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cuespan.operators.assign import LOOK_BACK
from cuespan.operators.ranges import Ranges

OUTPUT = "song_id bigint, line_no bigint, rank int, video_id bigint, clip_start_ms bigint, tier int"
PROGRESS = "next_line bigint, recent array<bigint>, waiting bigint, wake_ms bigint"
USED_KEY, USED = "video_id bigint, part bigint", "starts array<bigint>, ends array<bigint>"
EARLY_KEY, EARLY = "line_no bigint", "length_ms bigint, ranks array<bigint>, videos array<bigint>, times array<bigint>"
IDLE_MS = 6 * 3_600_000
WAIT_MS = 60_000
#: Length of the stretches of a video that used ranges are kept by.
PART_MS = 60_000

Offer = tuple[int, int, int]


class Song:
    """One song's progress, with all it needs in memory."""

    def __init__(self, state: tuple | None) -> None:
        line, recent, videos, starts, ends, early = state or (0, [], [], [], [], "{}")
        self.next_line, self.recent = int(line), [int(v) for v in recent]
        self.used: dict[int, Ranges] = defaultdict(Ranges)
        for video, start, end in zip(videos, starts, ends):
            self.used[int(video)].add(int(start), int(end))
        self.early: dict[int, tuple[int, list[Offer]]] = {int(k): (v[0], [tuple(o) for o in v[1]]) for k, v in json.loads(early).items()}

    def state(self) -> tuple:
        spans = [(v, s, e) for v, ranges in self.used.items() for s, e in zip(ranges.starts, ranges.ends)]
        return (
            self.next_line, self.recent, [x[0] for x in spans], [x[1] for x in spans], [x[2] for x in spans], json.dumps(self.early),
        )

    def is_used(self, video: int, start: int, end: int) -> bool:
        return self.used[video].hits(start, end)

    def use(self, video: int, start: int, end: int) -> None:
        self.used[video].add(start, end)

    def take(self, line: int) -> tuple[int, list[Offer]] | None:
        """A line that has come, given up here."""
        return self.early.pop(line, None)

    def choose(self, length: int, offers: list[Offer]) -> tuple[int, Offer]:
        open_offers = [o for o in offers if not self.is_used(o[1], max(0, o[2]), max(0, o[2]) + length)]
        fresh = [o for o in open_offers if o[1] not in self.recent]
        if fresh:
            return 1, fresh[0]
        return (2, open_offers[0]) if open_offers else (3, offers[0])

    def advance(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Decide every line that is next in order."""
        while (line := self.take(self.next_line)) is not None:
            length, offers = line
            if offers:
                tier, (rank, video, time) = self.choose(length, offers)
                start = max(0, time)
                self.use(video, start, start + length)
                self.recent = [*self.recent, video][-LOOK_BACK:]
                yield self.next_line, rank, video, start, tier
            elif self.recent:
                # A line without offers shows the last clip played on.
                self.recent = [*self.recent, self.recent[-1]][-LOOK_BACK:]
            self.next_line += 1


class StoredSong(Song):
    """A song whose used ranges and early lines stay in the state store; ``early`` holds the batch's own lines."""

    def __init__(self, progress, used, early) -> None:  # noqa: ANN001 - handles of the state store
        super().__init__(None)
        self.progress, self.ranges, self.stored = progress, used, early
        line, recent, self.waiting, self.wake = progress.get() or (0, [], 0, None)
        self.next_line, self.recent = int(line), [int(v) for v in recent]
        self.parts: dict[tuple[int, int], Ranges] = {}
        self.changed: set[tuple[int, int]] = set()

    def _part(self, key: tuple[int, int]) -> Ranges:
        if key not in self.parts:
            self.parts[key] = ranges = Ranges()
            for start, end in zip(*(self.ranges.getValue(key) or ([], []))):
                ranges.add(int(start), int(end))
        return self.parts[key]

    def is_used(self, video: int, start: int, end: int) -> bool:
        return any(self._part((video, part)).hits(start, end) for part in range(start // PART_MS, end // PART_MS + 1))

    def use(self, video: int, start: int, end: int) -> None:
        for part in range(start // PART_MS, end // PART_MS + 1):
            self._part((video, part)).add(start, end)
            self.changed.add((video, part))

    def take(self, line: int) -> tuple[int, list[Offer]] | None:
        own = super().take(line)
        if own is None and self.waiting and self.stored.containsKey((line,)):
            length, *offers = self.stored.getValue((line,))
            self.stored.removeKey((line,))
            self.waiting -= 1
            own = int(length), [tuple(map(int, o)) for o in zip(*offers)]
        return own

    def skip(self) -> None:
        """Go on with the earliest line at hand."""
        if self.waiting:
            self.next_line = max(self.next_line, min(int(key[0]) for key in self.stored.keys()))

    def save(self, wake: int | None) -> None:
        for line, (length, offers) in self.early.items():
            if line < self.next_line:
                continue
            self.waiting += not (self.waiting and self.stored.containsKey((line,)))
            self.stored.updateValue((line,), (length, *([o[i] for o in offers] for i in range(3))))
        for key in self.changed:
            self.ranges.updateValue(key, (self.parts[key].starts.tolist(), self.parts[key].ends.tolist()))
        self.progress.update((self.next_line, self.recent, self.waiting, wake))


class AssignInOrder(StatefulProcessor):
    def __init__(self, idle_ms: int | None, wait_ms: int | None) -> None:
        self.idle_ms, self.wait_ms = idle_ms, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", PROGRESS)
        self.used = handle.getMapState("used", USED_KEY, USED)
        self.early = handle.getMapState("early", EARLY_KEY, EARLY)

    def _load(self) -> StoredSong:
        return StoredSong(self.progress, self.used, self.early)

    def _advance(self, song_id: int, song: StoredSong, timerValues, woken: bool) -> pd.DataFrame:  # noqa: ANN001
        out = [(song_id, *row) for row in song.advance()]
        wake = None
        if self.idle_ms is not None:
            # One timer per song: until a missing line is given up, or until the song counts as over.
            if song.wake is not None and not woken:
                self.handle.deleteTimer(song.wake)
            late = song.waiting or any(line >= song.next_line for line in song.early)
            wake = timerValues.getCurrentProcessingTimeInMs() + (self.wait_ms if late else self.idle_ms)
            self.handle.registerTimer(wake)
        song.save(wake)
        return pd.DataFrame(out, columns=["song_id", "line_no", "rank", "video_id", "clip_start_ms", "tier"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        song = self._load()
        for part in rows:
            for line, length, offered in zip(part["line_no"], part["length_ms"], part["candidates"]):
                offers = sorted((int(c["rank"]), int(c["video_id"]), int(c["t_ms"])) for c in offered)
                song.early[int(line)] = (int(length), offers)
        yield self._advance(key[0], song, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A missing line is given up; a song without missing lines has been idle and is forgotten."""
        song = self._load()
        if song.waiting:
            song.skip()
            yield self._advance(key[0], song, timerValues, True)
        else:
            for state in (self.progress, self.used, self.early):
                state.clear()
            yield pd.DataFrame([], columns=["song_id", "line_no", "rank", "video_id", "clip_start_ms", "tier"])

    def close(self) -> None:
        pass


def assign_stream(prompts: DataFrame, *, timed: bool = True, idle_ms: int = IDLE_MS, wait_ms: int = WAIT_MS) -> DataFrame:
    """prompts: (song_id, line_no, length_ms, candidates array<struct<rank, video_id, t_ms>>), lines counted from 0.

    Needs the RocksDB state store. ``timed`` is for continuous triggers: idle songs expire
    and missing lines are given up after a while. Without it (a run over what is available
    now, which timers would keep going for ever) late lines are waited for.
    """
    logic = AssignInOrder(idle_ms, wait_ms) if timed else AssignInOrder(None, None)
    return prompts.groupBy("song_id").transformWithStateInPandas(logic, OUTPUT, "append", "ProcessingTime" if timed else "None")
