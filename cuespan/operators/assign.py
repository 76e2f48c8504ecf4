"""Diverse assignment of candidates to the lines of a song, in line order.

Each choice depends on all earlier ones, so a song is one ordered pass. Only whole numbers travel to it, sorted: first the song's
lines with the slots already set (their times are needed ahead), then the candidates line by line, in Arrow batches. What a choice
asks, "does any other line show this part of this video", is answered from ordered ranges and searches in logarithmic time.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.functions.timecode import CLIP_MARGIN_MS
from cuespan.operators.ranges import Ranges, Tree
from cuespan.operators.timeline import FALLBACK_TAIL_MS

# Fixed value: how many lines back a repeated video is avoided.
LOOK_BACK = 4

#: Beyond any time.
ANY = 1 << 60

CHOICE_SCHEMA = "song_id bigint, line_no bigint, rank int, video_id bigint, clip_start_ms bigint, tier int"

Offer = tuple[int, int, int, int, int]


class Slot(NamedTuple):
    """A filled line: its place, the video, where the clip starts and how long it is, and the last start that later lines may show."""

    at: int
    video: int
    clip: int
    length: int
    last: int


def slot(at: int, video: int, clip: int, length: int, limit: int) -> Slot:
    return Slot(at, video, clip, length, (limit if limit > 0 else length + FALLBACK_TAIL_MS) - CLIP_MARGIN_MS)


class Pass:
    """What the lines of one song show while its empty lines are filled in order.

    A filled line shows its clip; lines after it play that clip on until the next filled one, and lines before the first filled one
    show its clip. Lines behind the pass do not change any more and are kept as ranges per video. Of the lines ahead, those up to
    the next slot play the current one on, and those behind later slots are known from the start.
    """

    def __init__(self, starts: np.ndarray, ends: np.ndarray, slots: Sequence[Slot]) -> None:
        self.starts, self.ends, self.slots, self.n = starts, ends, slots, len(starts)
        self.used: dict[int, Ranges] = defaultdict(Ranges)
        self.at, self.set, self.owner = 0, 0, None
        self.recent: deque[int | None] = deque(maxlen=LOOK_BACK)
        self.by_time, self.by_length = Tree(starts, ends), Tree(-starts, ends - starts)
        self.ahead: dict[int, tuple[Tree, dict[int, int]]] = {}
        for own in slots:
            self.used[own.video].add(own.clip, own.clip + own.length)
        self._look_ahead()

    def _look_ahead(self) -> None:
        """What lines behind slots that are set show, per video, to be given up as the pass reaches their slot."""
        parts = defaultdict(list)
        for own, after in zip(self.slots, [*self.slots[1:], None]):
            stop = self.n if after is None else after.at
            if stop > own.at + 1:
                parts[own.video].append((np.arange(own.at + 1, stop), self._played_on(own, own.at + 1, stop)))
        for video, shown in parts.items():
            lines = np.concatenate([lines for lines, _ in shown])
            clips = np.concatenate([clips for _, clips in shown])
            self.ahead[video] = Tree(clips, clips + self.ends[lines] - self.starts[lines]), dict(zip(lines.tolist(), range(len(lines))))

    def _played_on(self, own: Slot, first: int, stop: int) -> np.ndarray:
        clips = own.clip + self.starts[first:stop] - self.starts[own.at]
        return np.where(clips > own.last, max(0, own.last), clips)

    def _next(self) -> Slot | None:
        return self.slots[self.set] if self.set < len(self.slots) else None

    def _take(self, own: Slot) -> None:
        """``own`` is the slot that the lines after it show; as the first one, the lines before it show it too."""
        if self.owner is None:
            if own.at:
                self.used[own.video].add(own.clip, own.clip + int((self.ends[: own.at] - self.starts[: own.at]).max()))
            self.recent = deque((own.video for _ in self.recent), maxlen=LOOK_BACK)
        self.owner = own
        self.recent.append(own.video)
        self.at = own.at + 1

    def go_to(self, line: int) -> None:
        """Leave the lines before ``line`` behind."""
        while self.at < line:
            after = self._next()
            if after is not None and after.at == self.at:
                stop = self.slots[self.set + 1].at if self.set + 1 < len(self.slots) else self.n
                tree, rows = self.ahead.get(after.video, (None, None))
                for k in range(after.at + 1, stop):
                    tree.drop(rows[k])
                self.set += 1
                self._take(after)
                continue
            stop = min(line, self.n if after is None else after.at)
            if self.owner is not None:
                used, lengths = self.used[self.owner.video], self.ends[self.at : stop] - self.starts[self.at : stop]
                for clip, length in zip(self._played_on(self.owner, self.at, stop).tolist(), lengths.tolist()):
                    used.add(clip, clip + length)
            self.recent.extend([None if self.owner is None else self.owner.video] * min(LOOK_BACK, stop - self.at))
            self.at = stop

    def shown_before(self) -> set[int]:
        """Videos of the last lines."""
        first = self._next() if self.owner is None else None
        return {first.video if video is None and first else video for video in self.recent} - {None}

    def overlaps(self, video: int, start: int) -> bool:
        """Whether another line shows part of ``video`` within the time that the current line would play from ``start``."""
        i = self.at
        end = start + int(self.ends[i] - self.starts[i])
        if self.used[video].hits(start, end):
            return True
        after, own = self._next(), self.owner
        if own is not None and own.video == video:
            stop = self.n if after is None else after.at
            moved = own.clip - int(self.starts[own.at])
            if self.by_time.exists(i + 1, stop, min(end, own.last + 1) - moved, start - moved):
                return True
            held = max(0, own.last)
            if held < end and self.by_length.exists(i + 1, stop, moved - own.last, start - held):
                return True
        if own is None and after is not None and after.video == video and after.clip < end:
            if self.by_length.exists(0, i, ANY, start - after.clip) or self.by_length.exists(i + 1, after.at, ANY, start - after.clip):
                return True
        tree, _ = self.ahead.get(video, (None, None))
        return tree is not None and tree.exists(0, tree.size, end, start)

    def choose(self, offers: Sequence[Offer]) -> tuple[int, Offer]:
        """(tier, offer): fresh video without overlap, else no overlap, else the first."""
        recent = self.shown_before()
        second = None
        for offer in offers:
            if second is not None and offer[1] in recent:
                continue
            if not self.overlaps(offer[1], max(0, offer[2])):
                if offer[1] not in recent:
                    return 1, offer
                second = offer
        return (3, offers[0]) if second is None else (2, second)

    def fill(self, offer: Offer) -> None:
        i, (_, video, _, clip, limit) = self.at, offer
        length = int(self.ends[i] - self.starts[i])
        self._take(slot(i, video, clip, length, limit))
        self.used[video].add(clip, clip + length)

    def decide(self, line: int, offers: Sequence[Offer]) -> tuple[int, Offer] | None:
        """The choice for an empty line; None where a slot is set. Lines come in order."""
        self.go_to(line)
        after = self._next()
        if after is not None and after.at == line or not offers:
            return None
        chosen = self.choose(offers)
        self.fill(chosen[1])
        return chosen


TIMES = ["line_no", "start_ms", "end_ms", "slot_video_id", "slot_clip_ms", "slot_length_ms", "slot_limit_ms"]


class Song:
    """One song as its rows come in: lines first, then candidates."""

    def __init__(self, song_id: int) -> None:
        self.song_id, self.parts, self.numbers, self.run = song_id, [], None, None

    def add_lines(self, batch: pa.RecordBatch) -> None:
        self.parts.append([batch.column(c) for c in TIMES])

    def begin(self) -> None:
        columns = [pa.concat_arrays([part[i] for part in self.parts]) for i in range(len(TIMES))]
        set_lines = np.flatnonzero(columns[3].is_valid().to_numpy(zero_copy_only=False))
        whole = [c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
        self.parts, self.numbers = [], whole[0]
        slots = [slot(*row) for row in zip(set_lines.tolist(), *(c[set_lines].tolist() for c in whole[3:]))]
        self.run = Pass(whole[1], whole[2], slots)

    def decide(self, line_no: int, offered: list[dict]) -> tuple[int, int, int, int, int, int] | None:
        if self.run is None:
            self.begin()
        place = int(np.searchsorted(self.numbers, line_no))
        if place == len(self.numbers) or self.numbers[place] != line_no:
            return None
        chosen = self.run.decide(place, [tuple(o.values()) for o in offered])
        if chosen is None:
            return None
        tier, (rank, video, _, clip, _) = chosen
        return self.song_id, line_no, rank, video, clip, tier


def assign_songs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by song, lines before candidates, line number: the choices."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    names = ["song_id", "line_no", "rank", "video_id", "clip_start_ms", "tier"]
    song = None
    for batch in batches:
        # Runs of one song and one kind of row.
        keys = np.stack([batch.column("song_id").to_numpy(), batch.column("kind").to_numpy()])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        out = []
        for first, stop in zip(cuts, cuts[1:]):
            if first == stop:
                continue
            part = batch.slice(first, stop - first)
            if song is None or song.song_id != int(keys[0, first]):
                song = Song(int(keys[0, first]))
            if keys[1, first] == 0:
                song.add_lines(part)
                continue
            for line_no, offered in zip(part.column("line_no").to_pylist(), part.column("candidates").to_pylist()):
                chosen = song.decide(line_no, offered) if song.parts or song.run else None
                if chosen is not None:
                    out.append(chosen)
        columns = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def assign_candidates(lines: DataFrame, slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """Chosen candidate per empty line: (song_id, line_no, rank, video_id, clip_start_ms, tier).

    candidates: (song_id, line_no, rank, video_id, t_ms, clip_start_ms, limit_ms): overlap is
    judged at ``t_ms``, the slot plays from ``clip_start_ms``; ``limit_ms`` is the source
    length or 0. Slots already set stay and count.
    """
    offered = candidates.groupBy("song_id", "line_no").agg(
        F.array_sort(F.collect_list(F.struct("rank", "video_id", "t_ms", "clip_start_ms", F.coalesce("limit_ms", F.lit(0).cast("bigint")).alias("limit_ms")))).alias("candidates")
    )
    own = slots.select(
        "song_id", F.col("slot_no").alias("line_no"), F.col("video_id").alias("slot_video_id"), F.col("clip_start_ms").alias("slot_clip_ms"),
        F.col("clip_duration_ms").alias("slot_length_ms"), F.col("video_duration_ms").alias("slot_limit_ms"),
    )
    times = lines.select("song_id", "line_no", "start_ms", "end_ms").join(own, ["song_id", "line_no"], "left")
    rows = times.withColumn("kind", F.lit(0)).unionByName(offered.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.where(F.col("song_id").isNotNull())
    # A fixed number of partitions: the pass is bound by computing, not by bytes, so small ones are not merged.
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "song_id").sortWithinPartitions("song_id", "kind", "line_no").mapInArrow(assign_songs, CHOICE_SCHEMA)
