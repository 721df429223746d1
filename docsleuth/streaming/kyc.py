"""Liveness sessions as streams: frame features, challenges as keyed state, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docsleuth.functions import scalars as X
from docsleuth.operators.identity import MATCH

CHALLENGES = ["turn_left", "turn_right", "nod", "blink"]
RECENT, LEAST_FRAMES, TTL_MS = 20, 3, 30 * 60 * 1000
LEFT, RIGHT, NOD = 0.62, 0.38, 0.28
EVENT = "session_id string, frame_no bigint, status string, challenge string, passed int, similarity double"
#: The frames of a challenge that a blink is judged by, beside the recent ones.
FIRST = 5
#: Keys of the state; each holds the open sessions of its hash.
BUCKETS = 4096


def frame_features(points: str = "points", box: str = "bbox", extra: DataFrame | None = None) -> dict[str, Column]:
    """From five key points (left eye, right eye, nose, left and right mouth corner) and a box x1, y1, x2, y2."""
    p, b = F.col(points), F.col(box)
    at = lambda i, c: F.get(p, i)[c]
    width, height = F.greatest(b["x2"] - b["x1"], F.lit(1.0)), F.greatest(b["y2"] - b["y1"], F.lit(1.0))
    eye_x, eye_y = (at(0, "x") + at(1, "x")) / 2, (at(0, "y") + at(1, "y")) / 2
    apart = F.greatest(F.hypot(at(1, "x") - at(0, "x"), at(1, "y") - at(0, "y")), F.lit(1.0))
    return {"nose_rel_x": (at(2, "x") - b["x1"]) / width, "nose_rel_y": (at(2, "y") - b["y1"]) / height, "yaw": (at(2, "x") - eye_x) / apart, "pitch": (at(2, "y") - eye_y) / apart}


def challenge_passed(kind: str, frames: list[dict], gone: int = 0, low: tuple[float, float] = (np.inf, np.inf)) -> bool:
    """L02-L05 over a challenge's frames so far: the FIRST ones and the RECENT ones, and of those gone between them the number and the least ear and det_score."""
    n = len(frames) + gone
    if n < LEAST_FRAMES:
        return False
    recent = frames[-RECENT:]
    if kind == "turn_left":
        return max(f["nose_rel_x"] for f in recent) >= LEFT
    if kind == "turn_right":
        return min(f["nose_rel_x"] for f in recent) <= RIGHT
    if kind == "nod":
        pitch = [f["pitch"] for f in recent]
        return n >= 6 and max(pitch) - min(pitch) >= NOD
    if kind == "blink" and n >= 8:
        ear, score = [f["ear"] for f in frames], [f["det_score"] for f in frames]
        if sum(ear[:FIRST]) / FIRST > 0.18 and min(low[0], *ear[FIRST:]) < 0.15 and sum(ear[-5:]) / 5 > 0.18:
            return True
        base = max(score[:FIRST])
        return base >= 0.88 and min(low[1], *score[FIRST:]) < 0.94 * base and sum(score[-5:]) / 5 >= 0.96 * base
    return False


class Session(StatefulProcessor):
    """The number of passed challenges and the current one's frames, a bounded number of them.

    When the last challenge has passed, a session with a reference embedding completes if the frame's own embedding is as similar as face_match()
    asks, else it fails; one without completes. A session without frames for half an hour expires, and what is kept of a
    finished one goes by the same timer.

    A key with state of its own costs some milliseconds of calls between Python and the state store, and most sessions have few frames. So the keys are
    buckets of sessions: a bucket's list of open sessions is read and written once a batch, and its timer is the earliest of theirs.
    """

    #: What challenge_passed() looks at; kept frames are these values, one frame after the other.
    NAMES = ("nose_rel_x", "pitch", "ear", "det_score")
    STATE = "session_id string, n int, done boolean, gone int, ear double, score double, until bigint, frames array<double>"
    NEW = (0, False, 0, np.inf, np.inf, 0, ())

    def __init__(self, challenges: list[str]):
        self.challenges = challenges

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("sessions", self.STATE)

    def finished(self, similarity: float | None) -> str:
        """L07."""
        return "completed" if similarity is None or similarity >= MATCH else "failed"

    def followed(self, session_id: str, rows: list[Row], state: tuple) -> tuple[list[Row], tuple]:
        """The events of a session's next frames, and its state after them."""
        n, done, gone, ear, score, until, kept = state
        low, width, out = (ear, score), len(self.NAMES), []
        history = [dict(zip(self.NAMES, kept[i : i + width], strict=True)) for i in range(0, len(kept), width)]
        for row in sorted(rows, key=lambda r: r["frame_no"]):
            if done:
                break
            history.append({c: row[c] for c in self.NAMES})
            kind = self.challenges[n]
            if challenge_passed(kind, history, gone, low):
                n, history, gone, low = n + 1, [], 0, (np.inf, np.inf)
                done = n == len(self.challenges)
                similarity = row["similarity"] if done else None
                status = self.finished(similarity) if done else "challenge_passed"
                out.append(Row(session_id=session_id, frame_no=row["frame_no"], status=status, challenge=kind, passed=n, similarity=similarity))
            elif len(history) > FIRST + RECENT:
                old = history.pop(FIRST)
                gone, low = gone + 1, (min(low[0], old["ear"]), min(low[1], old["det_score"]))
        frames = [] if done else [f[c] for f in history for c in self.NAMES]
        return out, (n, done, gone, *low, max(until, max(r["at_ms"] for r in rows) + TTL_MS), frames)

    def kept(self) -> dict[str, tuple]:
        return {session_id: tuple(state) for session_id, *state in self.open.get()}

    def keep(self, states: dict[str, tuple]) -> None:
        if states:
            self.open.put([(session_id, *state) for session_id, state in states.items()])
            self.handle.registerTimer(min(until for *_, until, _ in states.values()))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        incoming: dict[str, list[Row]] = {}
        for row in rows:
            incoming.setdefault(row["session_id"], []).append(row)
        states, out = self.kept(), []
        if states:
            self.handle.deleteTimer(min(until for *_, until, _ in states.values()))
        for session_id, own in incoming.items():
            found, states[session_id] = self.followed(session_id, own, states.get(session_id, self.NEW))
            out += found
        self.keep(states)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now, states = timerValues.getCurrentWatermarkInMs(), self.kept()
        out = [Row(session_id=session_id, frame_no=-1, status="expired", challenge="", passed=n, similarity=None) for session_id, (n, done, *_, until, _) in states.items() if until <= now and not done]
        self.keep({session_id: state for session_id, state in states.items() if state[-2] > now})
        return iter(out)

    def close(self) -> None:
        pass


def compared(frame: Column, reference: Column) -> Column:
    """The similarity of a frame's embedding to the reference; null without a reference, 0 if the frame has none of that length."""
    alike = F.when(F.size(frame) == F.size(reference), X.dot(frame.cast("array<double>"), reference.cast("array<double>")))
    return F.when(F.size(reference) > 0, F.coalesce(alike, F.lit(0.0)))


def sessions(frames: DataFrame, challenges: list[str] | None = None) -> DataFrame:
    """Events of a stream of frames, by session; ts, a timestamp, drives the expiry. Frames may have an embedding and their session's reference embedding.

    Embeddings are compared before the keyed state, so none of them is shuffled or kept.
    """
    both = {"embedding", "reference"} <= set(frames.columns)
    similarity = compared(F.col("embedding"), F.col("reference")) if both else F.lit(None).cast("double")
    seen = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in Session.NAMES]
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    timed = frames.withWatermark("ts", "10 minutes").select(bucket, "session_id", "frame_no", *seen, "ts", F.unix_millis("ts").alias("at_ms"), similarity.alias("similarity"))
    return timed.groupBy("bucket").transformWithState(Session(challenges or CHALLENGES), EVENT, "Append", "EventTime")


def with_references(frames: DataFrame, entities: DataFrame, key: str = "entity_ref", vector: str = "embedding") -> DataFrame:
    """A stream of frames with their people's reference embeddings, from the table of entities, before any keyed state.

    The table is read anew for every micro-batch; frames of unknown people have no reference. Of several rows of a person the one with the greatest
    embedding counts, so that no frame is doubled.
    """
    known = entities.groupBy(F.col(key).alias("__ref")).agg(F.max(vector).alias("reference"))
    return frames.drop("reference").join(known, F.col(key) == F.col("__ref"), "left").drop("__ref")


def first_passes(frames: DataFrame) -> DataFrame:
    """W14, L02-L04 for a table of frames: per session the first frame at which each window challenge passes."""
    w = Window.partitionBy("session_id").orderBy("frame_no").rowsBetween(-(RECENT - 1), 0)
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("frame_no"))
    marked = frames.withColumns({"n": n, "hi": F.max("nose_rel_x").over(w), "lo": F.min("nose_rel_x").over(w), "span": F.max("pitch").over(w) - F.min("pitch").over(w)})
    first = lambda c: F.min(F.when(c & (F.col("n") >= LEAST_FRAMES), F.col("frame_no")))
    return marked.groupBy("session_id").agg(first(F.col("hi") >= LEFT).alias("turn_left"), first(F.col("lo") <= RIGHT).alias("turn_right"), first((F.col("span") >= NOD) & (F.col("n") >= 6)).alias("nod"), F.count(F.lit(1)).alias("n_frames"))
