"""State machines of tracks, one observation at a time; batch folds and streams run the same steps.

An observation is a dict of a frame; a state is a small dict that steps replace. Robot overlap alone never ends a track,
an evaluation frame is never a check, and a missing candidate is no proof of absence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.sequences import cooldown as spaced_frames
from trackloom.operators.sequences import ordered_fold


def termination(misses: Column, empty: Column, tiny: Column, severe: Column, presence: Column, checks: int = 3, frames: int = 3) -> Column:
    """Why a track ends, null if it goes on; without ``checks`` misses in a row it always does."""
    return F.when(misses >= checks, F.when(empty >= frames, "lost_empty_no_detector_support").when(tiny, "suspected_out_of_view_residue").when(severe & (presence < 0.5), "lost_unreliable_no_detector_support"))


def why_ended(misses: int, empty: int, tiny: bool, severe: bool, presence: float) -> str | None:
    """The same rule for one observation."""
    if misses < 3:
        return None
    if empty >= 3:
        return "lost_empty_no_detector_support"
    if tiny:
        return "suspected_out_of_view_residue"
    return "lost_unreliable_no_detector_support" if severe and presence < 0.5 else None


def check_due(offset: Column, is_eval: Column, searching: Column, warned: Column, grid: int = 5, period: int = 15) -> Column:
    """Reasons to look for candidates at a frame, as an array: on the grid, never at an evaluation frame, at the start always."""
    reasons = F.array_compact(F.array(F.when(offset % period == 0, "periodic_identity_check"), F.when(searching, "unseeded_or_terminated_search"), F.when(warned, "temporal_or_overlap_warning")))
    empty = F.array().cast("array<string>")
    return F.when(offset == 0, F.array(F.lit("initial"))).when((offset % grid != 0) | is_eval, empty).otherwise(reasons)


def new_track() -> dict:
    return {"active": False, "ever": False, "misses": 0, "empty": 0, "segment": 0, "verified": None, "pending": None, "last_check": None}


#: What a check of the recovery loop finds, and what follows: an action and its reason. The reasons are fixed values of the review format.
OUTCOMES = {
    "nothing seen": ("keep", "no_candidate_unknown"),
    "lost": ("terminate", None),
    "first sight": ("seed", "first_visible_candidate"),
    "seen again": ("seed", "reacquire"),
    "in doubt": ("seed", "candidate_disagreement_or_temporal_anomaly"),
    "confirmed": ("keep", "candidate_supports_track"),
}
#: Agreement of track and candidate below which the track is in doubt.
AGREEMENT = 0.25


def situation(t: dict, o: dict, ended: str | None) -> str:
    """A key of OUTCOMES."""
    if not o["candidate"]:
        return "lost" if ended and t["active"] else "nothing seen"
    if not t["active"]:
        return "seen again" if t["ever"] else "first sight"
    agrees = o["agreement"] is not None and o["agreement"] >= AGREEMENT
    return "confirmed" if agrees and not (o["severe"] or o["tiny"]) else "in doubt"


def recover(t: dict, o: dict) -> tuple[dict, str, str]:
    """One check of the causal recovery loop: (state, action, reason) of seed, keep or terminate.

    ``o``: candidate, tiny, severe, presence, empty, agreement (IoU of track and candidate, None without).
    """
    t = dict(t, empty=t["empty"] + 1 if o["empty"] else 0, misses=0 if o["candidate"] else t["misses"] + 1)
    ended = why_ended(t["misses"], t["empty"], o["tiny"], o["severe"], o["presence"])
    action, reason = OUTCOMES[situation(t, o, ended)]
    if action == "seed":
        t |= {"active": True, "ever": True, "empty": 0, "segment": t["segment"] + 1}
    elif action == "terminate":
        t["active"] = False
    return t, action, reason or ended or ""


def guard(t: dict, o: dict, mode: str) -> tuple[dict, str, str]:
    """One check under admission: guarded_replace seeds what is admitted, guarded_all also clears tracks that 30 frames didn't verify, assisted follows prompts.

    ``o``: frame_idx, first (the window's first frame), candidate, admitted, agreement, prompt (visible, other, or None).
    """
    if mode == "assisted":
        if o["prompt"] is None:
            return t, "keep", "no_check"
        seed = o["prompt"] == "visible"
        return dict(t, active=seed), "seed" if seed else "clear_unknown", "assistant_" + o["prompt"]
    allowed, reason = o["admitted"], "admitted" if o["admitted"] else "rejected"
    if mode == "guarded_replace" and o["first"]:
        allowed, reason = o["candidate"], "baseline_initialization"
    if allowed:
        t = dict(t, verified=o["frame_idx"])
        if not t["active"] or o["agreement"] is None or o["agreement"] < 0.25:
            return dict(t, active=True), "seed", reason
        return t, "keep", reason
    if mode == "guarded_all" and t["active"] and o["frame_idx"] - (t["verified"] if t["verified"] is not None else o["frame_idx"] - 30) >= 30:
        return dict(t, active=False), "clear_unknown", "unverified_track_expired"
    return t, "keep", reason


def dense(df: DataFrame, stream: list[str], cooldown: int = 10, least: float = 0.50) -> DataFrame:
    """The dense driver: (stream, object_id, frame_idx, action, reason, active, segment) of every observation.

    An object that three key frames in a row had no detection of, and that is a tiny residue of low presence, ends at that frame. A frame off the key frames on which any object that
    goes on has a serious anomaly makes the detector look again at all objects, at most every ``cooldown`` frames of the stream, whichever objects asked; those
    of them that have an anomaly, a detection and at least the confidence ``least`` start anew. The rule is one for the stream, so the frames
    to look at are a cooldown of the stream's frames, and the rest are running counts of each object: nothing is folded row by row.

    Rows: stream, object_id, frame_idx, keyframe, hit, tiny, severe, presence, confidence; nulls of conditions are false. Keys aren't null.
    """
    own = W.partitionBy(*stream, "object_id").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0)

    def true(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    key, hit, tiny = true(F.col("keyframe")), true(F.col("hit")), true(F.col("tiny"))
    x = df.select(*stream, "object_id", "frame_idx", key.alias("keyframe"), hit.alias("hit"), tiny.alias("tiny"), (true(F.col("severe")) | tiny).alias("odd"), "presence", "confidence")
    x = x.withColumn("streak", F.sum((F.col("keyframe") & F.col("hit")).cast("int")).over(own))
    misses = F.sum((F.col("keyframe") & ~F.col("hit")).cast("int")).over(W.partitionBy(*stream, "object_id", "streak").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("ends", (misses >= 3) & F.col("tiny") & true(F.col("presence") < 0.5))
    asked = x.where(F.col("odd") & ~F.col("ends") & ~F.col("keyframe"))
    looks = spaced_frames(asked, stream, "frame_idx", cooldown).select(*[F.col(k).alias(f"{k}_") for k in stream], F.col("frame_idx").alias("__at"), F.lit(True).alias("look"))
    x = x.join(looks, [*[F.col(k) == F.col(f"{k}_") for k in stream], F.col("frame_idx") == F.col("__at")], "left")
    looked = true(F.col("look")) & F.col("odd") & ~F.col("ends")
    seed = looked & F.col("hit") & true(F.col("confidence") >= least)
    # the names are fixed values of the event format
    x = x.withColumn("action", F.when(F.col("ends"), "terminate").when(seed, "seed").otherwise("keep"))
    x = x.withColumn("reason", F.when(F.col("ends"), "low_presence_border_residue_termination").when(seed, "redetect_reseed").when(looked, "anomaly_without_candidate").otherwise("tracked"))
    active = F.last(F.when(F.col("action") != "keep", F.col("action") == "seed"), ignorenulls=True).over(own)
    return x.select(*stream, "object_id", "frame_idx", "action", "reason", true(active).alias("active"), F.sum((F.col("action") == "seed").cast("int")).over(own).cast("int").alias("segment"))


#: What a check of the two-arm trial finds, and what follows; both arms share the first seed, later ones restart the recovery arm only. The names are fixed values of the event format.
TRIAL = {
    "nothing new": ("keep", "no_change"),
    "lost": ("terminate", None),
    "first confirmed": ("seed", "initial_seed_shared"),
    "confirmed while gone": ("seed", "reentry_reseed"),
    "confirmed elsewhere": ("seed", "suspicious_reseed"),
}
PERIOD, SEARCH, CONFIRMATION, SUPPORT = 15, 5, 0.25, 0.30


def trial_situation(t: dict, o: dict, confirmed: bool, ended: str | None) -> str:
    """A key of TRIAL."""
    odd = o["severe"] or o["tiny"] or (o["agreement"] or 0.0) < SUPPORT
    if confirmed and (odd or not t["active"]):
        return ("confirmed elsewhere" if t["active"] else "confirmed while gone") if t["ever"] else "first confirmed"
    return "lost" if ended and t["active"] else "nothing new"


def paired(t: dict, o: dict, due: bool = True) -> tuple[dict, str, str]:
    """One frame of an object in the two-arm trial; only at a frame that is due its candidate counts.

    A candidate is confirmed by the one of an earlier check, at most PERIOD frames back, at IoU CONFIRMATION. ``o`` as for recover(), with frame_idx and
    confirm (IoU with the last candidate). ``empty`` counts all frames.
    """
    t = dict(t, empty=t["empty"] + 1 if o["empty"] else 0)
    if not due:
        return t, "keep", "no_check"
    before, t["pending"] = t["pending"], o["frame_idx"] if o["candidate"] else None
    confirmed = bool(o["candidate"]) and before is not None and 0 < o["frame_idx"] - before <= PERIOD and (o["confirm"] or 0.0) >= CONFIRMATION
    t["misses"] = 0 if o["candidate"] else t["misses"] + 1
    ended = why_ended(t["misses"], t["empty"], o["tiny"], o["severe"], o["presence"])
    action, reason = TRIAL[trial_situation(t, o, confirmed, ended)]
    if action == "seed":
        t |= {"active": True, "ever": True, "empty": 0, "segment": t["segment"] + 1}
    elif action == "terminate":
        t["active"] = False
    return t, action, reason or ended or ""


def trial(df: DataFrame, stream: list[str]) -> DataFrame:
    """(stream, object_id, frame_idx, action, reason, active, segment) of the two-arm trial, in which all objects of a stream share their checks.

    A frame is due each PERIOD frames, and SEARCH frames after the last check if an object there has an anomaly or no track. A stream's frames are streamed in order; the state is a small dict an object.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = [*stream, "object_id", "frame_idx"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", action string, reason string, active boolean, segment int"

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        tracks: dict = {}
        last = None
        for frame, group in groupby(rows, key=lambda o: o["frame_idx"]):
            seen = list(group)  # the objects of one frame
            for o in seen:
                tracks.setdefault(o["object_id"], new_track())
            idle = any(o["severe"] or o["tiny"] or not tracks[o["object_id"]]["active"] for o in seen)
            due = frame % PERIOD == 0 or (idle and (last is None or frame - last >= SEARCH))
            last = frame if due else last
            for o in seen:
                t, action, reason = paired(tracks[o["object_id"]], o, due)
                tracks[o["object_id"]] = t
                yield {**{k: o[k] for k in keys}, "action": action, "reason": reason, "active": t["active"], "segment": t["segment"]}

    return ordered_fold(df, stream, ["frame_idx", "object_id"], fold, schema)


Step = Callable[[dict, dict], tuple[dict, str, str]]


def run(df: DataFrame, keys: list[str], step: Step, order: str = "frame_idx") -> DataFrame:
    """(keys, order, action, reason, active, segment) of every observation, each group's in order."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, order]) + ", action string, reason string, active boolean, segment int"

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        t = new_track()
        for o in rows:
            t, action, reason = step(t, o)
            yield {**{k: o[k] for k in [*keys, order]}, "action": action, "reason": reason, "active": t["active"], "segment": t["segment"]}

    return ordered_fold(df, keys, [order], fold, schema)
