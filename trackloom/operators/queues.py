"""Work queues, review requests, and deterministic choices of episodes, clips and splits."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.functions.boxes import stable_seed

MAX_ATTEMPTS = 3


def status_rollup(jobs: DataFrame) -> DataFrame:
    """Jobs by status."""
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def task_progress(jobs: DataFrame) -> DataFrame:
    """Jobs and finished jobs by task."""
    return jobs.groupBy("task_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "done").alias("done"))


def finished_episodes(jobs: DataFrame) -> DataFrame:
    """Episodes whose every job is done."""
    return jobs.groupBy("episode_id").agg(F.min((F.col("status") == "done").cast("int")).alias("all_")).where("all_ = 1").select("episode_id")


def latest(jobs: DataFrame, n: int = 100) -> DataFrame:
    """The n jobs updated last, ties by id."""
    return jobs.orderBy(F.desc("updated"), "job_id").limit(n)


def next_jobs(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The pending jobs that n workers claim next: by priority, then id."""
    return jobs.where("status = 'pending'").orderBy("priority", "job_id").limit(n)


def priorities(jobs: DataFrame, audited: Column) -> DataFrame:
    """Adds rank: 0 for audited episodes, 10 for the first episode of a task and side, else 20."""
    first = F.row_number().over(W.partitionBy("task_id", "side").orderBy("episode_id", "job_id")) == 1
    return jobs.withColumn("rank", F.when(audited, 0).when(first, 10).otherwise(20))


def applied(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Job rows (job_id, status, attempts) after events (job_id, seq, kind): claim, finish, fail, dead, requeue, in order.

    A claim needs a pending job and counts an attempt; a failed or dead job is pending again until MAX_ATTEMPTS,
    then failed; requeue resets the attempts. Other events change nothing. Each job's events are folded in an ``aggregate``.
    """
    e = events.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind"))).alias("events"))
    x = jobs.join(e, "job_id", "left")
    start = F.struct(F.col("status").alias("status"), F.coalesce("attempts", F.lit(0)).cast("int").alias("attempts"))

    def step(s: Column, v: Column) -> Column:
        kind, status, n = v["kind"], s["status"], s["attempts"]
        again = F.when(n >= MAX_ATTEMPTS, "failed").otherwise("pending")
        new = (
            F.when((kind == "claim") & (status == "pending"), F.struct(F.lit("running").alias("status"), (n + 1).alias("attempts")))
            .when((kind == "finish") & (status == "running"), F.struct(F.lit("done").alias("status"), n.alias("attempts")))
            .when(kind.isin("fail", "dead") & (status == "running"), F.struct(again.alias("status"), n.alias("attempts")))
            .when((kind == "requeue") & (status != "done"), F.struct(F.lit("pending").alias("status"), F.lit(0).alias("attempts")))
        )
        return F.coalesce(new, s)

    final = F.aggregate(F.coalesce("events", F.array().cast("array<struct<seq:bigint,kind:string>>")), start, step)
    return x.withColumn("s", final).select(*[c for c in jobs.columns if c not in ("status", "attempts")], "s.status", "s.attempts")


def select_episodes(episodes: DataFrame, per_task: int, salt: str) -> DataFrame:
    """``per_task`` episodes of each task, in the order of a stable hash: ceil(n/2) left and floor(n/2) right if every side is known, else any.

    Raises when the rows are computed if a task has too few.
    """
    x = episodes.withColumn("h", stable_seed(F.col("episode_id"), salt))
    sided = F.min(F.col("side").isNotNull().cast("int")).over(W.partitionBy("task_id")) == 1
    x = x.withColumn("sided", sided)
    group = F.when(F.col("sided"), F.col("side")).otherwise("any")
    want = F.when(~F.col("sided"), per_task).when(F.col("side") == "left", (per_task + 1) // 2).otherwise(per_task // 2)
    w = W.partitionBy("task_id", group)
    x = x.withColumn("n", F.row_number().over(w.orderBy("h", "episode_id"))).withColumn("have", F.count("*").over(w)).withColumn("want", want)
    note = F.concat(F.lit("too few episodes of task "), F.col("task_id"))
    x = x.where(F.when(F.col("have") < F.col("want"), F.raise_error(note).cast("boolean")).otherwise(True))
    return x.where("n <= want").select("task_id", "episode_id", "side", "h")


def balanced_clips(clips: DataFrame, n: int) -> DataFrame:
    """n clips, one an episode, from the camera used least so far, in the order of their hash.

    Counters over all choices decide, so one task folds the candidates; those are at most n of each camera, its first
    by hash with distinct episodes, since no camera gives more.
    """
    first = clips.withColumn("i", F.row_number().over(W.partitionBy("camera", "episode_id").orderBy("h", "clip_id"))).where("i = 1")
    most = first.withColumn("j", F.row_number().over(W.partitionBy("camera").orderBy("h", "clip_id"))).where(F.col("j") <= n * 3)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["h", "clip_id"]).to_dict("records")
        used, episodes, out = Counter(), set(), []
        while len(out) < n:
            free = [r for r in rows if r["episode_id"] not in episodes]
            if not free:
                break
            least = min(used[r["camera"]] for r in free)
            r = next(r for r in free if used[r["camera"]] == least)
            out.append((r["clip_id"], r["camera"], len(out)))
            used[r["camera"]] += 1
            episodes.add(r["episode_id"])
        return pd.DataFrame(out, columns=["clip_id", "camera", "place"])

    return most.groupBy(F.lit(0).alias("g")).applyInPandas(pick, "clip_id long, camera string, place long")


def diagnostic_split(clips: DataFrame, tasks: int = 16) -> DataFrame:
    """The first clip by hash of each task with two clips or more, and of those the first ``tasks``."""
    w = W.partitionBy("task_id")
    x = clips.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("h", "clip_id"))).where("n >= 2 AND i = 1")
    return x.orderBy("h", "clip_id").limit(tasks).select("task_id", "clip_id")


def least_counted(clips: DataFrame, n: int) -> DataFrame:
    """n clips one by one: the least counts of its task, camera and horizon among those chosen, then the hash.

    Counters over all choices decide, so one task folds the candidates: of each task, camera and horizon the first n by hash, since
    no more of them can be chosen. A choice looks at the first clip left of each group.
    """
    w = W.partitionBy("task_id", "camera", "horizon").orderBy("h", "clip_id")
    first = clips.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n).select("clip_id", "task_id", "camera", "horizon", "h")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: dict[tuple, list[tuple]] = {}
        for r in pdf.sort_values(["h", "clip_id"], ascending=False).to_dict("records"):
            groups.setdefault((r["task_id"], r["camera"], r["horizon"]), []).append((r["h"], r["clip_id"]))
        counts, out = Counter(), []
        while groups and len(out) < n:
            g = min(groups, key=lambda g: (counts["t", g[0]], counts["c", g[1]], counts["h", g[2]], *groups[g][-1]))
            out.append((groups[g].pop()[1], len(out)))
            if not groups[g]:
                del groups[g]
            counts.update([("t", g[0]), ("c", g[1]), ("h", g[2])])
        return pd.DataFrame(out, columns=["clip_id", "place"])

    return first.groupBy(F.lit(0).alias("g")).applyInPandas(pick, "clip_id long, place long")


def task_objects(tasks: DataFrame, default: list[int], overrides: dict[int, list[int]]) -> DataFrame:
    """(task_id, object_id): the objects of each task, the default ones or those that override them."""
    ids = lambda own: F.array(*map(F.lit, own)).cast("array<bigint>")
    objects = ids(default)
    for task, own in overrides.items():
        objects = F.when(F.col("task_id") == task, ids(own)).otherwise(objects)
    return tasks.select("task_id").distinct().select("task_id", F.explode(objects).alias("object_id"))


def windows(anchors: DataFrame, horizons: tuple[int, ...] = (8, 16, 32), length: int = 64) -> DataFrame:
    """Adds horizon, by turns in order of ordinal, and the window's start: max(0, min(anchor - 16 - horizon // 2, frames - length))."""
    h = F.element_at(F.array(*map(F.lit, horizons)), (F.col("ordinal") % len(horizons)).cast("int") + 1)
    x = anchors.withColumn("horizon", h)
    return x.withColumn("start", F.greatest(F.lit(0), F.least(F.col("anchor") - 16 - F.floor(F.col("horizon") / 2), F.col("frames") - length)))
