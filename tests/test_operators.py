"""Operators on tiny tables: the rules' edges."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackloom.operators import audit, bank, detections, intervals, machines, masks, queues, sequences, stats

BOX = "episode_id long, camera string, frame_idx long, object_id long, confidence double, x0 double, y0 double, x1 double, y1 double, t long"


def seen(spark, rows):
    return spark.createDataFrame([(1, "head", f, o, c, *map(float, b), k) for k, (f, o, c, b) in enumerate(rows)], BOX)


def test_ambiguity_and_collision(spark):
    rows = [(0, 1, 0.9, (0, 0, 10, 10)), (0, 2, 0.8, (0, 0, 10, 10)), (0, 3, 0.9, (50, 50, 60, 60)), (0, 3, 0.86, (70, 70, 80, 80)), (0, 4, 0.9, (1, 1, 5, 5)), (0, 5, 0.3, (90, 90, 95, 95))]
    best = detections.best(seen(spark, rows), ["t"])
    got = {r["object_id"]: r["reason"] for r in detections.choose(best).collect()}
    assert got == {1: "cross_class_box_collision", 2: "cross_class_box_collision", 3: "ambiguous_multiple_instances", 4: "cross_class_box_collision"}
    kept = {r["object_id"]: r["reason"] for r in detections.choose(best, rule="identical").collect()}
    assert kept[1] == kept[2] == "near_identical_cross_class_boxes" and kept[4] is None


def test_disappearance_is_a_row(spark):
    found = seen(spark, [(0, 1, 0.9, (0, 0, 10, 10)), (10, 1, 0.9, (60, 60, 90, 90))]).drop("t")
    frames = spark.createDataFrame([(1, "head", f, 0) for f in (0, 5, 10)], "episode_id long, camera string, frame_idx long, task_id long")
    objects = spark.createDataFrame([(0, 1), (1, 9)], "task_id long, object_id long")
    got = {r["frame_idx"]: r for r in detections.temporal(detections.skeleton(frames, objects, found)).collect()}
    assert set(got) == {5, 10} and got[5]["disappeared"] and got[5]["frame_gap"] == 5 and got[10]["reappeared"] and got[10]["iou"] is None


@pytest.mark.parametrize("iou, strict, most", [(0.5, True, None), (0.65, False, 4), (0.1, False, None)])
def test_suppression_in_crowded_frames_equals_the_loop(spark, iou, strict, most):
    """Boxes of all sizes, chains, equal boxes and confidences, boxes without extent; one frame of thousands."""
    import numpy as np

    r = np.random.default_rng(13)
    rows = []
    for frame, n in ((1, 2500), (2, 300), (None, 200), (4, 1)):
        c = r.integers(-40, 200 if n < 1000 else 900, (n, 2)).astype(float)
        size = np.exp(r.uniform(0, 5, (n, 2))) if frame == 2 else r.uniform(8, 40, (n, 2))
        size[r.random(n) < 0.03] *= 0
        for k in range(n):
            rows.append((frame, int(k), float(round(r.random(), 1 if frame is None else 3)), *(float(v) for v in (*c[k], *(c[k] + size[k])))))
        rows += [(frame, 9000 + k, *rows[-1][2:]) for k in range(3)]
    df = spark.createDataFrame(rows, "frame_idx int, t int, confidence double, x0 double, y0 double, x1 double, y1 double").repartition(3)
    got = {(x.frame_idx, x.t) for x in detections.suppress(df, ["frame_idx"], ["t"], iou=iou, strict=strict, most=most).collect()}
    want = set()
    for frame in (1, 2, None, 4):
        own = sorted((x for x in rows if x[0] == frame), key=lambda x: (-x[2], x[1]))
        b, kept = np.array([x[3:] for x in own]), []
        for i in range(len(own)):
            k = b[kept]
            inter = np.maximum(np.minimum(k[:, 2:], b[i, 2:]) - np.maximum(k[:, :2], b[i, :2]), 0).prod(axis=1)
            union = (k[:, 2:] - k[:, :2]).prod(axis=1) + (b[i, 2:] - b[i, :2]).prod() - inter
            value = np.divide(inter, union, out=np.zeros(len(k)), where=union != 0)
            if not (value > iou if strict else value >= iou).any():
                kept.append(i)
        want |= {(frame, own[i][1]) for i in kept[:most]}
    assert got == want


def near_copies(n, span=6):
    """Boxes of one frame that nearly all overlap, with confidences in steps, and their greedy choice."""
    import numpy as np

    r = np.random.default_rng(5)
    b = np.concatenate([r.uniform(0, span, (n, 2)), r.uniform(30, 30 + span, (n, 2))], axis=1)
    return [(1, k, float(round(r.random(), 2)), *map(float, b[k])) for k in range(n)]


def greedy(rows, iou, strict, most=None):
    kept = []
    for x in sorted(rows, key=lambda x: (-x[2], x[1])):
        def share(k, b=x[3:]):
            inter = max(0.0, min(k[2], b[2]) - max(k[0], b[0])) * max(0.0, min(k[3], b[3]) - max(k[1], b[1]))
            return inter / ((k[2] - k[0]) * (k[3] - k[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)

        if not any(share(k[3:]) > iou if strict else share(k[3:]) >= iou for k in kept):
            kept.append(x)
    return {x[1] for x in kept[:most]}


SEEN = "frame_idx int, t int, confidence double, x0 double, y0 double, x1 double, y1 double"


def stored(spark):
    """Bytes in the checkpoint folder."""
    from pathlib import Path

    at = spark.sparkContext.getCheckpointDir()
    return sum(p.stat().st_size for p in Path(at.removeprefix("file:")).rglob("*") if p.is_file()) if at else 0


def test_suppression_of_near_copies_writes_no_pairs(spark):
    """3,000 boxes make 4.5 million pairs."""
    rows = near_copies(3000)
    df, before = spark.createDataFrame(rows, SEEN), stored(spark)
    got = {x.t for x in detections.suppress(df, ["frame_idx"], ["t"], iou=0.5, strict=True).collect()}
    assert got == greedy(rows, 0.5, True) and stored(spark) - before < 3_000_000


def test_first_few_of_near_copies_write_no_pairs(spark):
    """At most four boxes of a group stay, as of the robot's candidates."""
    rows = near_copies(2000, 60) + [(2, *x[1:]) for x in near_copies(1000)]
    df, before = spark.createDataFrame(rows, SEEN), stored(spark)
    got = {(x.frame_idx, x.t) for x in detections.suppress(df, ["frame_idx"], ["t"], iou=0.65, most=4).collect()}
    assert got == {(f, t) for f in (1, 2) for t in greedy([x for x in rows if x[0] == f], 0.65, False, 4)} and stored(spark) - before < 200_000


@pytest.mark.parametrize("iou,strict,most", [(0.5, True, None), (0.65, False, 4), (0.2, False, None)])
def test_crowds_are_thinned_by_all_tasks(spark, monkeypatch, iou, strict, most):
    """Groups over the limit, one of near copies and one spread out, with chains that the rounds don't end."""
    import numpy as np

    r = np.random.default_rng(8)
    spread = np.floor(r.uniform(0, 400, (500, 2)))
    size = np.exp(r.uniform(0, 4, (500, 2)))
    size[:9] = 0
    rows = near_copies(400, 40) + [(None, k, float(round(r.random(), 1)), *map(float, spread[k]), *map(float, spread[k] + size[k])) for k in range(500)]
    rows += [(3, k, 1 - k / 1000, 3.0 * k, 0.0, 3.0 * k + 10, 10.0) for k in range(200)] + [(4, k, 0.5, 0.0, 0.0, 9.0, 9.0) for k in range(3)]
    df = spark.createDataFrame(rows, SEEN).repartition(3)
    want = {(x.frame_idx, x.t) for x in detections.suppress(df, ["frame_idx"], ["t"], iou=iou, strict=strict, most=most).collect()}
    monkeypatch.setattr(detections, "CROWD", 100)
    monkeypatch.setattr(detections, "THINNING", 3)
    got = [(x.frame_idx, x.t) for x in detections.suppress(df, ["frame_idx"], ["t"], iou=iou, strict=strict, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {t for f, t in want if f == 1} == greedy([x for x in rows if x[0] == 1], iou, strict, most)


@pytest.mark.parametrize("iou,strict,most", [(0.5, True, None), (0.65, False, 4), (0.2, False, 30)])
def test_suppression_by_blocks(monkeypatch, iou, strict, most):
    """Groups that go on over blocks, with more kept boxes than the rounds over all groups."""
    import numpy as np

    monkeypatch.setattr(detections, "ROUNDS", 3)
    r = np.random.default_rng(3)
    groups = [sorted(near_copies(n, span), key=lambda x: (-x[2], x[1])) for n, span in ((7, 90), (300, 400), (1, 5), (150, 30), (90, 300))]
    rows = [x for g in groups for x in g]
    first = np.concatenate([np.arange(len(g)) == 0 for g in groups])
    box = [np.array([x[3 + k] for x in rows]) for k in range(4)]
    state, got, at = detections.Suppression(iou, most, strict), [], 0
    while at < len(rows):
        n = int(r.integers(1, 60))
        got += (at + state.feed(first[at : at + n], [c[at : at + n] for c in box])).tolist()
        at += n
    want, begin = [], 0
    for g in groups:
        kept = greedy(g, iou, strict, most)
        want += [begin + k for k, x in enumerate(g) if x[1] in kept]
        begin += len(g)
    assert got == want


def test_suppression_is_greedy(spark):
    rows = [(0, 1, 0.9, (0, 0, 10, 10)), (0, 1, 0.8, (3, 0, 13, 10)), (0, 1, 0.7, (6, 0, 16, 10))]
    got = detections.suppress(seen(spark, rows), ["frame_idx", "object_id"], ["t"], iou=0.5).collect()
    assert sorted(r["confidence"] for r in got) == [0.7, 0.9]
    assert detections.suppress(seen(spark, rows), ["frame_idx", "object_id"], ["t"], iou=0.5, most=1).count() == 1


def vis(spark, rows):
    start = datetime(2026, 1, 1)
    return spark.createDataFrame([(1, f, start + timedelta(seconds=f / 30), g, p, i, 0) for f, g, p, i in rows], "clip_id long, frame_idx long, ts timestamp, gt_visibility string, pred_visible boolean, iou double, pred_area long")


def test_reentry_and_false_positive_run(spark):
    rows = [(0, "out_of_view", True, 0.0), (5, "out_of_view", True, 0.0), (10, "visible", True, 0.0), (15, "visible", True, 0.9), (20, "visible", True, 0.9)]
    run = audit.false_positive_runs(vis(spark, rows), ["clip_id"]).collect()
    assert [(r["samples"], r["first_frame"], r["last_frame"]) for r in run] == [(2, 0, 5)]
    got = audit.reentries(vis(spark, rows), ["clip_id"]).first()
    assert got["eligible"] and got["success"] and got["latency_seconds"] == pytest.approx(1 / 6, abs=1e-3)
    assert not audit.reentries(vis(spark, rows[:3]), ["clip_id"]).first()["eligible"]
    broken = [*rows[:3], (17, "visible", True, 0.9), (22, "visible", True, 0.9)]
    assert not audit.reentries(vis(spark, broken), ["clip_id"]).first()["eligible"]


def test_abstention_is_wrong(spark):
    got = vis(spark, [(0, "out_of_view", None, None)]).agg(*audit.metrics()).first()
    assert got["visibility_accuracy"] == 0 and got["abstentions"] == 1 and got["mask_iou"] is None


def test_missing_prediction_is_an_error(spark):
    labels, preds = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, True)], "k long, v boolean")
    with pytest.raises(Exception, match="no prediction"):
        audit.matched(labels, preds, ["k"]).collect()


def test_identity_switches(spark):
    pairs = [(1, f, g, p, 0.9 if p == (g if f == 0 else 1 - g) else 0.0) for f in (0, 5) for g in (0, 1) for p in (0, 1)]
    df = spark.createDataFrame(pairs, "clip_id long, frame_idx long, gt long, pred long, iou double")
    x = audit.id_switches(audit.assign(df, ["clip_id", "frame_idx"]), df, ["clip_id"])
    assert x.where("switched").count() == 2 and x.where("comparable").count() == 2
    far = df.withColumn("frame_idx", F.col("frame_idx") * 2)
    assert audit.id_switches(audit.assign(far, ["clip_id", "frame_idx"]), far, ["clip_id"]).where("comparable").count() == 0


def test_three_conventions_of_scores(spark):
    df = spark.createDataFrame([(1, [0, 4], [4]), (2, [4], [4]), (3, [4], [0, 4]), (4, [0, 2, 2], [0, 2, 2]), (5, [0, 4], None)], "k long, runs array<long>, p_runs array<long>")
    from trackloom.functions import runs as R

    x = masks.scored(df.withColumn("mask_area", R.area(F.col("runs"))).withColumn("p_area", R.area(F.col("p_runs"))))
    got = {r["k"]: r for r in x.collect()}
    assert got[1]["iou"] == 0 and got[1]["missed"] and got[2]["iou"] is None and got[2]["visibility_correct"] and got[3]["false_positive"] and got[4]["iou"] == 1
    assert not got[5]["visibility_correct"] and got[5]["missed"]
    total = x.agg(*masks.summary()).first()
    assert total["macro_iou"] == pytest.approx(1 / 3, abs=1e-6) and total["micro_iou"] == pytest.approx(2 / 14, abs=1e-6)


def test_seed_intervals_cover_once(spark):
    seeds = spark.createDataFrame([("a", 2), ("a", 7)], "clip string, seed_frame long")
    got = [tuple(r)[1:] for r in intervals.seed_intervals(seeds, ["clip"]).orderBy("seed_frame").collect()]
    assert got == [(2, None, 4), (7, 5, None)]
    frames = spark.range(10).select(F.lit("a").alias("clip"), F.col("id").alias("frame_idx"))
    near = {r["frame_idx"]: r["seed_frame"] for r in intervals.nearest_seed(frames, seeds, ["clip"]).collect()}
    assert near == {f: 2 if f <= 4 else 7 for f in range(10)}


def test_untouched_rows_compare_nulls(spark):
    a = spark.createDataFrame([(1, None, 2.0), (2, "x", None), (3, "y", 1.0)], "k long, v string, w double")
    b = spark.createDataFrame([(1, None, 2.0), (2, "x", 0.0), (4, "y", 1.0)], "k long, v string, w double")
    none = a.limit(0)
    assert {(r["k"], r["problem"]) for r in intervals.changed_rows(a, b, ["k"], none).collect()} == {(2, "changed"), (3, "lost"), (4, "added")}
    assert intervals.changed_rows(a, a, ["k"], none).count() == 0


def test_double_write_raises(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    with pytest.raises(Exception, match="written twice"):
        intervals.overlaid(a, a.union(a), ["k"], ["v"]).collect()


@pytest.mark.parametrize(("frames", "kept"), [(range(200), [0, 90, 180]), ([5], [5]), ([0, 89, 90], [0, 90])])
def test_cooldown_counts_from_the_last_kept(spark, frames, kept):
    df = spark.createDataFrame([("a", f) for f in frames], "k string, f long")
    assert sorted(r["f"] for r in sequences.cooldown(df, ["k"], "f", 90).collect()) == kept


@pytest.mark.parametrize("n", [1, 119, 120, 121, 240, 241])
def test_chunks_cover_every_frame_once(spark, n):
    frames = spark.range(n).select(F.lit(1).alias("episode_id"), F.lit("head").alias("camera"), F.col("id").alias("frame_idx"))
    x = sequences.chunk(frames, 120).collect()
    assert sorted(r["frame_idx"] for r in x if not r["shared"]) == list(range(n))
    assert sum(r["shared"] for r in x) == (n - 1) // 120


def test_even_sample(spark):
    df = spark.range(10).select(F.lit(0).alias("g"), "id")
    assert sorted(r["id"] for r in sequences.evenly(df, ["g"], ["id"], 4).collect()) == [0, 3, 6, 9]
    assert sequences.evenly(df, ["g"], ["id"], 1).first()["id"] == 0 and sequences.evenly(df, ["g"], ["id"], 20).count() == 10


def entry(i, o, episode, camera, v):
    return (i, o, episode, camera, "active", [float(x) for x in v])


def test_retrieval_with_competitor_and_fallback(spark):
    rows = [entry(1, 1, 1, "head", (1, 0)), entry(2, 2, 1, "head", (0.8, 0.6)), entry(3, 1, 2, "left_wrist", (0, 1))]
    df = spark.createDataFrame(rows, "exemplar_id long, object_id long, episode_id long, camera string, bank_status string, embedding array<float>")
    q = spark.createDataFrame([(10, 1, 9, "head", [1.0, 0.0]), (11, 1, 1, "head", [1.0, 0.0]), (12, 3, 9, "head", [1.0, 0.0]), (13, 1, 9, "right_wrist", [0.0, 1.0])], "query_id long, q_object_id long, q_episode_id long, q_camera string, q_embedding array<float>")
    got = {r["query_id"]: r for r in bank.retrieve(q, df).collect()}
    assert got[10]["similarity"] == 1 and got[10]["margin"] == pytest.approx(0.2) and got[10]["competitor_id"] == 2 and got[10]["camera_scope"] == "same_camera"
    assert got[11]["nearest"] == "3" and got[11]["margin"] is None and got[11]["camera_scope"] == "cross_camera_fallback"
    assert got[12]["status"] == "no_reference" and got[13]["camera_scope"] == "cross_camera_fallback" and got[13]["nearest"] == "3,1"


def test_ranking_and_eligibility(spark):
    df = spark.createDataFrame([("a", 1, 0.29, 0.9), ("b", 1, 0.6, 0.8), ("c", 2, 0.5, 0.5), ("d", 2, 0.5, 0.5)], "candidate_id string, g long, det double, s double")
    after = bank.ranked(df, ["g"], F.col("s"), F.col("det") >= 0.3).collect()
    assert [r["candidate_id"] for r in after] == ["c"]
    first = bank.ranked(df, ["g"], F.col("s"), F.col("det") >= 0.3, True).collect()
    assert sorted(r["candidate_id"] for r in first) == ["b", "c"]


def test_diverse_leaves_out_adjacent_copies(spark):
    rows = [(k, 1, 7, f, 500, [1.0, 0.0]) for k, f in enumerate((0, 1, 60))]
    df = spark.createDataFrame(rows, "exemplar_id long, object_id long, episode_id long, frame_idx long, mask_area long, embedding array<float>")
    assert [r["exemplar_id"] for r in bank.diverse(df, ["object_id"]).orderBy("place").collect()] == [0, 2]


def test_termination_needs_missing_support():
    assert machines.why_ended(2, 0, True, False, 1.0) is None
    assert machines.why_ended(3, 0, True, False, 1.0) == "suspected_out_of_view_residue"
    assert machines.why_ended(3, 3, False, False, 1.0) == "lost_empty_no_detector_support"
    assert machines.why_ended(3, 0, False, True, 0.6) is None


def test_recovery_actions():
    none = {"candidate": False, "tiny": False, "severe": True, "presence": 0.1, "empty": False, "agreement": None}
    t, action, reason = machines.recover(machines.new_track(), {**none, "candidate": True})
    assert (action, reason) == ("seed", "first_visible_candidate")
    actions = []
    for _ in range(3):
        t, action, _ = machines.recover(t, none)
        actions.append(action)
    assert actions == ["keep", "keep", "terminate"]
    t, action, reason = machines.recover(t, {**none, "candidate": True, "severe": False})
    assert (action, reason) == ("seed", "reacquire")
    assert machines.recover(t, {**none, "candidate": True, "severe": False, "agreement": 0.9})[1] == "keep"
    assert machines.recover(t, {**none, "candidate": True, "agreement": 0.9})[1] == "seed"


def test_every_situation_of_the_recovery_loop():
    from itertools import product

    seen = set()
    for active, ever, candidate, severe, tiny, agreement, misses, empty in product((False, True), (False, True), (False, True), (False, True), (False, True), (None, 0.2, 0.25, 0.9), (0, 1, 2), (False, True)):
        if active and not ever:
            continue
        t = {**machines.new_track(), "active": active, "ever": ever, "misses": misses, "empty": 2, "segment": 4}
        o = {"candidate": candidate, "severe": severe, "tiny": tiny, "agreement": agreement, "presence": 0.1, "empty": empty}
        new, action, reason = machines.recover(t, o)
        seen.add(reason)
        if candidate:
            sure = active and not severe and not tiny and agreement in (0.25, 0.9)
            assert action == ("keep" if sure else "seed") and new["misses"] == 0 and new["active"]
            assert (new["segment"], new["ever"]) == (4, ever) if sure else (5, True)
        else:
            why = machines.why_ended(misses + 1, 3 if empty else 0, tiny, severe, 0.1)
            assert (action, reason) == (("terminate", why) if active and why else ("keep", "no_candidate_unknown"))
            assert new["misses"] == misses + 1 and new["segment"] == 4 and new["active"] == (active and action == "keep")
    assert len(seen) == 5 + 3


def drawn(seed, frames=120, objects=3):
    """Observations of some streams with several objects a frame."""
    import random

    r = random.Random(seed)
    rows = []
    for clip in range(4):
        for frame in sorted(r.sample(range(3 * frames), frames)):
            for o in range(r.randint(1, objects)):
                hit = r.random() < 0.4
                rows.append(dict(clip_id=clip, object_id=o, frame_idx=frame, keyframe=frame % 10 < 4, hit=hit, candidate=hit, tiny=r.random() < 0.15, severe=r.random() < 0.1,
                                 presence=r.random(), confidence=r.random(), empty=r.random() < 0.3, agreement=r.choice([None, 0.1, 0.28, 0.9]), confirm=r.choice([None, 0.1, 0.5, 0.9]),
                                 admitted=hit and r.random() < 0.7, first=frame < 5, prompt=r.choice([None, None, "visible", "not_visible"])))
    return rows


DRAWN = ("clip_id long, object_id long, frame_idx long, keyframe boolean, hit boolean, candidate boolean, tiny boolean, severe boolean, presence double, confidence double, empty boolean, "
         "agreement double, confirm double, admitted boolean, first boolean, prompt string")


def by_frame(rows):
    from itertools import groupby

    for clip in sorted({o["clip_id"] for o in rows}):
        own = sorted((o for o in rows if o["clip_id"] == clip), key=lambda o: (o["frame_idx"], o["object_id"]))
        yield clip, [(f, list(g)) for f, g in groupby(own, key=lambda o: o["frame_idx"])]


def test_dense_driver_equals_the_loop(spark):
    """Frames one by one: one cooldown for the stream, any object's anomaly looks at all objects."""
    rows = drawn(3)
    want = set()
    for clip, frames in by_frame(rows):
        misses, active, segment, last = {}, {}, {}, -1000
        for f, seen in frames:
            gone = set()
            for o in seen:
                k = o["object_id"]
                if o["keyframe"]:
                    misses[k] = 0 if o["hit"] else misses.get(k, 0) + 1
                if misses.get(k, 0) >= 3 and o["tiny"] and o["presence"] < 0.5:
                    gone.add(k)
            odd = [o for o in seen if (o["severe"] or o["tiny"]) and o["object_id"] not in gone]
            look = bool(odd) and f - last >= 10 and not seen[0]["keyframe"]
            last = f if look else last
            for o in seen:
                k = o["object_id"]
                what = ("keep", "tracked")
                if k in gone:
                    what, active[k] = ("terminate", "low_presence_border_residue_termination"), False
                elif look and o in odd:
                    what = ("keep", "anomaly_without_candidate")
                    if o["hit"] and o["confidence"] >= 0.5:
                        what, active[k], segment[k] = ("seed", "redetect_reseed"), True, segment.get(k, 0) + 1
                want.add((clip, k, f, *what, active.get(k, False), segment.get(k, 0)))
    got = machines.dense(spark.createDataFrame([tuple(o.values()) for o in rows], DRAWN), ["clip_id"]).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert {"terminate", "seed"} <= {x[3] for x in want} and machines.dense(spark.createDataFrame([], DRAWN), ["clip_id"]).count() == 0


def test_two_arm_trial_equals_the_loop(spark):
    """Frames one by one, all objects of a stream checked together; written as conditions on each object's history."""
    rows = drawn(6)
    want = set()
    for clip, frames in by_frame(rows):
        checked, state = None, {}
        for f, seen in frames:
            for o in seen:
                h = state.setdefault(o["object_id"], dict(on=False, seeds=0, quiet=0, missed=0, prior=None))
                h["quiet"] = h["quiet"] + 1 if o["empty"] else 0
            trouble = any(o["severe"] or o["tiny"] or not state[o["object_id"]]["on"] for o in seen)
            check = f % 15 == 0 or trouble and (checked is None or f - checked >= 5)
            if check:
                checked = f
            for o in seen:
                h, event = state[o["object_id"]], ("keep", "no_change" if check else "no_check")
                if check:
                    sure = o["candidate"] and h["prior"] is not None and f - h["prior"] <= 15 and (o["confirm"] or 0) >= 0.25
                    h["prior"], h["missed"] = (f, 0) if o["candidate"] else (None, h["missed"] + 1)
                    if sure and (h["seeds"] == 0 or not h["on"] or o["severe"] or o["tiny"] or (o["agreement"] or 0) < 0.3):
                        event = ("seed", "initial_seed_shared" if h["seeds"] == 0 else "suspicious_reseed" if h["on"] else "reentry_reseed")
                        h.update(on=True, seeds=h["seeds"] + 1, quiet=0)
                    elif h["on"] and h["missed"] >= 3:
                        why = "lost_empty_no_detector_support" if h["quiet"] >= 3 else "suspected_out_of_view_residue" if o["tiny"] else None
                        why = why or ("lost_unreliable_no_detector_support" if o["severe"] and o["presence"] < 0.5 else None)
                        if why:
                            event, h["on"] = ("terminate", why), False
                want.add((clip, o["object_id"], f, *event, h["on"], h["seeds"]))
    got = machines.trial(spark.createDataFrame([tuple(o.values()) for o in rows], DRAWN), ["clip_id"]).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert {"initial_seed_shared", "suspicious_reseed", "reentry_reseed"} <= {x[4] for x in want} and "terminate" in {x[3] for x in want}


@pytest.mark.parametrize("mode", ["guarded_replace", "guarded_all", "assisted"])
def test_guarded_modes_equal_their_rules(spark, mode):
    """Each observation judged from the whole history before it."""
    from functools import partial

    rows = drawn(9)
    df = spark.createDataFrame([tuple(o.values()) for o in rows], DRAWN)
    got = {(r.clip_id, r.object_id, r.frame_idx): (r.action, r.active) for r in machines.run(df, ["clip_id", "object_id"], partial(machines.guard, mode=mode)).collect()}
    for clip, k in {(o["clip_id"], o["object_id"]) for o in rows}:
        own = sorted((o for o in rows if (o["clip_id"], o["object_id"]) == (clip, k)), key=lambda o: o["frame_idx"])
        past = []
        for o in own:
            on = past[-1][1] if past else False
            let = [p["frame_idx"] for p, (_, _, ok) in zip(own, past) if ok]
            ok = o["candidate"] if mode == "guarded_replace" and o["first"] else o["admitted"]
            if mode == "assisted":
                action, ok = {None: "keep", "visible": "seed"}.get(o["prompt"], "clear_unknown"), False
            elif ok:
                action = "keep" if on and (o["agreement"] or 0) >= 0.25 else "seed"
            else:
                action = "clear_unknown" if mode == "guarded_all" and on and o["frame_idx"] - max(let) >= 30 else "keep"
            on = True if action == "seed" else False if action == "clear_unknown" else on
            past.append((action, on, ok))
            assert got[clip, k, o["frame_idx"]] == (action, on)


def test_guarded_expiry():
    o = {"frame_idx": 0, "first": True, "candidate": True, "admitted": True, "agreement": None, "prompt": None}
    t, action, _ = machines.guard(machines.new_track(), o, "guarded_all")
    assert action == "seed"
    later = {**o, "first": False, "admitted": False}
    assert machines.guard(t, {**later, "frame_idx": 29}, "guarded_all")[1] == "keep"
    assert machines.guard(t, {**later, "frame_idx": 30}, "guarded_all")[2] == "unverified_track_expired"
    assert machines.guard(t, {**later, "frame_idx": 30}, "guarded_replace")[1] == "keep"


def test_queue_lifecycle(spark):
    jobs = spark.createDataFrame([(1, "pending", 0), (2, "pending", 0), (3, "pending", 0)], "job_id long, status string, attempts int")
    kinds = {1: ["claim", "fail", "claim", "finish"], 2: ["finish", "claim"], 3: ["claim", "dead", "claim", "dead", "claim", "fail", "claim"]}
    events = spark.createDataFrame([(j, k, e) for j, es in kinds.items() for k, e in enumerate(es)], "job_id long, seq long, kind string")
    assert {r["job_id"]: (r["status"], r["attempts"]) for r in queues.applied(jobs, events).collect()} == {1: ("done", 2), 2: ("running", 1), 3: ("failed", 3)}


def test_too_few_episodes_raise(spark):
    eps = spark.createDataFrame([(0, 1, "left"), (0, 2, "left"), (0, 3, "right")], "task_id long, episode_id long, side string")
    assert queues.select_episodes(eps, 3, "s").count() == 3
    with pytest.raises(Exception, match="too few episodes"):
        queues.select_episodes(eps, 4, "s").collect()


def test_empty_tables(spark):
    none = seen(spark, [(0, 1, 0.9, (0, 0, 1, 1))]).limit(0)
    assert detections.choose(detections.best(none, ["t"])).count() == 0
    assert detections.suppress(none, ["frame_idx"], ["t"]).count() == 0
    assert audit.assign(spark.createDataFrame([], "k long, gt long, pred long, iou double"), ["k"]).count() == 0


def test_plug_points(spark):
    from trackloom.functions import plugs

    frames = spark.createDataFrame([(1, "head", f) for f in range(3)], "episode_id long, camera string, frame_idx long")

    def stub():  # stands in for a detector; it finds one box a frame
        return lambda rows: [{**r, "object_id": 1, "confidence": 0.5, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0} for r in rows]

    assert plugs.detect(frames, stub).count() == 3
    spans = spark.createDataFrame([("c", 1, 0, f) for f in (2, 0, 1)], "clip_id string, object_id long, seed_frame long, frame_idx long")
    got = plugs.propagate(spans, lambda: lambda rows: ({**r, "n": k} for k, r in enumerate(rows)), "clip_id string, object_id long, seed_frame long, frame_idx long, n long").collect()
    assert {(r["frame_idx"], r["n"]) for r in got} == {(0, 0), (1, 1), (2, 2)}


def test_matching_equals_enumeration():
    import random
    import time
    from itertools import permutations

    r = random.Random(1)
    for _ in range(600):
        n = r.randint(1, 7)
        real = r.randint(1, n)
        w = [[r.randrange(6) / 97 if i < real else 0.0 for _ in range(n)] for i in range(n)]  # many ties
        assert audit.matching(w) == list(max(permutations(range(n)), key=lambda p: round(sum(w[i][j] for i, j in enumerate(p)), 12)))
    began = time.time()
    audit.matching([[r.random() for _ in range(12)] for _ in range(12)])
    assert time.time() - began < 0.1


def test_assignment_of_uneven_sides(spark):
    pairs = [(1, g, p, v) for g, p, v in ((10, 1, 0.5), (10, 2, 0.6), (11, 2, 0.6), (12, 2, 0.05), (12, 3, None))]
    got = audit.assign(spark.createDataFrame(pairs, "f long, gt long, pred long, iou double"), ["f"]).collect()
    assert {(r["gt"], r["pred"]) for r in got} == {(10, 1), (11, 2)}


def test_nearest_seed_of_a_long_stream_in_time(spark):
    import time

    frames = spark.range(40_000).select(F.lit("a").alias("clip"), F.col("id").alias("frame_idx"))
    seeds = spark.range(0, 40_000, 100).select(F.lit("a").alias("clip"), F.col("id").alias("seed_frame"))
    intervals.nearest_seed(frames, seeds, ["clip"]).count()
    began = time.time()
    x = intervals.nearest_seed(frames, seeds, ["clip"])
    wrong = F.when(F.col("frame_idx") > 39_900, 39_900).otherwise(F.ceil((F.col("frame_idx") - 50) / 100) * 100)
    assert x.where(F.col("seed_frame") != wrong).count() == 0 and time.time() - began < 10


def test_exclusions_become_segments(spark):
    import random

    r = random.Random(3)
    ex = [(k % 3, a := r.randint(0, 40), a + r.randint(-2, 25), f"r{i}", i) for i, k in enumerate(range(40))] + [(None, 0, 99, "null", 0), (7, None, 5, "open", 0)]
    rows = [(k, f, f"{k}/{f}") for k in (0, 1, 2, 5) for f in range(70)] + [(None, 3, "n")]
    df, e = spark.createDataFrame(rows, "k long, frame_idx long, name string"), spark.createDataFrame(ex, "k long, start long, end long, reason string, ordinal long")
    got = {x["name"]: x["reason"] for x in intervals.excluded(df, e, ["k"]).collect()}
    for k, f, name in rows:
        own = [x for x in ex if x[0] is not None and x[1] is not None and x[0] == k and x[1] <= f <= x[2]]
        assert got[name] == (min(own, key=lambda x: x[4])[3] if own else None)
    assert intervals.excluded(df, e.limit(0), ["k"]).where("reason IS NULL").count() == len(rows)


def test_quantiles_interpolate(spark):
    import numpy as np

    v = [(g, float(x) if x % 5 else None) for g in ("a", None) for x in range(1, 38)] + [("b", None), ("c", float("nan")), ("c", 2.0)]
    got = {r["g"]: r for r in stats.quantiles(spark.createDataFrame(v, "g string, x double"), ["g"], {"x": F.col("x")}, {"median": 0.5, "p95": 0.95}).collect()}
    own = [x for g, x in v if g == "a" and x is not None]
    assert got["a"]["x_median"] == got[None]["x_median"] == np.quantile(own, 0.5) and got["a"]["x_p95"] == pytest.approx(np.quantile(own, 0.95))
    assert "b" not in got and got["c"]["x_p95"] == 2


def test_cooldown_and_spacing_equal_the_loops(spark):
    """Chains of many lengths, gaps over empty cells, null keys, repeated and null frames."""
    import random

    r = random.Random(8)
    rows = []
    for key in ("a", "b", None, "c", "d"):
        f = r.randint(-50, 50)
        for _ in range({"a": 400, "b": 3, "c": 1, "d": 60}.get(key, 150)):
            rows.append((key, key and key < "b", f, r.randint(0, 9)))
            f += r.choice([0, 1, 1, 2, 5, 40, 7])
    rows.append(("e", True, None, 1))
    df = spark.createDataFrame(rows, "k string, b boolean, f int, w int")
    for wait in (1, 7, 30):
        want = []
        for key in {x[:2] for x in rows}:
            last = None
            for f in sorted({x[2] for x in rows if x[:2] == key and x[2] is not None}):
                if last is None or f - last >= wait:
                    want.append((*key, f))
                    last = f
        assert sorted(map(tuple, sequences.cooldown(df, ["k", "b"], "f", wait).collect()), key=str) == sorted(want, key=str)
    for gap, most in ((60, 2), (5, 4), (1, 1)):
        want = []
        for key in {x[:2] for x in rows}:
            kept = []
            for _, f in sorted((-x[3], x[2]) for x in rows if x[:2] == key and x[2] is not None):
                if len(kept) < most and all(abs(f - g) >= gap for g in kept):
                    kept.append(f)
            want += [(*key, f) for f in kept]
        assert sorted(map(tuple, sequences.spaced(df, ["k", "b"], "f", [-F.col("w")], gap, most).collect()), key=str) == sorted(want, key=str)
    assert sequences.cooldown(df.limit(0), ["k"], "f", 5).count() == 0 and sequences.spaced(df.limit(0), ["k"], "f", [F.col("w")]).count() == 0


def test_quantiles_of_large_groups_are_exact(spark, monkeypatch):
    """Groups that are selected between bounds, with ties, few values, infinities and a long tail; few rows are ordered in one place."""
    import numpy as np

    monkeypatch.setattr(stats, "SMALL", 200)
    monkeypatch.setattr(stats, "ACCURACY", 500)
    monkeypatch.setattr(stats, "ASIDE", 2 / 500 + 2 / 200)
    r = np.random.default_rng(4)
    groups = {
        "even": r.random(20_001), "tied": r.integers(0, 3, 15_000).astype(float), "one": np.full(9_000, 7.5), "tail": r.pareto(1, 12_345), "small": r.random(150), "edge": np.arange(201.0),
        "inf": np.concatenate([r.random(500), np.full(400, np.inf), np.full(3, -np.inf)])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, x double").repartition(7)
    shares = {"min": 0.0, "p1": 0.01, "median": 0.5, "p95": 0.95, "max": 1.0}
    got = {row["g"]: row for row in stats.quantiles(df, ["g"], {"x": F.col("x"), "y": -F.col("x")}, shares).collect()}
    for g, v in groups.items():
        v = np.sort(v)
        for name, own in (("x", v), ("y", np.sort(-v))):
            for s, q in shares.items():
                p = q * (len(own) - 1)
                low, high = own[int(np.floor(p))], own[int(np.ceil(p))]
                want = low if p == int(p) else low + (high - low) * (p - np.floor(p))
                assert got[g][f"{name}_{s}"] == want or np.isnan(want) and np.isnan(got[g][f"{name}_{s}"]) or (low == high == got[g][f"{name}_{s}"]), (g, name, s)


@pytest.mark.parametrize("cell, first", [(1024, 4096), (6, 9)])
def test_retrieval_by_cells_and_blocks_equals_brute_force(spark, monkeypatch, cell, first):
    import numpy as np

    from trackloom.operators import cells

    r = np.random.default_rng(2)
    v = r.normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]  # a tie
    rows = [(k, k % 4, [k % 4, 2] if k % 9 == 0 else None, k % 5, ("head", "left")[k % 2], "active" if k % 11 else "excluded", [float(x) for x in v[k]]) for k in range(60)]
    df = spark.createDataFrame(rows, "exemplar_id long, object_id long, merged array<long>, episode_id long, camera string, bank_status string, embedding array<float>")
    q = df.where("exemplar_id % 6 = 0").select(F.col("exemplar_id").alias("query_id"), F.col("object_id").alias("q_object_id"), F.col("episode_id").alias("q_episode_id"), F.col("camera").alias("q_camera"), F.col("embedding").alias("q_embedding"))
    monkeypatch.setattr(bank, "QUERY_BLOCK", 3)
    monkeypatch.setattr(bank, "ENTRY_BLOCK", 7)
    monkeypatch.setattr(bank, "FIRST", first)
    monkeypatch.setattr(cells, "CELL", cell)
    got = {x["query_id"]: x for x in bank.candidates(q, df, 3).collect()}
    f = np.asarray(v, np.float32).astype(float)
    for k in range(0, 60, 6):
        _, o, _, e, c, _, _ = rows[k]
        pool = [(-round(float(f[k] @ f[x[0]]), 6), x[0], x[1], o in (x[2] or [x[1]]), x[4] == c) for x in rows if x[5] == "active" and x[3] != e]
        for name, keep in (("p_same", lambda p: p[3] and p[4]), ("p_all", lambda p: p[3]), ("c_same", lambda p: not p[3] and p[4]), ("c_all", lambda p: not p[3])):
            own = sorted(p for p in pool if keep(p))
            assert [x["exemplar_id"] for x in got[k][name]] == [p[1] for p in own[:3]]
            if name in ("p_same", "p_all", "c_same"):
                assert got[k][{"p_same": "n_same", "p_all": "n_all", "c_same": "m_same"}[name]] == len(own)
    assert bank.retrieve(q, df.limit(0)).where("status = 'no_reference'").count() == q.count()


def test_retrieval_compares_fewer_of_more_entries(spark, monkeypatch):
    """Entries in tight groups: the lists are those of all pairs, and the share of pairs that are compared falls as the bank grows."""
    import numpy as np

    from trackloom.operators import cells

    monkeypatch.setattr(bank, "FIRST", 60)
    monkeypatch.setattr(cells, "CELL", 20)
    shares = []
    for n in (400, 1600):
        r = np.random.default_rng(n)
        v = r.normal(size=(n // 20, 16)).repeat(20, 0)
        v = v / np.linalg.norm(v, axis=1, keepdims=True) + 0.03 * r.normal(size=(n, 16))
        v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        rows = [(k, k // 20, None, k % 3, ("head", "left")[k % 2], "active", [float(x) for x in v[k]]) for k in range(n)]
        df = spark.createDataFrame(rows, "exemplar_id long, object_id long, merged array<long>, episode_id long, camera string, bank_status string, embedding array<float>")
        q = df.where("exemplar_id % 10 = 0").select(F.col("exemplar_id").alias("query_id"), F.col("object_id").alias("q_object_id"), F.col("episode_id").alias("q_episode_id"), F.col("camera").alias("q_camera"), F.col("embedding").alias("q_embedding"))
        got = {x["query_id"]: x for x in bank.candidates(q, df, 3).collect()}
        sim = np.round(v.astype(float) @ v.astype(float).T, 6)
        for k in range(0, n, 10):
            pool = sorted((-sim[k, x], x) for x in range(n) if x % 3 != k % 3)
            own, others = [x for _, x in pool if x // 20 == k // 20], [x for _, x in pool if x // 20 != k // 20]
            assert [x["exemplar_id"] for x in got[k]["p_all"]] == own[:3] and [x["exemplar_id"] for x in got[k]["c_all"]] == others[:3]
            assert [x["exemplar_id"] for x in got[k]["c_same"]] == [x for x in others if x % 2 == k % 2][:3] and got[k]["n_all"] == len(own)
        shares.append(sum(x["compared"] for x in got.values()) / (len(got) * n))
    assert shares[0] < 0.7 and shares[1] < 0.7 * shares[0]


def test_diverse_equals_a_greedy_loop(spark):
    import numpy as np

    r = np.random.default_rng(4)
    v = r.normal(size=(40, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, k % 2, int(r.integers(0, 4)), int(r.integers(0, 120)), int(r.integers(1, 60_000)), [float(x) for x in v[k]]) for k in range(40)]
    df = spark.createDataFrame(rows, "exemplar_id long, object_id long, episode_id long, frame_idx long, mask_area long, embedding array<double>")
    got = {}
    for x in bank.diverse(df, ["object_id"]).orderBy("place").collect():
        got.setdefault(x["object_id"], []).append(x["exemplar_id"])
    for o in (0, 1):
        chosen = []
        for _ in range(6):
            free = [x for x in rows if x[1] == o and all(x[0] != c[0] and (x[2] != c[2] or abs(x[3] - c[3]) >= 30) for c in chosen)]
            if not free:
                break
            chosen.append(max(free, key=lambda x: (-sum(c[2] == x[2] for c in chosen), 1 - max(float(np.dot(x[5], c[5])) for c in chosen) if chosen else 0, min(x[4], 50_000), -x[0])))
        assert got[o] == [c[0] for c in chosen]


def test_least_counted_equals_a_greedy_loop(spark):
    import random
    from collections import Counter

    r = random.Random(5)
    rows = [(k, r.randrange(5), r.choice("abc"), r.randrange(3), r.randrange(20)) for k in range(80)]
    got = [x["clip_id"] for x in queues.least_counted(spark.createDataFrame(rows, "clip_id long, task_id long, camera string, horizon long, h long"), 30).orderBy("place").collect()]
    left, counts, want = list(rows), Counter(), []
    for _ in range(30):
        x = min(left, key=lambda x: (counts["t", x[1]], counts["c", x[2]], counts["h", x[3]], x[4], x[0]))
        left.remove(x)
        want.append(x[0])
        counts.update([("t", x[1]), ("c", x[2]), ("h", x[3])])
    assert got == want


def test_layers_by_priority(spark):
    import numpy as np

    from trackloom.functions import runs as R

    r, rows, images = np.random.default_rng(6), [], {}
    for f in range(5):
        for o in range(4):
            m = r.random((5, 6)) < 0.4
            images[f, o] = None if (f, o) == (2, 3) else m
            rows.append((1, "head", f, o, None if images[f, o] is None else [int(x) for x in R.of_raster(m)], (3 - o) % 3))
    df = spark.createDataFrame(rows, "episode_id long, camera string, frame_idx long, object_id long, runs array<long>, priority long")
    got = {(x["frame_idx"], x["object_id"]): x["runs"] for x in masks.layered(df).collect()}
    for f in range(5):
        taken = np.zeros((5, 6), bool)
        for o in sorted(range(4), key=lambda o: (-((3 - o) % 3), o)):
            m = images[f, o]
            assert got[f, o] == (None if m is None else [int(x) for x in R.of_raster(m & ~taken)])
            taken |= False if m is None else m


def test_a_clip_without_requests_gets_its_middle(spark):
    chosen = spark.createDataFrame([(1, 10)], "c long, f long")
    frames = spark.createDataFrame([(c, f) for c in (1, 2) for f in range(4, 9)], "c long, f long")
    assert sorted(map(tuple, sequences.or_middle(chosen, frames, ["c"], "f").collect())) == [(1, 10), (2, 6)]


def test_encoder_plug_point(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bcd"), (3, None)], "id long, name string")
    got = {r["id"]: r["embedding"] for r in bank.batches_of(rows, lambda batch: [[len(r["name"] or ""), 1] for r in batch]).collect()}
    assert got == {1: [1.0, 1.0], 2: [3.0, 1.0], 3: [0.0, 1.0]}
    assert bank.batches_of(rows.limit(0), lambda batch: []).count() == 0


def test_splits_that_share_groups(spark):
    rows = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "k long, e long")
    assert [tuple(r) for r in bank.shared_groups(rows, F.col("k").isin(1, 3), F.col("k").isin(2, 4), "e").collect()] == [(7, 1, 1)]
