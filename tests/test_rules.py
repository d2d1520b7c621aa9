"""The smaller rules on hand cases, and balanced clips against a plain loop."""

from pyspark.sql import functions as F

from trackloom.operators import queues, rules


def test_confirmed_by_the_one_before(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    rows = [("a", 0, *box), ("a", 3, *box), ("a", 7, *box), ("a", 8, 5.0, 0.0, 15.0, 10.0), ("a", 9, 50.0, 50.0, 60.0, 60.0), ("b", 8, *box), ("b", 9, None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, frame_idx int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.k, r.frame_idx): r.confirmed for r in rules.confirmed(df, ["k"], 3, 0.3).collect()}
    assert got == {("a", 0): False, ("a", 3): True, ("a", 7): False, ("a", 8): True, ("a", 9): False, ("b", 8): False, ("b", 9): False}


def test_prompts(spark):
    ok = ([[1, 1], [5, 5]], [1, 0], [0, 0, 4, 4])
    cases = [
        (ok, True), (([[-1, 1]], [1], [0, 0, 4, 4]), False), (([[10, 1]], [1], [0, 0, 4, 4]), False), (([[1, 1]], [0], [0, 0, 4, 4]), False), (([[1, 1]], [2], [0, 0, 4, 4]), False),
        (([[1, 1]], [1, 0], [0, 0, 4, 4]), False), (([[1, 1]], [1], [4, 0, 4, 4]), False), (([[1, 1]], [1], [0, -1, 4, 4]), False), (([[1, 1]], [1], [0, 0, 11, 4]), False), ((None, [1], [0, 0, 4, 4]), False)]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, p array<array<int>>, l array<int>, b array<int>")
    got = {r.i: r.v for r in df.select("i", rules.prompt_valid(F.col("p"), F.col("l"), F.col("b"), 10, 8).alias("v")).collect()}
    assert got == {i: v for i, (_, v) in enumerate(cases)}


def test_scenes_and_assembly(spark):
    df = spark.createDataFrame([(i, f) for i, f in enumerate((5, 30, 60, 61, 500, None))], "sample_id int, f int")
    state = rules.scene_visibility(F.col("f"), [("partial_occlusion", [(30, 60)]), ("visible", [(0, 100), (150, 200)])])
    assert [r.v for r in df.orderBy("sample_id").select(state.alias("v")).collect()] == ["visible", "partial_occlusion", "partial_occlusion", "visible", "unknown", "unknown"]
    x = df.select("sample_id", state.alias("visibility"), F.lit(0.5).alias("iou"))
    refined = spark.createDataFrame([(1, 0.9), (4, 0.8)], "sample_id int, refined double")
    got = {r.sample_id: (r.source, r.confidence) for r in rules.assembled(x, refined).collect()}
    assert got == {0: ("scene", 0.25), 1: ("refined", 0.9), 2: ("scene", 0.25), 3: ("scene", 0.25), 4: ("refined", 0.8), 5: ("none", None)}


def test_isolation_exclusion_and_counts(spark):
    rows = spark.createDataFrame([(1, "a", True, "x"), (1, "b", False, None), (2, "c", False, "x"), (None, "d", True, "x"), (None, "e", None, "y")], "clip int, s string, held boolean, action string")
    assert [r.s for r in rules.isolated(rows, F.col("held"), "clip").collect()] == ["c"]
    assert {r.action: (r.scored, r.excluded) for r in rules.scored_and_excluded(rows, ["action"], F.col("held")).collect()} == {"x": (1, 2), None: (1, 0), "y": (1, 0)}
    assert sorted((r.s, r.n) for r in rules.event_counts(rows.withColumn("s", F.lit("all")), ["s"]).collect()) == [("all", 1), ("all", 3)]
    assert {(r.action, r.origin): r.labels for r in rules.label_origins(rows, "action", F.col("held")).collect()} == {("x", "assisted"): 2, ("x", "manual"): 1, (None, "manual"): 1, ("y", "manual"): 1}
    times = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 6), (2, 0, 6), (2, 1, None)], "k int, i int, t int")
    assert {r.k: (r.samples, r.repeated) for r in rules.repeated_times(times, "k", F.col("t"), ["i"]).collect()} == {1: (3, 1), 2: (2, 0)}


def test_joint_motion(spark):
    a, b = [0.0] * 23, [0.0] * 23
    b[7], b[13], b[15], b[14], b[22] = 1.0, -2.0, 4.0, 3.0, -5.0
    got = rules.joint_motion(spark.createDataFrame([(1, 0, a), (1, 1, b), (1, 2, a)], "k int, i int, v array<double>"), "k", "i", "v").first()
    assert (got.left_arm, got.right_arm, got.left_gripper, got.right_gripper) == (6.0, 8.0, 3.0, 5.0)


def test_compared_backends(spark):
    a = spark.createDataFrame([(1, "v", True), (2, "v", False), (3, "w", None)], "k int, g string, p boolean")
    b = spark.createDataFrame([(1, "v", True), (3, "w", True), (4, "w", False)], "k int, g string, p boolean")
    assert {r.g: (r.frames, r.agree, r.unmatched) for r in rules.compared_backends(a, b, "k", "g", "p").collect()} == {"v": (2, 1, 1), "w": (2, 0, 1)}


def test_balanced_clips_equal_the_loop(spark):
    """Choices one by one over all clips, not only over the first of each camera."""
    import random

    r = random.Random(12)
    rows = [(k, r.choice(["head", "head", "head", "left", "right"]), r.randrange(30), r.randrange(50)) for k in range(200)]
    df = spark.createDataFrame(rows, "clip_id long, camera string, episode_id long, h long")
    for n in (1, 7, 25, 60):
        used, episodes, want = {}, set(), []
        for _ in range(n):
            free = [x for x in rows if x[2] not in episodes]
            if not free:
                break
            k, camera, episode, _ = min(free, key=lambda x: (used.get(x[1], 0), x[3], x[0]))
            want.append((k, camera, len(want)))
            used[camera] = used.get(camera, 0) + 1
            episodes.add(episode)
        assert sorted(map(tuple, queues.balanced_clips(df, n).collect()), key=lambda x: x[2]) == want
