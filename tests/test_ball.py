"""The ball tracker in stretches against one loop over all frames of a ball."""

import math
import random

import pytest

from strideframe.operators import ball
from strideframe.plans.policy import BallPolicy

FRAMES = "analysis_id long, frame long, x double, y double, confidence double"


def plain(rows):
    """Points, log and rejected motions of one ball's frames in order."""
    points, log, jumps = [], [], 0
    path, missing, number = [], 0, 0  # the segment's accepted frames
    for frame, x, y, c in rows:
        if x is None:
            if path:
                missing += 1
                if missing == 1:
                    log.append((frame, "gap_started", number, None, None))
            continue
        if path and missing <= 8:
            way = math.dist(path[-1][1:3], (x, y))
            speed = math.dist(path[-1][1:3], path[-2][1:3]) if len(path) > 1 else 0
            if way > max(42 + 24 * missing, speed * (missing + 1) * 2.5):
                jumps, missing = jumps + 1, missing + 1
                continue
            if missing:
                if missing <= 4:
                    for k in range(1, missing + 1):
                        p = k / (missing + 1)
                        points.append((path[-1][0] + k, path[-1][1] * (1 - p) + x * p, path[-1][2] * (1 - p) + y * p, number, True, min(c, path[-1][3]) * 0.6, missing))
                log.append((frame, "reacquired", number, missing, "short_gap_interpolated" if missing <= 4 else "long_gap_not_interpolated"))
        else:
            if path:
                log.append((path[-1][0], "segment_ended", number, missing, "association_gap_exceeded"))
            path, number = [], number + 1
            log.append((frame, "segment_started", number, None, None))
        path.append((frame, x, y, c))
        points.append((frame, x, y, number, False, c, 0))
        missing = 0
    if path:
        log.append((path[-1][0], "segment_ended", number, missing, "stream_ended"))
    return points, log, jumps


def walk(rng, n, blind):
    x, y, out, dark = 100.0, 100.0, [], 0
    for frame in range(n):
        x, y = x + rng.uniform(-30, 30), y + rng.uniform(-30, 30)
        if rng.random() < 0.05:
            x = rng.uniform(0, 900)
        dark = dark - 1 if dark else (rng.choice([1, 2, 4, 5, 8, 9, 10, 15]) if rng.random() < blind else 0)
        out.append((frame, None, None, 0.1) if dark else (frame, x, y, rng.choice([0.4, 0.5, 0.9])))
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_stretches_equal_one_loop_over_random_paths(spark, monkeypatch, block):
    monkeypatch.setattr(ball, "BLOCK", block)
    rng = random.Random(block)
    balls = {k: walk(rng, n, blind) for k, (n, blind) in enumerate([(400, 0.1), (3000, 0.05), (200, 0.6), (50, 0.0), (1, 0.0)])}
    balls[9] = [(f, None, None, 0.0) for f in range(20)]
    df = spark.createDataFrame([(k, *r) for k, rows in balls.items() for r in rows], FRAMES).repartition(5)
    rows = ball.track(df, BallPolicy()).collect()
    for k, frames in balls.items():
        points, log, jumps = plain(frames)
        own = [r for r in rows if r.analysis_id == k]
        got = sorted((r.frame, r.x, r.y, r.segment, r.interpolated, r.confidence, r.gap) for r in own if r.kind == "point")
        assert got == [pytest.approx(p) for p in sorted(points)]
        assert sorted([(r.frame, r.event, r.segment, r.gap, r.detail) for r in own if r.kind == "event" and r.event != "impossible_motion"], key=repr) == sorted(log, key=repr)
        assert sum(r.event == "impossible_motion" for r in own) == jumps


def test_a_single_player_is_spread_over_tasks(spark):
    df = spark.createDataFrame([(1, *r) for r in walk(random.Random(2), 4000, 0.2)], FRAMES)
    rows = ball.stretches(df, BallPolicy())
    assert rows.select("stretch").distinct().count() > 50
    assert rows.repartition(4, "analysis_id", "stretch").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).filter(bool).count() > 1


def test_reach_grows_with_the_last_step_and_the_gap(spark):
    def kept(*rows):
        return [r.frame for r in ball.reconstruct(spark.createDataFrame([(1, *r, 0.5) for r in rows], FRAMES), BallPolicy()).where("NOT interpolated").orderBy("frame").collect()]

    assert kept((0, 0.0, 0.0), (1, 20.0, 0.0), (2, 70.0, 0.0)) == [0, 1, 2]  # 50 = 20 * 2.5
    assert kept((0, 0.0, 0.0), (1, 20.0, 0.0), (2, 70.5, 0.0)) == [0, 1]
    assert kept((0, 0.0, 0.0), (1, 20.0, 0.0), (2, None, None), (3, 120.0, 0.0)) == [0, 1, 3]  # 100 = 20 * 2 * 2.5
    assert kept((0, 0.0, 0.0), (1, 42.5, 0.0)) == [0]


def test_report_names_the_state_of_the_evidence(spark):
    frames = [(1, f, None, None, 0.1) for f in range(3)] + [(2, 0, 1.0, 1.0, 0.5), (2, 1, 1.0, 1.0, 0.5)] + [(3, f, 1.0 if f % 10 == 0 else None, 1.0, 0.7) for f in range(31)] + [(4, f, float(f), 1.0, 0.5) for f in range(5)]
    rows = {r.analysis_id: r for r in ball.report(spark.createDataFrame(frames, FRAMES), BallPolicy()).collect()}
    assert [rows[k].status for k in (1, 2, 3, 4)] == ["no_ball_detected", "insufficient_observations", "excessive_track_fragmentation", "available"]
    assert (rows[3].segments, rows[3].longest_gap, rows[3].mean_gap, rows[3].fragmentation, rows[1].p50) == (4, 9, 9.0, 0.75, None)


def test_policies_are_checked():
    for bad in ({"base": 0}, {"per_gap": -1}, {"interpolate": -1}, {"restart": 3}):
        with pytest.raises(ValueError):
            BallPolicy(**bad)
