"""Hard negatives against the full join."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relaytrace.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, vec string, win string"


def brute(rows, is_anchor, positives=5, negatives=5, low=80):
    """One row a dictionary of id, label and whole-number vector."""
    rows = [(i, lab, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, lab in rows
            if i is not None and v is not None and lab is not None and all(c is not None and math.isfinite(c) for c in v)]
    seen, out = set(), []
    for i, lab, v in rows:
        if not is_anchor(i) or (i, lab, tuple(v)) in seen:
            continue
        seen.add((i, lab, tuple(v)))
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            near = [x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(near)]
    return sorted(out)


def make(seed, n=400, dims=20, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.6) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]
    rows += [(n + i, rows[7][1], i % labels) for i in range(60)]  # a common vector
    rows += [(None, rows[0][1], 0), (9001, None, 0), (9002, [float("nan")] * dims, 1), (9003, [1.0, None], 1), (9004, [float("inf")] * dims, 2),
             (9005, rows[1][1], None), (9006, [], 0), (9007, [1.0, 2.0], 1), (20, *rows[20][1:]), (21, *rows[21][1:]), (20, rows[5][1], 1), (9008, [0.0] * dims, 3)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


@pytest.mark.parametrize(("seed", "block", "low", "labels"), [(1, 2048, 80, 4), (2, 7, 50, 9), (3, 16, 100, 1)])
def test_mine_equals_full_join(spark, monkeypatch, seed, block, low, labels):
    rows = make(seed, labels=labels)
    got = hn.mine(frame(spark, rows).repartition(5), F.col("id") % 20 == 0, low=low, block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 20 == 0, low=low)
    assert got or labels == 1


def test_no_rows(spark):
    empty = frame(spark, []).limit(0)
    assert hn.mine(empty, F.col("id") % 100 == 0).count() == 0
    assert hn.mine(frame(spark, [(100, [1.0], 1)]), F.col("id") % 100 == 0).count() == 0
    assert hn.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 1)]), F.col("id") % 100 == 0).count() == 0


def blocks(seed, scale, dims=37):
    rng = np.random.default_rng(seed)
    fade = 1.2 ** -np.arange(dims)
    x = (rng.normal(size=(300, dims)) * fade * scale).astype(np.int64)
    q = (rng.normal(size=(40, dims)) * fade * scale).astype(np.int64)
    anchors = hn.Anchors(list(range(40)), [0] * 40, q.tolist(), dims)
    return hn.Rows(np.arange(300), np.zeros(300, np.int64), x[:, anchors.order]), anchors, x, q


@pytest.mark.parametrize("scale", [50, 1_000_000, 400_000_000])
def test_search_returns_every_pair_over_the_threshold(scale):
    rows, anchors, x, q = blocks(3, scale)
    full = x.astype(object) @ q.astype(object).T
    for share in (2, 0.6, 0.3, 0.0, -0.5, -np.inf):
        least = share * np.sqrt(np.square(q.astype(float)).sum(axis=1)) * scale * 2
        which = np.arange(0, 40, 3)
        r, a, s = hn.search(rows, anchors, which, least[which])
        want = {(i, j): full[i, j] for i in range(300) for j in which if full[i, j] >= least[j]}
        assert {(i, j): v for i, j, v in zip(r.tolist(), a.tolist(), s.tolist(), strict=True)} == want


def test_windows_fill_over_blocks_and_scores_only_fall_to_the_low_end():
    rows, anchors, x, q = blocks(5, 80)
    labels = np.arange(300) % 2
    win = hn.Windows(anchors, np.arange(40), np.full(40, 3000.0), np.full(40, 6000.0), 3, same_label=False)
    for lo in range(0, 300, 70):
        win.take(hn.Rows(rows.ids[lo:lo + 70] + 1000, labels[lo:lo + 70], rows.x[lo:lo + 70]))
    full = x @ q.T
    for a in range(40):
        want = sorted((-full[i, a], i + 1000) for i in range(300) if labels[i] != 0 and 3000 <= full[i, a] <= 6000)[:3]
        got = sorted((-s, i) for w, s, i in zip(win.win, win.score, win.ids, strict=True) if w == a)
        assert got == want
