"""Streams of pages, runs that are cancelled, and distances of poses."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinia.operators import spatial
from affinia.session import Run, scratch
from affinia.sources import paged


def count(url):
    return int(open(f"{url}/count").read())


def fetch(url, offset, limit):
    """Records offset .. offset + limit; each request is a line of the log. Page 20 fails while the file ``down`` is there."""
    import os

    if offset >= 20 and os.path.exists(f"{url}/down"):
        raise ValueError("down")
    with open(f"{url}/log", "a") as f:
        f.write(f"{offset} {limit}\n")
    return [{"id": i} for i in range(offset, offset + limit)]


def test_a_killed_stream_goes_on_without_lost_or_double_records(spark, tmp_path):
    options = {"url": str(tmp_path), "fetch": "tests.test_runs:fetch", "count": "tests.test_runs:count", "page": "10", "pages_per_task": "1", "tries": "1"}
    out, check = scratch(spark, "out"), scratch(spark, "checkpoint")
    ids = lambda: sorted(json.loads(r.json)["id"] for r in spark.read.parquet(out).collect())
    (tmp_path / "count").write_text("15")
    paged.followed(spark, out, check, **options).awaitTermination()
    assert ids() == list(range(15))
    (tmp_path / "count").write_text("37")
    (tmp_path / "down").write_text("")
    with pytest.raises(Exception, match="down"):
        paged.followed(spark, out, check, **options).awaitTermination()
    assert ids() == list(range(15))  # the batch that was under way left nothing to be read
    (tmp_path / "down").unlink()
    paged.followed(spark, out, check, **options).awaitTermination()
    assert ids() == list(range(37))
    before = (tmp_path / "log").read_text()
    paged.followed(spark, out, check, **options).awaitTermination()
    assert ids() == list(range(37)) and (tmp_path / "log").read_text() == before


def slow(batches):
    for b in batches:
        time.sleep(0.2)
        yield b


def test_one_of_two_runs_is_cancelled(spark):
    job = lambda n: lambda: spark.range(0, n, 1, n).mapInArrow(slow, "id long").count()
    a, b = Run(spark, "first", job(400)), Run(spark, "second", job(8))
    end = time.time() + 60
    while not a.progress()[1] and time.time() < end:
        time.sleep(0.1)
    done, every = a.progress()
    assert 0 <= done < every
    a.cancel()
    with pytest.raises(Exception, match="(?i)cancel"):
        a.wait()
    assert b.wait() == 8


def atoms_of(n, seed, names=5):
    r = random.Random(seed)
    return [(c, p, a, r.random(), r.random(), r.random()) for c in range(3) for p in range(n if c else 1) for a in range(names - (p == 2))]


@pytest.mark.parametrize("poses, fit", [(64, False), (3, False), (3, True)])
def test_distances_of_poses(spark, monkeypatch, poses, fit):
    monkeypatch.setattr(spatial, "POSES", poses)
    rows = atoms_of(9, 1)
    random.Random(2).shuffle(rows)
    got = {(r.compound, r.a, r.b): r.rmsd for r in spatial.pose_rmsd(spark.createDataFrame(rows, "compound int, pose int, atom int, x double, y double, z double"), fit).collect()}
    xyz = {}
    for c, p, _, *v in sorted(rows):
        xyz.setdefault((c, p), []).append(v)
    want = {}
    for (c, p), u in xyz.items():
        for (d, q), v in xyz.items():
            if c == d and p < q and len(u) == len(v):
                want[c, p, q] = float(spatial.fitted_rmsd(np.array(u), np.array(v))) if fit else math.sqrt(sum(math.dist(a, b) ** 2 for a, b in zip(u, v)) / len(u))
    assert got == pytest.approx(want) and len(want) == 2 * 28


def test_a_turned_copy_fits_and_a_mirror_image_does_not():
    a = np.random.default_rng(3).normal(size=(7, 3))
    turn = np.linalg.qr(np.random.default_rng(4).normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    assert spatial.fitted_rmsd(a, a @ turn + 5) == pytest.approx(0, abs=1e-6)
    assert spatial.fitted_rmsd(a, a * [1, 1, -1]) > 0.1


def test_consistent_poses_are_counted(spark):
    poses = spark.createDataFrame([(1, "a", 1.0, True), (1, "b", 2.0, True), (1, "c", 0.0, False), (1, "d", 3.0, True), (2, "e", 1.0, True)], "compound int, pose string, score double, valid boolean")
    rmsd = spark.createDataFrame([(1, "a", "b", 1.5), (1, "a", "c", 0.1), (1, "b", "d", 0.1), (1, "d", "a", 2.0)], "compound int, a string, b string, rmsd double")
    got = {r.compound: (r.pose, r.n_valid, r.consistent) for r in spatial.best_pose(poses, rmsd).collect()}
    assert got == {1: ("a", 3, 2), 2: ("e", 1, 0)}
    assert spatial.best_pose(poses.where(F.lit(False)), rmsd).count() == 0
