from __future__ import annotations

import glob
import math
import os
import random

import pytest
from pyspark.sql import SparkSession

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("skyframe-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def separation(a, b) -> float:
    """Degrees between two (ra, dec), by unit vectors: not the formula under test."""
    vectors = []
    for ra, dec in (a, b):
        ra, dec = math.radians(ra), math.radians(dec)
        vectors.append((math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec)))
    (x, y, z), (u, v, w) = vectors
    cross = math.hypot(y * w - z * v, z * u - x * w, x * v - y * u)
    return math.degrees(math.atan2(cross, x * u + y * v + z * w))


def awkward_points(n: int, seed: int = 5):
    """Points over the sphere, crowded at the poles, the seam and one field; some not points."""
    rng = random.Random(seed)
    points = []
    for _ in range(n):
        points.append((rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))))
        points.append((rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(86, 90)))
        points.append((rng.choice([0.0, 360.0, 359.9]) + rng.uniform(-0.5, 0.5), rng.uniform(-30, 30)))
        points.append((120 + rng.uniform(-1, 1), 20 + rng.uniform(-1, 1)))
    points += [(0.0, 90.0), (77.0, -90.0), (None, 5.0), (5.0, None), (math.nan, 5.0), (5.0, math.nan), (math.inf, 0.0)]
    return list(enumerate(points))


def known(point) -> bool:
    return all(v is not None and math.isfinite(v) for v in point)
