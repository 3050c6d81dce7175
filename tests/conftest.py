import datetime as dt
import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]

from times import START  # noqa: E402

from wayfare.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("TZ", "UTC")
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def journey(spark):
    """One-session event tables from (offset seconds, kind letter, product, category)."""
    kinds = {"v": "view", "c": "cart", "r": "remove_from_cart", "p": "purchase"}

    def make(*rows, session="1_0"):
        data = [
            (1, session, START + dt.timedelta(seconds=t), kinds[k], p, c, 10.0 * (i + 1), i)
            for i, (t, k, p, c) in enumerate(rows)
        ]
        return spark.createDataFrame(
            data, "user_id long, session_id string, event_time timestamp, event_type string, "
                  "product_id long, category_id long, price double, seq long")

    return make


@pytest.fixture(scope="session")
def scores(spark):
    """Two runs of imbalanced scores with ties, and the same data as plain lists."""
    import numpy as np

    rng = np.random.default_rng(7)
    y = (rng.random(1500) < 0.13).astype(int)
    a = np.round(np.clip(0.3 * y + rng.random(1500) * 0.7, 0, 1), 3)
    b = np.round(np.clip(0.15 * y + rng.random(1500) * 0.7, 0, 1), 2)
    rows = [(f"s{i}", int(y[i]), float(a[i]), float(b[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "session_id string, y int, a double, b double"), y, a, b
