import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.default.parallelism", "4").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def write_tree(root, files):
    for name, content in files.items():
        path = os.path.join(str(root), name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w" if isinstance(content, str) else "wb", newline="" if isinstance(content, str) else None) as f:
            f.write(content)


@pytest.fixture
def make_index(spark, tmp_path):
    """Build an index over small repositories: make_index({repo: {path: content}}) -> (navigator, builder, roots)."""
    from quarry.model import Limits
    from quarry.plans.build import Builder
    from quarry.plans.store import Store
    from quarry.plans.tools import Navigator
    from quarry.sources.config import Config, Repo

    def make(repos, **limits):
        roots = {}
        for name, files in repos.items():
            roots[name] = str(tmp_path / name)
            os.makedirs(roots[name], exist_ok=True)
            write_tree(roots[name], files)
        config = Config([Repo(n, r) for n, r in roots.items()], limits=Limits(**limits))
        store = Store(spark, "file://" + str(tmp_path / "index"))
        os.makedirs(tmp_path / "index", exist_ok=True)
        builder = Builder(spark, store, config)
        stats = builder.build()
        navigator = Navigator(spark, store, roots, config.limits)
        navigator.stats = stats
        return navigator, builder, roots

    return make
