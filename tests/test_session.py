"""Shared folders, hot keys and joins that spread them."""

import types

import pytest
from pyspark.sql import functions as F

from strandline import session


def fake(master, folder=None):
    conf = types.SimpleNamespace(get=lambda key, default=None: folder or default)
    return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, applicationId="app-1"))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,3000]"):
        with pytest.raises(session.NoSharedFolder):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, "hdfs://x/shared/")) == "hdfs://x/shared/strandline-app-1"
    assert session.shared_dir(fake("local[4]")).startswith("file://")


def test_the_tests_have_a_folder_of_their_own(spark):
    assert session.shared_dir(spark).startswith(spark.conf.get(session.CHECKPOINT_CONF))


def test_hot_keys_by_share_and_by_number(make):
    rows = [{"k": "a"}] * 3000 + [{"k": "b"}] * 1500 + [{"k": None}] * 2000 + [{"k": f"x{i}"} for i in range(300)]
    df = make("k string", *rows).where("k is not null")
    assert {r["k"]: r["n"] for r in session.hot_keys(df, ["k"], 0.5).collect()} == {"a": 3000}
    assert {r["k"] for r in session.hot_keys(df, ["k"], 0.9, 1200).collect()} == {"a", "b"}
    assert session.small(df, 4800) and not session.small(df, 4799)


def test_lookups_keep_every_row_once(make, monkeypatch):
    rows = make("id long, k string, x int", *[{"id": i, "k": "hot" if i < 2500 else None if i < 2600 else f"k{i % 40}"} for i in range(3000)])
    table = make("k string, v int, x int", {"k": "hot", "v": 1}, *[{"k": f"k{i}", "v": i} for i in range(30)])
    want = sorted((r["id"], r["v"]) for r in rows.join(table.drop("x"), "k", "left").collect())
    for most in (100_000, 0):
        monkeypatch.setattr(session, "small", lambda df, most=most: df.limit(most + 1).count() <= most)
        assert sorted((r["id"], r["v"]) for r in session.lookup(rows, table, ["k"], "id", ["v"]).collect()) == want
    pairs = session.lookup_pairs(rows.drop("x"), table.drop("x"), "k", F.col("id"))
    assert sorted((r["id"], r["v"]) for r in pairs.collect()) == [x for x in want if x[1] is not None]
