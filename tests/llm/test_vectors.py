import struct
from datetime import datetime

import numpy as np
import pytest

from tessera.llm import vectors

T0 = datetime(2024, 1, 1)
S = "id string, version long, updated_at timestamp, doc_id long, embedding_blob binary, embedding string, key string, a string"


def blob(v):
    return struct.pack(f"<{len(v)}f", *v)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", None) for r in rows], S)


def test_decoding():
    v = [1.0, -2.0, 0.5]
    for text in ("[1,-2,0.5]", " [ 1 , -2 , 5e-1 ] ", "{1.0,-2.0,0.5}", "1 -2 0.5", "(1; -2; 0.5)", "1|-2|.5"):
        assert vectors._decode(None, text, 3).tolist() == v
    assert vectors._decode(blob(v), "[9,9,9]", 3).tolist() == v
    assert vectors._decode(blob([0.0, 0, 0]), "[1,1,1]", 3).tolist() == [1, 1, 1]
    assert vectors._decode(blob([float("nan"), 1, 1]), None, 3) is None
    assert vectors._decode(b"123", "[1,2]", 3) is None
    for bad in ("null", "", "[]", "[nan,1,2]", "[1,2,x]", "[0,0,0]", "[inf,0,1]"):
        assert vectors._decode(None, bad, 3) is None


def brute(units, ids, k, least):
    out = set()
    for i in range(len(ids)):
        s = units @ units[i]
        near = sorted([(-round(s[j], 9), ids[j], j) for j in range(len(ids)) if j != i and s[j] >= least])[:k]
        out |= {(min(ids[i], x), max(ids[i], x)) for _, x, _ in near}
    return out


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 32))
    near = [base[i] + rng.standard_normal(32) * 0.12 for i in range(0, 600, 2) for _ in range(int(rng.integers(1, 4)))]
    crowd = base[1] + rng.standard_normal((700, 32)) * 0.02  # a third of all rows close together
    return np.concatenate([base, near, crowd]) * rng.uniform(0.1, 9, (1500 + len(near) + 700, 1))


def test_recall_against_brute_force(spark, rows, crowd):
    ids = list(range(100, 100 + len(crowd)))
    df = frame(spark, [(f"f{i}", 1, T0, i, blob(v), None) for i, v in zip(ids, crowd)])
    got = rows(vectors.similar_pairs(df, leaf_rows=64))
    units = crowd.astype(np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    want = brute(units, ids, 5, 0.95)
    assert len(got & want) / len(want) >= 0.95
    position = {i: n for n, i in enumerate(ids)}
    assert all(units[position[a]] @ units[position[b]] >= 0.95 - 1e-6 and a < b for a, b in got)


def test_recall_is_counted(spark, crowd):
    df = frame(spark, [(f"f{i}", 1, T0, i, blob(v), None) for i, v in enumerate(crowd)])
    got = vectors.recall(df, every=20, block=50, leaf_rows=64).first()
    assert got["asked"] == -(-len(crowd) // 20) and got["near"] >= got["found"] >= 0.9 * got["near"] > 0
    assert tuple(vectors.recall(df.limit(0)).first()) == (0, 0, 0, 1.0)


def test_copies_versions_and_dirt(spark, rows):
    rng = np.random.default_rng(6)
    v, w, u = rng.standard_normal((3, 32))
    text = "[" + ", ".join(f"{x:.9g}" for x in v) + "]"
    data = [(f"c{i}", 1, T0, i, blob(v * (i + 1)), None) for i in range(9)]  # copies of any length
    data += [("c9", 1, T0, 9, None, text), ("old", 1, T0, 50, blob(v), None), ("old", 2, T0, 51, blob(w), None)]
    data += [("d", 1, T0, 60, blob(u), None), ("d", 1, T0, 60, blob(u), None), ("e", 1, T0, 61, blob([0.0] * 32), None)]
    data += [(None, 1, T0, 62, blob(v), None), ("g", 1, T0, None, blob(v), None), ("h", 1, T0, 63, b"", "null"), ("i", 1, T0, 64, None, None)]
    df = frame(spark, data)
    got = rows(vectors.similar_facts(df).select("doc_id", "neighbour"))
    assert {b for a, b in got if a == 9} == {0, 1, 2, 3, 4}  # equal neighbours by the lowest id
    assert {b for a, b in got if a == 0} == {1, 2, 3, 4, 5}
    assert {a for a, _ in got} == set(range(10))
    assert vectors.similar_pairs(df.limit(0)).collect() == []


def test_splits_route_everything():
    rng = np.random.default_rng(7)
    u = rng.standard_normal((500, 8))
    axes = vectors.axes_of(u, 2, 8, 3)
    assert np.allclose(axes[1, :8] @ axes[1, :8].T, np.eye(8))
    heaps = vectors.fit_splits(rng.standard_normal((200, 8)), axes[0], 0, 4)[None]
    one, zero, yes = np.ones(500, dtype=np.int64), np.zeros(500, dtype=np.int64), np.ones(500, dtype=bool)
    home = vectors.descend(u, axes[0], one, heaps, zero)
    assert home.min() >= 16 and home.max() < 32 and len(set(home)) == 16
    row, node, own, _ = vectors.spread_out(u, axes[0], np.full(500, 1e9), one, yes, np.zeros(500), heaps, zero, 1e-9)
    assert len(row) == 500 * 16  # with a window over everything, each meets every leaf
    assert {(int(r), int(n)) for r, n in zip(row[own], node[own])} == set(enumerate(home.tolist()))
    row, node, own, _ = vectors.spread_out(u, axes[0], np.zeros(500), one, yes, np.zeros(500), heaps, zero, 0.03)
    assert sorted(row) == list(range(500)) and (node[np.argsort(row)] == home).all()
    assert (vectors.descend(u, axes[0], one, heaps, zero - 1) == 1).all()


@pytest.mark.parametrize("broadcast", [4096, 0])
def test_stages_keep_leaves_small(spark, monkeypatch, broadcast):
    """More levels than one stage has, with the splits given to the tasks and with a join."""
    monkeypatch.setattr(vectors, "HOT_SHARE", broadcast)
    rng = np.random.default_rng(8)
    u = rng.standard_normal((6000, 4)).astype("<f4")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(u)], "a long, vec binary")
    leaves = vectors.Leaves(points, 6000, 4, 1, 4, 600, 3)
    assert len(leaves.stages) > 1 and leaves.homes.count() == 6000
    assert leaves.homes.groupBy("node").count().where("count > 8").isEmpty()
    full = leaves.asked(points.selectExpr("a", "vec", "cast(1e9 as double) as need").where("a < 3"), 1e-9, 1e-9, 0.0)
    assert full.where("home").count() == 3
    full = full.where("not home")
    held = leaves.homes.select("node").distinct()  # a leaf that no vector fell into may be asked as well
    assert full.join(held, "node").count() == 3 * (held.count() - 1)




def test_bundles_hold_what_was_asked(spark, monkeypatch):
    rng = np.random.default_rng(11)
    u = rng.standard_normal((4000, 8)).astype("<f4")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(u)], "a long, vec binary")
    leaves = vectors.Leaves(points, 4000, 8, 1, 8, 4000, 3)
    asked = leaves.asked(points.selectExpr("a", "vec", "cast(0.5 as double) as need"), 0.05, 0.05, 0.0)
    want = {(r["a"], r["node"], r["home"]) for r in asked.select("a", "node", "home").collect()}
    bundles = leaves.bundled(asked).select("bundle", "own", "nodes", "a").collect()
    got = [(r["a"], n, False) for r in bundles for n in r["nodes"]] + [(r["a"], r["own"], True) for r in bundles if r["own"] >= 0]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(bundles) < len(want)
