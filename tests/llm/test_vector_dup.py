import numpy as np

from maillake.llm import vector_dup as vd
from maillake.llm.queries import QUERIES
from maillake.llm.store import scratch

from .helpers import component_names

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=vd.THRESHOLD):
    links = {}
    for i, (a, x, p) in enumerate(rows):
        for b, y, q in rows[:i]:
            if p is None or p != q or len(x) != len(y):
                continue
            x_, y_ = np.array(x, float), np.array(y, float)
            with np.errstate(all="ignore"):
                c = x_ @ y_ / (np.linalg.norm(x_) * np.linalg.norm(y_))
            if np.isfinite(c) and c >= threshold:
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
    names = component_names([r[0] for r in rows], [(a, b) for a, own in links.items() for b in own])
    return {r[0]: (len(links.get(r[0], ())), names[r[0]]) for r in rows}


def found(spark, rows):
    out = vd.near_duplicates(spark.createDataFrame(rows, SCHEMA), scratch(spark, "test")).collect()
    assert len(out) == len(rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}


def test_the_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op7_vector_duplicates"](spark, SF).collect()}
    assert got == brute(rows)


def test_dense_groups_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vd, "BLOCK", 20)
    rng = np.random.default_rng(1)
    center = rng.standard_normal(16)
    rows = [(i, (center + 0.04 * rng.standard_normal(16)).tolist(), 1) for i in range(90)]
    rows += [(100 + i, center.tolist(), 1) for i in range(40)] + [(200 + i, center.tolist(), 2) for i in range(3)]
    rows += [(300 + i, rng.standard_normal(16).tolist(), 1) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def dense(rng, center, n, size=32):
    """Vectors with a cosine of about 0.99 to each other."""
    center = center / np.linalg.norm(center)
    return [(center + 0.1 * x / np.linalg.norm(x)).tolist() for x in rng.standard_normal((n, size))]


def test_links_between_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(vd, "AUDITED", 4)
    rng = np.random.default_rng(3)
    vectors = []
    for n in [20] * 12 + [150]:
        one, other = rng.standard_normal((2, 32))
        one /= np.linalg.norm(one)
        other -= one * (one @ other)
        other /= np.linalg.norm(other)
        vectors += dense(rng, one, n) + dense(rng, 0.944 * one + np.sqrt(1 - 0.944**2) * other, n)
    vectors = [vectors[i] for i in rng.permutation(len(vectors))]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    assert found(spark, rows) == brute(rows)


def test_balls_miss_no_link_between_components(spark, monkeypatch):
    monkeypatch.setattr(vd, "BLOCK", 5)
    rng = np.random.default_rng(4)
    groups = [dense(rng, rng.standard_normal(3), 12, 3) for _ in range(60)]
    rows = [(f"{g:03}-{i:03}".encode(), 1, np.array(v).tobytes(), b"%03d" % g) for g, own in enumerate(groups) for i, v in enumerate(own)]
    members = spark.createDataFrame(rows, "node binary, space long, vec binary, component binary")
    links = vd.crossing_links(members, scratch(spark, "test"), 0.93, "x").collect()
    unit = [np.array(g) / np.linalg.norm(g, axis=1, keepdims=True) for g in groups]
    wanted = {(a, b) for a in range(60) for b in range(a) if (unit[a] @ unit[b].T).max() >= 0.93}
    assert {tuple(sorted((int(r["a"][:3]), int(r["b"][:3])), reverse=True)) for r in links} == wanted


def test_low_recall_ends_in_exact_comparisons(spark, monkeypatch):
    monkeypatch.setattr(vd, "RECALL", 1.01)
    monkeypatch.setattr(vd, "TRIES", 1)
    monkeypatch.setattr(vd, "BLOCK", 16)
    monkeypatch.setattr(vd, "TREES", 1)
    monkeypatch.setattr(vd, "RUN", 2)
    monkeypatch.setattr(vd, "ROUNDS", 0)  # next to no link is found by the descent
    rng = np.random.default_rng(8)
    rows = [(i, v, 1 + i % 2) for i, v in enumerate(rng.standard_normal((90, 3)).tolist())]
    assert found(spark, rows) == brute(rows)


def test_balls_linked_as_a_whole_are_not_compared(spark, monkeypatch):
    """Counts of a dense group equal brute force, and no vector of it meets another one."""
    monkeypatch.setattr(vd, "BLOCK", 16)
    rng = np.random.default_rng(9)
    vectors = [(np.eye(8)[0] + 0.01 * rng.standard_normal(8)) for _ in range(300)]
    rows = [(b"%04d" % i, 1, v.tobytes(), 1 + i % 3, b"c") for i, v in enumerate(vectors)]
    members = spark.createDataFrame(rows, "node binary, space long, vec binary, copies long, component binary")
    tables = scratch(spark, "test")
    met = []
    real = vd._meeting
    monkeypatch.setattr(vd, "_meeting", lambda pairs, own, *c: (met.append(pairs.count()), real(pairs, own, *c))[1])
    counts = {bytes(r["node"]): r["n"] for r in vd.count_links(members, tables, 0.93).collect()}
    total = sum(r[3] for r in rows)
    assert met == [0] and counts == {r[0]: total - r[3] for r in rows}


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1),
            (6, [inf, 1.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [-1.0, 0.0], 1), (10, [1e200, 1e-200], 1), (11, [0.0, -1e-300], 1)]
    extra = [(7, None, 1), (12, [1.0, None], 1), (13, [], 1)]
    got = found(spark, rows + extra)
    assert {k: got[k] for k, _, _ in extra} == {7: (0, 7), 12: (0, 12), 13: (0, 13)}
    assert got[1] == got[2] == got[10][:1] + (1,) == (2, 1)
    assert all(got[k] == (0, k) for k in (3, 4, 5, 6, 8, 9, 11))
    assert vd.near_duplicates(spark.createDataFrame([], SCHEMA), scratch(spark, "test")).count() == 0


def test_repeated_rows_link_with_each_other(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    out = vd.near_duplicates(spark.createDataFrame(rows, SCHEMA), scratch(spark, "test")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in out) == [("1", 2, 1), ("1", 2, 1), ("None", 2, 1)]
