import random

from maillake.llm.graph import components
from maillake.llm.store import scratch

from .helpers import component_names


def found(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r["node"]: r["component"] for r in components(df, scratch(spark, "test"), "c").collect()}


def test_random_graphs_paths_and_stars(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(0, 300)]
    shuffled = list(range(1000, 1200))
    rng.shuffle(shuffled)
    graph = path + list(zip(shuffled, shuffled[1:])) + [(5000, 5000 - i) for i in range(1, 500)]
    graph += [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(260)] + [(9, 9), (0, 1), (1, 0)]
    real = [(a, b) for a, b in graph if a != b]
    names = component_names({x for e in real for x in e}, real)
    assert found(spark, graph) == names


def test_no_edges(spark):
    assert found(spark, []) == {}
