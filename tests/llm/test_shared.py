import numpy as np
import pytest

from waymark.llm.shared import components


def least_reached(edges):
    up = {v: v for e in edges for v in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {v: find(v) for e in edges if e[0] != e[1] for v in e}


def rows_joined(spark, since):
    """Rows that joins made in the SQL executions after ``since``."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs, total = store.executionsList(), 0
    for k in range(since, runs.size()):
        at = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for i in range(nodes.size()):
            metrics = nodes.apply(i).metrics()
            for j in range(metrics.size()) if "Join" in nodes.apply(i).name() else ():
                value = values.get(metrics.apply(j).accumulatorId())
                if metrics.apply(j).name() == "number of output rows" and value.isDefined():
                    total += int(value.get().replace(",", ""))
    return total


def path(n):
    return [(i, i + 1) for i in range(n)]


def cliques(count, size):
    return [(size * g + i, size * g + j) for g in range(count) for i in range(size) for j in range(i)]


def drawn():
    rng = np.random.default_rng(4)
    return [tuple(int(x) for x in e) for e in rng.integers(-500, 500, (600, 2))]


@pytest.mark.parametrize("edges", [path(300), [(9, i) for i in range(50)], [(a * 37 % 301, b * 37 % 301) for a, b in path(300)], cliques(3, 8), drawn(), [(-(2**63), 5), (5, 2**63 - 1), (5, 5), (7, 7), (1, 0), (0, 1)]])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.v for r in got}) and {r.v: r.c for r in got} == least_reached(edges)


def test_components_without_edges(spark):
    for rows in ([], [(3, 3)]):
        got = components(spark.createDataFrame(rows, "a long, b long"))
        assert got.columns == ["v", "c"] and got.count() == 0


def test_components_join_no_edge_in_every_round(spark):
    # dense groups hung on a long path: as many rounds as the path needs, few edges left in the later ones
    edges = cliques(20, 30) + [(30 * g, 30 * g + 30) for g in range(19)] + [(600 + a, 600 + b) for a, b in path(200)]
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.c for r in got} == least_reached(edges)
    assert 0 < rows_joined(spark, since) <= 4 * len(edges)
