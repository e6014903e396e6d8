import numpy as np
import pytest

from vecloom.operators.ann import Graph


def groups_of_copies(metric):
    """300 rows, and 4 groups of 40 near copies of one: pruning cuts rows and groups off."""
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.repeat(x[:4], 40, 0)
    x = np.concatenate([x, near + 0.01 * r.standard_normal(near.shape)])
    return Graph(x[r.permutation(len(x))].astype(np.float32), metric, 4, 20, 7)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_every_row_is_found_by_its_own_vector(metric):
    """At any width from the usual one, under a filter, and after a round trip."""
    built = groups_of_copies(metric)
    odd = np.arange(len(built.x)) % 2 == 1
    for graph in (built, Graph.load(built.dump())):
        for how in ({}, {"ef": 51}, {"ef": 200}):
            assert [i for i in range(len(graph.x)) if graph.search(graph.x[i], 1, **how)[0] != i] == []
        assert [i for i in np.flatnonzero(odd) if graph.search(graph.x[i], 1, allowed=odd)[0] != i] == []


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_copies_and_odd_vectors_end(metric):
    """More copies than a search keeps, vectors of zeros and of no numbers: the search for missed rows ends, a row gets as many edges more as a search keeps at most."""
    for value in (1.0, 0.0, np.nan):
        x = np.random.default_rng(1).standard_normal((140, 8)).astype(np.float32)
        x[20:] = value
        graph = Graph(x, metric, 4, 20, 7)
        assert max(map(len, graph.layers[0].values())) <= 8 + 50
        if metric != "dot" and value == 1.0:
            assert all(graph.search(x[i], 1)[0] == i for i in range(20))
            assert (graph.x[graph.search(x[30], 10)] == 1).all()
