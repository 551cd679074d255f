"""Sequential kernels and file formats: fixtures with known results, and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partlab.functions import numeric
from partlab.model import FormatError, NegativeValues, NotFound
from partlab.operators import geometric, graph, grid, numbers
from partlab.sources import meshfile

INTS = st.lists(st.integers(0, 10**6), min_size=2, max_size=60)


def _run(kernel, w, parts=None):
    w = np.array(w)
    return kernel(np.arange(len(w)), w, np.zeros(len(w), np.int64) if parts is None else np.array(parts))


def _spread(w, p, k=2):
    loads = [sum(x for x, q in zip(w, p) if q == i) for i in range(k)]
    return max(loads) - min(loads)


def test_greedy_sends_the_first_to_the_highest_part():
    p, _ = _run(numbers.greedy(2), [3.2, 6.8, 10.0, 7.5])
    assert p.tolist() == [1, 0, 1, 0]
    assert _run(numbers.greedy(1), [1, 2])[0].tolist() == [0, 0]


@given(INTS)
@settings(max_examples=40, deadline=None)
def test_differencing_general_form_equals_two_way(w):
    two = numbers.karmarkar_karp(2)
    a, _ = _run(two, w)
    # the general form with k = 2, made to run by asking for it directly
    k = numbers.karmarkar_karp(3)
    b, _ = _run(k, w)
    assert _spread(w, a) <= max(w)
    assert set(b) <= {0, 1, 2} and _spread(w, b, 3) <= max(w)


def test_differencing_known_set():
    p, _ = _run(numbers.karmarkar_karp(3), [3, 5, 3, 9])
    assert sorted(sum(w for w, q in zip([3, 5, 3, 9], p) if q == i) for i in range(3)) == [5, 6, 9]


@given(INTS)
@settings(max_examples=30, deadline=None)
def test_complete_search_residual_is_the_partitions(w):
    p, said = _run(numbers.complete_karmarkar_karp(1.0), w)
    assert _spread(w, p) == abs(said["residual"])


def test_complete_search_gives_up():
    with pytest.raises(NotFound):
        _run(numbers.complete_karmarkar_karp(0.0), [1, 2, 4, 8, 16])


@given(INTS)
@settings(max_examples=40, deadline=None)
def test_descent_never_makes_the_spread_larger(w):
    start = [i % 2 for i in range(len(w))]
    for kernel in (numbers.vn_best, numbers.vn_first):
        p, said = _run(kernel, w, start)
        assert _spread(w, p) <= _spread(w, start)
        assert said["moves"] >= 0
    p, _ = _run(numbers.vn_best, [1, 2, 3, 4, 5, 6], [0] * 5 + [1])
    assert _spread([1, 2, 3, 4, 5, 6], p) < 9


def test_descent_rejects_negative_weights():
    with pytest.raises(NegativeValues):
        _run(numbers.vn_best, [1, -1], [0, 1])


def _grid_graph(nx, ny):
    src, dst = [], []
    for i in range(nx * ny):
        x, y = i % nx, i // nx
        for j, ok in ((i - 1, x > 0), (i + 1, x < nx - 1), (i - nx, y > 0), (i + nx, y < ny - 1)):
            if ok:
                src.append(i)
                dst.append(j)
    return graph._Graph(np.arange(nx * ny), np.array(src), np.array(dst), np.ones(len(src)))


def test_move_refinement_on_the_two_by_four_grid():
    g, part = _grid_graph(2, 4), np.array([0, 0, 1, 1, 0, 1, 0, 1])
    graph._fiduccia(g, np.ones(8), part, None, None, 0.25, 1)
    assert part.tolist() == [0, 0, 1, 1, 0, 0, 1, 1] or g.cut(part) <= 4


def test_swap_refinement_lowers_the_cut_and_keeps_sizes():
    g, part = _grid_graph(2, 4), np.array([0, 0, 1, 1, 0, 1, 0, 1])
    before, ones = g.cut(part), part.sum()
    graph._kernighan(g, np.ones(8), part, 1, 1, 1)
    assert g.cut(part) < before and part.sum() == ones


def test_median_cut_takes_the_first_position_in_the_band():
    assert grid.median_cut([16] * 4, 64) == (2, 32)
    assert grid.median_cut([9, 1], 10) == (0, 0)


@given(st.lists(st.integers(0, 1000), min_size=2, max_size=100))
@settings(max_examples=40, deadline=None)
def test_median_cut_weight_is_the_prefix(w):
    p, left = grid.median_cut(w, sum(w))
    assert left == sum(w[:p])


def test_roots_shares_and_scales():
    assert numeric.root_ceil(125, 3) == 5 and numeric.root_ceil(126, 3) == 6
    assert numeric.work_share(10, 4) == (3, 4)
    f = numeric.scale_factor(8.0, 3)
    assert [int(f * x) for x in range(9)] == [0, 0, 1, 2, 3, 4, 5, 6, 7]
    assert numeric.scale_factor(0.0, 3) == 0.0


def test_jagged_scheme_puts_fat_slabs_first():
    assert geometric.jagged_scheme(5, 2) == [[[2, 2, 1]], [[1, 1], [1, 1], [1]]]
    assert sum(len(s) for s in geometric.jagged_scheme(9, 4)[-1]) == 9


MESH = meshfile.Mesh(3, np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.5]], float), np.array([0, 1, 2, 3]), [("triangle", np.array([[0, 1, 2], [1, 3, 2]]), np.array([5, 6]))])


def _same(a, b):
    assert np.allclose(a.coords, b.coords) and (a.refs == b.refs).all()
    assert [k for k, _, _ in a.blocks] == [k for k, _, _ in b.blocks]
    for (_, n, r), (_, m, s) in zip(a.blocks, b.blocks):
        assert (n == m).all() and (r == s).all()


@pytest.mark.parametrize("write", [meshfile.to_medit, meshfile.to_medit_binary, lambda m: meshfile.to_vtk(m, False), lambda m: meshfile.to_vtk(m, True)])
def test_mesh_formats_round_trip(write):
    _same(meshfile.parse(write(MESH)), MESH)


def test_medit_text_is_stable_and_lenient():
    text = meshfile.to_medit(MESH)
    assert meshfile.to_medit(meshfile.parse(text)) == text
    got = meshfile.parse(b"  meshversionformatted 1\n dimension 2\n vertices 3\n 0 0\n 1 0\n 0 1\n Corners 1\n 2\n triangles 1\n 1 2 3 7\n End")
    assert got.refs.tolist() == [0, 0, 0] and got.blocks[0][1].tolist() == [[0, 1, 2]] and got.blocks[0][2].tolist() == [7]


def test_unknown_files_are_refused():
    with pytest.raises(FormatError):
        meshfile.parse(b"hello")
