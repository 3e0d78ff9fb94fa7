import numpy as np
import pytest

from regionscore.llm.elias_fano import EliasFano, NgramTrie, path_order, prefix_starts, select_in_words


def test_select_in_words():
    rng = np.random.default_rng(1)
    words = np.concatenate([rng.integers(0, 1 << 63, 200, dtype=np.uint64), np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64)])
    for word in words:
        ones = [i for i in range(64) if int(word) >> i & 1]
        if ones:
            assert select_in_words(np.full(len(ones), word), np.arange(len(ones))).tolist() == ones


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (5, 5), (1000, 900), (1000, 10 ** 6), (5000, 10 ** 12), (300, 2 ** 40), (2000, 30)])
def test_values_and_successors(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    s = EliasFano.build(values)
    assert (s.get(np.arange(n)) == values.astype(np.uint64)).all()
    asked = np.concatenate([values, rng.integers(0, top * 2, 500)]).astype(np.int64)
    at, hit = s.successor(asked)
    assert (at == np.searchsorted(values, asked)).all() and (hit == np.isin(asked, values)).all()


def test_clustered_values_take_the_binary_search():
    values = np.concatenate([np.arange(3000), [10 ** 9]])
    s = EliasFano.build(values)
    at, hit = s.successor(np.arange(0, 6000, 7))
    assert (at == np.searchsorted(values, np.arange(0, 6000, 7))).all() and (hit == (np.arange(0, 6000, 7) < 3000)).all()


def test_trie_lookups(tmp_path):
    rng = np.random.default_rng(0)
    paths = np.unique(rng.integers(1, 40, (4000, 3)), axis=0)
    pairs = prefix_starts(paths, 2)
    two, three = rng.integers(1, 255, (pairs.sum(), 2)).astype("<u2"), rng.integers(1, 255, (len(paths), 1)).astype("<u2")
    trie = NgramTrie.build(paths, [two, three]).saved(str(tmp_path))
    asked = rng.integers(0, 45, (5000, 3))
    by_pair = {tuple(p): tuple(c) for p, c in zip(paths[pairs, :2].tolist(), two.tolist(), strict=True)}
    by_path = {tuple(p): c[0] for p, c in zip(paths.tolist(), three.tolist(), strict=True)}
    for order in (np.arange(5000), np.lexsort(asked.T[::-1])):  # sorted or not
        a, b = trie.lookup(asked[order])
        assert [tuple(x) for x in a.tolist()] == [by_pair.get(tuple(q[:2]), (0, 0)) for q in asked[order].tolist()]
        assert b[:, 0].tolist() == [by_path.get(tuple(q), 0) for q in asked[order].tolist()]


def test_path_order_with_ids_of_any_size():
    rng = np.random.default_rng(2)
    for top in (50, 2 ** 40):
        paths = rng.integers(0, top, (500, 3))
        first = np.unique(paths[:, 0], return_inverse=True)[1]
        assert (paths[path_order(paths, first)] == paths[np.lexsort(paths.T[::-1])]).all()
