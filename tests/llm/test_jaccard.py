"""The similarity join against all pairs."""

import re

import numpy as np
import pytest
from samples import collected, edited, prose

from factorlab.llm import jaccard


def brute(rows, size, num, den):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                label[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        out.append((doc, len(sets[i]), min((rows[j][0] for j in range(len(rows)) if root(j) == root(i)), default=None) if doc is not None else None))
    return sorted(out, key=repr)


def cases():
    base, other = prose(250, 1), prose(120, 2)
    rows = [(50, base), (40, base.upper()), (60, None), (61, ""), (62, " \n"), (63, "one two"), (64, "One  two"), (65, "one two three four"), (66, "one"), (67, "ONE"), (None, base), (68, "a " * 90), (69, "a " * 300)]
    rows += [(100 + i, edited(base, 8 + 3 * i, i)) for i in range(25)]
    # A chain: neighbours are linked, its ends are not.
    chain = other.split()
    for i in range(12):
        chain = [*chain[3:], *prose(3, 900 + i).split()]
        rows.append((300 - i, " ".join(chain)))
    rows += [(400 + i, prose(n, 40 + i)) for i, n in enumerate((3, 4, 5, 6, 7, 9, 12, 20, 33))]
    rows += [(500 + i, edited(prose(n, 40 + i), max(3, n), 77)) for i, n in enumerate((3, 4, 5, 6, 7, 9, 12, 20, 33))]
    return rows


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 80, 100)])
def test_matches_all_pairs(documents, size, num, den, monkeypatch):
    rows = cases()
    got = jaccard.join(documents(rows), size, num, den)
    assert collected(got, "doc_id", "n_shingles", "component_id") == brute(rows, size, num, den)


def test_small_blocks(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 4)
    rows = cases()
    assert collected(jaccard.join(documents(rows), 4, 85, 100), "doc_id", "n_shingles", "component_id") == brute(rows, 4, 85, 100)


def test_empty_table(documents):
    assert jaccard.join(documents([(1, "x")]).filter("doc_id < 0"), 4, 85, 100).count() == 0


@pytest.mark.parametrize("n", [5, 6, 7, 11, 12, 13, 30, 100, 400])
def test_linked_sets_share_a_piece(n):
    """Any two sets on the threshold share a key, whichever members differ."""
    rng = np.random.default_rng(n)
    for _ in range(60):
        common = rng.integers(0, 2**63, n).astype(np.uint64)
        extra = int(rng.integers(0, int(n * 15 / 85) + 1))
        cut = int(rng.integers(0, extra + 1))
        a = np.unique(np.concatenate((common, rng.integers(0, 2**63, cut).astype(np.uint64))))
        b = np.unique(np.concatenate((common, rng.integers(0, 2**63, extra - cut).astype(np.uint64))))
        keys, edge = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
        if 100 * n < 85 * len(set(a.tolist()) | set(b.tolist())):
            continue
        both = [jaccard.piece_keys(keys, edge, s, 85, 100) for s in (0, 1)]
        mine = [set(np.concatenate([k[w == i] for k, w in both]).tolist()) for i in (0, 1)]
        assert mine[0] & mine[1]


def test_sets_of_over_a_million_shingles_keep_their_own_pieces():
    rng = np.random.default_rng(8)
    large = rng.integers(0, 1 << 63, 1_300_000).astype(np.uint64)
    copy, small = np.append(large[:-2000], rng.integers(0, 1 << 63, 1000).astype(np.uint64)), rng.integers(0, 1 << 63, 50).astype(np.uint64)

    def pieces(*sets, shift):
        key, who = jaccard.piece_keys(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), shift, 85, 100)
        return [set(key[who == i].tolist()) for i in range(len(sets))]

    for shift in (0, 1):
        alone = [pieces(s, shift=shift)[0] for s in (large, copy, small)]
        assert pieces(small, large, small, copy, small, shift=shift) == [alone[i] for i in (2, 0, 2, 1, 2)]
        assert alone[0] & alone[1] and not alone[0] & alone[2]


@pytest.mark.parametrize("width", [1, 4])
def test_cells_send_on_a_forest(width):
    """Copies of three texts in one cell: as many pairs as a forest has, that join what can be joined, without tested ones."""
    rng = np.random.default_rng(5)
    stock = [rng.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(3)]
    sets = [np.append(stock[i % 3][: 200 - i % 5], rng.integers(0, 1 << 63, i % 5).astype(np.uint64)) for i in range(240)]
    short = jaccard.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    tested = [[j for j in range(240) if j != i and i == 7] or None for i in range(240)]
    rows = {"cell": [1] * 240, "side": [0] * 240, "node": list(range(240)), "comp": list(range(240)), "n": [200] * 240, "short": [jaccard.fold(s, 512).to_bytes(64, "little") for s in short], "wide": [b""] * 240, "tested": tested}
    got = jaccard.group_pairs(jaccard.pa.table(rows), 85, 100, width).to_pydict()
    pairs = list(zip(got["a"], got["b"], strict=True))
    assert len(pairs) <= width * 239 and all(a % 3 == b % 3 and a < b for a, b in pairs)
    label = list(range(240))
    for a, b in pairs:
        label = [label[a] if x == label[b] else x for x in label]
    # 7 has been held against all by itself, but others may still ask for it.
    assert len({label[i] for i in range(240)}) == 3


def test_a_common_phrase_makes_no_key_groups():
    """Sets that have only a phrase in common share next to no keys: pieces that the phrase alone touches are not sent."""
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    sets = [np.append(phrase, rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(2000)]
    edge = np.cumsum([0, *map(len, sets)])
    keys = np.concatenate([jaccard.piece_keys(np.concatenate(sets), edge, shift, 85, 100)[0] for shift in (0, 1)])
    held = np.unique(keys, return_counts=True)[1]
    assert (held * (held - 1) // 2).sum() <= 50
