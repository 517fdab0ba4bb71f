"""Removal of repeated windows against brute force."""

import re

import numpy as np
import pytest
from samples import collected, edited, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from factorlab.llm import repeats


def brute(rows, length, words):
    units = {}
    for k, (doc, text) in enumerate(rows):
        text = text or ""
        units[k] = (doc, re.findall(r"[^\x20\x09-\x0D]+", text) if words else list(text.encode()))
    first = {}
    for doc, u in units.values():
        for i in range(len(u) - length + 1):
            key = tuple(u[i : i + length])
            first[key] = min(first.get(key, repeats.LAST), repeats.LAST if doc is None else doc)
    out = []
    for doc, u in units.values():
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if first[tuple(u[i : i + length])] < (repeats.LAST if doc is None else doc):
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        out.append((doc, len(u), sum(gone), spans, " ".join(kept).encode() if words else bytes(kept)))
    return sorted(out, key=repr)


def cases():
    base, passage = prose(300, 1), prose(60, 2)
    rows = [
        (7, base), (3, base), (9, base), (3, base), (12, edited(base, 40, 5)), (11, edited(base, 70, 6)), (1, edited(base, 55, 7)),
        (20, prose(80, 8) + "\t" + passage + "\n" + prose(90, 9)), (21, prose(30, 10) + "\x0b " + passage), (22, passage),
        (2, None), (4, ""), (5, " \n\t "), (6, "one two"), (8, "a " * 500), (10, "a " * 300), (13, "é語🙂 " * 120), (14, "x" + "é語🙂 " * 90),
        (None, base), (None, passage), (15, " ".join(passage.split()[:49])), (16, "nul\x00 " * 70), (17, "y nul\x00 " * 70), (18, "z" + " nul\x00" * 70),
        (30, prose(5000, 11)), (31, edited(prose(5000, 11), 200, 12)),
    ]
    return rows + [(100 + i, edited(base, 25 + i, i)) for i in range(20)]


@pytest.mark.parametrize("words", [True, False])
@pytest.mark.parametrize("length", [50, 9])
def test_matches_brute_force(documents, words, length):
    rows = cases()
    df = documents(rows)
    got = (repeats.suffix_automata if words else repeats.suffix_ranges)(df, length)
    assert collected(got.withColumn("kept", got.kept), "doc_id", "n_units", "n_removed", "n_spans", "kept") == [(a, b, c, d, bytearray(e)) for a, b, c, d, e in brute(rows, length, words)]


def test_empty_table(documents):
    df = documents([(1, "x")]).filter("doc_id < 0")
    assert repeats.suffix_automata(df).count() == 0
    assert repeats.suffix_ranges(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), min_size=4, max_size=30), min_size=1, max_size=6))
def test_matchers_agree_with_counting(texts):
    contents = sorted({" ".join(t).encode() for t in texts})
    docs = np.arange(len(contents), dtype=np.int64) * 3
    low = {}
    for c, d in zip(contents, docs.tolist(), strict=True):
        w = c.split()
        for i in range(len(w) - 3):
            low.setdefault(tuple(w[i : i + 4]), d)
    want = [[low[tuple(c.split()[i : i + 4])] for i in range(len(c.split()) - 3)] for c in contents]
    assert repeats.window_owners(contents, docs, 4).tolist() == sum(want, [])
    by_byte = [min(d for o, d in zip(contents, docs.tolist(), strict=True) if c[i : i + 7] in o) for c in contents for i in range(len(c) - 6)]
    assert repeats.sorted_owners(contents, docs, 7).tolist() == by_byte


def test_segments_travel_packed_by_chunk_and_group():
    """What is moved for a segment is its content, and per place a document and a position: 16 bytes."""
    import pyarrow as pa

    base = prose(400, 3)
    texts = [base, edited(base, 40, 4), edited(base, 60, 5)]
    left = pa.table({"chunk": pa.array([0] * 3, pa.int32()), "doc": pa.array([5, 6, 7], pa.int64()), "text": texts})
    keys = repeats.anchors(left, False, 50, 16, 1)
    right = repeats.shared_keys(keys)
    heads = lambda keys, heads: np.array([h[0] % 8 for h in heads])
    got = repeats.candidate_segments(left, right, False, 50, 16, heads, 4)
    assert set(got["group"].to_pylist()) <= {0, 1}
    n = sum(len(held) for held, *_ in repeats.packed_ranges(got))
    assert n > 3 * repeats.PACK and got.num_rows <= n // repeats.PACK + 2
    for row in range(got.num_rows):
        found = list(repeats.packed_ranges(got.slice(row, 1)))
        contents = [c for held, *_ in found for c in held]
        assert 0 < len(set(contents)) == len(contents) <= repeats.PACK
        places = sum(int(counts.sum()) for _, counts, *_ in found)
        assert got["docs"][row].as_py().__len__() + got["places"][row].as_py().__len__() == 16 * places
        raw = b"".join(t.encode() for t in texts)
        for held, counts, _, docs, at in found:
            for c, d, a in zip(np.repeat(np.array(held, dtype=object), counts), docs, at, strict=True):
                assert raw[a : a + len(c)] == c and d == 5 + np.searchsorted(np.cumsum([len(t.encode()) for t in texts]), a, side="right")


def test_ranges_part_suffixes_that_begin_inside_a_character(documents):
    """Half of these suffixes begin with the second byte of a letter: they must not all lie beyond the last boundary of one."""
    rows = [(i, "".join(np.random.default_rng(i).choice(list("éñóßäöüç"), 400))) for i in range(40)]
    bounds = repeats.splitters(documents(rows), 16, 64, sum(len(t.encode()) for _, t in rows))
    inside = [b for b in bounds if 0x80 <= b[0] < 0xC0]
    assert len(bounds) > 50 and 0.4 < len(inside) / len(bounds) < 0.6


def test_levels_do_not_change_the_result(documents):
    """A window's anchor is one of its rarer grams; what is removed stays the same."""
    rows = cases()
    df = documents(rows)
    levels = repeats.gram_levels(df, 9, 10**6, common=40)
    assert levels is not None and set(levels.tolist()) >= {0, 1}
    got = repeats.suffix_ranges(df, 50, 9, common=40)
    assert collected(got, "doc_id", "n_units", "n_removed", "n_spans", "kept") == [(a, b, c, d, bytearray(e)) for a, b, c, d, e in brute(rows, 50, False)]


def test_common_grams_are_anchors_only_where_a_window_has_no_other():
    """A phrase in every second sentence, with other surroundings each time, does not gather their segments."""
    import pyarrow as pa

    def smallest(phrase):
        return repeats.gram_hashes(np.frombuffer(phrase.encode(), dtype=np.uint8), 16, repeats.BYTE_BASE).min()

    phrase, n = min((prose(8, seed)[:20] for seed in range(1000, 1200)), key=smallest), 400
    text = " ".join(f"{prose(6, i)} {phrase}" for i in range(n))
    chunk = repeats.Chunk(pa.table({"chunk": pa.array([0], pa.int32()), "doc": pa.array([1], pa.int64()), "text": [text]}), False)

    def most(levels):
        return np.unique(np.concatenate([key for _, _, key, _ in repeats.segments(chunk, 50, 16, levels)]), return_counts=True)[1].max()

    h = repeats.gram_hashes(chunk.units, 16, repeats.BYTE_BASE)
    seen = np.bincount(repeats.gram_class(h), minlength=1 << repeats.CLASS_BITS)
    assert most(None) >= n // 4 and most((seen > 20).astype(np.uint8)) <= 25


def test_chunks_follow_the_bytes_of_texts(documents, spark):
    """What a task holds depends neither on the session's partitions nor on the input's size."""
    from factorlab.llm.common import pieces, text_size

    assert text_size(documents([(1, "é" * 10), (2, None), (3, "ab")])) == 22
    assert text_size(documents([(1, "x")]).filter("doc_id < 0")) == 0
    assert pieces(10 << 30, repeats.CHUNK) == 2560 and pieces(0, repeats.CHUNK) == 16
