"""Ranked search against a plain loop over all documents and terms."""

import math
import random
import re
from collections import Counter

import pytest
from samples import collected, prose

from factorlab.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(d, c) for d, t in docs if (c := Counter(terms(t)))]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(x for _, c in held for x in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, want in asked.items():
        scores = []
        for d, c in held:
            m = 10 + 90 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in want if c[x])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    docs = [(i, prose(rng.choice([1, 3, 20, 200]), rng.randint(0, 30), 60)) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,-\x00"), (303, "Straße İstanbul ÉTÉ 東京 x" * 3), (None, docs[1][1]), (1, docs[1][1]), (1, docs[1][1])]
    docs += [(400 + i, docs[2][1]) for i in range(25)]  # more ties than places
    items = [(i, prose(rng.randint(1, 30), rng.randint(0, 30), 60)) for i in range(30)]
    items += [(30, None), (31, ""), (None, "東京 straße STRASSE İSTANBUL été"), (5, docs[2][1]), (33, "nowhere-found")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"block_pairs": 150}, {"shard_postings": 50}, {"k": 1}, {"k": 40, "shard_postings": 300}])
def test_against_loop(spark, documents, limits):
    docs, items = corpus(len(limits))
    table = spark.createDataFrame([(*r, "n", 1) for r in items], "item_id long, text string, n string, rank int").repartition(2)
    got = ranked.search(documents(docs), table, **limits)
    assert collected(got, "item_id", "rank", "doc_id", "score") == plain(docs, items, limits.get("k", 10))


def test_nothing(spark, documents):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(documents([]), items).collect() == []
    assert ranked.search(documents([(1, "a")]), items.limit(0)).collect() == []
    assert ranked.search(documents([(1, None), (2, "...")]), items).collect() == []


def test_pieces_cut_between_terms():
    text = ("wort " * 10 + "x" * 90 + " " + "é" * 200).encode()
    for size in (1, 7, 64, 1000):
        cut = ranked.pieces(text, size)
        assert b"".join(cut) == text
        assert [t for p in cut for t in terms(p.decode(errors="surrogateescape"))] == terms(text.decode())
