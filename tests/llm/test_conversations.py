"""Prefix trie and chat formatting against plain loops, and their hard rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T
from samples import collected, prose

from factorlab.llm import chat, trie
from factorlab.llm.queries import PLANTED, tokenizer_paths

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
    # Names that the operators use themselves.
    T.StructField("depth", T.StringType()), T.StructField("node", T.StringType()), T.StructField("_part", T.StringType()),
    T.StructField("ids", T.StringType()), T.StructField("t", T.StringType()),
])


@pytest.fixture(scope="module")
def conversations(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "d", "n", "p", "i", "t") for r in rows], SCHEMA).repartition(5)

    return make


def in_order(rows):
    """Turns of every conversation as (role, text), ordered by turn (null first), role and text."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}


def plain_trie(rows):
    own = {c: t for c, t in in_order(rows).items() if c is not None}
    members, size = defaultdict(set), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - c % 100, [])[:h] + turns[h:]
        size[c] = len(whole)
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].add(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if size[c] == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def dialogue(seed, longest):
    """Conversations that share openings, with repeated rows, null fields and ids without a first of their hundred."""
    rng, rows = random.Random(seed), []
    for c in [*range(0, 40), *range(97, 140), *range(250, 262), 10_007]:
        n = longest if c % 37 == 5 else rng.randint(1, 9)
        for t in range(n):
            few = rng.random() < 0.8
            rows.append((c, t, rng.choice(["user", "assistant"]), f"w{rng.randint(0, 1)}" if few else prose(rng.randint(1, 6), rng.randint(0, 3))))
    rows += [(3, None, None, None), (3, 2, "user", "w0"), (3, 2, "user", "w0"), (4, 0, "user", ""), (None, 0, "user", "w0"), (None, 1, "user", "é🙂")]
    # A copy of a whole conversation, and one that is left without turns.
    rows += [(200 + c, t, r, x) for c, t, r, x in rows if c == 7]
    empty = next(c for c in range(5_000, 6_000) if c % 100 and zlib.crc32(str(c).encode()) % 6 > 1)
    return [*rows, (empty, 0, "user", "gone")]


@pytest.mark.parametrize("height", [3, 32])
def test_trie_against_loops(conversations, height):
    rows = dialogue(height, 40)
    got = trie.family_trie(conversations(rows), height)
    assert sorted(tuple(r[c] for c in NODE) for r in got.collect()) == plain_trie(rows)


def test_trie_of_one_long_conversation(conversations, spark):
    # All rows under one key: it spans every range partition.
    rows = [(100, t, "user", f"turn {t % 7}") for t in range(900)] + [(101, t, "user", f"turn {t % 7}") for t in range(450)]
    got = trie.family_trie(conversations(rows))
    assert sorted(tuple(r[c] for c in NODE) for r in got.collect()) == plain_trie(rows)
    parts = {r._part for r in trie.written(trie.ranged(conversations(rows).select("conv_id", "turn").withColumn("_part", trie.F.spark_partition_id()), "conv_id", "turn").withColumn("_part", trie.F.spark_partition_id()), "p").select("_part").distinct().collect()}
    assert len(parts) > 4


def test_trie_of_nothing(conversations):
    assert trie.family_trie(conversations([])).collect() == []
    assert trie.family_trie(conversations([(None, 0, "user", "x")])).collect() == []


HARD = [
    PLANTED, "", "\\", "\\\\", "\\\\\\</turn>", "</turn", "##### User:### User:", "### User: x\\", "</role>\n</turn>\\</turn>", " é🙂\x00",
    "### Assistant:" * 50, "\\" * 3_000 + "x", "x" * 60_000, "<|endoftext|>", " </turn> ", "### Role:tool</role>",
]


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    turn = f"### User:\n{chat.escape(text)}</turn>\n### Role:\n{chat.escape(text)}</role>\n{chat.escape('a' + text)}</turn>\n"
    assert chat.parse(turn) == [("user", text), (text, "a" + text)]


def test_format_and_read_back(conversations):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "### User:", "", None]), rng.choice([*HARD, None])) for c in range(12) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "assistant", "a\\"), (None, None, "user", "first"), (3, 1, "assistant", "twice"), (3, 1, "assistant", "twice")]
    rows += [(50, t, "assistant", f"line {t}") for t in range(700)]  # one conversation over all partitions
    made = chat.written(chat.assemble(conversations(rows), *tokenizer_paths()), "made")
    want, told = in_order(rows), []
    by_conv = defaultdict(list)
    for r in made.collect():
        by_conv[r.conv_id].append(r)
    code = chat._tokenizer(*tokenizer_paths())
    for conv, turns in want.items():
        found = sorted(by_conv[conv], key=lambda r: r.turn_no)
        assert [r.turn_no for r in found] == list(range(len(turns)))
        assert [r.start for r in found] == np.cumsum([0, *(len(r.ids) for r in found)])[:-1].tolist()
        text = chat.rendered(np.array([i for r in found for i in r.ids]), code)
        assert chat.parse(text) == turns
        assert len(text) == sum(r.n_chars for r in found)
        said = "".join(x for r, x in turns if r == "assistant")
        told.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
    got = chat.digest(made, *tokenizer_paths())
    assert collected(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars") == sorted(told, key=repr)


def test_format_of_nothing(conversations):
    assert chat.digest(chat.assemble(conversations([]), *tokenizer_paths()), *tokenizer_paths()).collect() == []
