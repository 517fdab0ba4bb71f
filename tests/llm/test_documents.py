"""Personal data, licences, language, benchmark leaks, language model, packing and search on hard rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from samples import collected, edited, prose

from factorlab.llm import decontaminate, language, licenses, lm, packing, pii, search

EDGES = [(1, None), (2, ""), (3, " "), (4, "\x01\x02 a\x01b"), (5, "x" * 60_000), (6, "1" * 60_000), (7, "a.b" * 20_000), (7, "a.b" * 20_000)]


def luhn(s):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(x := re.sub("[^0-9]", "", m)) <= 19 and luhn(x)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]

PERSONAL = [
    (10, "a@b.cx@d.ee a@b.c_d@e.f .a@b..c a@b.c. é🙂x.y+z@mail-1.example.com"),
    (11, "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.2.3 1.2.3.999.4.5.6 01.02.03.04x"),
    (12, "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 41111111111111111111111 4111111111111111 5 4111111111111111-"),
    (13, "+1 (644) 555-7859 +44 20 7946 0958. +1 2 +49123456789012345678 ++1-800-555-0199(12"),
    (14, "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 DE88370400440532013000 my ssn 123-45-6789 or 123-45-6789"),
    (15, "\x01a@b.cd\x02 \x02+1 800 555 0199\x01"),
    (16, "x@y.zz " * 700 + "10.0.0.1"),
    (17, "a@" + "b." * 3000 + "com 1@2.3"),
]


def test_pii_base_spans(documents):
    rows = EDGES + PERSONAL
    got = pii.digest(pii.find(documents(rows)))
    want = []
    for doc, text in rows:
        spans = [(k, m.start(), m.end()) for k, r, ok in BASE for m in re.finditer(r, text or "") if ok(m[0])] if doc not in (5, 6) else []
        n = Counter(k for k, _, _ in spans)
        want.append((doc, *(n[k] for k, _, _ in BASE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert collected(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)


def test_pii_added_kinds_and_masks(documents):
    df = documents(PERSONAL + [(1, None)])
    spans = {r.doc_id: r.pii for r in pii.find(df).collect()}
    added = [(s.kind, s.start, s.end) for s in spans[14] if s.kind in ("iban", "ssn")]
    text = dict(PERSONAL)[14]
    assert [text[a:b] for k, a, b in added if k == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert any(k == "ssn" for k, _, _ in added)
    masked = {r.doc_id: r for r in pii.redact(df).collect()}
    assert masked[1].text is None
    assert masked[13].text.startswith("[PHONE] [PHONE]. +1 2 ")
    assert "@" not in masked[16].text and masked[16].n_chars == len(masked[16].text)
    assert pii.redact(df).columns == df.columns


def test_licenses(documents):
    mit = licenses.TEMPLATES[15][1]
    rows = EDGES + [(20, "Some text that is long enough to stand apart.\nLicensed under the Apache License, Version 2.0.\nMore of the same kind of text."), (21, mit), (22, mit.replace(" ", "\n", 30) + "\n\nend"), (23, "the licensed plumber came under the bridge"), (24, "released UNDER the mit license!")]
    got = {r.doc_id: (r.n_matches, r.licenses) for r in licenses.digest(licenses.scan(documents(rows))).collect()}
    assert got[20] == (1, "Apache-2.0") and got[21] == (1, "MIT") and got[22] == (1, "MIT") and got[24] == (1, "MIT")
    assert all(got[i] == (0, "") for i in (1, 2, 3, 4, 5, 6, 7, 23))
    # Pruning by key words loses no unit that reaches the threshold.
    words = set(licenses.key_words(licenses.TEMPLATES))
    for _, text in licenses.TEMPLATES:
        grams = licenses.template_bigrams(text)
        for drop in range(0, len(grams), 3):
            kept = grams[:drop] + grams[drop + len(grams) // 3 :]
            if 2 * len(kept) / (len(kept) + len(grams)) >= licenses.THRESHOLD:
                assert words & {w for g in kept for w in g.split()}


def test_language(documents):
    stock = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "éèçàabcd"}
    rows = []
    for n, (lang, letters) in enumerate(stock.items()):
        for i in range(40):
            rng = np.random.default_rng(n * 100 + i)
            text = " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(60))
            rows.append((1000 + n * 100 + i, text.upper() if i % 5 == 0 else text, lang))
    rows += [(*r, None) for r in EDGES] + [(30, "123 !!", "aa"), (31, "語語語", None), (32, rows[0][1] * 40, None)]
    got = {r.doc_id: r for r in language.predict(documents(rows)).collect()}
    held = [r for r in rows if r[0] >= 1000 and got[r[0]].held_out]
    assert len(held) > 10 and sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 6, 30))
    assert got[32].lang_pred == "aa" and got[31].lang_pred in stock
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    blank = language.predict(documents(EDGES))
    assert {r.lang_pred for r in blank.collect()} == {"und"}
    assert language.predict(documents(EDGES).filter("doc_id < 0")).count() == 0


def test_phrases_are_longest_matches():
    rng = np.random.default_rng(3)
    samples = [rng.integers(1, 5, 50).astype(np.uint8) for _ in range(3)]
    held = {s[i:j].tobytes() for s in samples for i in range(50) for j in range(i + 1, 51)}
    texts = [rng.integers(1, 6, n).astype(np.uint8) for n in (0, 1, 7, 400, 90)]
    want = []
    for t in texts:
        i = n = 0
        while i < len(t):
            j = i + 1
            while j < len(t) and t[i : j + 1].tobytes() in held:
                j += 1
            i, n = j, n + 1
        want.append(n)
    assert language.phrase_counts(texts, language.suffix_automaton(samples)).tolist() == want


def test_decontamination(spark, documents):
    q = "A farmer had 12 goats and sold 5 kg of cheese to Maria for 30 dollars each morning. How much did he earn?"
    items = spark.createDataFrame([(1, q), (2, None), (3, ""), (4, "tiny item of five words"), (5, "ab"), (6, prose(40, 3))], "item_id long, text string")
    swapped = q.replace("12", "77").replace("30", "41").replace("Maria", "Jonas").replace("5 kg", "9 km")
    uneven = q.replace("12", "7").replace("5", "12").replace("30", "12")
    rows = EDGES + [(20, prose(50, 9) + ". " + q), (21, "Hello. " + swapped), (22, prose(300, 10)), (23, "so a tiny item of five words"), (24, uneven), (25, prose(40, 3)[: len(prose(40, 3)) // 4]), (26, edited(prose(40, 3), 19, 1))]
    got = {r.doc_id: r for r in decontaminate.decontaminate(documents(rows), items).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {20, 21, 23, 26}
    assert got[20].items == "1" and got[20].coverage == 1.0 and got[23].items == "4"
    none = decontaminate.decontaminate(documents(rows), items.filter("item_id > 99"))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)


def test_decontamination_in_shards(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WINDOWS", 20)
    items = spark.createDataFrame([(i, prose(30, i)) for i in range(6)], "item_id long, text string")
    rows = [(10 + i, prose(20, 50 + i) + " " + prose(30, i) + " " + prose(30, (i + 1) % 6)) for i in range(6)] + [(99, prose(40, 77)), (99, prose(40, 77))]
    got = collected(decontaminate.decontaminate(documents(rows), items), "doc_id", "items")
    assert got == sorted([(10 + i, ",".join(map(str, sorted((i, (i + 1) % 6))))) for i in range(6)] + [(99, ""), (99, "")], key=repr)


def test_language_model(documents):
    rows = EDGES + [(100 + i, edited(prose(300, i % 7), 17, i)) for i in range(60)] + [(8, "The the THE")]
    got = lm.score(documents(rows), language.crc_class(7) == 2, sweeps=2).collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for d, t in rows]
    train = Counter(w for d, ws in tokens if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    want = sorted((d, len(ws), sum(train[w] > 0 for w in ws), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score <= 0 for r in got)
    held = [r for r in got if r.held_out and r.doc_id >= 100]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(documents(rows).filter("doc_id < 0"), language.crc_class(7) == 2).count() == 0


def test_seating_stays_within_bounds():
    c = np.array([0, 1, 2, 5, 40, 1000, 10**6])
    t = lm.seat(np.arange(7, dtype=np.uint64), c, np.full(7, 0.5), 0.8)
    assert t[0] == 0 and t[1] == 1 and (t <= c).all() and (t[1:] >= 1).all() and (np.diff(t[2:]) > -2).all()
    assert (t == lm.seat(np.arange(7, dtype=np.uint64), c, np.full(7, 0.5), 0.8)).all()


def test_packing(documents):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    rows = EDGES[:4] + [(5, "x" * 9000), (7, "a.b"), (7, "a.b"), (8, "é語🙂 <|endoftext|> \x85\x1f 12 'll"), (None, "z")] + [(100 + i, prose(30 + 37 * i, i)) for i in range(70)]
    got = packing.best_fit_pack(documents(rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else (len(ids) % 1024 or 1024)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((doc, p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert sum(n for _, n in places) <= 1024 and all(o == sum(n for _, n in places[:i]) for i, (o, _) in enumerate(places))
    assert len(by) <= -(-sum(r.length for r in got) // 1024) + 2
    assert packing.best_fit_pack(documents(rows).filter("doc_id < 0"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("capacity", [10, 24])
def test_dominance_is_optimal_on_small_instances(capacity):
    rng = np.random.default_rng(capacity)

    def optimum(items):
        best = [len(items)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                    bins[k] += items[i]
                    place(i + 1, bins)
                    bins[k] -= items[i]
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return best[0]

    for _ in range(150):
        items = sorted(rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist(), reverse=True)
        left = dict(Counter(items))
        fixed = packing.dominating(left, capacity)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + (optimum(rest) if rest else 0) == optimum(items)


def test_search(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=12).round(3).tolist(), 0) for i in range(300)]
    vectors += [(1000 + i, vectors[5][1], 1) for i in range(90)] + [(2000, None, 0), (2001, [1.0, None] + [0.0] * 10, 0), (2020, [float("nan")] * 12, 0), (2040, [float("inf")] * 12, 0), (2060, [0.0] * 12, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    from pyspark.sql import functions as F

    got = collected(search.top_k(search.quantised(df), F.col("vec_id") % 20 == 0, 7, lead=4, shard_rows=60, block_rows=9), "query_id", "rank", "vec_id", "score")
    ok = {i: np.floor(64 * np.array(e, dtype=np.float32).astype(np.float64)).astype(int) for i, e, _ in vectors if e and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in (i for i in ok if i % 20 == 0):
        best = sorted(((-int(ok[q] @ ok[c]), c) for c in ok if c != q))[:7]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == sorted(want, key=repr)
    assert search.top_k(search.quantised(df.filter("vec_id < 0")), F.col("vec_id") % 20 == 0, 7).count() == 0


def swept(tok, sweeps):
    """States of a corpus of one chunk and one bucket, and all tables after each sweep."""
    n, v = int(tok.count.sum()), int((tok.count > 0).sum())
    states, t, back, tables, totals = [lm.State.first(tok.words, tok.count, n, v)], tok.pair_count, None, v, []
    for i in range(sweeps):
        t = states[-1].reseat(tok.pairs, tok.pair_count, t, tok.pair_context, tok.pair_word, i)
        a, b = (np.bincount(place, weights=t, minlength=len(tok.words)) for place in (tok.pair_word, tok.pair_context))
        sent = lm._send(0, tok.words, 1, a, "<i8", b, "<i8")
        own = [] if back is None else [back.filter([c == -1 for c in back["chunk"].to_pylist()])]
        back = lm.seat_parent(pa.concat_tables([sent, *own]), v, tables, i)
        customers, tables = lm.unpack(back["a"][1].as_py(), "<f8")
        states.append(lm.State(lm.parent_probability(lm.unpack(back["a"][0].as_py(), "<f4"), customers, tables, v), lm.unpack(back["b"][0].as_py(), "<i8")))
        totals.append(customers)
    return states, totals


def test_language_model_sums_to_one_in_small_and_hot_contexts():
    rng = np.random.default_rng(5)
    stock = [f"w{i}" for i in range(300)]
    words = [stock[i] for i in np.minimum(rng.zipf(1.3, 60000) - 1, 299)]
    # The held-out text has every word, and an unknown one, after a hot, a rare and an unknown context.
    used = sorted(set(words))
    rare = min(used, key=words.count)
    held = " ".join(f"{c} {w}" for c in ("w0", rare, "?") for w in [*used, "?"])
    # The end of a text follows each of them too.
    texts = [" ".join(words), held, "w0", rare, "?"]
    tok = lm.Tokens(pa.table({"doc": list(range(5)), "held": [False, True, True, True, True], "text": texts}))
    states, totals = swept(tok, 25)
    assert abs(totals[-1] / totals[-4] - 1) < 0.02, totals
    p = lm.predictions(tok, tok.pair_count, tok.count, states, 3)
    for c in ("w0", rare, "?"):
        at = tok.words[tok.pair_context] == lm.hash_words(np.frombuffer(c.encode(), dtype=np.uint8))[2][0]
        assert at.sum() == len(used) + 2
        assert abs(p[at].sum() - 1) < 1e-5, (c, p[at].sum())
    assert (p > 0).all() and (p <= 1).all()


def test_search_of_large_and_uneven_vectors(spark):
    """Components far beyond exact floats, vectors of several lengths, repeated ids."""
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=int(rng.integers(1, 9))).tolist()) for i in range(120)]
    vectors += [(200 + i, (rng.normal(size=6) * 1e14).round().tolist()) for i in range(60)] + [(300, [2e15] * 6), (301, [-2e15, 1.0]), (302, [])]
    vectors += [(400, [1e300, -1e300]), (401, [1e300]), (33, [0.25] * 3)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    end = (1 << 63) - 1
    ok = [(i, [max(-end - 1, min(end, math.floor(64 * x))) for x in e]) for i, e in vectors if e]
    want = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-max(-end, min(end, sum(x * y for x, y in zip(a, b, strict=False)))), c) for c, b in ok if c != q)[:9]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    got = search.top_k(search.quantised(df), F.col("vec_id") % 20 == 0, 9, lead=3, shard_rows=40, block_rows=4)
    assert collected(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_redaction_beside_a_clashing_column(documents):
    from pyspark.sql import functions as F

    df = documents(PERSONAL).withColumn("_T", F.lit("kept"))
    masked = pii.redact(df)
    assert masked.columns == df.columns and {r["_T"] for r in masked.collect()} == {"kept"}


def test_language_without_doc_id(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(8)] + [(None, "the cat and the dog", "en")]
    got = language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [r.held_out for r in got if r.doc_id is None] == [False] and all(r.lang_pred == "en" for r in got)
