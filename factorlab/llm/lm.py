"""Language-model scores from a hierarchical Pitman-Yor model of words.

Tokens are lower-cased (A-Z) words and one end per document. Each context, the previous token, is a
restaurant in which the tokens that follow it are seated; all contexts share one parent restaurant,
whose customers are the tables of its children, over a uniform base of V + 1 words.

Seating is sampled by blocked Gibbs sweeps: all customers of one (context, word) leave and are seated again one
after another by the Chinese-restaurant rule, given the other tables of their context and the parent's probabilities
as the sweep before left them; then the words of the parent are seated again in the same way. The first state is every
customer at a table of its own and one table a word in the parent. Sweeps go on until the number of all tables settles;
the predictive probabilities of the next `KEEP` states are averaged. In each of them discount and back-off come from the same
seating, so that they sum to one over the words and the unknown one. Random numbers come from the key of
the (context, word), the customer and the sweep, so every task that meets a pair draws the same tables
and a repeated task repeats its draws.

What Spark moves: chunks of documents (as many as the bytes of all texts ask for) meet hash buckets of words, and of pairs, once for counts, and of words once a sweep.
Each chunk sends a key once with its count and gets the corpus's count back in the same order. A word that
holds a third of all tokens is one entry a chunk. The tokens are written once as a table bucketed by chunk, read
four times; sweeps read only the distinct pairs, each in the one chunk that owns it, from a table bucketed likewise.
A state goes when the next one has been written, but for those that are averaged. Of these the owners tell the other chunks
that hold a pair its tables, through the pair's bucket, so that no chunk seats a pair that it does not own.

Null text counts as empty (one end). A null doc_id trains (its crc32 is null). Rows with equal doc_id are scored alike
and all train. With nothing to train on, every token has probability 1. Further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import U64, by_value, discarded, hash_words, joined, lower_ascii, mix, pack_keys, pieces, removed, shared_folder, text_groups, text_size, unpack_keys, writing, written

by_value(__name__)

#: Bytes of text for a chunk and for a bucket of keys, whatever the session's partitions.
CHUNK, BUCKET = 8 << 20, 8 << 20
#: Discount and strength of the contexts and of their parent.
CONTEXT = (0.8, 1.0)
PARENT = (0.7, 10.0)
#: Most sweeps before states are kept, should the tables not settle; states kept; change of all tables that counts as settled.
SWEEPS = 40
KEEP = 3
SETTLED = 0.005
END, START = U64(0x0E0D), U64(0x57A7)
NULL_DOC = (1 << 63) - 1
ONE_BY_ONE = 32
#: Keys, places and counts lie byte by byte, which this packs closer than the default does.
CODEC = "zstd"
#: Further customers are seated in blocks of this share of those seated.
STEP = 8


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * U64(0xA24BAED4963EE407) + word)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each and the number of every entry's key; which place does not matter."""
    order = np.argsort(key)
    ranked = key[order]
    fresh = np.concatenate((np.ones(min(1, len(key)), dtype=bool), ranked[1:] != ranked[:-1]))
    inverse = np.empty(len(key), dtype=np.int32)
    inverse[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return ranked[fresh], order[fresh], inverse


class Tokens:
    """Tokens of a chunk, its distinct words and distinct (context, word) pairs, both in the order of their keys."""

    def __init__(self, table: pa.Table, pairs: bool = True):
        docs, held, texts = (table[c].to_pylist() for c in ("doc", "held", "text"))
        order = sorted(range(len(docs)), key=lambda i: (docs[i], texts[i]))
        self.docs = np.array([docs[i] for i in order], dtype=np.int64)
        self.held = np.array([held[i] for i in order], dtype=bool)
        body = [texts[i].encode("utf-8", "surrogatepass") for i in order]
        hashes, rows = [], []
        for lo, hi in text_groups(body):
            raw, ends = joined(body[lo:hi])
            starts, _, h = hash_words(lower_ascii(raw))
            hashes.append(h)
            rows.append((lo + np.searchsorted(ends, starts, side="right")).astype(np.int32))
        words, row = np.concatenate(hashes), np.concatenate(rows)
        stops = np.searchsorted(row, np.arange(len(body)), side="right")
        self.row = np.insert(row, stops, np.arange(len(body), dtype=np.int32))
        del body, texts, hashes, rows
        self.words, _, inverse = grouped(np.append(np.insert(words, stops, END), START))
        self.word = inverse[:-1]
        self._count(pairs)

    def _count(self, pairs: bool) -> None:
        self.train = ~self.held[self.row]
        self.count = np.bincount(self.word[self.train], minlength=len(self.words))
        if pairs:
            start = np.concatenate(([True], self.row[1:] != self.row[:-1]))
            context = np.empty(len(self.word), dtype=np.int32)
            context[1:] = self.word[:-1]
            context[start] = np.searchsorted(self.words, START)
            self.pairs, first, self.pair = grouped(pair_keys(self.words[context], self.words[self.word]))
            self.pair_context, self.pair_word = context[first], self.word[first]
            self.pair_count = np.bincount(self.pair[self.train], minlength=len(self.pairs))

    def packed(self) -> dict[str, bytes]:
        """The chunk's documents and tokens as a row of TOKENS."""
        size = np.bincount(self.row, minlength=len(self.docs))
        cells = (self.docs, "<i8"), (self.held, "u1"), (size, "<i4"), (self.words, "<u8"), (self.word, "<i4")
        return dict(zip(("docs", "held", "sizes", "words", "word"), (pack(x, k) for x, k in cells), strict=True))

    @classmethod
    def stored(cls, table: pa.Table, pairs: bool = True) -> Tokens:
        """From the chunk's row of TOKENS."""
        self, cell = cls.__new__(cls), {c: table[c][0].as_py() for c in ("docs", "held", "sizes", "words", "word")}
        self.docs, self.held, self.words = unpack(cell["docs"], "<i8"), unpack(cell["held"], "u1").astype(bool), unpack(cell["words"], "<u8")
        self.row = np.repeat(np.arange(len(self.docs), dtype=np.int32), unpack(cell["sizes"], "<i4"))
        self.word = unpack(cell["word"], "<i4")
        self._count(pairs)
        return self


TOKENS = "chunk int, docs binary, held binary, sizes binary, words binary, word binary"


# ---- blocks of sorted keys and values between chunks and buckets ----


def pack(values: np.ndarray, kind: str) -> bytes:
    """Values of one type, byte by byte."""
    v = np.ascontiguousarray(values.astype(kind))
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.itemsize).T).tobytes()


def unpack(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys; buckets are ranges of the key."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


BLOCK = "at int, chunk int, keys binary, a binary, b binary"
BLOCK_SCHEMA = pa.schema([("at", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in BLOCK_SCHEMA]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)


def _send(chunk: int, keys: np.ndarray, buckets: int, a: np.ndarray, a_kind: str, b: np.ndarray | None = None, b_kind: str = "") -> pa.Table:
    cut = _cuts(keys, buckets).tolist()
    return _table([
        (i, chunk, pack_keys(keys[lo:hi]), pack(a[lo:hi], a_kind), pack(b[lo:hi], b_kind) if b is not None else b"")
        for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo
    ])


def _received(right: pa.Table, column: str, kind: str, tag: str | None = None) -> np.ndarray:
    """A chunk's replies in the order of its keys: buckets are ranges, so their number orders them. Rows below 0 are its own."""
    tags = right["tag"].to_pylist() if tag else None
    rows = sorted((at, i) for i, at in enumerate(right["at"].to_pylist()) if at >= 0 and (tags is None or tags[i] == tag))
    return np.concatenate([unpack(right[column][i].as_py(), kind) for _, i in rows])


def _merge(table: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Chunks in order, their key arrays, the distinct keys, and for all entries in turn the place of their key."""
    order = sorted(range(table.num_rows), key=lambda i: table["chunk"][i].as_py())
    held = [unpack_keys(table["keys"][i].as_py()) for i in order]
    keys, inverse = np.unique(np.concatenate(held), return_inverse=True)
    return order, held, keys, inverse


def add_words(table: pa.Table) -> pa.Table:
    """Corpus counts of words back to every chunk, and the bucket's tokens and distinct words under chunk -1."""
    order, held, keys, inverse = _merge(table)
    mine = np.concatenate([unpack(table["a"][i].as_py(), "<i4") for i in order])
    total = np.bincount(inverse, weights=mine, minlength=len(keys)).astype(np.int64)
    at, reply, rows, lo = table["at"][0].as_py(), total[inverse], [], 0
    for i, k in zip(order, held, strict=True):
        rows.append((at, table["chunk"][i].as_py(), b"", pack(reply[lo : lo + len(k)], "<i8"), b""))
        lo += len(k)
    rows.append((at, -1, b"", pack(np.array([total.sum(), (total > 0).sum()]), "<i8"), b""))
    return _table(rows)


def add_pairs(table: pa.Table) -> pa.Table:
    """Corpus counts of pairs back to every chunk, which chunk owns a pair (the first that trains on it): 1, and whether others hold it: 2."""
    order, held, keys, inverse = _merge(table)
    mine = np.concatenate([unpack(table["a"][i].as_py(), "<i4") for i in order])
    total = np.bincount(inverse, weights=mine, minlength=len(keys)).astype(np.int64)
    owner = 2 * (np.bincount(inverse, minlength=len(keys)) > 1)[inverse].astype(np.uint8)
    trained = np.flatnonzero(mine > 0)
    _, first = np.unique(inverse[trained], return_index=True)
    owner[trained[first]] += 1
    at, reply, rows, lo = table["at"][0].as_py(), total[inverse], [], 0
    for i, k in zip(order, held, strict=True):
        rows.append((at, table["chunk"][i].as_py(), b"", pack(reply[lo : lo + len(k)], "<i8"), pack(owner[lo : lo + len(k)], "u1")))
        lo += len(k)
    return _table(rows)


def seat_parent(table: pa.Table, words: int, all_tables: float, sweep: int) -> pa.Table:
    """Customers less discounts of words in the parent restaurant, and each word's tables as a context, back to the chunks.

    `all_tables` are the parent's tables in the state before. Under chunk -1: the bucket's customers and tables, and its state,
    the tables of each word. A chunk's own tables (bucket below 0) go back as they are.
    """
    if table["at"][0].as_py() < 0:
        return table
    own = table["chunk"].to_numpy() == -1
    state, sent = np.flatnonzero(own), table.take(pa.array(np.flatnonzero(~own)))
    order, held, keys, inverse = _merge(sent)
    customers, context = (
        np.bincount(inverse, weights=np.concatenate([unpack(sent[c][i].as_py(), "<i8") for i in order]), minlength=len(keys)).astype(np.int64) for c in ("a", "b")
    )
    before = unpack(table["b"][int(state[0])].as_py(), "<i8") if len(state) else np.minimum(customers, 1)
    discount, strength = PARENT
    tables = seat(keys, customers, (strength + discount * (all_tables - before)) / (words + 1), discount, discount / (words + 1), sweep)
    at, rows, lo = table["at"][0].as_py(), [], 0
    net, context = (customers - discount * tables)[inverse], context[inverse]
    for i, k in zip(order, held, strict=True):
        rows.append((at, sent["chunk"][i].as_py(), b"", pack(net[lo : lo + len(k)], "<f4"), pack(context[lo : lo + len(k)], "<i8")))
        lo += len(k)
    rows.append((at, -1, b"", pack(np.array([customers.sum(), tables.sum()]), "<f8"), pack(tables, "<i8")))
    return _table(rows)


def _part(data: bytes, n: int, i: int) -> np.ndarray:
    """The i-th of n lists of numbers."""
    size = len(data) // n
    return unpack(data[i * size : (i + 1) * size], "<i8")


def _parted(data: bytes, n: int) -> np.ndarray:
    """n lists of numbers, one a row."""
    return np.stack([_part(data, n, i) for i in range(n)])


def ask_buckets(chunk: int, asked: np.ndarray, told: np.ndarray, tables: list[np.ndarray], buckets: int) -> pa.Table:
    """One row a bucket: the sorted keys of which the chunk asks the tables, those of which it tells them, and these."""
    ask, tell = _cuts(asked, buckets).tolist(), _cuts(told, buckets).tolist()
    return _table([
        (i, chunk, pack_keys(asked[lo:hi]), b"".join(pack(x[at:to], "<i8") for x in tables), pack_keys(told[at:to]))
        for i, (lo, hi, at, to) in enumerate(zip(ask[:-1], ask[1:], tell[:-1], tell[1:], strict=True)) if hi > lo or to > at
    ])


def tell_tables(table: pa.Table) -> pa.Table:
    """The tables of a bucket's pairs, as their owners told them, to the chunks that ask for them."""
    chunk, wanted, tables, told = (table[c].to_pylist() for c in ("chunk", "keys", "a", "b"))
    keys = np.concatenate([unpack_keys(x) for x in told])
    tables = np.concatenate([_parted(x, KEEP) for x in tables], axis=1)
    order, at, rows = np.argsort(keys), table["at"][0].as_py(), []
    for c, x in zip(chunk, wanted, strict=True):
        if x:
            place = order[np.searchsorted(keys, unpack_keys(x), sorter=order)]
            rows.append((at, c, b"", b"".join(pack(t, "<i8") for t in tables[:, place]), b""))
    return _table(rows)


# ---- seating ----


def seat(keys: np.ndarray, customers: np.ndarray, mass: np.ndarray, discount: float, gain: np.ndarray | float = 0.0, sweep: int = 0) -> np.ndarray:
    """Number of tables at which the given customers of each key are seated.

    `mass` is the weight of a new table before any of the key's own, (strength + discount * other tables of the
    context) * parent's probability, and `gain` what each own table adds to it, discount * parent's probability.
    The first customers are seated one by one; those after go in blocks, by the expected
    number of new tables of the block, rounded at random.
    """
    total = np.minimum(customers, 1).astype(np.int64)
    more = np.flatnonzero(customers > 1)
    if not len(more):
        return total
    more = more[np.argsort(-customers[more], kind="stable")]
    c, m, k = customers[more], mass[more], mix(keys[more] ^ mix(np.array([sweep + 1], dtype=np.uint64)))
    g = np.broadcast_to(gain, customers.shape)[more]
    tables = np.ones(len(more))
    n = 1  # customers seated
    while True:
        live = int(np.searchsorted(-c, -n, side="left"))  # keys with more than n customers
        if not live:
            break
        u = (mix(k[:live] ^ mix(np.array([n], dtype=np.uint64))) >> U64(11)).astype(np.float64) * 2.0**-53
        t = tables[:live]
        new = m[:live] + g[:live] * t
        if n < ONE_BY_ONE:
            tables[:live] = t + (u * (new + n - discount * t) < new)
            n += 1
        else:
            until = np.minimum(n + n // STEP, c[:live])
            base = new - discount * t
            fresh = new * np.log((base + until) / (base + n))
            tables[:live] = np.minimum(t + np.floor(fresh + u), t + (until - n))
            n += n // STEP
    total[more] = tables.astype(np.int64)
    return total


class State:
    """What a sweep starts from: the parent's probabilities of words and the words' tables as contexts."""

    def __init__(self, parent: np.ndarray, context: np.ndarray):
        self.parent, self.context = parent, context

    @classmethod
    def first(cls, words: np.ndarray, word_count: np.ndarray, n: int, v: int) -> State:
        """Every customer at a table of its own, one table a word in the parent."""
        return cls(parent_probability(word_count - PARENT[0] * (word_count > 0), n, v, v), context_count(words, word_count))

    def reseat(self, keys: np.ndarray, totals: np.ndarray, tables: np.ndarray, context: np.ndarray, word: np.ndarray, sweep: int) -> np.ndarray:
        """Tables of pairs with the given customers and tables, seated again."""
        discount, strength = CONTEXT
        parent = self.parent[word]
        return seat(keys, totals, (strength + discount * np.maximum(self.context[context] - tables, 0)) * parent, discount, discount * parent, sweep)

    def predictive(self, totals: np.ndarray, tables: np.ndarray, size: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        discount, strength = CONTEXT
        return (totals - discount * tables + (strength + discount * self.context[context]) * self.parent[word]) / (strength + size)


def averaged(tok: Tokens, totals: np.ndarray, word_count: np.ndarray, seated: Iterable[tuple[State, np.ndarray]]) -> np.ndarray:
    """Probability of every pair of the chunk, averaged over KEEP states, given its tables in each of them."""
    size = context_count(tok.words, word_count)[tok.pair_context]
    out = np.zeros(len(totals))
    for state, t in seated:
        out += state.predictive(totals, t, size, tok.pair_context, tok.pair_word) / KEEP
    return out


def predictions(tok: Tokens, totals: np.ndarray, word_count: np.ndarray, states: list[State], keep: int) -> np.ndarray:
    """Probability of every pair of the chunk, averaged over the last `keep` states; each follows from the one before."""
    size = context_count(tok.words, word_count)[tok.pair_context]
    tables, out = totals, np.zeros(len(totals))
    for i, (before, after) in enumerate(zip(states[:-1], states[1:], strict=True)):
        tables = before.reseat(tok.pairs, totals, tables, tok.pair_context, tok.pair_word, i)
        if i >= len(states) - 1 - keep:
            out += after.predictive(totals, tables, size, tok.pair_context, tok.pair_word) / keep
    return out


def context_count(words: np.ndarray, word_count: np.ndarray) -> np.ndarray:
    """Customers of each word as a context: what follows it. Nothing follows an end; the start is followed once a document."""
    out = word_count.astype(np.int64).copy()
    start, end = (np.searchsorted(words, w) for w in (START, END))
    out[start], out[end] = word_count[end], 0
    return out


def parent_probability(net: np.ndarray, customers: float, tables: float, v: int) -> np.ndarray:
    discount, strength = PARENT
    return (net + (strength + discount * tables) / (v + 1)) / (strength + customers)


# ---- the job ----


def by_chunk(df: DataFrame, kind: str, chunks: int) -> tuple[str, str]:
    """Name and folder of a table bucketed by chunk in the shared folder, read again and again without a shuffle."""
    spark = df.sparkSession
    name = f"corpus_{kind}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/corpus/{spark.sparkContext.applicationId}/{name}"
    with writing(spark):
        df.write.bucketBy(chunks, "chunk").sortBy("chunk").option("path", path).option("compression", CODEC).saveAsTable(name)
    return name, path


def chunked(docs: DataFrame, held_out: Column, chunks: int) -> str:
    """Name of the documents' tokens as a table of one row a chunk."""
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC)).alias("doc"),
        F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )

    def tokens(table: pa.Table) -> pa.Table:
        cells = Tokens(table, pairs=False).packed()
        return pa.table([pa.array([table["chunk"][0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in cells.values())], names=["chunk", *cells])

    return by_chunk(rows.repartition(chunks, "chunk").groupBy("chunk").applyInArrow(tokens, TOKENS), "chunks", chunks)[0]


def _scalars(replies: DataFrame, kind: str) -> tuple[float, float]:
    """Sums over the buckets' own rows: one row of two numbers a bucket."""

    def add(batches):
        one = two = 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                x, y = unpack(value, kind).tolist()
                one, two = one + x, two + y
        yield pa.RecordBatch.from_arrays([pa.array([float(one)]), pa.array([float(two)])], names=["x", "y"])

    row = replies.filter("chunk = -1").select("a").mapInArrow(add, "x double, y double").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).first()
    return row.x or 0.0, row.y or 0.0


def score(docs: DataFrame, held_out: Column, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); scores are log10 probabilities of texts."""
    spark = docs.sparkSession
    size = text_size(docs)
    chunks, buckets = pieces(size, CHUNK), pieces(size, BUCKET)
    name = chunked(docs, held_out, chunks)

    def texts():
        return spark.table(name).groupBy("chunk")

    def to_chunks(replies: DataFrame):
        return replies.filter("chunk >= 0").withColumnRenamed("chunk", "to").groupBy("to")

    def tagged(**replies: DataFrame):
        every = [r.withColumn("tag", F.lit(t)) for t, r in replies.items()]
        out = every[0]
        for r in every[1:]:
            out = out.unionByName(r)
        return to_chunks(out)

    def count_words(table: pa.Table) -> pa.Table:
        tok = Tokens.stored(table, pairs=False)
        return _send(table["chunk"][0].as_py(), tok.words, buckets, tok.count, "<i4")

    word_replies = written(texts().applyInArrow(count_words, BLOCK).groupBy("at").applyInArrow(add_words, BLOCK), "words", CODEC)
    n, v = (int(x) for x in _scalars(word_replies, "<i8"))

    def count_pairs(table: pa.Table) -> pa.Table:
        tok = Tokens.stored(table)
        return _send(table["chunk"][0].as_py(), tok.pairs, buckets, tok.pair_count, "<i4")

    pair_replies = written(texts().applyInArrow(count_pairs, BLOCK).groupBy("at").applyInArrow(add_pairs, BLOCK), "pairs", CODEC)

    def owned_places(tok: Tokens, flags: np.ndarray) -> np.ndarray:
        """The chunk's own pairs in the order of their contexts."""
        mine = np.flatnonzero(flags & 1)
        return mine[np.argsort(tok.pair_context[mine], kind="stable")]

    def own_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        tok = Tokens.stored(left)
        words, totals, flags = _received(right, "a", "<i8", "words"), _received(right, "a", "<i8", "pairs"), _received(right, "b", "u1", "pairs")
        mine = owned_places(tok, flags)
        cells = (tok.words, "<u8"), (words, "<i8"), (tok.pair_context[mine], "<i4"), (tok.pair_word[mine], "<i4"), (totals[mine], "<i8"), (flags[mine] > 1, "u1")
        asked = tok.pairs[(flags & 1 == 0) & (totals > 0)]
        return pa.table([pa.array([left["chunk"][0].as_py()], pa.int32()), *(pa.array([pack(x, k)], pa.binary()) for x, k in cells), pa.array([pack(asked, "<u8")], pa.binary())], names=OWNED)

    OWNED = ["chunk", "words", "counts", "context", "word", "totals", "shared", "asked"]
    known = {"words": word_replies, "pairs": pair_replies}
    ddl = "chunk int, " + ", ".join(f"{c} binary" for c in OWNED[1:])
    owned, owned_path = by_chunk(texts().cogroup(tagged(**known)).applyInArrow(own_pairs, ddl), "owned", chunks)

    def pairs_of_chunks():
        return spark.table(owned).groupBy("chunk")

    def own_tables(right: pa.Table, chunk: int, totals: np.ndarray, tag: str | None = None) -> np.ndarray:
        """Tables of the chunk's own pairs in a state, which has those of more than one customer."""
        out = np.ones(len(totals), dtype=np.int64)
        out[totals > 1] = next(unpack(right["a"][i].as_py(), "<i8") for i, at in enumerate(right["at"].to_pylist()) if at == -1 - chunk and (tag is None or right["tag"][i].as_py() == tag))
        return out

    def sweep_pairs(left: pa.Table, right: pa.Table | None, sweep: int, customers: float, tables: float) -> pa.Table:
        cell = {c: left[c][0].as_py() for c in ("chunk", "words", "counts", "context", "word", "totals")}
        words, counts, totals = unpack(cell["words"], "<u8"), unpack(cell["counts"], "<i8"), unpack(cell["totals"], "<i8")
        context, word = (unpack(cell[c], "<i4").astype(np.int64) for c in ("context", "word"))
        state, t = State.first(words, counts, n, v), totals
        if right is not None:
            state = State(parent_probability(_received(right, "a", "<f4"), customers, tables, v), _received(right, "b", "<i8"))
            t = own_tables(right, cell["chunk"], totals)
        # A single customer has a table of its own in every state.
        some, t = totals > 1, t.copy()
        there, of = context[some], word[some]
        t[some] = state.reseat(pair_keys(words[there], words[of]), totals[some], t[some], there, of, sweep)
        sums = [np.bincount(place, weights=t, minlength=len(words)) for place in (word, context)]
        sent = _send(cell["chunk"], words, buckets, sums[0], "<i8", sums[1], "<i8")
        return pa.concat_tables([sent, _table([(-1 - cell["chunk"], cell["chunk"], b"", pack(t[some], "<i8"), b"")])])

    def one_sweep(sweep: int, replies: DataFrame | None, customers: float, tables: float) -> DataFrame:
        if replies is None:
            sent = pairs_of_chunks().applyInArrow(lambda left: sweep_pairs(left, None, sweep, 0, 0), BLOCK)
        else:
            back = replies.filter("chunk >= 0").withColumnRenamed("chunk", "to").groupBy("to")
            sent = pairs_of_chunks().cogroup(back).applyInArrow(lambda left, right: sweep_pairs(left, right, sweep, customers, tables), BLOCK)
            sent = sent.unionByName(replies.filter("chunk = -1"))
        held = tables if replies is not None else v
        return written(sent.groupBy("at").applyInArrow(lambda t: seat_parent(t, v, held, sweep), BLOCK), "parents", CODEC)

    replies: list[DataFrame] = []
    sizes: list[tuple[float, float]] = []
    customers = tables = 0.0
    until = None
    while until is None or len(replies) < until:
        before = customers if replies else float(n)
        replies.append(one_sweep(len(replies), replies[-1] if replies else None, customers, tables))
        customers, tables = _scalars(replies[-1], "<f8")
        sizes.append((customers, tables))
        # Small corpora differ by chance from state to state.
        settled = abs(customers - before) <= max(SETTLED * before, 2 * before**0.5)
        if until is None and (settled or len(replies) >= sweeps):
            until = len(replies) + KEEP
        if len(replies) > 1 and (until is None or len(replies) - 2 < until - KEEP):
            discarded(replies[-2])

    last = {f"state{i}": r for i, r in enumerate(replies[-KEEP:])}
    tags = list(last)

    def ask_tables(left: pa.Table, right: pa.Table) -> pa.Table:
        """Tables of the chunk's own pairs that others hold too, and the keys of those that it holds of others."""
        cell = {c: left[c][0].as_py() for c in OWNED}
        words, some = unpack(cell["words"], "<u8"), unpack(cell["shared"], "u1").astype(bool)
        context, word = (unpack(cell[c], "<i4")[some] for c in ("context", "word"))
        keys = pair_keys(words[context], words[word])
        order = np.argsort(keys)
        totals = unpack(cell["totals"], "<i8")
        tables = [own_tables(right, cell["chunk"], totals, tag)[some][order] for tag in tags]
        return ask_buckets(cell["chunk"], unpack(cell["asked"], "<u8"), keys[order], tables, buckets)

    told = pairs_of_chunks().cogroup(tagged(**{k: r.filter("at < 0") for k, r in last.items()})).applyInArrow(ask_tables, BLOCK)
    known |= last | {"told": written(told.groupBy("at").applyInArrow(tell_tables, BLOCK), "told", CODEC)}
    spark.sql(f"DROP TABLE {owned}")
    removed(spark, owned_path)

    out = pa.schema([("doc", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        tok, chunk = Tokens.stored(left), left["chunk"][0].as_py()
        words, totals, flags = _received(right, "a", "<i8", "words"), _received(right, "a", "<i8", "pairs"), _received(right, "b", "u1", "pairs")
        mine, others = owned_places(tok, flags), (flags & 1 == 0) & (totals > 0)
        tags = right["tag"].to_pylist()
        answers = sorted((at, i) for i, at in enumerate(right["at"].to_pylist()) if tags[i] == "told")

        def seated():
            """The states and the chunk's tables in them, one after another."""
            for i, (customers, seats) in enumerate(sizes[-KEEP:]):
                tables = np.zeros(len(totals), dtype=np.int64)
                tables[mine] = own_tables(right, chunk, totals[mine], f"state{i}")
                if answers:
                    tables[others] = np.concatenate([_part(right["a"][k].as_py(), KEEP, i) for _, k in answers])
                yield State(parent_probability(_received(right, "a", "<f4", f"state{i}"), customers, seats, v), _received(right, "b", "<i8", f"state{i}")), tables

        p = averaged(tok, totals, words, seated())
        docs_here = len(tok.docs)
        base = np.log10((words + 1) / (n + v + 1))
        cols = (
            tok.docs, tok.held, np.bincount(tok.row, minlength=docs_here), np.bincount(tok.row, weights=words[tok.word] > 0, minlength=docs_here).astype(np.int64),
            np.bincount(tok.row, weights=base[tok.word], minlength=docs_here), np.bincount(tok.row, weights=np.log10(np.minimum(p, 1.0))[tok.pair], minlength=docs_here),
        )
        return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    ddl = "doc long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = texts().cogroup(tagged(**known)).applyInArrow(judge, ddl)
    return scored.select(F.nullif(F.col("doc"), F.lit(NULL_DOC)).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
