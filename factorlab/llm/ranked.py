"""Ranked lexical search: accumulator-limited term-at-a-time over shards of documents.

1. One pass over the texts keeps, per document, its length in terms and the frequencies of
   those terms that some item asks for. Corpus statistics (documents, terms, document
   frequencies) are partial aggregates over that table.
2. Every shard of documents inverts its own postings. An item's terms are taken rarest first;
   each adds to the accumulators of its documents. As soon as the bounds of the terms to come
   can't lift a new document to the k-th best partial score, no accumulator is created any more;
   those that can still reach it are completed exactly by looking up their own postings.
3. The k best of every shard meet in one ranking per item.

Items travel to the shards in blocks, whose number of (item, term) pairs is counted before it is
sent and never exceeds `block_pairs`; more items make more blocks, not larger ones. A shard closes
after `shard_postings` postings, whatever the batches are.

Null and term-less texts have no score and count in no statistic. Rows of one item_id form one item
with all their terms; a null item_id is an item as well. Every row of documents is a document, so
repeated rows each take a rank; rows with a null doc_id come last among equal scores.
Other columns are never read, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorlab.llm.common import as_bytes, by_value, joined, lower_ascii, span_hashes, text_groups, written

by_value(__name__)

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
BLOCK_PAIRS = 1_000_000
SHARD_POSTINGS = 4_000_000
PIECE = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of terms: digits, ASCII letters and everything from 0x80, of which UTF-8 makes all other characters.
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[128:] = _IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = True


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of every item."""
    lower = F.translate("text", UPPER, LOWER)
    return items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def term_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _IN_TERM[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    """A text in pieces of about `size` bytes, cut where no term runs on."""
    out, at = [], 0
    while len(text) - at > size:
        apart = np.flatnonzero(~_IN_TERM[np.frombuffer(text, dtype=np.uint8, count=size, offset=at)])
        cut = at + int(apart[-1]) + 1 if len(apart) else len(text)
        if not len(apart):  # one term longer than a piece: up to its end
            rest = np.frombuffer(text, dtype=np.uint8, offset=at)
            after = np.flatnonzero(~_IN_TERM[rest])
            cut = at + int(after[0]) + 1 if len(after) else len(text)
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def _vocabulary(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct terms, their lengths, and the place of each given term among them."""
    raw, ends = joined(terms)
    starts = np.concatenate(([0], ends[:-1])) if len(terms) else np.empty(0, dtype=np.int64)
    hashes = span_hashes(raw, starts, ends - 1)
    vocab, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    return vocab, (ends - 1 - starts)[first], place


def postings(docs: DataFrame, vocab: np.ndarray, lengths: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with at least one term: wanted terms as places in `vocab`, ascending."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def count(batches):
        for batch in batches:
            parts, owner = [], []
            for i, text in enumerate(as_bytes(batch.column(1))):
                for piece in pieces(text):
                    parts.append(piece)
                    owner.append(i)
            owner = np.array(owner, dtype=np.int64)
            n = np.zeros(batch.num_rows, dtype=np.int64)
            keys = []
            for lo, hi in text_groups(parts):
                raw, ends = joined(parts[lo:hi])
                raw = lower_ascii(raw)
                a, b = term_spans(raw)
                whose = owner[lo:hi][np.searchsorted(ends, a, side="right")]
                np.add.at(n, whose, 1)
                if len(vocab) and len(a):
                    h = span_hashes(raw, a, b)
                    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                    ok = (vocab[at] == h) & (lengths[at] == b - a)
                    keys.append(whose[ok] * len(vocab) + at[ok])
            key, tf = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
            whose = key // max(1, len(vocab))
            keep = np.flatnonzero(n)
            offsets = pa.array(np.searchsorted(whose, np.append(keep, batch.num_rows)).astype(np.int32))
            terms = pa.array((key % max(1, len(vocab))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep)).cast(pa.int64()),
                    pa.array(n[keep]),
                    pa.ListArray.from_arrays(offsets, terms),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
                ],
                schema=schema,
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Postings of some documents by term, with every posting's share of a score and each term's best share."""

    def __init__(self, sizes: np.ndarray, m: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weight: np.ndarray):
        docs = np.repeat(np.arange(len(sizes)), sizes)
        share = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs]))
        order = np.argsort(terms, kind="stable")
        self.docs, self.share = docs[order], share[order]
        self.at = np.searchsorted(terms[order], np.arange(len(weight) + 1))
        self.best = np.zeros(len(weight), dtype=np.int64)
        held = np.flatnonzero(np.diff(self.at))
        if len(held):
            self.best[held] = np.maximum.reduceat(self.share, self.at[held])
        self.acc = np.zeros(len(sizes), dtype=np.int64)

    def top(self, terms: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best for an item whose terms come rarest first; `ids` order equal scores."""
        terms = terms[self.best[terms] > 0]
        rest = np.append(np.cumsum(self.best[terms][::-1])[::-1], 0)
        acc, made, done = self.acc, np.empty(0, dtype=np.int64), 0
        cut = 0
        for done, t in enumerate(terms, start=1):
            docs, share = self.docs[self.at[t] : self.at[t + 1]], self.share[self.at[t] : self.at[t + 1]]
            fresh = docs[(acc[docs] == 0) & (share > 0)]
            acc[docs] += share
            made = np.concatenate((made, fresh))
            if len(made) >= k:
                cut = max(cut, int(np.partition(acc[made], len(made) - k)[len(made) - k]))
                if rest[done] < cut:  # a new document couldn't even draw level
                    break
        live = np.sort(made[acc[made] + rest[done] >= cut])
        for j in range(done, len(terms)):
            t = terms[j]
            docs, share = self.docs[self.at[t] : self.at[t + 1]], self.share[self.at[t] : self.at[t + 1]]
            at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
            hit = docs[at] == live
            acc[live[hit]] += share[at[hit]]
        score = acc[live]
        if len(live) > k:
            edge = np.partition(score, len(live) - k)[len(live) - k]
            live, score = live[score >= edge], score[score >= edge]
        first = np.lexsort((ids[live], -score))[:k]
        out = live[first].copy(), score[first].copy()
        acc[made] = 0
        return out


def _scored(rows: DataFrame, weight: np.ndarray, items: pa.Array, at: np.ndarray, terms: np.ndarray, k: int, shard_postings: int) -> DataFrame:
    """The k best documents of every shard for every item of a block."""

    def score(batches):
        held, size = [], 0

        def answer():
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, lists, tfs = whole["doc_id"].combine_chunks(), whole["terms"].combine_chunks(), whole["tfs"].combine_chunks()
            # Null ids after all others.
            order = np.where(ids.is_null(), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy())
            sizes = lists.value_lengths().to_numpy()
            shard = Shard(sizes, whole["m"].to_numpy(), lists.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64), weight)
            which, docs, scores = [], [], []
            for i in range(len(items)):
                d, s = shard.top(terms[at[i] : at[i + 1]], order, k)
                which.append(np.full(len(d), i))
                docs.append(d)
                scores.append(s)
            empty = np.empty(0, dtype=np.int64)
            which, docs, scores = (np.concatenate([empty, *x]).astype(np.int64) for x in (which, docs, scores))
            return pa.RecordBatch.from_arrays([items.take(pa.array(which)), ids.take(pa.array(docs)), pa.array(scores)], names=["item_id", "doc_id", "score"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows + len(batch.column(2).flatten())
            if size >= shard_postings:
                yield answer()
                held, size = [], 0
        if held:
            yield answer()

    return rows.select("doc_id", "m", "terms", "tfs").mapInArrow(score, "item_id long, doc_id long, score long")


def _blocks(pairs: DataFrame, block_pairs: int) -> tuple[Column, int]:
    """A block number per item and their count, with no block over `block_pairs` pairs unless it is one item alone."""
    total = pairs.count()
    n = max(1, -(-total // block_pairs))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        sizes = pairs.groupBy(block.alias("b")).agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))
        if n == 1 and total <= block_pairs or not sizes.filter((F.col("n") > block_pairs) & (F.col("items") > 1)).head(1):
            return block, n
        n *= 2


def search(docs: DataFrame, items: DataFrame, k: int = K, block_pairs: int = BLOCK_PAIRS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k highest-scoring documents of every item."""
    pairs = written(item_terms(items), "item-terms")
    block, blocks = _blocks(pairs, block_pairs)
    found = None
    for b in range(blocks):
        wanted = pairs.filter(block == b).orderBy("item_id", "term").toArrow().combine_chunks()
        vocab, lengths, place = _vocabulary([t.encode() for t in wanted["term"].to_pylist()])
        rows = written(postings(docs, vocab, lengths), "postings")
        total = rows.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(1)).alias("L")).first()
        w = F.floor(1000 * F.log(F.lit(2.0 * total.N + 2) / (2 * F.count("*") + 1)))
        # At most one row per term of the block.
        freq = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"), w.cast("long").alias("w")).toArrow()
        df, weight = np.zeros(len(vocab), dtype=np.int64), np.zeros(len(vocab), dtype=np.int64)
        df[freq["t"].to_numpy()], weight[freq["t"].to_numpy()] = freq["df"].to_numpy(), freq["w"].to_numpy()
        ids = wanted["item_id"].combine_chunks() if isinstance(wanted["item_id"], pa.ChunkedArray) else wanted["item_id"]
        number = ids.dictionary_encode(null_encoding="encode")
        item = number.indices.to_numpy()
        order = np.lexsort((place, df[place], item))
        at = np.searchsorted(item[order], np.arange(len(number.dictionary) + 1))
        m = F.lit(10) + F.expr(f"(90 * n * {total.N}L) div {total.L}L")
        best = _scored(rows.withColumn("m", m), weight, number.dictionary.cast(pa.int64()), at, place[order], k, shard_postings)
        found = best if found is None else found.unionByName(best)
    first = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
