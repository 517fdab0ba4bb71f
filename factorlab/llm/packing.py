"""Best-fit packing after dominance reduction.

Documents become token ids, long ones are cut into full pieces and one remainder,
and pieces go into sequences of `capacity` tokens. The packing itself works on the
histogram of piece lengths, which has at most `capacity` classes however many
documents there are:

1. Reduction: a set of one, two or three pieces is fixed for good when no other
   filling of its sequence can beat it (the dominance criterion of Martello and Toth).
2. The remaining instance is packed best fit, longest first.

Both yield patterns with multiplicities. Pieces are ranked within their length by
distributed counting and look up their place in a slot table whose size depends on
the number of patterns alone.

Null text counts as empty; an empty document is the end token alone. Equal lengths
are ranked by (doc_id, piece) within a hash group, so results do not depend on the layout.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorlab.llm.common import by_value, parts, written

by_value(__name__)

CAPACITY = 1024
END_ID = 2
END_TEXT = "<|endoftext|>"


def _encoder(ranks_path: str, pattern: str):
    """A function from text to little-endian 32-bit ids.

    tiktoken reads the tokenizer's vocabulary as ranks and gives the same ids (a test holds the two
    against each other) in a fifth of the time.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_TEXT: len(ranks)})
    return lambda text: whole.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); only documents over `capacity` are cut, their first piece short."""
    tail = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        encode = _encoder(ranks_path, pattern)
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + tail
                n = len(ids) // 4
                at, piece = 0, 0
                size = n if n <= capacity else n % capacity or capacity
                while at < n:
                    for column, value in zip(rows, (doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        column.append(value)
                    at, piece, size = at + size, piece + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _largest(have: dict[int, int], at_most: int, but: tuple[int, ...] = ()) -> int:
    """Largest length with an unused piece, at most `at_most`; 0 if none."""
    for size in range(at_most, 0, -1):
        if have.get(size, 0) > sum(b == size for b in but):
            return size
    return 0


def dominating(have: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets of up to three pieces that dominate every other filling, and remove them from `have`.

    For the longest piece j and the room left beside it: j alone if nothing fits; j with k, the largest
    that fits, if k fills the room exactly or no two pieces fit beside j; j with the best two if at most
    two fit and they hold at least as much as any single piece, the larger of them no smaller than it.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    for j in sorted(have, reverse=True):
        while have.get(j, 0) > 0:
            room = capacity - j
            k = _largest(have, room, (j,))
            chosen: tuple[int, ...] | None = None
            if not k:
                chosen = (j,)
            elif k == room:
                chosen = (j, k)
            else:
                small = sorted(s for s, n in have.items() if n - (s == j) > 0)
                a = small[0]
                b = a if have[a] - (a == j) > 1 else (small[1] if len(small) > 1 else None)
                if b is None or a + b > room:
                    chosen = (j, k)
                else:
                    c = a if have[a] - (a == j) > 2 else (b if have[b] - (b == j) - (b == a) > 1 else next((s for s in small if s > b), None))
                    pair = next(((k, y) for y in [_largest(have, room - k, (j, k))] if y), None)
                    if pair and sum(pair) == room and (c is None or a + b + c > room):
                        chosen = (j, *pair)
            if chosen is None:
                break
            need = {s: chosen.count(s) for s in chosen}
            times = min(have[s] // n for s, n in need.items())
            for s, n in need.items():
                have[s] -= n * times
            fixed.append((chosen, times))
    return fixed


def best_fit(have: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each piece into the fullest sequence with room; alike sequences are handled together."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for size in sorted((s for s, n in have.items() if n > 0), reverse=True):
        left = have[size]
        while left:
            room = next((r for r in range(size, capacity + 1) if open_bins.get(r)), None)
            if room is None:
                fit = capacity // size
                if left >= fit:
                    open_bins[capacity - fit * size][(size,) * fit] += left // fit
                    left %= fit
                else:
                    open_bins[capacity - left * size][(size,) * left] += 1
                    left = 0
                continue
            pattern, bins = next(iter(open_bins[room].items()))
            fit = min(room // size, left)
            times = min(bins, left // fit)
            open_bins[room][pattern] -= times
            if not open_bins[room][pattern]:
                del open_bins[room][pattern]
            open_bins[room - fit * size][pattern + (size,) * fit] += times
            left -= fit * times
        have[size] = 0
    return [(p, n) for by in open_bins.values() for p, n in by.items() if n]


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    have = dict(counts)
    return dominating(have, capacity) + best_fit(have, capacity)


def slot_rows(packed: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, after the last rank, first sequence, offset): where the pieces of each length go."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, times in packed:
        offset = 0
        for size in pattern:
            rows.append((size, taken[size], taken[size] + times, sequence, offset))
            taken[size] += times
            offset += size
        sequence += times
    return rows


def ranked(pieces: DataFrame, groups: int) -> DataFrame:
    """`place`: rank of every piece within its length, counted per (length, group) so that no length meets in one task."""
    p = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    count = p.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    # At most groups x capacity rows, whatever the number of pieces.
    base = count.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "start")
    return p.withColumn("_r", F.row_number().over(inside)).join(base, ["length", "_g"]).withColumn("place", F.col("_base") + F.col("_r") - 1).drop("_g", "_r", "_base")


def best_fit_pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, ranks_path, pattern, capacity, end_id), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = slot_rows(patterns(counts, capacity))
    slots = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, seq long, offset long")
    # Per length an array of its slots, sorted by first rank: one equi-join, then a search in the row.
    by_length = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "seq", "offset"))).alias("_slots"))
    groups = max(1, parts(spark) // 4)
    hit = F.element_at(F.filter("_slots", lambda s: (s.lo <= F.col("place")) & (F.col("place") < s.hi)), 1)
    return (
        ranked(pieces, groups).join(F.broadcast(by_length), "length").withColumn("_s", hit)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_s.seq") + F.col("place") - F.col("_s.lo")).alias("sequence_id"), F.col("_s.offset").alias("offset"))
    )
