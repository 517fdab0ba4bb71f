"""Removal of strings that an earlier document already holds.

A window is `length` consecutive units (words or bytes) of one document. A unit goes if a
window over it also starts in a document with a smaller doc_id; windows are judged on the
input. Two operators share the frame below and differ in how they match:

* :func:`suffix_automata` (words): documents are streamed through suffix automata of
  reference shards, whose matching statistics give the repeated spans;
* :func:`suffix_ranges` (bytes): sampled splitters range-partition the suffixes by their
  leading bytes, and every range is sorted by multikey quicksort and its neighbours compared.

Matching every document against every shard, or moving every suffix, would grow with the
square of the corpus or be fifty times its size. So windows are first routed by content:
each window names its anchor, the k-gram in it with the smallest hash. Equal windows have
equal anchors, so a window can only repeat inside its anchor's group. Among bytes a common gram is an anchor only
where a window has none that is rarer (:func:`gram_levels`), so that no group grows with the corpus.

1. `chunk -> bucket`: hashes of the anchors of a chunk, each once, with a mark if two of its documents hold it.
2. `bucket -> chunk`: those that two documents hold.
3. `chunk -> bucket`: the distinct segments (all windows of one anchor in a row) around shared anchors, each once a
   chunk, with the places where it stands. An anchor in a third of all documents so comes once a chunk and content.
4. `bucket -> chunk`: per place the spans that are repeated, from the matcher. Whole strings are compared, so
   a collision of hashes can cost time but not change a result.
5. `chunk`: what is left.

Chunks are hash classes of doc_id whose texts a task holds (of words a multiple of the shuffle partitions, of bytes as many
as the bytes of all texts ask for, whatever the session's partitions).

Null text counts as empty, an empty text keeps nothing and loses nothing. A null doc_id ranks
after all others. Rows with equal doc_id are one rank: neither removes the other's text. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import (
    BYTE_BASE, U64, WORD_BASE, as_bytes, by_value, gram_hashes, hash_words, joined, mix, pack_keys, parts, pieces, runs, text_groups, text_size, unpack_keys,
)

by_value(__name__)

LAST = (1 << 63) - 1
SLICE = 1 << 19
INDEX = U64((1 << 20) - 1)
#: Anchors are known by 55 bits of hash; the bit below marks those that two documents of a chunk hold.
HASH, MARK = U64(0xFFFFFFFFFFFFFE00), U64(0x100)
BINARY = pa.binary()
#: Bytes of text for a chunk, for a bucket of anchors and for a suffix range; so many ranges are a group, whose rows a chunk gets together.
CHUNK, BUCKET, RANGE, TOGETHER = 4 << 20, 16 << 20, 2 << 20, 4
#: Grams fall into 2**CLASS_BITS classes of hash. Those that occur COMMON times or more, and four times the mean of all classes, are of
#: level 1, STEEPER times as often of level 2, and so on; their number is taken from documents of about SAMPLE bytes in COUNTERS groups.
CLASS_BITS, COMMON, STEEPER, SAMPLE, COUNTERS = 20, 1 << 12, 8, 1 << 25, 8


class Chunk:
    """Texts of a chunk in the order of (doc_id, text), as one stream of units."""

    def __init__(self, table: pa.Table, words: bool):
        docs = table["doc"].to_pylist()
        texts = as_bytes(table["text"])
        order = sorted(range(len(docs)), key=lambda i: (docs[i], texts[i]))
        self.docs = np.array([docs[i] for i in order], dtype=np.int64)
        self.texts = [texts[i] for i in order]
        self.words = words
        if words:
            hashes, rows, starts, ends, at = [], [], [], [], 0
            for lo, hi in text_groups(self.texts):
                raw, text_ends = joined(self.texts[lo:hi])
                s, e, h = hash_words(raw)
                hashes.append(h)
                rows.append(lo + np.searchsorted(text_ends, s, side="right").astype(np.int32))
                starts.append(s + at)
                ends.append(e + at)
                at += len(raw)
            self.raw = b"\n".join(self.texts) + b"\n"
            self.units = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
            self.rows = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
            self.starts = np.concatenate(starts) if starts else np.empty(0, dtype=np.int64)
            self.ends = np.concatenate(ends) if ends else np.empty(0, dtype=np.int64)
        else:
            self.raw = b"".join(self.texts)
            self.units = np.frombuffer(self.raw, dtype=np.uint8)
            self.rows = np.repeat(np.arange(len(self.texts), dtype=np.int32), np.fromiter(map(len, self.texts), dtype=np.int64, count=len(self.texts)))
        self.first = np.searchsorted(self.rows, np.arange(len(self.texts) + 1))

    def content(self, start: int, stop: int) -> bytes:
        """Units [start, stop) as bytes; words are joined by one space."""
        if self.words:
            return b" ".join(self.raw[self.starts[start] : self.ends[stop - 1]].split())
        return self.raw[start:stop]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: span - width], x[width - span :]) if span < width else x


def gram_class(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - CLASS_BITS)).astype(np.int64)


def segments(chunk: Chunk, length: int, k: int, levels: np.ndarray | None = None):
    """Arrays (first window, number of windows, anchor hash, anchor place) of all runs of windows with one anchor."""
    units, rows = chunk.units, chunk.rows
    for at in range(0, max(0, len(units) - length + 1), SLICE):
        part, row = units[at : at + SLICE + length - 1], rows[at : at + SLICE + length - 1]
        m = len(part) - length + 1
        h = gram_hashes(part, k, WORD_BASE if chunk.words else BYTE_BASE)
        # The smallest hash of the lowest level, leftmost among equals: a function of the window's content.
        rank = h if levels is None else (h >> U64(2)) | (levels[gram_class(h)].astype(np.uint64) << U64(62))
        own = (sliding_min((rank & ~INDEX) | np.arange(len(h), dtype=np.uint64), length - k + 1) & INDEX).astype(np.int64)
        inside = row[:m] == row[length - 1 :]
        cut = np.flatnonzero((own[1:] != own[:-1]) | (inside[1:] != inside[:-1]) | (row[1:m] != row[: m - 1])) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [m]))
        keep = inside[lo]
        lo, hi = lo[keep], hi[keep]
        yield at + lo, hi - lo, mix(h[own[lo]] ^ U64(0x5DEECE66D1234567)), at + own[lo]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int32)


def _blocks(sorted_keys: np.ndarray, buckets: int):
    """(bucket, slice) of sorted keys; buckets are ranges of the hash."""
    bucket = bucket_of(sorted_keys, buckets)
    edge = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hi > lo:
            yield int(bucket[lo]), slice(lo, hi)


KEYS = pa.schema([("at", pa.int32()), ("chunk", pa.int32()), ("keys", BINARY)])


def anchors(table: pa.Table, words: bool, length: int, k: int, buckets: int, levels: np.ndarray | None = None) -> pa.Table:
    chunk = Chunk(table, words)
    found = [(key, chunk.docs[chunk.rows[first]]) for first, _, key, _ in segments(chunk, length, k, levels)]
    if not found:
        return KEYS.empty_table()
    key, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(key, kind="stable")  # documents stay in order within a key
    key, doc = key[order] & HASH, doc[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    many = doc[edge] != doc[np.append(edge[1:], len(key)) - 1]
    key = np.where(many, key[edge] | MARK, key[edge])
    name = table["chunk"][0].as_py()
    rows = [(b, name, pack_keys(key[part])) for b, part in _blocks(key, buckets)]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), KEYS, strict=True)], schema=KEYS)


def shared_keys(table: pa.Table) -> pa.Table:
    """Reply to every chunk the keys that two documents hold."""
    held = [unpack_keys(b) for b in table["keys"].to_pylist()]
    every = np.concatenate(held)
    plain = np.sort(every & HASH)
    shared = np.unique(np.concatenate((plain[1:][plain[1:] == plain[:-1]], every[(every & MARK) > 0] & HASH)))
    rows = []
    for chunk, keys in zip(table["chunk"].to_pylist(), held, strict=True):
        keys = keys & HASH
        hit = _member(keys, shared)
        if hit.any():
            rows.append((0, chunk, pack_keys(keys[hit])))
    cols = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, KEYS, strict=True)], schema=KEYS)


def _member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), dtype=bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


#: At most so many contents travel as one row, which spreads what a row costs and bounds its size.
PACK = 16
#: Segments of a chunk for one group of ranges are packed into rows: per content its range, size and number of places, in the
#: order of the ranges; per place the document and the first unit in the chunk.
SEGMENTS = pa.schema([("group", pa.int32()), ("chunk", pa.int32()), *((c, BINARY) for c in ("parts", "sizes", "counts", "contents", "docs", "places"))])


def candidate_segments(
    left: pa.Table, right: pa.Table, words: bool, length: int, k: int, route: Callable[[np.ndarray, list[bytes]], np.ndarray], together: int,
    levels: np.ndarray | None = None,
) -> pa.Table:
    """Distinct contents around shared anchors with their places, each sent to the range that `route` names; `together` ranges are a group."""
    if not left.num_rows or not right.num_rows:
        return SEGMENTS.empty_table()
    chunk = Chunk(left, words)
    shared = np.sort(np.concatenate([unpack_keys(b) for b in right["keys"].to_pylist()]))
    seen: dict[bytes, list] = {}
    for first, count, key, place in segments(chunk, length, k, levels):
        hit = _member(key & HASH, shared)
        for a, n, h, p in zip(first[hit].tolist(), count[hit].tolist(), key[hit].tolist(), place[hit].tolist(), strict=True):
            content = chunk.content(a, a + n + length - 1)
            entry = seen.get(content)
            if entry is None:
                entry = seen[content] = [h, p, []]
            entry[2].append(a)
    if not seen:
        return SEGMENTS.empty_table()
    heads = [] if words else [chunk.raw[e[1] : e[1] + k] for e in seen.values()]
    part = route(np.array([e[0] for e in seen.values()], dtype=np.uint64), heads)
    name = left["chunk"][0].as_py()
    entries = list(seen.items())
    order = np.argsort(part, kind="stable")
    part = part[order].astype(np.int32)
    group = part // together
    edge = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)])).tolist()
    rows = []
    for lo, hi in ((at, min(at + PACK, b)) for a, b in zip(edge[:-1], edge[1:], strict=True) for at in range(a, b, PACK)):
        own = [entries[i] for i in order[lo:hi].tolist()]
        counts = np.fromiter((len(e[2]) for _, e in own), dtype=np.int32, count=len(own))
        places = np.fromiter((a for _, e in own for a in e[2]), dtype=np.int64, count=int(counts.sum()))
        sizes = np.fromiter((len(c) for c, _ in own), dtype=np.int32, count=len(own))
        arrays = (part[lo:hi], sizes, counts), (chunk.docs[chunk.rows[places]], places)
        rows.append((int(group[lo]), name, *(x.tobytes() for x in arrays[0]), b"".join(c for c, _ in own), *(x.tobytes() for x in arrays[1])))
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), SEGMENTS, strict=True)], schema=SEGMENTS)


def packed_ranges(table: pa.Table):
    """Per range of a group: (contents, number of places of each, chunk of each place, documents, places)."""
    parts, sizes, counts = (np.frombuffer(b"".join(table[c].to_pylist()), dtype=np.int32) for c in ("parts", "sizes", "counts"))
    docs, places = (np.frombuffer(b"".join(table[c].to_pylist()), dtype=np.int64) for c in ("docs", "places"))
    blob = b"".join(table["contents"].to_pylist())
    per_row = np.fromiter((len(b) // 4 for b in table["parts"].to_pylist()), dtype=np.int64, count=table.num_rows)
    chunk = np.repeat(np.repeat(table["chunk"].to_numpy(), per_row), counts)
    end = np.cumsum(sizes, dtype=np.int64)
    begin, of_place = end - sizes, np.repeat(parts, counts)
    for part in np.unique(parts).tolist():
        own, at = np.flatnonzero(parts == part), of_place == part
        contents = [blob[x:y] for x, y in zip(begin[own].tolist(), end[own].tolist(), strict=True)]
        yield contents, counts[own], chunk[at], docs[at], places[at]


SPANS = pa.schema([("chunk", pa.int32()), ("starts", BINARY), ("ends", BINARY)])


def _range_spans(
    held: list[bytes], counts: np.ndarray, chunk: np.ndarray, docs: np.ndarray, places: np.ndarray,
    words: bool, length: int, matcher: Callable[[list[bytes], np.ndarray, int], np.ndarray],
) -> list[tuple]:
    """(chunk, start, end) arrays of the repeated spans of one range."""
    seen: dict[bytes, int] = {}
    number = np.fromiter((seen.setdefault(c, len(seen)) for c in held), dtype=np.int64, count=len(held))
    which = np.repeat(number, counts)
    first = np.full(len(seen), LAST, dtype=np.int64)
    np.minimum.at(first, which, docs)
    contents = list(seen)
    order = sorted(range(len(contents)), key=lambda i: (first[i], contents[i]))
    low = matcher([contents[i] for i in order], first[order], length)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    units = np.fromiter((c.count(b" ") + 1 if words else len(c) for c in map(contents.__getitem__, order)), dtype=np.int64, count=len(order))
    windows = units - length + 1
    begin = np.cumsum(windows) - windows
    least, most = np.minimum.reduceat(low, begin), np.maximum.reduceat(low, begin)
    which = rank[which]
    # All windows repeated: the whole segment goes. Some: its runs.
    whole = np.flatnonzero(docs > most[which])
    got = [(chunk[whole], places[whole], places[whole] + windows[which[whole]] + length - 1)]
    for i in np.flatnonzero((docs > least[which]) & (docs <= most[which])).tolist():
        s, e = runs(low[begin[which[i]] : begin[which[i]] + windows[which[i]]] < docs[i])
        got.append((np.full(len(s), chunk[i]), places[i] + s, places[i] + e + length - 1))
    return got


def repeated_spans(table: pa.Table, words: bool, length: int, matcher: Callable[[list[bytes], np.ndarray, int], np.ndarray]) -> pa.Table:
    """Per chunk the spans (start, end) whose windows an earlier document holds.

    `matcher(contents, first_docs, length)` gives for all windows of all contents in turn the smallest doc_id.
    """
    # Ranges of a group one after another: equal windows are in one range, and only one is expanded at a time.
    got = []
    for held in packed_ranges(table):
        got += _range_spans(*held, words, length, matcher)
    to, start, end = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(to, kind="stable")
    to, start, end = to[order], start[order].astype(np.int64), end[order].astype(np.int64)
    edge = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)])).tolist() if len(to) else [0]
    out = [(int(to[a]), start[a:b].tobytes(), end[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    cols = zip(*out, strict=True) if out else ([], [], [])
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, SPANS, strict=True)], schema=SPANS)


KEPT = pa.schema([("doc", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", BINARY)])


def remainder(left: pa.Table, right: pa.Table, words: bool) -> pa.Table:
    if not left.num_rows:
        return KEPT.empty_table()
    chunk = Chunk(left, words)
    gone = np.zeros(len(chunk.units), dtype=bool)
    if right.num_rows:
        starts, ends = (np.concatenate([np.frombuffer(b, dtype=np.int64) for b in right[c].to_pylist()]) for c in ("starts", "ends"))
        step = np.zeros(len(chunk.units) + 1, dtype=np.int32)
        np.add.at(step, starts, 1)
        np.add.at(step, ends, -1)
        gone = np.cumsum(step[:-1], dtype=np.int32) > 0
        del step
    n = np.diff(chunk.first)
    before = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(gone, dtype=np.int32)))
    removed = before[chunk.first[1:]] - before[chunk.first[:-1]]
    begins = gone & ~np.concatenate(([False], gone[:-1])) if len(gone) else gone
    begins[chunk.first[:-1][n > 0]] = gone[chunk.first[:-1][n > 0]]
    opened = np.concatenate((np.zeros(1, dtype=np.int32), np.cumsum(begins, dtype=np.int32)))
    spans = opened[chunk.first[1:]] - opened[chunk.first[:-1]]
    kept = []
    for i, text in enumerate(chunk.texts):
        lo, hi = chunk.first[i], chunk.first[i + 1]
        if words:
            w = text.split()
            kept.append(b" ".join(w if not removed[i] else [x for x, g in zip(w, gone[lo:hi].tolist(), strict=True) if not g]))
        else:
            kept.append(text if not removed[i] else chunk.units[lo:hi][~gone[lo:hi]].tobytes())
    cols = (chunk.docs, n, removed, spans, kept)
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, KEPT, strict=True)], schema=KEPT)


def _frame(docs: DataFrame, words: bool, length: int, k: int, route, matcher, chunks: int, buckets: int, together: int = 1, levels: np.ndarray | None = None) -> DataFrame:
    def texts() -> DataFrame:
        return docs.select(
            F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        )

    held = texts().groupBy("chunk").applyInArrow(lambda t: anchors(t, words, length, k, buckets, levels), "at int, chunk int, keys binary")
    shared = held.groupBy("at").applyInArrow(shared_keys, "at int, chunk int, keys binary").select(F.col("chunk").alias("to"), "keys")
    found = texts().groupBy("chunk").cogroup(shared.groupBy("to")).applyInArrow(
        lambda a, b: candidate_segments(a, b, words, length, k, route, together, levels),
        "group int, chunk int, parts binary, sizes binary, counts binary, contents binary, docs binary, places binary",
    )
    spans = found.groupBy("group").applyInArrow(lambda t: repeated_spans(t, words, length, matcher), "chunk int, starts binary, ends binary").withColumnRenamed("chunk", "to")
    left = texts().groupBy("chunk").cogroup(spans.groupBy("to")).applyInArrow(lambda a, b: remainder(a, b, words), "doc long, n_units long, n_removed long, n_spans long, kept binary")
    return left.select(F.nullif(F.col("doc"), F.lit(LAST)).alias("doc_id"), "n_units", "n_removed", "n_spans", "kept")


# ---- suffix automata of reference shards ----


def window_owners(contents: list[bytes], first_docs: np.ndarray, length: int) -> np.ndarray:
    """Smallest doc_id of every window by matching statistics against the suffix automaton of a shard.

    The shard holds each distinct content once; contents come in the order of their first document.
    States keep the smallest doc_id of all places where their strings end. A content is then streamed:
    after each word the state of the longest match is cut back to `length` words, where its document is read.
    """
    ids: dict[bytes, int] = {}
    sequences = [[ids.setdefault(w, len(ids)) for w in c.split(b" ")] for c in contents]
    nxt: list[dict[int, int]] = [{}]
    link, size, low = [-1], [0], [LAST + 1]
    for sequence, doc in zip(sequences, first_docs.tolist(), strict=True):
        last = 0
        for c in sequence:
            edges = nxt[last]
            q = edges.get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q
                if doc < low[q]:
                    low[q] = doc
                continue
            p = last
            if q is None:
                new = len(nxt)
                nxt.append({})
                size.append(size[last] + 1)
                low.append(doc)
                link.append(0)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p < 0:
                    last = new
                    continue
                q = nxt[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                    last = new
                    continue
            else:
                new = -1
            clone = len(nxt)
            nxt.append(nxt[q].copy())
            size.append(size[p] + 1)
            low.append(min(low[q], doc))
            link.append(link[q])
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            if new < 0:
                last = clone
            else:
                link[new] = clone
                last = new
    for state in np.argsort(-np.array(size), kind="stable").tolist():
        up = link[state]
        if up > 0 and low[state] < low[up]:
            low[up] = low[state]
    out = []
    for sequence in sequences:
        state = match = 0
        for c in sequence:
            while c not in nxt[state] and state:
                state = link[state]
                match = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                match += 1
            if match >= length:
                while size[link[state]] >= length:
                    state = link[state]
                match = length
                out.append(low[state])
    return np.array(out, dtype=np.int64)


def suffix_automata(docs: DataFrame, length: int = 50, k: int = 16) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept): words of windows that an earlier document holds are removed."""
    buckets = parts(docs.sparkSession)
    return _frame(docs, True, length, min(k, length), lambda keys, heads: bucket_of(keys, buckets), window_owners, buckets, parts(docs.sparkSession, 1))


# ---- range-partitioned suffixes ----


def multikey_order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their characters (one column each), and which rows of it begin a new string.

    Multikey: rows are sorted by one character, and only runs that are still equal go on to the next.
    A run of copies, whose neighbours agree in all characters to come, is done.
    """
    order = np.argsort(columns[0], kind="stable")
    head = columns[0][order]
    fresh = np.concatenate(([True], head[1:] != head[:-1]))
    for depth in range(1, len(columns)):
        run = np.cumsum(fresh) - 1
        inner = np.flatnonzero(~fresh)
        here, before = order[inner], order[inner - 1]
        differ = np.zeros(len(inner), dtype=bool)
        for column in columns[depth:]:
            differ |= column[here] != column[before]
        mixed = np.zeros(run[-1] + 1, dtype=bool)
        mixed[run[inner[differ]]] = True
        at = np.flatnonzero(mixed[run])
        if not len(at):
            break
        group, value = run[at], columns[depth][order[at]]
        sub = np.lexsort((value, group))
        order[at] = order[at][sub]
        value = value[sub]
        fresh[at[1:]] |= (value[1:] != value[:-1]) & (group[1:] == group[:-1])
    return order, fresh


def sorted_owners(contents: list[bytes], first_docs: np.ndarray, length: int) -> np.ndarray:
    """Smallest doc_id of every window: the suffixes of a range are sorted and equal neighbours share their documents."""
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    sizes = np.fromiter(map(len, contents), dtype=np.int64, count=len(contents))
    windows = sizes - length + 1
    first = np.cumsum(sizes) - sizes
    begin = np.cumsum(windows) - windows
    starts = np.repeat(first - begin, windows) + np.arange(windows.sum())
    doc = np.repeat(first_docs, windows)
    wide = -(-length // 8) * 8
    padded = np.concatenate((data, np.zeros(wide, dtype=np.uint8)))
    columns = []
    for at in range(0, wide, 8):
        value = np.zeros(len(starts), dtype=np.uint64)
        for j in range(at, at + 8):
            value <<= U64(8)
            if j < length:
                value |= padded[starts + j]
        columns.append(value)
    order, fresh = multikey_order(columns)
    edge = np.flatnonzero(fresh)
    low = np.empty(len(starts), dtype=np.int64)
    low[order] = np.repeat(np.minimum.reduceat(doc[order], edge), np.diff(np.append(edge, len(order))))
    return low


def splitters(docs: DataFrame, head: int, buckets: int, size: int) -> list[bytes]:
    """Range boundaries from the leading bytes of suffixes at equal steps of text; they steer the load, never the result.

    Bytes are counted, not characters: suffixes that begin inside a character have boundaries of their own.
    """
    step = max(1, size // max(20_000, 16 * buckets))
    body = docs.select(F.col("text").cast("binary").alias("s"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(step)) + 1).cast("int").alias("at"))
    last = F.octet_length("s") - head + 1
    spots = body.filter(F.col("at") <= last).select("s", F.explode(F.sequence(F.col("at"), last, F.lit(step))).alias("at"))
    heads = sorted(bytes(r.s) for r in spots.select(F.expr(f"substring(s, at, {head})").alias("s")).collect())
    return sorted({heads[i * len(heads) // buckets] for i in range(1, buckets)}) if heads else []


def gram_levels(docs: DataFrame, k: int, size: int, common: int = COMMON) -> np.ndarray | None:
    """Level of each class of k-grams of bytes, from 0 to 3 by the number of times that they occur; None if all are 0.

    The numbers come from a sample of documents. Levels order the grams of a window, which steers the load, never the result:
    a gram that is found all over the corpus is an anchor only where a window has no other.
    """
    if size <= common:
        return None
    share = min(1.0, SAMPLE / size)
    limit = max(common, 4 * size >> CLASS_BITS) * share

    def count(table: pa.Table) -> pa.Table:
        seen, texts = np.zeros(1 << CLASS_BITS, dtype=np.int64), as_bytes(table["text"])
        for lo, hi in text_groups(texts):
            seen += np.bincount(gram_class(gram_hashes(joined(texts[lo:hi])[0], k, BYTE_BASE)), minlength=1 << CLASS_BITS)
        there = np.flatnonzero(seen >= max(1.0, limit / COUNTERS / 2))  # less in every group is less in all
        return pa.table([pa.array(there, pa.int32()), pa.array(seen[there], pa.int64())], names=["gram", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.pmod(F.xxhash64("doc_id"), F.lit(COUNTERS)).alias("part"), F.col("text"))
    found = sample.groupBy("part").applyInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= limit).collect()
    if not found:
        return None
    levels = np.zeros(1 << CLASS_BITS, dtype=np.uint8)
    levels[[r.gram for r in found]] = [1 + (r.n >= STEEPER * limit) + (r.n >= STEEPER * STEEPER * limit) for r in found]
    return levels


def suffix_ranges(docs: DataFrame, length: int = 50, k: int = 16, common: int = COMMON) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept): bytes of windows that an earlier document holds are removed."""
    k = min(k, length)
    size = text_size(docs)
    bounds = np.array(splitters(docs, k, pieces(size, RANGE), size) or [b""], dtype=f"S{k}")

    def route(keys: np.ndarray, heads: list[bytes]) -> np.ndarray:
        return np.searchsorted(bounds, np.array(heads, dtype=f"S{k}"), side="right").astype(np.int32)

    return _frame(docs, False, length, k, route, sorted_owners, pieces(size, CHUNK), pieces(size, BUCKET), TOGETHER, gram_levels(docs, k, size, common))
