"""Similarity join of shingle sets by parity sketches.

A set's sketch is a row of bits; every shingle flips the bit that its hash names. The Hamming distance of
two sketches is at most the size of the symmetric difference, and a Jaccard similarity of at least t bounds
that difference by D = (1 - t) / t * the smaller size. Cut into K > D pieces, the sketches of a linked
pair agree in at least K - D pieces: pieces are the join keys. Sizes fall into bands a factor 1 / t wide, so linked
sets are in the same band or neighbours; each set sends pieces for its own band and the next.

A third more than D + 1 pieces are cut, and a set sends D + 1 of them, in an order that is the same for all sets: pieces that
many shingles touch come first. If P of a set's pieces are touched, P - D of these or more agree with those of any linked set, so
its first D + 1 and the other's first D + 1 have one in common. What stays behind are the pieces that one or two
shingles touch, which a common line or phrase alone makes equal in many documents. A set with fewer than D + 1 touched pieces
sends them all, and its empty pieces as keys among such sets. No link is lost.

Documents with equal sets are one node, the set's hash. Candidates are then filtered by whole sketches (their distance
never exceeds the symmetric difference, so no linked pair is lost) and what is left is verified on the sets:

1. every node of a key group with the group's smallest node;
2. nodes that those pairs leave in other components than the smallest's, with all of their group, in blocks of
   bounded size, by short sketches: a block sends on a spanning forest of its components, never all pairs;
3. the same again on verified components without the pairs that failed, with `WIDEN` times as many pairs for each branch
   of the forest in every round, until no untested pair joins two components.

Links are exact: sets hold 64-bit hashes of whole shingles. Pairs inside a component are never compared, so a group
of thousands of near copies costs as many pairs as it has members, and those of its outliers.

Documents without a shingle link with nothing. Null text has none. A null doc_id links with nothing and has a null component. Rows with equal doc_id are one document if
their texts have equal sets; all are returned. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import U64, as_bytes, by_value, gram_hashes, hash_words, joined, lower_ascii, mix, parts, text_groups, written

by_value(__name__)

#: Bits of a piece. Sketches are kept as the places of their set bits, so wide pieces cost nothing, and
#: a piece that one shingle touches is then as telling as the shingle.
PIECE_BITS = 1 << 22
SHORT_BITS = 512
#: Sets above this size, which short sketches can't tell apart, carry as many bits as shingles.
LONG = SHORT_BITS
BLOCK_NODES = 1024
#: How many times more pairs for a branch of the forest every further round asks for.
WIDEN = 16


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text, and where each text's begin (one more entry than texts).

    A text of fewer words than `size` has its whole word sequence as its only shingle.
    """
    out, counts = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for lo, hi in text_groups(texts):
        raw, ends = joined(texts[lo:hi])
        starts, _, words = hash_words(lower_ascii(raw))
        row = np.searchsorted(ends, starts, side="right")
        n = len(words) - size + 1
        at = np.flatnonzero(row[:n] == row[size - 1 :]) if n > 0 else np.empty(0, dtype=np.int64)
        key, owner = gram_hashes(words, size)[at] if len(at) else np.empty(0, dtype=np.uint64), row[at]
        number = np.bincount(row, minlength=hi - lo)
        for i in np.flatnonzero((number > 0) & (number < size)).tolist():
            a = int(np.searchsorted(row, i))
            whole = gram_hashes(words[a : a + number[i]], int(number[i])) ^ mix(number[i : i + 1].astype(np.uint64))
            key, owner = np.append(key, whole), np.append(owner, i)
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        out.append(key[fresh])
        counts[lo + 1 : hi + 1] = np.bincount(owner[fresh], minlength=hi - lo)
    return (np.concatenate(out) if out else np.empty(0, dtype=np.uint64)), np.cumsum(counts)


def node_ids(keys: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """One hash per set: sums of its mixed members and its size."""
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(keys), dtype=np.uint64)))
    size = np.diff(edge).astype(np.uint64)
    return mix((total[edge[1:]] - total[edge[:-1]]) ^ (size * U64(0x9FB21C651E98DF25))).view(np.int64)


def band_of(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Band of a size: band b holds sizes from (den/num)**b up; a linked larger set is in the same band or the next."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(den / num) + 1e-9).astype(np.int64)


def band_pieces(band: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a band, and how many a set sends: one more than the largest symmetric difference of linked sets of which the larger is in it."""
    largest = np.floor((den / num) ** (band + 1.0) + 1e-6)
    # |A xor B| = |union| - |intersection| <= (1 - t) |union|, |union| <= smaller / t, smaller <= larger.
    difference = np.floor((den - num) * largest / num + 1e-6).astype(np.int64)
    return difference + 1 + (difference + 3) // 3, difference + 1


def piece_keys(keys: np.ndarray, edge: np.ndarray, shift: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(join key, set number) for the pieces that every set's sketch sends in its own band plus `shift`."""
    size = np.diff(edge)
    owner = np.repeat(np.arange(len(size)), size)
    band = band_of(size, num, den) + shift
    pieces, sent = band_pieces(band, num, den)
    bits = (pieces * PIECE_BITS).astype(np.uint64)
    place = mix(keys ^ mix(band.astype(np.uint64))[owner]) % bits[owner]
    # Places of large sets take more than 40 bits, so owners are kept beside them.
    order = np.lexsort((place, owner))
    who, place = owner[order], place[order]
    # Bits flipped an odd number of times are set.
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (who[1:] != who[:-1])))) if len(place) else np.empty(0, dtype=np.int64)
    odd = np.diff(np.append(first, len(place))) % 2 == 1
    who, place = who[first[odd]], place[first[odd]]
    cell = (who.astype(np.uint64) << U64(32)) | (place // U64(PIECE_BITS))
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, dtype=np.int64)
    sums = np.add.reduceat(mix(place), starts) if len(starts) else np.empty(0, dtype=np.uint64)
    who, piece = who[starts], cell[starts] & U64(0xFFFFFFFF)
    key = mix(sums ^ mix(piece * U64(0xC2B2AE3D27D4EB4F) + band.astype(np.uint64)[who]))
    # The order of pieces: by the places in them, most first, then by key. Both are the piece's own, so all sets agree on it.
    order = np.lexsort((key, -np.diff(np.append(starts, len(cell))), who))
    touched = np.bincount(who, minlength=len(size))
    before = np.concatenate(([0], np.cumsum(touched)[:-1])) if len(size) else np.empty(0, dtype=np.int64)
    first = order[np.arange(len(order)) - before[who[order]] < sent[who[order]]]
    # Sets with fewer touched pieces than are sent meet in their empty pieces as well.
    more_key, more_who = [], []
    for i in np.flatnonzero((size > 0) & (touched < sent)).tolist():
        none = np.setdiff1d(np.arange(pieces[i]), piece[who == i].astype(np.int64)).astype(np.uint64)
        more_key.append(mix(mix(none + U64(1) + (U64(int(band[i])) << U64(32))) ^ U64(0x0E3F)))
        more_who.append(np.full(len(none), i))
    return np.concatenate([key[first], *more_key]), np.concatenate([who[first], *more_who])


# ---- connected components ----


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp): smallest node of each node's component, for edges (a, b) of longs.

    Every node takes the smallest label around it, then the label of its label, until nothing changes;
    each round is an aggregate and two joins, cut off by a written table.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        around = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("_l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_l").alias("_m"))
        near = labels.join(around, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_m").alias("comp"))
        jump = near.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        new = written(near.join(jump, "comp", "left").select("node", "_old", F.least("comp", F.coalesce("_up", "comp")).alias("comp")), f"{name}-{step}")
        changed = new.filter("comp <> _old").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


# ---- the join ----


def sketches(keys: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """Parity sketch of every set: twice as many bits as shingles or more, a power of two, so that it folds to any smaller one."""
    size = np.diff(edge)
    bits = np.maximum(SHORT_BITS, 2 ** np.ceil(np.log2(2 * np.maximum(size, 1))).astype(np.int64))
    place = mix(keys ^ U64(0x0DD5E75EED))
    out = []
    for a, b, n in zip(edge[:-1].tolist(), edge[1:].tolist(), bits.tolist(), strict=True):
        odd = np.bincount((place[a:b] & U64(n - 1)).astype(np.int64), minlength=n) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def fold(sketch: bytes, bits: int) -> int:
    """The sketch of the same set with fewer bits."""
    value, size = int.from_bytes(sketch, "little"), 8 * len(sketch)
    while size > bits:
        size //= 2
        value = (value >> size) ^ (value & ((1 << size) - 1))
    return value


def may_link(na: int, nb: int, sa: bytes, sb: bytes, num: int, den: int) -> bool:
    """False only if sizes or sketches rule out den * intersection >= num * union."""
    if den * min(na, nb) < num * max(na, nb):
        return False
    bits = 8 * min(len(sa), len(sb))
    return (fold(sa, bits) ^ fold(sb, bits)).bit_count() * (den + num) <= (den - num) * (na + nb)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def linked(a: int, b: int, inter: int, num: int, den: int) -> bool:
    """den * intersection >= num * union."""
    return den * inter >= num * (a + b - inter)


def group_pairs(table: pa.Table, num: int, den: int, width: int) -> pa.Table:
    """Pairs that join the components in the cells of key groups: of those that neither sketches nor an earlier test rule out
    as many as a spanning forest has, `width` for each of its branches.
    """
    cell, side, node = (table[c].to_numpy() for c in ("cell", "side", "node"))
    order = np.lexsort((node, side, cell))
    cell, side, node = cell[order], side[order], node[order]
    comp, n = (table[c].to_numpy()[order] for c in ("comp", "n"))
    short = np.frombuffer(b"".join(table["short"].to_pylist()), dtype=np.uint64).reshape(-1, SHORT_BITS // 64)[order]
    wide = table["wide"].take(pa.array(order)).to_pylist()
    # Lists of tested nodes stay one flat array: as Python numbers they would take several times the room.
    lists = table["tested"].cast(pa.list_(pa.int64())).combine_chunks()
    held, bound = lists.values.to_numpy(), lists.offsets.to_numpy()
    edge = np.concatenate((np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), [len(cell)]))
    found: set[tuple[int, int]] = set()
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        # Components that an earlier cell of this task has joined count as one.
        label = np.fromiter(map(root, comp[lo:hi].tolist()), dtype=np.int64, count=hi - lo)
        # Side 0 is apart from the smallest node's component and in both blocks, 1 in the first only, 2 in the second.
        left, right = np.arange(int((side[lo:hi] < 2).sum())), np.flatnonzero(side[lo:hi] != 1)
        step = max(1, (1 << 18) // max(1, len(right)))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            a, b = n[lo + part][:, None], n[lo + right][None, :]
            far = np.bitwise_count(short[lo + part][:, None, :] ^ short[lo + right][None, :, :]).sum(axis=2, dtype=np.int64)
            ok = (far * (den + num) <= (den - num) * (a + b)) & (label[part][:, None] != label[right][None, :])
            ok &= (den * a >= num * b) & (den * b >= num * a)
            for i in np.flatnonzero(ok.any(axis=1)).tolist():
                p, near = int(part[i]), right[ok[i]]
                tested = held[bound[order[lo + p]] : bound[order[lo + p] + 1]]
                if len(tested):
                    near = near[~np.isin(node[lo + near], tested)]
                branch, taken = label[near], 0
                while len(near):
                    q, other = int(near[0]), int(branch[0])
                    near, branch = near[1:], branch[1:]
                    if other == label[p] and not taken:
                        continue
                    x, y = lo + p, lo + q
                    if wide[x] and wide[y] and not may_link(int(n[x]), int(n[y]), wide[x], wide[y], num, den):
                        continue
                    found.add((int(min(node[x], node[y])), int(max(node[x], node[y]))))
                    taken += 1
                    small, large = sorted((int(label[p]), int(label[q])))
                    if small != large:
                        up[large] = small
                        label[label == large] = small
                    if taken == width:
                        keep = (branch != other) & (label[near] != label[p])
                        near, branch, taken = near[keep], branch[keep], 0
    return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def join(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, for links of Jaccard similarity >= num / den."""
    spark = docs.sparkSession
    buckets = parts(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def shingled(batches):
        """(sets, edges, doc_ids) of a few megabytes of texts at a time."""
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in text_groups(texts, 4 << 20):
                yield *shingle_sets(texts[lo:hi], size), batch.column(0).slice(lo, hi - lo)

    def describe(batches):
        for keys, edge, doc in shingled(batches):
            cols = [doc, pa.array(node_ids(keys, edge)), pa.array(np.diff(edge)), pa.array(sketches(keys, edge), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "n_shingles", "sketch"])

    def pieces(batches):
        for keys, edge, _ in shingled(batches):
            node, first = np.unique(node_ids(keys, edge), return_index=True)
            spot = np.full(len(edge) - 1, -1)
            spot[first] = np.arange(len(first))
            both = [piece_keys(keys, edge, shift, num, den) for shift in (0, 1)]
            key, who = (np.concatenate(x) for x in zip(*both, strict=True))
            # The same set twice goes out once.
            key, who = key[spot[who] >= 0], spot[who[spot[who] >= 0]]
            order = np.argsort(key, kind="stable")
            key, who = key[order], who[order]
            at = (((key >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int32)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)])).tolist() if len(at) else [0]
            rows = ([], [], [], [])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                there, local = np.unique(who[lo:hi], return_inverse=True)
                for column, value in zip(rows, (int(at[lo]), key[lo:hi].tobytes(), local.astype(np.uint32).tobytes(), node[there].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["at", "keys", "local", "nodes"])

    def groups(table: pa.Table) -> pa.Table:
        """Members of every key that two nodes hold, with the group's smallest node and its size."""
        key = np.concatenate([_unpack(b) for b in table["keys"].to_pylist()])
        node = np.concatenate([np.frombuffer(n, dtype=np.int64)[np.frombuffer(w, dtype=np.uint32)] for n, w in zip(table["nodes"].to_pylist(), table["local"].to_pylist(), strict=True)])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(start, len(key)))
        lead, m = np.repeat(node[start], count), np.repeat(count, count)
        some = m > 1
        return pa.table([key[some].view(np.int64), node[some], lead[some], m[some]], names=["g", "node", "lead", "m"])

    ids = written(text.mapInArrow(describe, "doc_id long, node long, n_shingles long, sketch binary"), "nodes")
    text = text.filter("doc_id IS NOT NULL")
    member = text.mapInArrow(pieces, "at int, keys binary, local binary, nodes binary").groupBy("at").applyInArrow(groups, "g long, node long, lead long, m long")
    member = written(member, "members")
    known = written(ids.filter("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min("sketch").alias("sketch")), "known")

    def sifted(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and whole sketches allow a link."""
        one = known.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        two = known.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

        def check(batches):
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)
                keep = pa.array([may_link(*r, num, den) for r in rows], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

        near = pairs.join(one, "a").join(two, "b").filter((den * F.col("na") >= num * F.col("nb")) & (den * F.col("nb") >= num * F.col("na")))
        return near.mapInArrow(check, "a long, b long")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs, on the sets of one document of each node."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # Written first, so that Spark knows how few they are: for a handful the texts stay where they are.
        wanted = written(known.join(nodes, "node", "left_semi").select("doc_id", F.col("node").alias("rep")), f"{name}-wanted")

        def members(batches):
            for keys, edge, doc in shingled(batches):
                data = [keys[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([doc, pa.array(node_ids(keys, edge)), pa.array(data, pa.binary())], names=["doc_id", "node", "set"])

        bodies = text.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
        # Rows that share a doc_id may have other sets, or the same twice.
        sets = bodies.mapInArrow(members, "doc_id long, node long, set binary").join(wanted.withColumnRenamed("rep", "node"), ["doc_id", "node"], "left_semi")
        sets = written(sets.dropDuplicates(["node"]).select("node", "set"), f"{name}-sets")
        one, two = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))

        def test(batches):
            for batch in batches:
                keep = []
                for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    a, b = _unpack(a), _unpack(b)
                    keep.append(linked(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), num, den))
                ok = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

        return written(pairs.join(one, "a").join(two, "b").mapInArrow(test, "a long, b long"), name)

    # Groups of the same members, as near copies make them by the dozen, are one.
    crowd = member.filter("m > 2")
    alike = crowd.groupBy("g").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("_x"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(20,0)")).alias("_y"), F.count("*").alias("_m"))
    crowd = written(crowd.join(alike.groupBy("_x", "_y", "_m").agg(F.min("g").alias("g")).select("g"), "g", "left_semi"), "crowd")

    def others(labels: DataFrame, tested: DataFrame | None = None, width: int = 1) -> DataFrame:
        """Untested pairs that join components of `labels` in key groups of three or more, `width` for each branch of a spanning forest."""
        lone = F.coalesce("comp", "node")
        comp = labels.select(F.col("node").alias("lead"), F.col("comp").alias("_lead"))
        rows = crowd.join(labels, "node", "left").join(comp, "lead", "left")
        rows = rows.select("g", "node", "m", lone.alias("comp"), (lone != F.coalesce("_lead", "lead")).alias("apart"))
        split = rows.groupBy("g").agg(F.max("apart").alias("_s")).filter("_s").select("g")
        body = known.select("node", "n", "sketch")
        if tested is None:
            body = body.withColumn("tested", F.lit(None).cast("array<long>"))
        else:
            both = tested.select(F.col("a").alias("node"), "b").union(tested.select(F.col("b").alias("node"), F.col("a").alias("b")))
            body = body.join(both.groupBy("node").agg(F.collect_set("b").alias("tested")), "node", "left")
        rows = rows.join(split, "g", "left_semi").join(body, "node")
        blocks = F.ceil(F.col("m") / BLOCK_NODES).cast("int")
        place = F.pmod(F.xxhash64("node"), blocks).cast("int")
        every = F.sequence(F.lit(0), blocks - 1)
        # A cell (i, j) holds the nodes apart in block i and all nodes in block j.
        rows = rows.withColumn("_p", place)
        left = rows.filter("apart").withColumn("i", F.col("_p")).withColumn("j", F.explode(every)).withColumn("side", F.when(F.col("i") == F.col("j"), 0).otherwise(1))
        right = rows.withColumn("j", F.col("_p")).withColumn("i", F.explode(every)).withColumn("side", F.lit(2)).filter(~(F.col("apart") & (F.col("i") == F.col("j"))))
        cells = left.unionByName(right).withColumn("cell", F.xxhash64("g", "i", "j"))

        def shorten(batches):
            for batch in batches:
                whole = batch.column("sketch").to_pylist()
                short = [fold(s, SHORT_BITS).to_bytes(SHORT_BITS // 8, "little") for s in whole]
                wide = [fold(s, 4 * len(s)).to_bytes(len(s) // 2, "little") if n > LONG else b"" for s, n in zip(whole, batch.column("n").to_pylist(), strict=True)]
                cols = [*(batch.column(c) for c in ("cell", "side", "node", "comp", "n")), pa.array(short, pa.binary()), pa.array(wide, pa.binary()), batch.column("tested")]
                yield pa.RecordBatch.from_arrays(cols, names=["cell", "side", "node", "comp", "n", "short", "wide", "tested"])

        schema = "cell long, side int, node long, comp long, n long, short binary, wide binary, tested array<long>"
        cells = cells.select("cell", "side", "node", "comp", "n", "sketch", "tested").mapInArrow(shorten, schema)
        dealt = cells.withColumn("at", F.pmod("cell", F.lit(8 * buckets)).cast("int")).groupBy("at")
        return dealt.applyInArrow(lambda t: group_pairs(t, num, den, width), "a long, b long").distinct()

    stars = written(sifted(member.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()), "stars")
    more = written(others(components(stars, "near")), "more")
    links = verified(stars.union(sifted(more)), "links")
    refused = written(stars.union(more).distinct().join(links, ["a", "b"], "left_anti"), "refused")
    # Where a pair taken for a link was none, its components may have hidden others: untested pairs of what is linked so far
    # are asked for until there are none, `WIDEN` times as many each time.
    width = WIDEN
    while refused.limit(1).count():
        more = written(others(components(links, "first"), refused, width), "rest")
        if not more.limit(1).count():
            break
        late = verified(sifted(more), "late")
        links = links.union(late)
        refused = refused.union(written(more.join(late, ["a", "b"], "left_anti"), "refused"))
        width *= WIDEN
    final = components(links, "last")

    # Copies are one node; the smallest doc_id of a component over all documents of its nodes.
    labelled = ids.drop("sketch").join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = labelled.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("_low"))
    out = labelled.join(low, "comp", "left")
    return out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_low")).otherwise(F.col("doc_id")).alias("component_id"))
