"""Prefix trie of conversations with totals of every subtree, by depth-band rollup.

1. Turns are put in order over range partitions. Every prefix of a conversation gets a 127-bit key,
   a running polynomial in the digests of its turns; runs combine, so keys cross partitions by carries.
2. A node is a (depth, key); its name is its smallest member, which is unique within a depth.
3. Depths are cut into bands of `height`. A node hands its values only to its ancestors within its band.
   The band roots, with the totals of their bands, form a tree that is `height` times less deep and is
   rolled up in the same way; the completed totals of a band's lowest nodes, roots of the next band, then
   go up their own band. Rounds grow with the logarithm of the depth, and a node is copied `height` times
   at most in each.

Turns are ordered by turn (null first), then by digest of role and text. Null role and text are empty;
repeated rows are repeated turns. Rows without a conv_id belong to no conversation and take no part.
Without conversations there is no root. Other columns are never read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorlab.llm.common import by_value, parts, written
from factorlab.llm.ordered import partition_number, ranged

by_value(__name__)

HEIGHT = 32
#: Shared turns come from the first conversation of each hundred, at most `HEADS` - 1 of them.
FAMILY, HEADS = 100, 6
PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D1B54A32D192ED03A8F5C3B1
#: A list of members holds the ids that share all but these low bits.
LOW_BITS = 12


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, t, key, chars): place of every turn from 1 and the key of the conversation up to it."""
    digest = F.concat(F.length("r").cast("string"), F.lit(":"), "r", "x")
    clean = (
        turns.filter(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x"))
        .select("conv_id", "turn", F.md5(digest).alias("digest"), F.length("x").cast("long").alias("chars"))
    )
    schema = pa.schema([("conv_id", pa.int64()), ("_part", pa.int32()), ("t", pa.int64()), ("key", pa.binary()), ("chars", pa.int64())])

    def walk(batches):
        part, known, t, key = partition_number(), None, 0, 0
        for batch in batches:
            ts, keys = [], []
            for conv, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv != known:
                    known, t, key = conv, 0, 0
                t, key = t + 1, (key * BASE + int(digest, 16) + 1) % PRIME
                ts.append(t)
                keys.append(_bytes(key))
            numbers = pa.array([part] * batch.num_rows, type=pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), numbers, pa.array(ts, type=pa.int64()), pa.array(keys, type=pa.binary()), batch.column(2)], schema=schema)

    rows = ranged(clean, "conv_id", "turn", "digest").select("conv_id", "digest", "chars")
    walked = written(rows.mapInArrow(walk, "conv_id long, _part int, t long, key binary, chars long"), "turns")
    # The last row of a conversation in a partition; only conversations over several partitions have more than one.
    last = walked.groupBy("conv_id", "_part").agg(F.max("t").alias("n"), F.max_by("key", "t").alias("k"))
    several = last.withColumn("_n", F.count("*").over(Window.partitionBy("conv_id"))).filter("_n > 1").drop("_n")

    def combine(runs: pa.Table) -> pa.Table:
        """What a conversation has before each of its partitions; no more rows than there are partitions."""
        out, n, k = [], 0, 0
        for run in runs.sort_by("_part").to_pylist():
            out.append((run["conv_id"], run["_part"], n, _bytes(k)))
            n, k = n + run["n"], (k * pow(BASE, run["n"], PRIME) + int.from_bytes(run["k"])) % PRIME
        names = ["_key", "_carried", "_t", "_k"]
        return pa.table([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=names)

    # A partition that continues a conversation does so with its first: at most one row each.
    before = several.groupBy("conv_id").applyInArrow(combine, "_key long, _carried int, _t long, _k binary").filter("_t > 0")

    def carry(batches):
        for batch in batches:
            ts, keys = [], []
            for t, key, n, k in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5)), strict=True):
                if n:
                    key = _bytes((int.from_bytes(k) * pow(BASE, t, PRIME) + int.from_bytes(key)) % PRIME)
                ts.append(t + (n or 0))
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ts, type=pa.int64()), pa.array(keys, type=pa.binary()), batch.column(3)], names=["conv_id", "t", "key", "chars"])

    full = walked.join(F.broadcast(before), (F.col("conv_id") == F.col("_key")) & (F.col("_part") == F.col("_carried")), "left")
    return full.select("conv_id", "t", "key", "chars", "_t", "_k").mapInArrow(carry, "conv_id long, t long, key binary, chars long")


def rebuilt(turns: DataFrame, shared: Column, first: Column) -> DataFrame:
    """(conv_id, depth, key, chars, size) of every prefix, the empty one included, of every rebuilt conversation.

    `first` is the conversation whose first `shared` turns (fewer than `HEADS`) replace one's own first `shared`.
    """
    own = written(numbered(turns), "numbered")
    heads = (
        own.groupBy("conv_id")
        .agg(F.max("t").alias("size"), F.array_sort(F.collect_list(F.when(F.col("t") < HEADS, F.struct("t", "key", "chars")))).alias("head"))
        .withColumn("h", shared.cast("long"))
        .withColumn("first", first)
    )
    # One row per conversation; at most `FAMILY` of them ask for one head.
    lead = heads.select(F.col("conv_id").alias("first"), F.slice("head", 1, HEADS - 1).alias("lead"))
    heads = heads.join(lead, "first", "left").withColumn("lead", F.slice(F.coalesce("lead", F.array().cast("array<struct<t: bigint, key: binary, chars: bigint>>")), F.lit(1), F.col("h").cast("int")))
    heads = heads.withColumn("m", F.size("lead").cast("long")).withColumn("own_h", F.when(F.col("h") > 0, F.element_at("head", F.least(F.col("h"), F.size("head")).cast("int"))["key"]))
    heads = heads.withColumn("lead_key", F.when(F.col("m") > 0, F.element_at("lead", -1)["key"])).withColumn("length", F.col("m") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    heads = written(heads.select("conv_id", "h", "m", "lead", "lead_key", "own_h", "length"), "heads")
    root = F.struct(F.lit(0).cast("long").alias("t"), F.lit(bytes(16)).alias("key"), F.lit(0).cast("long").alias("chars"))
    shared_rows = heads.select("conv_id", F.inline(F.concat(F.array(root), "lead")), "length").withColumnRenamed("t", "depth")

    def shift(batches):
        for batch in batches:
            keys = []
            for key, own_h, lead_key, tail in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                swap = int.from_bytes(lead_key or b"") - int.from_bytes(own_h or b"")
                keys.append(_bytes((swap * pow(BASE, tail, PRIME) + int.from_bytes(key)) % PRIME))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, type=pa.binary()), batch.column(6), batch.column(7)], names=["conv_id", "depth", "key", "chars", "length"])

    # One row of heads per conversation: adaptive execution splits a long conversation's side of this join.
    after = own.join(heads, "conv_id").filter(F.col("t") > F.col("h"))
    after = after.select("conv_id", (F.col("m") + F.col("t") - F.col("h")).alias("depth"), "key", "own_h", "lead_key", (F.col("t") - F.col("h")).alias("tail"), "chars", "length")
    own_rows = after.mapInArrow(shift, "conv_id long, depth long, key binary, chars long, length long")
    return shared_rows.select("conv_id", "depth", "key", "chars", "length").unionByName(own_rows)


def _upward(paths: DataFrame, height: int) -> DataFrame:
    """(node, depth, above): for every node below depth 0 the (depth, node) of its ancestors in its band, from the band's root down.

    `paths` has (conv_id, depth, node), node being the smallest member of conv_id's node at that depth.
    """
    low = F.floor((F.greatest(F.col("depth"), F.lit(1)) - 1) / height)
    # A band root closes the band above and opens its own.
    band = F.when((F.col("depth") % height == 0) & (F.col("depth") > 0), F.array(low, low + 1)).otherwise(F.array(low))
    dealt = paths.withColumn("band", F.explode(band))
    # height + 1 rows a group at most.
    groups = dealt.groupBy("conv_id", "band").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("p"))
    own = F.filter("p", lambda x: (x["node"] == F.col("conv_id")) & (x["depth"] > F.col("band") * height))
    return groups.select("p", F.explode(own).alias("x")).select(
        F.col("x.node").alias("node"), F.col("x.depth").alias("depth"), F.filter("p", lambda y: y["depth"] < F.col("x.depth")).alias("above")
    )


def rollup(paths: DataFrame, values: DataFrame, columns: list[str], deepest: int, height: int = HEIGHT) -> DataFrame:
    """(node, depth, columns): sums of `columns` over every node's subtree, itself included."""
    if height < 2:
        raise ValueError("a band holds two depths at least")
    up = written(_upward(paths, height), "upward")
    sums = [F.sum(c).alias(c) for c in columns]
    keyed = up.join(values, ["node", "depth"])

    def spread(rows: DataFrame) -> DataFrame:
        each = rows.select(F.explode("above").alias("a"), *columns)
        return each.select(F.col("a.node").alias("node"), F.col("a.depth").alias("depth"), *columns).groupBy("node", "depth").agg(*sums)

    own = values.select("node", "depth", *columns)
    if deepest <= height:
        return own.unionByName(spread(keyed)).groupBy("node", "depth").agg(*sums)
    inner = F.col("depth") % height != 0
    within = written(own.unionByName(spread(keyed.filter(inner))).groupBy("node", "depth").agg(*sums), "bands")
    roots = within.filter(~inner).withColumn("depth", (F.col("depth") / height).cast("long"))
    over = paths.filter(~inner).withColumn("depth", (F.col("depth") / height).cast("long"))
    complete = rollup(over, roots, columns, deepest // height, height).withColumn("depth", F.col("depth") * height)
    complete = written(complete, "roots")
    lowest = up.filter(~inner).join(complete, ["node", "depth"])
    # What the roots below a band's nodes bring; a band's own root has it in its completed total already.
    added = spread(lowest).filter(inner)
    return within.filter(inner).unionByName(added).groupBy("node", "depth").agg(*sums).unionByName(complete.select("node", "depth", *columns))


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) from (node, depth, conv_id).

    Ids that share their upper bits are joined first; a digest is a chain, so the joined lists of one node
    stream through one task, of which they are a fraction in rows.
    """
    block = F.shiftright("conv_id", LOW_BITS)
    lists = ends.groupBy("node", "depth", block.alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def chain(batches):
        known, sha = None, None
        for batch in batches:
            out = ([], [], [])
            for node, depth, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, depth) == known:
                    sha.update(b",")
                else:
                    if known:
                        _put(out, known, sha)
                    known, sha = (node, depth), hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
        if known:
            out = ([], [], [])
            _put(out, known, sha)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    order = lists.repartition(parts(ends.sparkSession, 1), "node", "depth").sortWithinPartitions("node", "depth", "b")
    return order.select("node", "depth", "ids").mapInArrow(chain, "node long, depth long, ends_sha256 string")


def _put(out: tuple, known: tuple, sha) -> None:
    for column, value in zip(out, (*known, sha.hexdigest()), strict=True):
        column.append(value)


def trie(prefixes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of the trie of `prefixes` (conv_id, depth, key, chars, length), named by (conv_id, depth)."""
    rows = written(prefixes, "prefixes")
    named = rows.groupBy("depth", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    named = written(named, "nodes")
    # Frequent prefixes (the root above all) have one row on the right: adaptive execution splits their rows on the left.
    paths = written(rows.join(named.select("depth", "key", "node"), ["depth", "key"]).select("conv_id", "depth", "node", "length"), "paths")
    deepest = rows.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first().d
    # A conversation names a node from some depth on; its parent's name stands one step before it on the same path.
    step = F.inline(F.array(F.struct(F.col("depth").alias("d"), F.col("node").alias("is"), F.lit(None).cast("long").alias("over")), F.struct((F.col("depth") + 1).alias("d"), F.lit(None).cast("long").alias("is"), F.col("node").alias("over"))))
    steps = paths.select("conv_id", step).groupBy("conv_id", "d").agg(F.max("is").alias("is"), F.max("over").alias("over"))
    parents = written(steps.filter(F.col("is") == F.col("conv_id")).select(F.col("conv_id").alias("node"), F.col("d").alias("depth"), F.col("over").alias("parent")), "parents")
    children = parents.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    none = F.lit(0).cast("long")
    facts = named.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", none))
    facts = written(facts.select("node", "depth", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "facts")
    totals = rollup(paths.select("conv_id", "depth", "node"), facts.select("node", "depth", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], deepest, height)
    ends = _ends_digest(paths.filter(F.col("depth") == F.col("length")).select("node", "depth", "conv_id"))
    out = facts.drop("n_leaves", "saved_tokens").join(parents, ["node", "depth"]).join(totals, ["node", "depth"]).join(ends, ["node", "depth"], "left")
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def family_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of conversations that take their first crc32(conv_id) mod `HEADS` turns from the first of their hundred."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    return trie(rebuilt(conversations, shared, F.col("conv_id") - F.col("conv_id") % FAMILY), height)
