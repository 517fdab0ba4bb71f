"""What a written table leaves behind."""

import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import collected, edited, prose
from test_documents import swept

from factorlab.llm import language, lm
from factorlab.llm.common import WRITING, shared_folder, written


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    found = env.blockManager().diskBlockManager().getAllFiles().iterator()
    out = set()
    while found.hasNext():
        name = found.next().getName()
        if name.startswith("shuffle_"):
            out.add(name)
    return out


def test_written_frees_its_shuffle_files_and_keeps_settings(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, held = shuffle_files(spark), {k: spark.conf.get(k, None) for k in WRITING}
    spark.conf.set(key, "1m")
    try:
        kept = written(spark.range(50_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "freed")
        assert spark.conf.get(key) == "1m"
    finally:
        if held[key] is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, held[key])
    assert {k: spark.conf.get(k, None) for k in WRITING} == held
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert sorted(r["count"] for r in kept.collect()) == sorted([7143] * 6 + [7142])


def test_language_model_keeps_the_averaged_states_alone_and_agrees_with_a_replay(spark, documents):
    rows = [(i, edited(prose(200, i % 5), 9, i)) for i in range(40)] + [(50, None), (51, "unseen words only")]
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    folder = Path(shared_folder(spark).removeprefix("file:")) / "corpus" / spark.sparkContext.applicationId
    before = set(folder.glob("*"))
    got = {r.doc_id: r.score for r in lm.score(documents(rows), language.crc_class(7) == 2, sweeps=1).collect()}
    left = [p.name for p in set(folder.glob("*")) - before]
    assert sum(x.startswith("parents-") for x in left) == lm.KEEP
    assert not any(x.startswith("corpus_owned") for x in left)

    tok = lm.Tokens(pa.table({"doc": [d for d, _ in rows], "held": [d in held for d, _ in rows], "text": [t or "" for _, t in rows]}))
    states, _ = swept(tok, 1 + lm.KEEP)
    p = lm.predictions(tok, tok.pair_count, tok.count, states, lm.KEEP)
    want = np.bincount(tok.row, weights=np.log10(p)[tok.pair])
    assert held and np.allclose([got[d] for d in tok.docs.tolist()], want, rtol=1e-9)


def test_owners_tell_tables_in_one_row_a_chunk_and_bucket():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**64, 900, dtype=np.uint64) & ~np.uint64(255))
    tables = [rng.integers(1, 9, len(keys)) for _ in range(lm.KEEP)]
    owner, buckets = np.arange(len(keys)) % 3, 4
    sent = pa.concat_tables([lm.ask_buckets(c, keys[owner == (c + 1) % 3], keys[owner == c], [t[owner == c] for t in tables], buckets) for c in range(3)])
    assert sent.num_rows <= 3 * buckets
    got = {c: [] for c in range(3)}
    for at in range(buckets):
        for row in lm.tell_tables(sent.filter(pa.array([x == at for x in sent["at"].to_pylist()]))).to_pylist():
            got[row["chunk"]].append(lm._parted(row["a"], lm.KEEP))
    for c, parts in got.items():
        assert (np.concatenate(parts, axis=1) == np.stack(tables)[:, owner == (c + 1) % 3]).all()


@pytest.mark.parametrize("partitions", ["2", "300"])
def test_what_a_task_of_the_language_model_holds_follows_the_bytes_of_texts(spark, documents, monkeypatch, partitions):
    """Not the session's partitions, which need not grow with the input; scores are the same in any number of chunks."""
    rows = [(i, prose(60, i)) for i in range(60)]
    df, size = documents(rows), sum(len(t.encode()) for _, t in rows)
    want = collected(lm.score(df, F.col("doc_id") % 7 == 2, sweeps=2), "doc_id", "score")
    seen = []

    def chunked(docs, held_out, chunks, real=lm.chunked):
        seen.append(chunks)
        return real(docs, held_out, chunks)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(lm, "chunked", chunked)
    monkeypatch.setattr(lm, "CHUNK", 1000)
    monkeypatch.setattr(lm, "BUCKET", 1000)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = collected(lm.score(df, F.col("doc_id") % 7 == 2, sweeps=2), "doc_id", "score")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [-(-size // 1000)] and 16 < seen[0] < 32
    assert got == want
