"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded labelled sample accepts every
substring of that sample. A text is cut greedily into phrases, each the longest match
from its start; the language whose sample needs the fewest phrases, normalised by the
text's length, describes the text best.

The automata are dense transition tables over a small alphabet, so that many texts are
parsed in step by array lookups. Texts are parsed whole: long ones in pieces of
`PIECE` characters whose phrases are added up.

The sample: per language one document from each of `slices` hash classes of doc_id,
`sample_chars` characters each. It bounds the broadcast tables whatever the corpus holds.

Null text, text without a letter, and any text when nothing was learned give `und` and
score 0. Ties go to the language that sorts first. Repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import by_value

by_value(__name__)

SLICES = 24
SAMPLE_CHARS = 1_000
PIECE = 2_048
ALPHABET = 64
UNKNOWN = "und"
LANES = 1 << 21


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def alphabet_of(samples: dict[str, list[str]]) -> np.ndarray:
    """Class of each code point below 2**16: 0 unknown, 1 anything but letters, 2.. the most frequent letters."""
    counts = np.zeros(1 << 16, dtype=np.int64)
    for texts in samples.values():
        for text in texts:
            codes = _codes(text)
            counts += np.bincount(codes[codes < len(counts)], minlength=len(counts))
    letter = np.fromiter((chr(i).isalpha() for i in range(len(counts))), dtype=bool, count=len(counts))
    classes = np.where(letter, 0, 1).astype(np.uint8)
    frequent = np.argsort(-np.where(letter, counts, 0), kind="stable")[: ALPHABET - 2]
    frequent = frequent[counts[frequent] > 0]
    classes[frequent] = np.arange(2, 2 + len(frequent))
    return classes


def _classes(text: str, table: np.ndarray) -> np.ndarray:
    """Letter classes with every run of other characters as one gap."""
    codes = _codes(text)
    out = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], 0).astype(np.uint8)
    return out[~((out == 1) & (np.concatenate(([0], out[:-1])) == 1))]


def suffix_automaton(sequences: list[np.ndarray]) -> np.ndarray:
    """Dense transitions [state, class] of the suffix automaton of the sequences; -1 where no substring goes on."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for sequence in sequences:
        last = 0
        for c in sequence.tolist():
            p, q = last, nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                new = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p < 0:
                    last = new
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                    last = new
                    continue
            else:
                new = None
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            if new is None:
                last = clone
            else:
                link[new] = clone
                last = new
    table = np.full((len(nxt), ALPHABET), -1, dtype=np.int32)
    for state, edges in enumerate(nxt):
        for c, target in edges.items():
            table[state, c] = target
    return table


def phrase_counts(texts: list[np.ndarray], automaton: np.ndarray) -> np.ndarray:
    """Number of greedy longest-match phrases of every text; a class that the sample lacks is a phrase of its own."""
    owner, pieces = [], []
    for i, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            owner.append(i)
            pieces.append(text[at : at + PIECE])
    total = np.zeros(len(texts), dtype=np.int64)
    if not pieces:
        return total
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    order = np.argsort(-size, kind="stable")
    sorted_size, longest = size[order], int(size.max())
    grid = np.zeros((longest, len(pieces)), dtype=np.uint8)
    for lane, k in enumerate(order.tolist()):
        grid[: size[k], lane] = pieces[k]
    flat = automaton.ravel()
    root = automaton[0]
    state = np.zeros(len(pieces), dtype=np.int64)
    count = np.zeros(len(pieces), dtype=np.int64)
    active = np.searchsorted(-sorted_size, -np.arange(longest), side="left")  # lanes longer than t
    for t in range(longest):
        n = int(active[t])
        c = grid[t, :n]
        s = state[:n]
        to = flat[s * ALPHABET + c]
        # A phrase begins at the root, and where the one before can't go on.
        failed = to < 0
        count[:n] += failed | (s == 0)
        state[:n] = np.where(failed, np.maximum(root[c], 0), to)
    np.add.at(total, np.asarray(owner)[order], count)
    return total


def labelled_sample(docs: DataFrame, train: Column, slices: int = SLICES, sample_chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Bounded sample: in every (language, hash class) the training document of the smallest hash with text."""
    lab = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & train)
    keyed = lab.select("lang", F.xxhash64("doc_id").alias("_h"), "text").withColumn("_c", F.pmod("_h", F.lit(slices)))
    pick = keyed.filter(F.length("text") > 0).groupBy("lang", "_c").agg(F.min("_h").alias("_h"))
    # Languages x classes rows: the bound of the sample.
    rows = keyed.join(F.broadcast(pick), ["lang", "_c", "_h"]).groupBy("lang", "_c").agg(F.min(F.substring("text", 1, sample_chars)).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r._c)):
        out.setdefault(row.lang, []).append(row.text)
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]], carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, lang_pred, score) for every row; `samples` are labelled texts by language."""
    spark = docs.sparkSession
    classes = alphabet_of(samples)
    names = sorted(samples)
    models = [suffix_automaton([_classes(t, classes) for t in samples[n]]) for n in names]
    shared = spark.sparkContext.broadcast((classes, names, models))
    body = docs.select("doc_id", "text", *carry)
    schema = body.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def judge(texts: list[str]) -> tuple[list[str], list[float]]:
        table, langs, automata = shared.value
        coded = [_classes(t, table) for t in texts]
        size = np.maximum(1, np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)))
        bad = [not langs or not (c != 1).any() or not any(map(str.isalpha, t)) for c, t in zip(coded, texts, strict=True)]
        if not langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        rate = np.stack([phrase_counts(coded, a) / size for a in automata])
        best = rate.argmin(axis=0)
        low = rate.min(axis=0)
        others = np.where(np.arange(len(langs))[:, None] == best, np.inf, rate).min(axis=0)
        # Share of phrases saved against the runner-up, squashed into 0.5 to 1.
        score = np.where(np.isfinite(others), np.clip(1 - 0.5 * low / np.where(np.isfinite(others), others, 1), 0, 1), 1.0)
        return [UNKNOWN if b else langs[i] for b, i in zip(bad, best.tolist(), strict=True)], np.where(bad, 0.0, score).tolist()

    def parse(batches):
        for batch in batches:
            kept, texts = [c for i, c in enumerate(batch.columns) if i != 1], [t or "" for t in batch.column(1).to_pylist()]
            lo = size = 0
            for i, text in enumerate([*texts, None]):
                if text is None or size and size + len(text) > LANES:
                    if i > lo:
                        langs, scores = judge(texts[lo:i])
                        yield pa.RecordBatch.from_arrays([*(c.slice(lo, i - lo) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)
                    lo, size = i, 0
                size += len(text or "")

    return body.mapInArrow(parse, schema)


def crc_class(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def predict(docs: DataFrame) -> DataFrame:
    """Learn from documents outside the held-out class and judge all: doc_id, held_out, lang_pred, score.

    A null doc_id is not held out.
    """
    held = F.coalesce(crc_class(4) == 2, F.lit(False))
    samples = labelled_sample(docs, ~held)
    return identify(docs, samples).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")
