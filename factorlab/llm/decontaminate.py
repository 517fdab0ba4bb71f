"""Benchmark decontamination by template canonicalisation.

Texts become typed templates: numbers, names and units are replaced by placeholders, other tokens
are lower-cased. Windows of template tokens are hashed and looked up among the benchmark's; the
values in the slots must then map one to one from the item to the document along a match, so that
a question asked again with other numbers is found, and a chance agreement of templates is not.

Tokens are runs of digits or runs of other letters (any byte from 0x80 counts as a letter); everything
else separates. A name is a capitalised token that does not begin a sentence.

The benchmark side is broadcast in shards of at most `shard_windows` windows, one pass over the
documents each; a benchmark within one shard takes one pass. Documents are read whole.

A document is contaminated by an item if the matches whose slots are consistent along their alignment
cover at least `share` of the item's tokens. Items of fewer tokens than a window are matched as one window of their own
length, at least `least` tokens; windows with fewer than `informative` plain tokens are not looked up.
Null or empty texts on either side match nothing. Every row gives one row; repeated rows are judged alike.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import BYTE_BASE, U64, as_bytes, by_value, gram_hashes, joined, lower_ascii, mix, powers, text_groups

by_value(__name__)

WINDOW = 8
LEAST = 4
INFORMATIVE = 4
SHARE = 0.5
SHARD_WINDOWS = 2_000_000
#: Unit words.
UNITS = (
    "kg g mg lb lbs oz ton tons km m cm mm mi mile miles ft feet inch inches yard yards kmh mph l ml litre litres liter liters "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent "
    "dollar dollars euro euros usd eur gbp cent cents kb mb gb tb hz khz mhz ghz w kw kwh v volt volts degree degrees"
).split()
NUMBER, NAME, UNIT = U64(11), U64(13), U64(17)


def _hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    prefix = np.empty(len(raw) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum((raw.astype(np.uint64) + U64(1)) * powers(BYTE_BASE, len(raw)), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(pow(BYTE_BASE, -1, 1 << 64), len(raw) + 1)[starts])


def unit_hashes() -> np.ndarray:
    raw, ends = joined([u.encode() for u in UNITS])
    starts = np.concatenate(([0], ends[:-1]))
    return np.sort(_hash_spans(raw, starts, ends - 1))


def template(texts: list[bytes], units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template token, value and text number of every token of the texts."""
    raw, text_ends = joined(texts)
    low = lower_ascii(raw)
    digit = (raw >= 48) & (raw <= 57)
    letter = ((low >= 97) & (low <= 122)) | (raw >= 128)
    kind = digit.astype(np.int8) + 2 * letter.astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], kind, [0]))))
    first = np.concatenate((kind, [0]))[edge]
    starts = edge[first > 0]
    # A run ends where the kind changes next.
    ends = edge[np.minimum(np.searchsorted(edge, starts, side="right"), len(edge) - 1)]
    value = _hash_spans(low, starts, ends)
    row = np.searchsorted(text_ends, starts, side="right")
    breaks = np.concatenate(([0], np.cumsum(np.isin(raw, np.frombuffer(b".!?:\n", dtype=np.uint8)))))
    before = np.concatenate(([0], ends[:-1]))
    opens = breaks[starts] > breaks[before]
    if len(opens):
        opens[0] = True
    capital = (raw[starts] >= 65) & (raw[starts] <= 90)
    token = value.copy()
    token[capital & ~opens] = NAME
    if len(units) and len(value):
        token[units[np.minimum(np.searchsorted(units, value), len(units) - 1)] == value] = UNIT
    token[digit[starts]] = NUMBER
    return token, value, row


def is_slot(token: np.ndarray) -> np.ndarray:
    return (token == NUMBER) | (token == NAME) | (token == UNIT)


def windows(token: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every window of `size` tokens of one text with enough plain tokens."""
    n = len(token) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    plain = np.concatenate(([0], np.cumsum(~is_slot(token))))
    ok = (row[:n] == row[size - 1 :]) & (plain[size:] - plain[:n] >= min(INFORMATIVE, size))
    at = np.flatnonzero(ok)
    return at, gram_hashes(token, size)[at] ^ U64(size)


def benchmark_index(items: list[tuple[int, bytes]], size: int) -> list[tuple]:
    """Shards of the benchmark: (sizes, sorted hashes, item place of each, tokens, values, first token, lengths, ids)."""
    units, shards, held, count = unit_hashes(), [], [], 0
    for item in items:
        held.append(item)
        count += len(item[1].split())
        if count >= SHARD_WINDOWS:
            shards.append(held)
            held, count = [], 0
    if held:
        shards.append(held)
    out = []
    for shard in shards:
        token, value, row = template([t for _, t in shard], units)
        first = np.searchsorted(row, np.arange(len(shard) + 1))
        lengths = np.diff(first)
        sizes = sorted({int(min(size, n)) for n in lengths if n >= LEAST})
        keys, places, spans = [], [], []
        for s in sizes:
            at, h = windows(token, row, s)
            mine = np.minimum(lengths[row[at]], size) == s
            keys.append(h[mine])
            places.append(at[mine])
            spans.append(np.full(int(mine.sum()), s))
        key = np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)
        order = np.argsort(key, kind="stable")
        place = np.concatenate(places)[order] if keys else np.empty(0, dtype=np.int64)
        out.append((sizes, key[order], place, token, value, row, first, [i for i, _ in shard]))
    return out


def _consistent(pairs) -> bool:
    """Slot values correspond one to one."""
    there: dict = {}
    back: dict = {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in pairs)


def _matches(texts: list[bytes], index: tuple, units: np.ndarray, share: float) -> dict[int, dict[int, float]]:
    """Per text the items whose consistent matches cover enough, with the share covered."""
    sizes, keys, places, item_token, item_value, item_row, item_first, ids = index
    token, value, row = template(texts, units)
    lines: dict[tuple[int, int, int], set] = defaultdict(set)
    for size in sizes:
        at, h = windows(token, row, size)
        lo, hi = np.searchsorted(keys, h, side="left"), np.searchsorted(keys, h, side="right")
        for i in np.flatnonzero(hi > lo).tolist():
            for j in range(int(lo[i]), int(hi[i])):
                there = int(places[j])
                if not np.array_equal(item_token[there : there + size], token[at[i] : at[i] + size]):
                    continue
                # Windows of one occurrence share the distance between both places.
                line = lines[int(row[at[i]]), int(item_row[there]), int(at[i]) - there]
                line.update(range(there, there + size))
    covered: dict[tuple[int, int], set] = defaultdict(set)
    for (text, item, gap), tokens in lines.items():
        slots = sorted(t for t in tokens if is_slot(item_token[t : t + 1])[0])
        if _consistent((int(item_value[t]), int(value[t + gap])) for t in slots):
            covered[text, item] |= tokens
    found: dict[int, dict[int, float]] = defaultdict(dict)
    for (text, item), tokens in covered.items():
        got = len(tokens) / int(item_first[item + 1] - item_first[item])
        if got >= share:
            found[text][ids[item]] = max(got, found[text].get(ids[item], 0.0))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = SHARE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, contaminated, n_items, items, coverage) of every document."""
    spark = docs.sparkSession
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    shards = benchmark_index([(r.item_id, r.text.encode()) for r in items.orderBy("item_id", "text").toLocalIterator()], size)
    found = docs.select("doc_id", *carry, "text", F.array().cast("array<long>").alias("_items"), F.lit(0.0).alias("_cover"))

    def search(held, last: bool):
        def judge(batches):
            units = unit_hashes()
            for batch in batches:
                texts, (*kept, text, before, cover) = as_bytes(batch.column("text")), batch.columns
                items, cover = before.to_pylist(), cover.to_pylist()
                for lo, hi in text_groups(texts):
                    for at, got in _matches(texts[lo:hi], held.value, units, share).items():
                        items[lo + at] = sorted({*items[lo + at], *got})
                        cover[lo + at] = max(cover[lo + at], *got.values())
                new = [pa.array(items, pa.list_(pa.int64())), pa.array(cover, pa.float64())]
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[n for n in names if n != "text"]) if last else pa.RecordBatch.from_arrays([*kept, text, *new], names=names)

        return judge

    # One pass a shard; the text is handed on to all but the last.
    for i, shard in enumerate(shards):
        last = i == len(shards) - 1
        found = found.mapInArrow(search(spark.sparkContext.broadcast(shard), last), (found.drop("text") if last else found).schema)
    return found.select(
        "doc_id", *carry, (F.size("_items") > 0).alias("contaminated"), F.size("_items").cast("long").alias("n_items"),
        F.concat_ws(",", F.transform("_items", lambda i: i.cast("string"))).alias("items"), F.round("_cover", 6).alias("coverage"),
    )
