r"""Chat formatting by token-level assembly.

A turn is written as a mark, its text, and `</turn>` on the end of a line:

    ### User:
    How are you?</turn>
    ### Role:
    tool</role>
    {"ok": true}</turn>

Every mark is one reserved id beyond the tokenizer's vocabulary. Texts and unusual roles are encoded
each for itself, so no token ever spans a mark, and the ids are spliced between the reserved ones. The
loss mask is a prefix sum: +1 behind an assistant's mark, -1 at the end of its text.

Control strings inside texts are escaped: backslashes before one (or at the end of a text) are doubled
and one more stands before the control string, so a mark is real exactly if an even number of backslashes
precedes it. `unescape` and `parse` invert that for every text.

Turns are ordered by turn (null first), role and text. Null role and text are empty; null conv_id is a
conversation of its own; repeated rows are repeated turns. Other columns are never read.
A conversation is a run of rows, one per turn, with the place of its first token: conversations of any
length are spread over range partitions, and the places are carried from one to the next.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import by_value, parts, written
from factorlab.llm.ordered import carries, partition_number, ranged, with_carries

by_value(__name__)

# Fixed values of the template: roles with a mark of their own, and the control strings in the order of their ids.
ROLES = {"system": 0, "user": 1, "assistant": 2}
OTHER, ROLE_END, TURN_END = 3, 4, 5
CONTROLS = ["### System:", "### User:", "### Assistant:", "### Role:", "</role>", "</turn>"]
FIRST_ID = 50_257
MARK = "|".join(map(re.escape, CONTROLS))
_SPOT = re.compile(rf"(?<!\\)(\\*+)({MARK}|\Z)")


def escape(text: str) -> str:
    return _SPOT.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def unescape(text: str) -> str:
    return _SPOT.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def _tokenizer(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _mask(ids: np.ndarray, first_id: int) -> np.ndarray:
    """True between an assistant's mark and the end of that turn; `ids` are whole turns."""
    step = np.zeros(len(ids) + 1, dtype=np.int32)
    begin = np.flatnonzero(ids == first_id + ROLES["assistant"])
    ends = np.flatnonzero(ids == first_id + TURN_END)
    step[begin + 1] += 1
    np.add.at(step, ends[np.searchsorted(ends, begin)], -1)
    return np.cumsum(step[:-1]) > 0


def assemble(turns: DataFrame, ranks_path: str, pattern: str, first_id: int = FIRST_ID) -> DataFrame:
    """(conv_id, turn_no, start, ids, loss, n_chars): a row per turn; `start` is the place of its first
    token in the conversation, `loss` the mask over `ids`, `n_chars` the turn's length as text."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("_part", pa.int32()), ("turn_no", pa.int64()), ("start", pa.int64()),
        ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("n_chars", pa.int64()),
    ])

    def walk(batches):
        code, part = _tokenizer(ranks_path, pattern), partition_number()
        known, no, at, empty = object(), 0, 0, np.empty(0, dtype=np.int32)

        def segment(text: str) -> np.ndarray:
            return code.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int32) if text else empty

        def mark(*which: int) -> np.ndarray:
            return np.array(which, dtype=np.int32) + first_id

        for batch in batches:
            nos, starts, chars, sizes, ids = [], [], [], [], []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != known:
                    known, no, at = conv, 0, 0
                body = escape(text)
                own = ROLES.get(role)
                if own is None:
                    name = escape(role)
                    row = [mark(OTHER), segment(name), mark(ROLE_END), segment(body), mark(TURN_END)]
                    n_chars = len(CONTROLS[OTHER]) + len(name) + len(CONTROLS[ROLE_END]) + 2
                else:
                    row = [mark(own), segment(body), mark(TURN_END)]
                    n_chars = len(CONTROLS[own]) + 1
                size = sum(map(len, row))
                nos.append(no)
                starts.append(at)
                chars.append(n_chars + len(body) + len(CONTROLS[TURN_END]) + 1)
                sizes.append(size)
                ids += row
                no, at = no + 1, at + size
            flat = np.concatenate(ids) if ids else empty
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(batch.num_rows, part, dtype=np.int32)),
                    pa.array(nos, type=pa.int64()),
                    pa.array(starts, type=pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(flat)),
                    pa.ListArray.from_arrays(offsets, pa.array(_mask(flat, first_id))),
                    pa.array(chars, type=pa.int64()),
                ],
                schema=schema,
            )

    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn"
    )
    order = ranged(clean, "conv_id", "turn", "role", "text").drop("turn")
    ddl = "conv_id long, _part int, turn_no long, start long, ids array<int>, loss array<boolean>, n_chars long"
    walked = written(order.mapInArrow(walk, ddl), "chat")
    before = carries(walked, "conv_id", {"_turns": F.count("*"), "_tokens": F.sum(F.size("ids").cast("long"))})
    full = with_carries(walked, before, "conv_id")
    return full.select(
        "conv_id",
        (F.col("turn_no") + F.coalesce("_turns", F.lit(0))).alias("turn_no"),
        (F.col("start") + F.coalesce("_tokens", F.lit(0))).alias("start"),
        "ids", "loss", "n_chars",
    )


def rendered(ids: np.ndarray, code, first_id: int = FIRST_ID) -> str:
    """Ids as formatted text."""
    out, at = [], 0
    for i in np.flatnonzero(ids >= first_id):
        out += [code.decode_bytes(ids[at:i].tolist()).decode(), CONTROLS[ids[i] - first_id], "\n"]
        at = i + 1
    return "".join(out)


_REAL = re.compile(rf"(?<!\\)(\\\\)*+({MARK})\n?")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text, from the text alone."""
    turns, role, at = [], "", 0
    for m in _REAL.finditer(formatted):
        mark = CONTROLS.index(m[2])
        between = unescape(formatted[at : m.start(2)])
        if mark == ROLE_END:
            role = between
        elif mark == TURN_END:
            turns.append((role, between))
        else:
            role = next((r for r, i in ROLES.items() if i == mark), "")
        at = m.end()
    return turns


def digest(assembled: DataFrame, ranks_path: str, pattern: str, first_id: int = FIRST_ID) -> DataFrame:
    """What a reader of the ids gets back, per conversation: turns and, under the mask, the assistant's texts.

    The digests of a conversation are chains over its turns, so its rows stream through one task, one turn at a time.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def read(batches):
        code = _tokenizer(ranks_path, pattern)
        names = {first_id + i: r for r, i in ROLES.items()}
        known, n = object(), 0
        whole = loss = None
        loss_chars = chars = 0

        def plain(ids: np.ndarray) -> str:
            return unescape(code.decode_bytes(ids.tolist()).decode())

        for batch in batches:
            out = []
            lists, masks = batch.column(1), batch.column(2)
            flat, mask = lists.flatten().to_numpy(), masks.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            for i, (conv, length) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if conv != known:
                    if whole:
                        out.append((known, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    known, n, whole, loss, loss_chars, chars = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                ids, kept = flat[ends[i] : ends[i + 1]], mask[ends[i] : ends[i + 1]]
                marks = np.flatnonzero(ids >= first_id)
                role = names[ids[0]] if ids[0] in names else plain(ids[1 : marks[1]])
                text = plain(ids[marks[-2] + 1 : marks[-1]])
                whole.update(f"{role}\n{text}\n".encode())
                said = plain(ids[kept])  # a turn holds one run of the mask at most
                loss.update(said.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(said), chars + length
            yield _rows(out, schema)
        if whole:
            yield _rows([(known, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars)], schema)

    order = assembled.repartition(parts(assembled.sparkSession, 1), "conv_id").sortWithinPartitions("conv_id", "turn_no")
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return order.select("conv_id", "ids", "loss", "n_chars").mapInArrow(read, ddl)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
