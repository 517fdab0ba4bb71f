"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Native column expressions only. A pattern's matches are put between two marks and the text is
split at them, so that the lengths of the parts give every position in one pass; the marks'
own characters in a text are first replaced by another control character, which no pattern matches.

Base kinds (their spans always stay): email, ip, card (Luhn), phone. Added kinds stay when
their score reaches `threshold`: iban (mod 97), and ssn, which only counts with a word near it.
Positions are code points, end exclusive. Matches of one kind don't overlap; kinds may.

Null text counts as empty. Every row gives one row; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import unused

MARK, STOP, OTHER = "\x01", "\x02", "\x03"
CONTEXT_CHARS = 40
THRESHOLD = 0.6
BLOCK = 128


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Checksum over all digits: from the right, every second one is doubled."""
    figures = F.split(F.reverse(number), "")
    values = F.transform(figures, lambda d, i: (lambda v: F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0)))(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(code: Column) -> Column:
    """The first four characters go to the end, letters count from 10; the rest modulo 97 is 1."""
    compact = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 60), F.substring(compact, 1, 4))
    value = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return value == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a text without this can't match
    valid: Callable[[Column], Column]
    score: float
    words: str  # context that raises the score, lower case
    base: bool = True
    boost: float = field(default=0.3)


def _between(c: Column, low: int, high: int) -> Column:
    n = F.length(c)
    return (n >= low) & (n <= high)


BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: The patterns match what the plain forms match leftmost; possessive parts and look-behind only spare
#: retries inside a run that has already failed, so that long runs take linear time.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.7, "mail|contact|write to|@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", lambda m: m.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$"), 0.5, r"\bip\b|address|host|server|port"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", "", lambda m: luhn(digits(m)), 0.6, "card|visa|credit|payment|cvv"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: _between(digits(m), 9, 15), 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "", mod97, 0.8, "iban|account|bank|konto", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social security", False, 0.4),
)


def _marked(text: Column, kind: Kind) -> Column:
    """Parts of a text: what precedes the first match, then for each match the match, a stop and what follows. Null: no match."""
    some = F.instr(text, kind.needs) > 0 if kind.needs else F.lit(True)
    marked = F.when(some, F.regexp_replace(text, kind.pattern, MARK + "$0" + STOP))
    parts = F.split(marked, MARK)
    return F.when(F.instr(marked, MARK) > 0, parts)


def _tail(c: Column) -> Column:
    return F.substring(c, -CONTEXT_CHARS, CONTEXT_CHARS)


SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _spans(parts: Column, kind: Kind, threshold: float) -> Column:
    """Valid spans in order. Blocks bound the cost of growing arrays in texts with very many matches."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 2, F.lit(BLOCK)))
    step = lambda p: F.length(p) - 1
    begins = F.aggregate(
        blocks, F.array(F.length(parts[0])),
        lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + F.aggregate(b, F.lit(0), lambda n, p: n + step(p)))),
    )

    def walk(block: Column, i: Column) -> Column:
        start = F.struct(F.get(begins, i).alias("at"), _tail(F.element_at(parts, i * BLOCK + 1)).alias("before"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def add(acc: Column, p: Column) -> Column:
            match, rest = F.substring_index(p, STOP, 1), F.substring_index(p, STOP, -1)
            near = F.lower(F.concat(acc.before, F.lit(" "), F.substring(rest, 1, CONTEXT_CHARS)))
            score = F.lit(kind.score) + F.when(near.rlike(kind.words), kind.boost).otherwise(0.0)
            keep = kind.valid(match) & (F.lit(True) if kind.base else score >= threshold)
            span = F.struct(F.lit(kind.name).alias("kind"), acc.at.alias("start"), (acc.at + F.length(match)).alias("end"), score.alias("score"))
            return F.struct(
                (acc.at + step(p)).alias("at"), _tail(rest).alias("before"),
                F.when(keep, F.concat(acc.out, F.array(span).cast(f"array<{SPAN}>"))).otherwise(acc.out).alias("out"),
            )

        return F.aggregate(block, start, add, lambda acc: acc.out)

    return F.coalesce(F.when(parts.isNotNull(), F.flatten(F.transform(blocks, walk))), F.array().cast(f"array<{SPAN}>"))


def clean_text() -> Column:
    return F.translate(F.coalesce(F.col("text"), F.lit("")), MARK + STOP, OTHER + OTHER)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, pii): spans (kind, start, end, score) by kind as listed, then start."""
    df = docs.select("doc_id", clean_text().alias("_t"))
    df = df.select("doc_id", *[_marked(F.col("_t"), k).alias(f"_p{i}") for i, k in enumerate(kinds)])
    df = df.select("doc_id", *[_spans(F.col(f"_p{i}"), k, threshold).alias(f"_s{i}") for i, k in enumerate(kinds)])
    return df.select("doc_id", F.concat(*[f"_s{i}" for i in range(len(kinds))]).alias("pii"))


def digest(found: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts of the base kinds, and the spans as text."""
    base = [k.name for k in kinds if k.base]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    known = F.sha2(listed(F.filter("pii", lambda s: s.kind.isin(base))), 256)
    return found.select("doc_id", *counts, known.alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def redacted(text: Column, kind: Kind, threshold: float = THRESHOLD) -> Column:
    """The text with every confirmed match of one kind replaced by its name in brackets."""
    parts = _marked(text, kind)

    def swap(p: Column, i: Column) -> Column:
        match, rest = F.substring_index(p, STOP, 1), F.substring_index(p, STOP, -1)
        near = F.lower(F.concat(_tail(F.substring_index(F.get(parts, i), STOP, -1)), F.lit(" "), F.substring(rest, 1, CONTEXT_CHARS)))
        keep = kind.valid(match) & (F.lit(True) if kind.base else kind.score + F.when(near.rlike(kind.words), kind.boost).otherwise(0.0) >= threshold)
        return F.concat(F.when(keep, f"[{kind.name.upper()}]").otherwise(match), rest)

    swapped = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), swap), ""))
    return F.coalesce(F.when(parts.isNotNull(), swapped), text)


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Documents with personal data masked, kind after kind, and n_chars brought up to date; null text stays null."""
    t = unused("_t", docs.columns)
    df = docs.withColumn(t, F.when(F.col("text").isNotNull(), clean_text()))
    for kind in kinds:
        df = df.withColumn(t, redacted(F.col(t), kind))
    changed = F.col(t) != clean_text()
    new = {"text": F.col(t), "n_chars": F.length(t).cast("long")}
    return df.select(*[F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
