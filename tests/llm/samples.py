"""Invented texts, their edited copies, and rows as tuples."""

import random


def prose(n: int, seed: int, words: int = 400) -> str:
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(1, 7))) for _ in range(words)]
    return " ".join(rng.choice(stock) for _ in range(n))


def edited(text: str, every: int, seed: int) -> str:
    rng, out = random.Random(seed), text.split(" ")
    for i in range(every // 2, len(out), every):
        out[i] = f"w{rng.randint(0, 10**6)}"
    return " ".join(out)


def collected(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
