"""Invented texts."""

import random


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    """Invented text, the same for a seed."""
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))
