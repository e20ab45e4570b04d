"""Texts for tests."""

import numpy as np


def sentence(rng: np.random.Generator, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.integers(words)}" for _ in range(n))
