"""What counts as a letter or digit."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from siftstone.functions.windows import code_points


@lru_cache(maxsize=1)
def alphanumeric() -> np.ndarray:
    """For each code point whether it is a letter or digit; marks, blanks and signs are not."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


def letters_and_digits(text: str) -> np.ndarray:
    """Code points of the letters and digits of a text, in order, without letter case."""
    codes = code_points(text.casefold())
    return codes[alphanumeric()[codes]]
