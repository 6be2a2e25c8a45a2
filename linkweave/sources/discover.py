"""Finding inputs by name, and sizes as people write them."""

from __future__ import annotations

import os
import re

UNITS = {"": 1, "k": 1_000, "m": 1_000_000}


def find(name: str, roots: list[str]) -> str:
    """The file or folder called ``name`` nearest to the first root that has one; archive leftovers are passed over."""
    for root in roots:
        hits = [os.path.join(d, name) for d, folders, files in os.walk(root) if "__MACOSX" not in d and name in (*folders, *files)]
        if hits:
            return min(hits, key=lambda p: (p.count(os.sep), p))
    raise FileNotFoundError(f"{name} under {', '.join(roots)}")


def parse_size(text: str | int) -> int:
    """``40k`` is 40,000, ``1.5m`` 1,500,000; a plain number itself."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([km]?)\s*", str(text).lower().replace(",", "").replace("_", ""))
    if not m:
        raise ValueError(f"no size: {text!r}")
    return round(float(m[1]) * UNITS[m[2]])


def size_label(n: int) -> str:
    """The shortest such text for a number."""
    for unit, of in (("m", 1_000_000), ("k", 1_000)):
        if n >= of and n % (of // 10) == 0:
            return f"{n / of:g}{unit}"
    return str(n)
