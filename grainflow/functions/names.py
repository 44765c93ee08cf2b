"""Column names from header lines, file names, and the values that file names hold."""

from __future__ import annotations

import math
import re
from pathlib import PurePosixPath

from .errors import AnalysisError, require

#: What a cell's volume is the product of: the first three of these that a file name has.
EXTENTS = ("dx", "dy", "dz", "Lx", "Ly", "Lz")


def sanitize(name: str) -> str:
    """A name of letters, digits and underscores that starts with a letter."""
    plain = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return plain if plain[:1].isalpha() else f"x{plain}"


def header_names(line: str) -> list[str]:
    """Sanitized column names of a header line with an optional leading '#'."""
    names = [sanitize(x) for x in re.sub(r"^\s*#", "", line).split()]
    require(bool(names), "NoVarNames", repr(line))
    return names


def _number(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def metadata(path: str) -> dict[str, float]:
    """Every adjacent pair of the name's parts (after the first) whose second part is a number."""
    parts = PurePosixPath(path).stem if path.endswith(".txt") else PurePosixPath(path).name
    parts = parts.split("_")
    return {a: v for a, b in zip(parts[1:], parts[2:], strict=False) if (v := _number(b)) is not None}


def cell_volume(path: str) -> float:
    """The volume of a bin from a name of strict key-value pairs: the product of the first three extents there."""
    parts = re.sub(r"\.txt$", "", PurePosixPath(path).name).split("_")[1:]
    require(len(parts) % 2 == 0, "BadBinName", f"{path}: keys and values don't pair")
    found = {}
    for k, v in zip(parts[::2], parts[1::2], strict=True):
        if (value := _number(v)) is None:
            raise AnalysisError("BadBinName", f"{path}: {v} is not a number")
        found[k] = value
    there = [found[k] for k in EXTENTS if k in found][:3]
    require(len(there) == 3, "NotEnoughVars", path)
    return math.prod(there)
