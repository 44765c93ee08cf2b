"""Which file an analysis reads: a given one, or the only one of its kind in a folder."""

from __future__ import annotations

import fnmatch

from pyarrow import fs

from ..functions.errors import require

#: File name patterns by kind of analysis.
PATTERNS = {"1d": "bin1d*.txt", "2d": "bin2d*.txt", "cluster": "cluster_chunk*.txt", "vx": "vx_chunk*.txt", "log": "slurm*"}


def _join(folder: str, name: str) -> str:
    return name if name.startswith("/") or "://" in name else f"{folder.rstrip('/')}/{name}"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def resolve(folder: str, kind: str, name: str | None = None) -> str:
    """The path of the named file, which must end in .txt, or of the only file of the kind; none or several are errors."""
    require(kind in PATTERNS, "BadChunkDim" if kind.endswith("d") else "BadTaskType", kind)
    if name:
        require(kind == "log" or name.lower().endswith(".txt"), "MissingTxtSuffix", name)
        path = _join(folder, name)
        store, place = _store(path)
        require(store.get_file_info(place).type == fs.FileType.File, "PreferredFileNotFound", path)
        return path
    store, place = _store(folder)
    require(store.get_file_info(place).type == fs.FileType.Directory, "DirNotFound", folder)
    files = store.get_file_info(fs.FileSelector(place))
    found = sorted(f.base_name for f in files if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, PATTERNS[kind]))
    require(bool(found), "NoMatch", f"{folder}: {PATTERNS[kind]}")
    require(len(found) == 1, "MultipleMatches", f"{folder}: {', '.join(found)}")
    return _join(folder, found[0])
