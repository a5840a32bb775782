"""Files of the operators' own formats, in any store that pyarrow can open."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path[len("file:") :]
    return fs.LocalFileSystem(), path


@contextmanager
def committed(path: str) -> Iterator:
    """A binary stream that becomes ``path`` when the block ends well.

    A task that is run again writes the same bytes and replaces the file, so lost
    executors and speculative copies leave one whole file."""
    store, target = resolve(path)
    folder, _, name = target.rpartition("/")
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(draft) as out:
            yield out
        store.move(draft, target)
    except BaseException:
        try:
            store.delete_file(draft)
        except OSError:
            pass
        raise


def listed(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files in a folder that end with ``suffix``, by name; none if it is absent."""
    store, target = resolve(folder)
    prefix = folder.rstrip("/")
    found = store.get_file_info(fs.FileSelector(target, allow_not_found=True))
    return sorted((f"{prefix}/{f.base_name}", f.size) for f in found if f.is_file and f.base_name.endswith(suffix) and f.base_name[0] != ".")
