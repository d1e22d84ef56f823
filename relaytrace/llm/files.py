"""Binary files in a shared folder, reached from the driver and from tasks.

Paths may carry a scheme; ``pyarrow.fs`` picks the file system.  A file is
written under a name of its own attempt and renamed when whole, so a lost or
repeated task leaves no half file under the final name.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and bare path of ``path``."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@contextlib.contextmanager
def written(path: str) -> Iterator:
    """A stream whose content appears at ``path`` once the block ends well."""
    where, bare = place(path)
    where.create_dir(bare.rsplit("/", 1)[0], recursive=True)
    tmp = f"{bare}.{uuid.uuid4().hex}.tmp"
    out = where.open_output_stream(tmp)
    try:
        yield out
    except BaseException:
        out.close()
        where.delete_file(tmp)
        raise
    out.close()
    where.move(tmp, bare)


def opened(path: str):
    """A seekable stream and the file's size."""
    where, bare = place(path)
    f = where.open_input_file(bare)
    return f, f.size()


def read_all(path: str) -> bytes:
    f, _ = opened(path)
    with f:
        return f.read()
