"""Small files in shared folders, as tasks and the driver reach them (pyarrow file systems)."""
from __future__ import annotations

import uuid


def filesystem(path: str):
    """(file system, path in it) of a local path or a URI (file, hdfs, s3, ...)."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def put(system, path: str, data: bytes) -> None:
    """Write a file whole: under another name first, so no reader sees a part of it."""
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    tmp = f"{folder}/_{uuid.uuid4().hex}-{name}"
    with system.open_output_stream(tmp) as f:
        f.write(data)
    system.move(tmp, path)


def get(system, path: str) -> bytes:
    with system.open_input_file(path) as f:
        return f.read()


def listed(system, folder: str, suffix: str) -> list[str]:
    """Finished files in a folder; none where there is no folder."""
    from pyarrow import fs
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(suffix) and not f.base_name.startswith("_"))
