"""Files that tasks open themselves, on any file system pyarrow reaches."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Spark path (local, HDFS, S3, GCS)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def reachable(uri: str) -> bool:
    """Whether tasks can open files under ``uri`` without Spark's readers."""
    try:
        locate(uri)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def children(uri: str) -> list[tuple[str, bool]]:
    """(path, whether it is a folder) of what lies in a folder, a file's own
    path if ``uri`` is one; names that Spark's readers pass over are left out."""
    fs, path = locate(uri)
    scheme = "file:" if isinstance(fs, pafs.LocalFileSystem) else uri.rstrip("/").removesuffix(path.rstrip("/"))
    if fs.get_file_info(path).type == pafs.FileType.File:
        return [(scheme + path, False)]
    return [(scheme + x.path, x.type == pafs.FileType.Directory) for x in fs.get_file_info(pafs.FileSelector(path))
            if not (x.base_name.startswith(".") or x.base_name.startswith("_") and "=" not in x.base_name
                    or x.base_name.endswith("._COPYING_"))]


def write_text(uri: str, text: str) -> None:
    """One file, in a folder that is there."""
    fs, path = locate(uri)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(text.encode())


def read_text(uri: str) -> str:
    """A whole file as text; bytes that are not UTF-8 become U+FFFD."""
    fs, path = locate(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read().decode("utf-8", "replace")
