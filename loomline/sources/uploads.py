"""A source of uploaded files: each is claimed by a move, is one row, and is never read twice.

Files land as landing/<tenant>/<base>/<name>. When a stream asks what is new, the
files that lie there are moved below dest/claim=<number>/, under the next number,
which is the stream's offset: whatever happens after that, the rows of a number
are those of its folder. A stream that starts anew without a checkpoint begins at
the first claim; a batch read gives all claims and moves nothing.

Options: landing, dest (paths or URIs of a file system that pyarrow knows, which
the driver and all executors reach), content (true: rows carry the files' bytes).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from posixpath import basename

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.ingest import PENDING
from .parsers import PARSERS

_SCHEMA = "doc_id string, tenant string, kb string, file_name string, file_type string, file_size long, file_url string, status string, error_message string, claim long, content binary"
REFUSED = "refused"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (fs.LocalFileSystem(), uri)


def _listed(uri: str) -> list:
    from pyarrow import fs

    files, path = _fs(uri)
    found = files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)


def error_of(name: str, size: int) -> str | None:
    """Why a file is refused; None if it isn't."""
    kind = name.rpartition(".")[2].lower() if "." in name else ""
    return f"unsupported type: {kind}" if kind not in PARSERS else "empty file" if size == 0 else None


class _File(InputPartition):
    def __init__(self, claim: int, path: str, size: int):
        super().__init__((claim, path))
        self.claim, self.path, self.size = claim, path, size


class _Claims:
    def __init__(self, options: dict):
        self.landing, self.dest, self.content = options["landing"].rstrip("/"), options["dest"].rstrip("/"), options.get("content", "false").lower() == "true"

    def claims(self) -> dict[int, list]:
        out: dict[int, list] = {}
        for f in _listed(self.dest):
            if m := re.search(r"/claim=(\d+)/", f.path):
                out.setdefault(int(m[1]), []).append(f)
        return out

    def claim(self) -> int:
        """Moves what lies in the landing folder; the newest claim's number, 0 without any."""
        newest = max(self.claims(), default=0)
        files, root = _fs(self.landing)
        to, dest = _fs(self.dest)
        moved = 0
        for f in _listed(self.landing):
            name = f.path[len(root) :].lstrip("/")
            if basename(name).startswith((".", "_")):
                continue  # still being written
            at = f"{dest}/claim={newest + 1}/{name}"
            to.create_dir(at.rpartition("/")[0], recursive=True)
            files.move(f.path, at)
            moved += 1
        return newest + bool(moved)

    def partitions_of(self, first: int, last: int) -> list[_File]:
        return [_File(n, f.path, f.size) for n, files in sorted(self.claims().items()) if first < n <= last for f in files]

    def rows(self, p: _File) -> Iterator[tuple]:
        files, dest = _fs(self.dest)
        *folders, name = p.path[len(f"{dest}/claim={p.claim}/") :].split("/")
        tenant, kb = [*folders, None, None][:2]
        error = error_of(name, p.size)
        data = None
        if self.content and error is None:
            with files.open_input_stream(p.path) as f:
                data = f.read()
        doc_id = hashlib.md5(f"{p.claim}/{'/'.join(folders)}/{name}".encode()).hexdigest()
        yield doc_id, tenant, kb, name, name.rpartition(".")[2].lower() if "." in name else "", p.size, p.path, REFUSED if error else PENDING, error, p.claim, data


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.of = _Claims(options)

    def partitions(self) -> list[InputPartition]:
        return self.of.partitions_of(0, 1 << 62)

    def read(self, partition: _File) -> Iterator[tuple]:
        return self.of.rows(partition) if isinstance(partition, _File) else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.of = _Claims(options)

    def initialOffset(self) -> dict:
        return {"claim": 0}

    def latestOffset(self) -> dict:
        return {"claim": self.of.claim()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.of.partitions_of(start["claim"], end["claim"])

    def read(self, partition: _File) -> Iterator[tuple]:
        return self.of.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Uploads(DataSource):
    """spark.dataSource.register(Uploads), then format("uploads")."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))
