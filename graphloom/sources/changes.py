"""A streaming source of changes below a folder: the listing says what moved, and only that is read."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Fixed value: changes under these directories don't count.
IGNORED = (".git", "target", "node_modules", "dist", "build", ".graphloom")
SCHEMA = "tree string, path string, change string, at timestamp"
#: Bytes of a file that are hashed at once.
BLOCK = 1 << 20


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


class TreeReader(SimpleDataSourceStreamReader):
    """An offset holds the number of a snapshot and the time. A snapshot is a line a file: path, size, time of modification and, once the file
    has moved, its hash. Snapshots and the changes that led to them are kept until the query has done with them, so a batch can be read again."""

    def __init__(self, root: str, state: str) -> None:
        self.root, self.state = root, state

    def initialOffset(self) -> dict:  # noqa: N802
        return {"snapshot": 0, "at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        number, at = start["snapshot"], time.time_ns() // 1_000_000
        before = self._lines(f"{number}.snapshot")
        known = {path: (size, mtime, digest) for path, size, mtime, digest in before}
        now, changes = {}, []
        for path, size, mtime in self._listed():
            old = known.pop(path, None)
            if old is not None and old[:2] == (size, mtime):
                now[path] = old
                continue
            digest = self._digest(path) if old is not None else None
            now[path] = (size, mtime, digest)
            if old is None or digest is None or digest != old[2]:
                changes.append((path, "added" if old is None else "changed"))
        changes += [(path, "removed") for path in known]
        if now != {p: (s, m, d) for p, s, m, d in before}:
            number += 1
            self._write(f"{number}.changes", [[*change, at] for change in changes])
            self._write(f"{number}.snapshot", [[path, *rest] for path, rest in sorted(now.items())])
        end = {"snapshot": number, "at": at}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The changes between two snapshots, and a row without a path that only tells the time."""
        rows = [(self.root, path, change, _moment(at)) for n in range(start["snapshot"] + 1, end["snapshot"] + 1) for path, change, at in self._lines(f"{n}.changes")]
        return iter([*rows, (self.root, None, None, _moment(end["at"]))])

    def commit(self, end: dict) -> None:
        from pyarrow import fs

        system, base = _opened(self.state)
        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            number, _, kind = info.base_name.partition(".")
            if number.isdigit() and int(number) < end["snapshot"] + (kind == "changes"):
                system.delete_file(info.path)

    def _listed(self) -> Iterator[tuple[str, int, int]]:
        from pyarrow import fs

        system, base = _opened(self.root)
        todo = [base]
        while todo:
            for info in system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
                if info.type == fs.FileType.Directory and info.base_name not in IGNORED:
                    todo.append(info.path)
                elif info.type == fs.FileType.File and info.base_name not in IGNORED:
                    yield info.path[len(base) :].lstrip("/"), info.size, info.mtime_ns or 0

    def _digest(self, path: str) -> str | None:
        """None if the file has gone meanwhile."""
        system, base = _opened(self.root)
        out = hashlib.sha256()
        try:
            with system.open_input_stream(f"{base}/{path}") as stream:
                while block := stream.read(BLOCK):
                    out.update(block)
        except FileNotFoundError:
            return None
        return out.hexdigest()

    def _lines(self, name: str) -> list:
        system, base = _opened(self.state)
        try:
            with system.open_input_stream(f"{base}/{name}") as stream:
                return [json.loads(line) for line in stream.read().decode().splitlines()]
        except FileNotFoundError:
            return []

    def _write(self, name: str, rows: list) -> None:
        system, base = _opened(self.state)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{name}.tmp") as stream:
            stream.write("".join(json.dumps(row) + "\n" for row in rows).encode())
        system.move(f"{base}/{name}.tmp", f"{base}/{name}")


def _moment(milliseconds: int) -> datetime:
    return datetime.fromtimestamp(milliseconds / 1000, UTC)


class TreeChanges(DataSource):
    """Options: root, the folder; state, a folder for the snapshots. Every trigger lists the folder once."""

    @classmethod
    def name(cls) -> str:
        return "graphloom_tree"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TreeReader:  # noqa: N802
        return TreeReader(self.options["root"], self.options["state"])
