"""Files that tasks write and read themselves, in the shared folder, by URI (file, hdfs, s3, ... as pyarrow knows them)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(folder: str, name: str):
    """A stream whose file appears under its name only when complete; a task that runs again replaces it."""
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(temporary, compression=None) as out:
            yield out
    except BaseException:
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_file(temporary)
        raise
    system.move(temporary, f"{root}/{name}")


def coalesced(spans: Iterable[tuple], most: int, gap: int) -> Iterator[list[tuple]]:
    """Runs of sorted (file, offset, length, ...) that one read covers: gaps up to ``gap``, spans up to ``most`` bytes."""
    run: list[tuple] = []
    for span in spans:
        if run and (span[0] != run[0][0] or span[1] > run[-1][1] + run[-1][2] + gap or span[1] + span[2] - run[0][1] > most):
            yield run
            run = []
        run.append(span)
    if run:
        yield run


class Reader:
    """Positional reads from one file at a time."""

    def __init__(self, folder: str):
        self.system, self.root = opened(folder)
        self.name, self.file = None, None

    def at(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.root}/{name}")
        raw = self.file.read_at(length, offset)
        if len(raw) != length:
            raise EOFError(f"{name}: {length} bytes wanted at {offset}, {len(raw)} there")
        return raw

    def runs(self, spans: Iterable[tuple], use: Callable[[tuple, memoryview], object], most: int = 8 << 20, gap: int = 64 << 10) -> Iterator:
        for run in coalesced(spans, most, gap):
            start = run[0][1]
            raw = memoryview(self.at(run[0][0], start, max(s[1] + s[2] for s in run) - start))
            for s in run:
                yield use(s, raw[s[1] - start : s[1] - start + s[2]])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None
