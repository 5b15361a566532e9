"""String-pooled lexicon files: searched by word, scanned in splits, written by tasks.

A file holds strings, each ended by a zero byte, their offsets, and two lists of records sorted by the bytes of the
word. Nothing reads it whole: a scan takes ``SPAN`` records a task, a filter on ``word`` becomes a binary search, and
``search_lexicon`` looks a table of words up where that table's tasks run. Paths are local ones, or URIs that ``pyarrow``
opens, which driver and executors must share.

Strings out of range, or not UTF-8, are read as ''. As '' may therefore stand anywhere, a filter that '' meets reads all.
"""

from __future__ import annotations

import os
import struct
import uuid
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    StringStartsWith, WriterCommitMessage,
)

SCHEMA = "word string, kind string, phone string, is_en boolean, vi_phone string, en_phone string"

# The layout of the file. Numbers are little-endian and unsigned, 32 bits.
MAGIC = b"SEAP"
HEADER = struct.Struct("<4s4x6I")  # strings, merged and common records; positions of offsets, merged and common
BASE = HEADER.size  # strings stand here, each ended by a zero byte
RECORD = {"merged": struct.Struct("<2I"), "common": struct.Struct("<3I")}
ENGLISH = "<en>"  # before the phonemes of an English word
LIMIT = 1 << 32

SPAN = 50_000  # records scanned by one task
POINTS = 1_000  # words searched by one task
SCAN_PAGE, SEARCH_PAGE = 1 << 20, 1 << 12  # bytes read at a time
KEPT_BYTES = 64 << 20  # of pages that a task holds
SHARED = 200_000  # strings that a writing task remembers, so as to write them once


def place(path: str) -> tuple[files.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return files.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


class PooledFile:
    """An open file, read by pages; ``bytes_read`` counts what came from the disk."""

    def __init__(self, path: str, page: int):
        system, name = place(path)
        self.file, self.page, self.pages, self.bytes_read = system.open_input_file(name), page, OrderedDict(), 0
        head = self._at(0, BASE)
        if len(head) < BASE or head[:4] != MAGIC:
            raise ValueError(f"{path} is not a lexicon file")
        _, self.strings, merged, common, self.offsets_at, merged_at, common_at = HEADER.unpack(head)
        self.count, self.records_at = {"merged": merged, "common": common}, {"merged": merged_at, "common": common_at}

    def _page(self, k: int) -> bytes:
        if k in self.pages:
            self.pages.move_to_end(k)
        else:
            self.file.seek(k * self.page)
            self.pages[k] = self.file.read(self.page)
            self.bytes_read += len(self.pages[k])
            if len(self.pages) * self.page > KEPT_BYTES:
                self.pages.popitem(last=False)
        return self.pages[k]

    def _at(self, begin: int, size: int) -> bytes:
        k, start = divmod(begin, self.page)
        found = self._page(k)[start : start + size]
        while len(found) < size and (more := self._page(k := k + 1)[: size - len(found)]):
            found += more
        return found

    def raw(self, k: int) -> bytes:
        """The bytes of a string."""
        place_ = self._at(self.offsets_at + 4 * k, 4) if k < self.strings else b""
        if len(place_) < 4:
            return b""
        page, start = divmod(BASE + int.from_bytes(place_, "little"), self.page)
        found = b""
        while data := self._page(page):
            end = data.find(b"\0", start)
            if end >= 0:
                return found + data[start:end]
            found, page, start = found + data[start:], page + 1, 0
        return found

    def _ids(self, kind: str, k: int) -> tuple[int, ...]:
        form = RECORD[kind]
        return form.unpack(self._at(self.records_at[kind] + form.size * k, form.size))

    def row(self, kind: str, k: int) -> tuple:
        """A row of ``SCHEMA``."""
        said = []
        for i in self._ids(kind, k):
            try:
                said.append(self.raw(i).decode())
            except UnicodeDecodeError:
                said.append("")
        if kind == "merged":
            return said[0], kind, said[1].replace(ENGLISH, "").strip(), ENGLISH in said[1], None, None
        return said[0], kind, None, None, said[1].strip(), said[2].replace(ENGLISH, "").strip()

    def bound(self, kind: str, word: bytes, after: bool = False) -> int:
        """The first record whose word isn't smaller than ``word`` (or, ``after``, is greater)."""
        return (bisect_right if after else bisect_left)(range(self.count[kind]), word, key=lambda k: self.raw(self._ids(kind, k)[0]))

    def find(self, word: bytes) -> Iterator[tuple]:
        for kind in RECORD:
            k = self.bound(kind, word)
            while k < self.count[kind] and self.raw(self._ids(kind, k)[0]) == word:
                yield self.row(kind, k)
                k += 1


@dataclass
class _Span(InputPartition):
    kind: str
    first: int
    last: int
    page: int


@dataclass
class _Points(InputPartition):
    words: list[bytes]


class PooledReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.kinds = set(RECORD)
        self.points: set[str] | None = None
        self.low: tuple[bytes, bool] = (b"", False)  # a word, and whether it is left out
        self.high: list[tuple[bytes, bool]] = []  # upper bounds, and whether they are taken in
        PooledFile(path, SEARCH_PAGE)

    def partitions(self) -> list[InputPartition]:
        if self.points is not None and "" not in self.points:
            words = sorted(w.encode() for w in self.points)
            return [_Points(words[k : k + POINTS]) for k in range(0, len(words), POINTS)]
        file, spans = PooledFile(self.path, SEARCH_PAGE), []
        for kind in sorted(self.kinds):
            first, last = 0, file.count[kind]
            if self.low[0]:
                first = file.bound(kind, *self.low)
                last = min([last, *(file.bound(kind, word, taken) for word, taken in self.high)])
            page = SEARCH_PAGE if last - first < file.count[kind] else SCAN_PAGE
            spans += [_Span(kind, k, min(k + SPAN, last), page) for k in range(first, last, SPAN)]
        return spans

    def read(self, part: InputPartition) -> Iterator[tuple]:
        if isinstance(part, _Points):
            file = PooledFile(self.path, SEARCH_PAGE)
            for word in part.words:
                yield from file.find(word)
        elif isinstance(part, _Span):
            file = PooledFile(self.path, part.page)
            for k in range(part.first, part.last):
                yield file.row(part.kind, k)


class SearchingReader(PooledReader):
    """Filters narrow what is read; Spark applies them to the rows all the same."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for test in filters:
            self._narrow(test)
            yield test

    def _narrow(self, test: Filter) -> None:
        column, value = getattr(test, "attribute", ()), getattr(test, "value", None)
        if column == ("kind",) and isinstance(test, EqualTo | EqualNullSafe):
            self.kinds &= {value}
        if column != ("word",) or value is None:
            return
        if isinstance(test, EqualTo | EqualNullSafe | In):
            words = {w for w in (value if isinstance(test, In) else [value]) if w is not None}
            self.points = words if self.points is None else self.points & words
        elif isinstance(test, GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, (value.encode(), isinstance(test, GreaterThan)))
        elif isinstance(test, LessThan | LessThanOrEqual):
            self.high.append((value.encode(), isinstance(test, LessThanOrEqual)))
        elif isinstance(test, StringStartsWith) and value:
            begin = value.encode()
            self.low = max(self.low, (begin, False))
            self.high.append((begin[:-1] + bytes([begin[-1] + 1]), False))


@dataclass
class _Part(WriterCommitMessage):
    """What a task wrote: files ``name``-section, counts, and the first and last word of each kind."""

    name: str
    strings: int = 0
    size: int = 0
    count: dict[str, int] = field(default_factory=lambda: dict.fromkeys(RECORD, 0))
    first: dict[str, bytes] = field(default_factory=dict)
    last: dict[str, bytes] = field(default_factory=dict)


def _numbers(stream, base: int) -> Iterator[bytes]:
    """The numbers of a part's section, each with ``base`` added."""
    rest = b""
    while block := stream.read(SCAN_PAGE):
        rest += block
        whole = len(rest) & ~3
        yield (np.frombuffer(rest[:whole], "<u4") + np.uint32(base)).astype("<u4").tobytes()
        rest = rest[whole:]


class PooledWriter(DataSourceArrowWriter):
    """Each task writes its sorted rows as a part, whose numbers count from 0; commit streams the parts, with numbers
    moved on, into one file beside the target and renames it. A task that runs twice writes other files, and only those it
    reports are used. Positions have 32 bits, so a file, and what commit moves, is at most 4 GB."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.parts = path, f"{path}.parts-{uuid.uuid4().hex}"
        system, name = place(path)
        if not overwrite and system.get_file_info(name).type != files.FileType.NotFound:
            raise FileExistsError(path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        system, folder = place(self.parts)
        system.create_dir(folder, recursive=True)
        part = _Part(f"{folder}/{uuid.uuid4().hex}")
        out = {s: system.open_output_stream(f"{part.name}-{s}") for s in ("strings", "offsets", *RECORD)}
        ids: dict[bytes, int] = {}
        for batch in batches:
            data = {s: bytearray() for s in out}

            def number(text: str | None, data=data) -> int:
                raw = (text or "").encode()
                if b"\0" in raw:
                    raise ValueError(f"a zero byte in {text!r}")
                if raw not in ids:
                    if len(ids) >= SHARED:
                        ids.clear()
                    ids[raw] = part.strings
                    data["offsets"] += struct.pack("<I", part.size)
                    data["strings"] += raw + b"\0"
                    part.strings, part.size = part.strings + 1, part.size + len(raw) + 1
                    if part.size >= LIMIT:
                        raise ValueError("more strings than a file can hold")
                return ids[raw]

            for r in batch.to_pylist():
                kind, word = r["kind"], r["word"]
                if word is None or kind not in RECORD:
                    raise ValueError(f"no word, or a kind that isn't known: {r}")
                raw = word.encode()
                if kind in part.last and raw <= part.last[kind]:
                    raise ValueError(f"rows must be sorted by kind and word, each word once: {word!r}")
                part.first.setdefault(kind, raw)
                part.last[kind] = raw
                part.count[kind] += 1
                said = ((ENGLISH if r["is_en"] else "") + (r["phone"] or ""),) if kind == "merged" else (r["vi_phone"], r["en_phone"])
                data[kind] += RECORD[kind].pack(number(word), *map(number, said))
            for s, stream in out.items():
                stream.write(bytes(data[s]))
        for stream in out.values():
            stream.close()
        return part

    def commit(self, messages: list[_Part | None]) -> None:
        system, name = place(self.path)
        parts = [p for p in messages if p is not None and p.strings]
        ordered = {kind: sorted((p for p in parts if p.count[kind]), key=lambda p: p.first[kind]) for kind in RECORD}
        for kind, row in ordered.items():
            if any(a.last[kind] >= b.first[kind] for a, b in zip(row, row[1:], strict=False)):
                raise ValueError("tasks must have separate ranges of words: use save_lexicon")
        ids, places, strings, size = {}, {}, 0, 0
        for p in parts:
            ids[p.name], places[p.name] = strings, size
            strings, size = strings + p.strings, size + p.size
        count = {kind: sum(p.count[kind] for p in parts) for kind in RECORD}
        offsets_at = BASE + size
        merged_at = offsets_at + 4 * strings
        common_at = merged_at + RECORD["merged"].size * count["merged"]
        if common_at + RECORD["common"].size * count["common"] >= LIMIT:
            raise ValueError("more words than a file can hold")
        whole = f"{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(whole) as out:
            out.write(HEADER.pack(MAGIC, strings, count["merged"], count["common"], offsets_at, merged_at, common_at))
            for p in parts:
                with system.open_input_stream(f"{p.name}-strings") as stream:
                    while block := stream.read(SCAN_PAGE):
                        out.write(block)
            for section, row, base in (("offsets", parts, places), *((kind, ordered[kind], ids) for kind in RECORD)):
                for p in row:
                    with system.open_input_stream(f"{p.name}-{section}") as stream:
                        for block in _numbers(stream, base[p.name]):
                            out.write(block)
        system.move(whole, name)
        self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        """The parts go; a file that was there stays."""
        system, folder = place(self.parts)
        if system.get_file_info(folder).type == files.FileType.Directory:
            system.delete_dir(folder)


class PooledLexicon(DataSource):
    """``spark.read.format("pooled_lexicon")``, and the same for ``write`` of rows in ranges (see ``save_lexicon``).

    Option ``search``: filters narrow what is read, for which the session needs ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "pooled_lexicon"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (SearchingReader if self.options.get("search") == "true" else PooledReader)(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PooledWriter(self.options["path"], overwrite)


def read_pooled(spark, path: str) -> DataFrame:
    """A file as a table. Filters on ``word`` (equal, IN, from, from and to, LIKE 'x%') and ``kind`` are pushed into it."""
    system, name = place(path)
    if system.get_file_info(name).type != files.FileType.File:
        raise FileNotFoundError(path)
    PooledFile(path, SEARCH_PAGE)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PooledLexicon)
    return spark.read.format("pooled_lexicon").option("search", "true").load(path)


def write_sorted(lexicon: DataFrame, path: str, overwrite: bool = False) -> None:
    """A lexicon, each word once, as a file: ranges of (kind, word) are sorted and written side by side."""
    lexicon.sparkSession.dataSource.register(PooledLexicon)
    ranges = lexicon.repartitionByRange("kind", "word").sortWithinPartitions("kind", "word")
    ranges.write.format("pooled_lexicon").mode("overwrite" if overwrite else "append").save(path)


def search_lexicon(words: DataFrame, path: str, word_col: str = "word") -> DataFrame:
    """The file's rows of the distinct words in ``words``: each task searches its own words, in order, so that
    neighbours share pages; what is read grows with the words, not with the file. Null words find nothing."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = PooledFile(path, SEARCH_PAGE)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            found = [row for word in batch.column(0).to_pylist() for row in file.find(word.encode())]
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "is_en" else pa.string()) for n, c in zip(names, columns, strict=True)], names=names)

    wanted = words.select(F.col(word_col).alias("word")).filter("word is not null").distinct().sortWithinPartitions("word")
    return wanted.mapInArrow(look, SCHEMA)
