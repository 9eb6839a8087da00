"""Packed tokens as files of 16-bit numbers, a Spark data source.

A task writes one file under a name of its own; only when all tasks are done
does the driver put the files of the attempts that count in place and write
the manifest, which readers go by.  So a task that runs twice, or a job that
fails, leaves no token that anyone reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, SCHEMA, MANIFEST = "token_files", "group STRING, block LONG, ids ARRAY<INT>", "manifest.json"
#: Tokens that one task of a reader takes.
READ_TOKENS = 1 << 25


@dataclass
class Written(WriterCommitMessage):
    """A file, and its runs ``(group, first block, tokens)`` of blocks that follow each other."""

    file: str
    runs: list[tuple[str, int, int]]


@dataclass
class Run(InputPartition):
    file: str
    group: str
    first: int
    offset: int
    tokens: int


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    files, root = pafs.FileSystem.from_uri(path)
    return files, root.rstrip("/")


def _manifest(path: str) -> dict:
    files, root = _opened(path)
    if files.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return {"block": 0, "files": {}}
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], int(self.options["block"]), overwrite)

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(self.options["path"])


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, block: int, overwrite: bool) -> None:
        self.path, self.block, self.overwrite = path, block, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _opened(self.path)
        files.create_dir(f"{root}/_writing", recursive=True)
        name = f"tokens-{uuid.uuid4().hex}.bin"
        runs: list[tuple[str, int, int]] = []
        with files.open_output_stream(f"{root}/_writing/{name}") as out:
            for batch in iterator:
                ids = batch.column(2)
                values = ids.flatten().to_numpy(zero_copy_only=False)
                if len(values) and (values.min() < 0 or values.max() > 0xFFFF):
                    raise ValueError("a token does not fit 16 bits")
                out.write(values.astype("<u2").tobytes())
                for group, block, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids.value_lengths().to_pylist(), strict=True):
                    if n > self.block:
                        raise ValueError(f"a block of {n} tokens is longer than {self.block}")
                    last = runs[-1] if runs else None
                    if last and last[0] == group and last[2] % self.block == 0 and block == last[1] + last[2] // self.block:
                        runs[-1] = (group, last[1], last[2] + n)
                    else:
                        runs.append((group, block, n))
        return Written(name, runs)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        before = _manifest(self.path)
        if before["files"] and not self.overwrite and before["block"] != self.block:
            raise ValueError(f"these files have blocks of {before['block']}")
        done = {m.file: m.runs for m in messages if m is not None and m.runs}
        for name in done:
            files.move(f"{root}/_writing/{name}", f"{root}/{name}")
        named = done if self.overwrite else before["files"] | done
        told = {"block": self.block, "tokens": sum(n for runs in named.values() for _, _, n in runs), "files": named}
        with files.open_output_stream(f"{root}/_writing/{MANIFEST}") as out:
            out.write(json.dumps(told).encode())
        files.move(f"{root}/_writing/{MANIFEST}", f"{root}/{MANIFEST}")  # from here on the new files are the ones read
        for name in set(before["files"]) - set(named):
            files.delete_file(f"{root}/{name}")
        files.delete_dir(f"{root}/_writing")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/_writing/{m.file}")


class TokenReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Run]:
        told = _manifest(self.path)
        self.block, out = told["block"], []
        step = max(1, READ_TOKENS // max(1, told["block"])) * told["block"]
        for file, runs in told["files"].items():
            at = 0
            for group, first, tokens in runs:
                out += [Run(file, group, first + i // told["block"], at + i, min(step, tokens - i)) for i in range(0, tokens, step)]
                at += tokens
        return out or [Run("", "", 0, 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.tokens:
            return
        files, root = _opened(self.path)
        block = _manifest(self.path)["block"]
        with files.open_input_file(f"{root}/{partition.file}") as f:
            values = np.frombuffer(f.read_at(2 * partition.tokens, 2 * partition.offset), "<u2")
        starts = np.append(np.arange(0, len(values), block), len(values))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.astype(np.int32)))
        for at in range(0, len(lists), 1024):
            some = lists.slice(at, 1024)
            places = pa.array(np.arange(partition.first + at, partition.first + at + len(some)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([partition.group] * len(some), pa.string()), places, some], names=["group", "block", "ids"])


def write_tokens(blocks: DataFrame, path: str, group: str, block: int, mode: str = "overwrite") -> None:
    """Write ``(group, block, ids)`` rows, all blocks full but a group's last, sorted so that a file holds long runs of a group."""
    spark = blocks.sparkSession
    spark.dataSource.register(TokenFiles)
    rows = blocks.selectExpr(f"cast(`{group}` AS string) AS `group`", "cast(block AS long) AS block", "cast(ids AS array<int>) AS ids")
    rows.repartitionByRange("group", "block").sortWithinPartitions("group", "block").write.format(FORMAT).option("block", block).mode(mode).save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(group, block, ids)`` by the manifest; each task takes a part of a file."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).load(path)
