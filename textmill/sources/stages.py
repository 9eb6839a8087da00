"""Stages of a pipeline that are run again only when their inputs have changed.

A stage's manifest holds a fingerprint of the contents of each input, of its
parameters and of its output.  A run whose inputs and parameters match reuses
the output; a stage whose input or output is missing is refused by name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.sources import storage


def fingerprint(rows: DataFrame) -> str:
    """16 hex digits of a table's schema and rows, whatever their order: one pass, a few numbers to the driver.

    Rows count by sums of two hashes, so that repeated rows tell as well.
    """
    names = sorted(rows.columns)
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"})
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    found = rows.agg(F.count("*").alias("n"), whole(F.xxhash64(row)).alias("x"), whole(F.xxhash64(row, F.lit(1))).alias("y")).first()
    kinds = sorted((f.name, f.dataType.simpleString()) for f in rows.schema.fields)
    return hashlib.sha256(json.dumps([kinds, [str(v) for v in found]]).encode()).hexdigest()[:16]


@dataclass
class Pipeline:
    """Named stages over Parquet tables below ``folder``; ``log`` tells what each run did."""

    spark: SparkSession
    folder: str
    reuse: bool = True
    log: list[tuple[str, str]] = field(default_factory=list)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str, stage: str = "") -> DataFrame:
        """A finished table; an error that names the stage that wants it if there is none."""
        if not storage.finished(self.spark, self.path(name)):
            raise FileNotFoundError(f"{stage or 'a reader'} needs {name}, which is not there or not finished")
        return self.spark.read.parquet(self.path(name))

    def manifest(self, name: str) -> dict | None:
        at = f"{self.path(name)}.manifest"
        if not storage.finished(self.spark, at):
            return None
        return json.loads(self.spark.read.text(at).first()["value"])

    def run(self, name: str, stage: Callable[..., DataFrame], inputs: list[str], fatal: bool = True, **parameters) -> DataFrame | None:
        """The table ``name``, made by ``stage(*inputs, **parameters)`` unless its manifest says it has been.

        An output that has been changed or lost since is made again.  With
        ``fatal`` off, an error of the stage is noted and gives nothing.
        """
        tables = [self.table(i, name) for i in inputs]
        wanted = {"inputs": {i: fingerprint(t) for i, t in zip(inputs, tables, strict=True)}, "parameters": json.loads(json.dumps(parameters, default=str))}
        held = self.manifest(name) if self.reuse else None
        if held and {k: held[k] for k in wanted} == wanted and storage.finished(self.spark, self.path(name)):
            out = self.table(name)
            if fingerprint(out) == held["output"]:
                self.log.append((name, "reused"))
                return out
        try:
            stage(*tables, **parameters).write.mode("overwrite").parquet(self.path(name))
        except Exception:
            self.log.append((name, "failed"))
            if fatal:
                raise
            return None
        out = self.table(name)
        told = json.dumps(wanted | {"output": fingerprint(out)})
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path(name)}.manifest")
        self.log.append((name, "made"))
        return out
