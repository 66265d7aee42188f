"""A sink ``caption_json``: records as JSON lines by all tasks, and one header that counts what they have written.

Rows are read once: each task counts as it writes, and the driver puts the counts into the header when all tasks are
done. If one fails for good, what was written goes away and there is no header. A task that is killed may leave a file
behind; no header names it, and the next overwrite takes it away.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

HEADER = "info.json"


@dataclass
class Written(WriterCommitMessage):
    file: str
    counts: dict


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class CaptionWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = options["path"].rstrip("/"), names, overwrite
        self.counted = options.get("counted", "rule")
        self.info = {k: options.get(k.replace("_", ""), options.get(k)) for k in ("description", "source_questions", "source_annotations")}
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        """One task's rows, in a file of its own."""
        files, root = _opened(self.path)
        name, counts = f"annotations-{self.run}-{uuid.uuid4().hex}.json", Counter()
        files.create_dir(root, recursive=True)
        try:
            with files.open_output_stream(f"{root}/{name}") as out:
                for row in iterator:
                    record = row.asDict(recursive=True)
                    counts[record.get(self.counted)] += 1
                    out.write(json.dumps(record, ensure_ascii=False, default=str).encode() + b"\n")
        except BaseException:
            files.delete_file(f"{root}/{name}")
            raise
        return Written(name, dict(counts))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        done, total = [m for m in messages if m is not None], Counter()
        for m in done:
            total.update(m.counts)
        kept = {m.file for m in done} | ({HEADER} if not self.overwrite else set())
        for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            stale = self.overwrite or self.run in f.base_name  # files of tries that were given up, or of an older result
            if f.base_name not in kept and stale:
                files.delete_file(f.path)
        head = self.info | {"num_samples": sum(total.values()), "rule_counts": {str(k): n for k, n in sorted(total.items(), key=lambda kn: str(kn[0]))}, "files": sorted(m.file for m in done)}
        with files.open_output_stream(f"{root}/{HEADER}") as out:  # the last step: a result without it is none
            out.write(json.dumps(head, ensure_ascii=False).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if self.run in f.base_name:
                files.delete_file(f.path)


class CaptionSink(DataSource):
    """``df.write.format("caption_json").option("path", ...)``; options: counted (column, ``rule``), description, source_questions,
    source_annotations. ``path`` is a folder that all executors share. Mode ``overwrite`` replaces an older result."""

    @classmethod
    def name(cls) -> str:
        return "caption_json"

    def schema(self) -> str:
        return "record string"  # written only

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not self.options.get("path"):
            raise ValueError("caption_json needs a path")
        return CaptionWriter(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptionSink)
