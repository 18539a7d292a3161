"""Tables that grow part by part, each part entering once and at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T


class CommittedTable:
    """Parquet parts under names; a log entry says which folder holds each name's part.

    A part is written to a folder nobody reads yet and then published by
    renaming one small file, so readers see it whole or not at all.  A name
    that is committed again takes the place of its earlier part: a run that
    was killed and starts over changes nothing.  One writer at a time.  The log
    entry grows with the number of parts, not with their rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def _entries(self) -> list[str]:
        log = self._at("_log")
        if not self._fs.exists(log):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json"))

    def parts(self) -> dict[str, str]:
        """Folder of each published part."""
        entries = self._entries()
        if not entries:
            return {}
        stream = self._fs.open(self._at(f"_log/{entries[-1]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, parts: dict[str, str]) -> None:
        entries = self._entries()
        number = int(entries[-1].removesuffix(".json")) + 1 if entries else 0
        draft = self._at(f"_log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if not self._fs.rename(draft, self._at(f"_log/{number:012d}.json")):
            raise RuntimeError(f"{self.path}: entry {number} was written by somebody else")

    def commit(self, name: str, part: DataFrame) -> None:
        """Write ``part`` and publish it under ``name``."""
        folder = f"parts/{uuid.uuid4().hex}"
        part.write.parquet(f"{self.path}/{folder}")
        self._publish({**self.parts(), name: folder})

    def read(self, schema: T.StructType | str, without: str | None = None) -> DataFrame:
        """All published parts, or all but one; an unwritten table is empty."""
        folders = [f"{self.path}/{f}" for n, f in self.parts().items() if n != without]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def clean(self) -> None:
        """Delete folders that no name holds any more: replaced parts and what killed runs left.  Nobody may be reading them."""
        kept = {f.rpartition("/")[2] for f in self.parts().values()}
        if self._fs.exists(self._at("parts")):
            for s in self._fs.listStatus(self._at("parts")):
                if s.getPath().getName() not in kept:
                    self._fs.delete(s.getPath(), True)
        for entry in self._entries()[:-1]:
            self._fs.delete(self._at(f"_log/{entry}"), False)
