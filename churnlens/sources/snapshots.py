"""Tables made of versions: a write never touches what readers use.

A table is a folder with ``data/<part>-<id>`` folders of Parquet files and ``_snapshots/<number>``, small text files
that each name the folders of one state of the table, one line per part. Writing a part puts its files into a folder of its own
and then adds the next snapshot by one rename; readers take the highest number. So a part, the rows of one source say, is replaced without
reading or moving the others, and a write that is killed at any point leaves the table as it was.
Two writers that meet on one number: the second fails and may try again. Old folders go with :meth:`Snapshots.vacuum`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

WHOLE = "all"


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._paths(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._at("_snapshots")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("_snapshots"))]
        return sorted(int(n) for n in names if n.isdigit())

    def parts(self, number: int | None = None) -> dict[str, str]:
        """part -> folder, of the newest state or the one given; empty if there is none."""
        number = number if number is not None else max(self.numbers(), default=None)
        if number is None:
            return {}
        stream = self._fs.open(self._at(f"_snapshots/{number:012d}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return dict(line.split("\t") for line in text.splitlines())

    def exists(self) -> bool:
        return bool(self.numbers())

    def read(self) -> DataFrame:
        folders = sorted(set(self.parts().values()))
        if not folders:
            raise FileNotFoundError(f"{self.path} has no snapshot")
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders])

    def write_part(self, df: DataFrame, part: str) -> str:
        """The rows as a new folder, which no reader sees until :meth:`switch`."""
        folder = f"{part}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def switch(self, parts: dict[str, str], after: int) -> None:
        """Make ``parts`` the table's state, if ``after`` is still the newest snapshot (0: there is none)."""
        target = self._at(f"_snapshots/{after + 1:012d}")
        made = self._at(f"_snapshots/.{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        try:
            out.write("".join(f"{p}\t{f}\n" for p, f in sorted(parts.items())).encode())
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(made, target):
            self._fs.delete(made, False)
            raise RuntimeError(f"{self.path}: another writer made snapshot {after + 1} first")

    def replace(self, df: DataFrame) -> None:
        """The whole table becomes ``df``."""
        after = max(self.numbers(), default=0)
        self.switch({WHOLE: self.write_part(df, WHOLE)}, after)

    def replace_part(self, df: DataFrame, part: str) -> None:
        """The part's rows become ``df``; other parts stay as they are."""
        after = max(self.numbers(), default=0)
        folder = self.write_part(df, part)
        self.switch({**self.parts(after or None), part: folder}, after)

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the newest ``keep`` states and the folders that only older ones name; not while a write runs."""
        numbers = self.numbers()
        kept = {f for n in numbers[-keep:] for f in self.parts(n).values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._at(f"_snapshots/{n:012d}"), False)
        if self._fs.exists(self._at("data")):
            for s in self._fs.listStatus(self._at("data")):
                if s.getPath().getName() not in kept:
                    self._fs.delete(s.getPath(), True)
