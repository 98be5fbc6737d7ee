"""The last event of each key, deletions included, as a log of sorted segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.operators.merge import latest
from wayfarer.sources.shared import deleted

#: Segments of one level that become one segment of the next.
FAN = 4
#: Keys of a batch that are looked up by name, so that row groups without them are skipped; and that are broadcast.
NAMED, BROADCAST = 500, 200_000


class LogTable:
    """A state table whose batches append, and whose segments are merged by size.

    A batch writes its own keys' last events as a segment of level 0. When ``FAN``
    segments have the same level, they are merged into one of the next level, so a row
    is written once for each level: what a batch writes follows the batch, times the
    logarithm of the number of batches, and not the state.

    Each batch ends with a list of the segments that are the state as of it. A batch
    that is run again after a failure starts from the list before it and writes the
    same segments and list anew. Lists and segments that neither this batch nor the one
    before needs are deleted. Deletions stay as tombstones, or a late replay of an
    older upsert would bring a key back. All of it is in ``folder``, so another
    process, or a later call, goes on from there.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, offset: str):
        self.spark, self.folder, self.key, self.offset = spark, folder, key, offset

    def numbers(self) -> list[int]:
        """Batches whose list is there; a list is there once it is complete."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/lists/*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(s.getPath().getParent().getName()) for s in found or [])

    def segments(self, number: int | None) -> list[tuple[str, int]]:
        """(name, level) of the segments that are the state as of a batch."""
        if number is None:
            return []
        rows = self.spark.read.schema("name string, level int").json(f"{self.folder}/lists/{number}").collect()  # some tens
        return sorted((r["name"], r["level"]) for r in rows if r["name"] is not None)

    def _before(self, number: int) -> int | None:
        return max((n for n in self.numbers() if n < number), default=None)

    def _read(self, names: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/segments/{n}" for n in names]) if names else None

    def _write(self, df: DataFrame, name: str) -> None:
        df.sortWithinPartitions(self.key).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/segments/{name}")

    def state(self, number: int | None = None) -> DataFrame | None:
        """All keys' last events as of a batch, by default of the last one."""
        number = max(self.numbers(), default=None) if number is None else number
        found = self._read([name for name, _ in self.segments(number)])
        return None if found is None else latest(found, self.key, self.offset)

    def before(self, number: int, keys: DataFrame) -> DataFrame | None:
        """The last events of some keys before a batch; other keys' rows are left out before anything is shuffled."""
        found = self._read([name for name, _ in self.segments(self._before(number))])
        if found is None:
            return None
        keys = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        some = [r[0] for r in keys.limit(BROADCAST + 1).collect()]
        if len(some) <= NAMED:
            found = found.where(F.col(self.key).isin(some))
        else:
            found = found.join(F.broadcast(keys) if len(some) <= BROADCAST else keys, self.key, "left_semi")
        return latest(found, self.key, self.offset)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take in a batch; ``number`` grows from batch to batch."""
        before = self._before(number)
        held = self.segments(before)
        name = f"{number:012d}-0"
        self._write(latest(batch, self.key, self.offset), name)
        held.append((name, 0))
        level, made = 0, {name}
        while len(same := [n for n, at in held if at == level]) >= FAN:
            level += 1
            name = f"{number:012d}-{level}"
            self._write(latest(self._read(same), self.key, self.offset), name)
            held = [s for s in held if s[1] != level - 1] + [(name, level)]
            made.add(name)
        self.spark.createDataFrame(held, "name string, level int").coalesce(1).write.mode("overwrite").json(f"{self.folder}/lists/{number}")
        # A batch that runs again needs the list before it; what only older ones name goes.
        needed = {n for n, _ in held} | {n for n, _ in self.segments(before)}
        for gone in made - needed:  # merged at once
            deleted(self.spark, f"{self.folder}/segments/{gone}")
        for old in [n for n in self.numbers() if before is not None and n < before]:
            for gone in {n for n, _ in self.segments(old)} - needed:
                deleted(self.spark, f"{self.folder}/segments/{gone}")
            deleted(self.spark, f"{self.folder}/lists/{old}")


def current(table: LogTable, gone: Column) -> DataFrame | None:
    """The rows of the last batch's state that aren't deletions."""
    found = table.state()
    return None if found is None else found.where(~gone)
