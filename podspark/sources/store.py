"""Several tables that change together: buckets written aside, and one small file that makes them count.

A table is Parquet in hash buckets of its key.  A commit never touches what is there: the buckets it
changes are written into a folder of their own, and a ledger file ``commits/NNN.json`` then says, for
every bucket of every table, which folder holds it.  That file appears by a rename, so all tables of a
commit change at once; a run that breaks off before leaves only folders that nothing names.  The ledger
also holds the last batch of each stream, so a batch that is sent again is left out, and marks: how far
a job has read the changes of its inputs.

Every stored row carries the version of the commit that brought or changed it.  A bucket whose rows are
the same as before is not committed, so a run without news changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Collection, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podspark.sources.tables import BUCKETS, bucket_of, empty, remove

VERSION = "_version"


class Snapshot(NamedTuple):
    """What the ledger says at one version."""

    version: int
    #: By table and bucket number (as text), the folder that holds the bucket.
    folders: dict[str, dict[str, str]]
    marks: dict[str, int]
    batches: dict[str, int]


class Change(NamedTuple):
    """All rows that the buckets ``numbers`` of a table hold from now on."""

    rows: DataFrame
    numbers: list[int]


class Store:
    """Tables ``{name: (schema, key)}`` below ``root``."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, tuple[str, str]], buckets: int = BUCKETS):
        self.spark, self.root, self.tables, self.buckets = spark, root, dict(tables), buckets

    # ------------------------------------------------------------ the ledger

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of all commits, in order."""
        files, folder = self._files(), self._path("commits")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in names) if m)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The state after the last commit, or after an earlier one that has not been cleared."""
        known = self.versions()
        if version is None:
            if not known:
                return Snapshot(0, {}, {}, {})
            version = known[-1]
        lines = self.spark.read.text(f"{self.root}/commits/{version:020d}.json", wholetext=True).collect()
        return Snapshot(**json.loads(lines[0][0]))

    def _publish(self, snapshot: Snapshot) -> None:
        """The ledger file appears whole or not at all; of two runs with the same number one fails."""
        files = self._files()
        files.mkdirs(self._path("commits"))
        draft, final = self._path(f"commits/.{uuid.uuid4()}"), self._path(f"commits/{snapshot.version:020d}.json")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(snapshot._asdict()).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise RuntimeError(f"another run has committed version {snapshot.version}")

    # ------------------------------------------------------------ reading

    def _read(self, snapshot: Snapshot, name: str, numbers: list[int] | None = None) -> DataFrame:
        schema, _ = self.tables[name]
        held = snapshot.folders.get(name, {})
        paths = [f"{self.root}/{name}/{folder}/bucket={n}" for n, folder in held.items() if numbers is None or int(n) in numbers]
        schema = f"{schema}, {VERSION} bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else empty(self.spark, schema)

    def read(self, name: str, snapshot: Snapshot | None = None, numbers: list[int] | None = None) -> DataFrame:
        return self._read(snapshot or self.snapshot(), name, numbers).drop(VERSION)

    def numbers(self, keys: DataFrame, key: str) -> list[int]:
        """The buckets of the keys in a column; at most as many as there are buckets."""
        return sorted(r[0] for r in keys.select(bucket_of(F.col(key), self.buckets)).distinct().collect())

    def touched(self, snapshot: Snapshot, name: str, keys: DataFrame) -> Change:
        """The rows of the buckets that hold any of ``keys`` (a column named as the table's key), and their numbers."""
        numbers = self.numbers(keys, self.tables[name][1])
        return Change(self.read(name, snapshot, numbers), numbers)

    def changes(self, snapshot: Snapshot, name: str, above: int) -> DataFrame:
        """Rows brought or changed by commits after version ``above``; buckets without such are not read."""
        later = [int(n) for n, folder in snapshot.folders.get(name, {}).items() if int(folder.partition("-")[0]) > above]
        return self._read(snapshot, name, later).filter(F.col(VERSION) > above).drop(VERSION)

    # ------------------------------------------------------------ writing

    def _stage(self, snapshot: Snapshot, name: str, change: Change, folder: str) -> dict[str, str]:
        """Writes the buckets aside; returns where every bucket of the table is if this is committed."""
        schema, key = self.tables[name]
        version = snapshot.version + 1
        held = dict(snapshot.folders.get(name, {}))
        columns = empty(self.spark, schema).columns
        marked = lambda df, new: df.withColumns({"bucket": bucket_of(F.col(key), self.buckets), "_a": F.xxhash64(*columns), "_b": F.xxhash64(F.lit(1), *columns), "_new": F.lit(new)})
        old = marked(self._read(snapshot, name, change.numbers), False).select("bucket", "_a", "_b", "_new", VERSION)
        new = marked(change.rows.select(*columns), True).withColumn(VERSION, F.lit(version).cast("bigint"))
        if any(str(n) in held for n in change.numbers):
            # One shuffle, by bucket: equal rows meet in it, and what was there before keeps its version.
            same = Window.partitionBy("bucket", "_a", "_b")
            both = new.unionByName(old, allowMissingColumns=True).repartition("bucket")
            both = both.withColumn(VERSION, F.coalesce(F.max(F.when(~F.col("_new"), F.col(VERSION))).over(same), F.col(VERSION)))
        else:
            both = new.repartition("bucket")
        path = f"{self.root}/{name}/{folder}"
        both.filter("_new").select(*columns, VERSION, "_a", "bucket").write.partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(f"_a bigint, {VERSION} bigint, bucket int").parquet(path).withColumn("_new", F.lit(True))
        counts = written.unionByName(old.drop("_b")).groupBy("bucket", "_new").agg(F.count("*").alias("n"), F.sum(F.col("_a").cast("decimal(38,0)")).alias("sum"), F.max(VERSION).alias("last")).collect()
        now, was = ({r.bucket: r for r in counts if r["_new"] == new} for new in (True, False))
        for number in change.numbers:
            after, before = now.get(number), was.get(number)
            if after is None:
                held.pop(str(number), None)
            elif before is None or after.last == version or (after.n, after.sum) != (before.n, before.sum):
                held[str(number)] = folder
            else:
                remove(self.spark, f"{path}/bucket={number}")
        return held

    def commit(self, snapshot: Snapshot, changes: Mapping[str, Change], marks: Collection[str] = (), batch: tuple[str, int] | None = None) -> Snapshot:
        """All changes as one version on top of ``snapshot``; returns what holds from now on.

        ``marks`` then stand at the new version.  If neither a bucket, a mark nor a batch changes, nothing is committed.
        """
        version = snapshot.version + 1
        folder = f"{version:020d}-{uuid.uuid4()}"
        some = {name: change for name, change in changes.items() if change.numbers}
        # One table after the other: each is a job of all executors, and the driver holds the plans of one only.
        folders = snapshot.folders | {name: self._stage(snapshot, name, change, folder) for name, change in some.items()}
        folders = {name: held for name, held in folders.items() if held}
        batches = snapshot.batches | ({batch[0]: batch[1]} if batch else {})
        if (folders, batches) == (snapshot.folders, snapshot.batches) and not marks:
            return snapshot
        after = Snapshot(version, folders, snapshot.marks | dict.fromkeys(marks, version), batches)
        self._publish(after)
        return after

    def unseen(self, snapshot: Snapshot, name: str, mark: str) -> bool:
        """Whether a table has buckets that changed after the mark; reads the ledger only."""
        return any(int(f.partition("-")[0]) > snapshot.marks.get(mark, 0) for f in snapshot.folders.get(name, {}).values())

    def done(self, snapshot: Snapshot, batch: tuple[str, int]) -> bool:
        """Whether this batch of a stream has been committed."""
        return snapshot.batches.get(batch[0], -1) >= batch[1]

    def clear(self, keep: int = 1) -> None:
        """Deletes ledger files but the last ``keep``, and all folders that none of those names; readers of older states must be done."""
        files, known = self._files(), self.versions()
        named = {f"{name}/{folder}" for v in known[-keep:] for name, held in self.snapshot(v).folders.items() for folder in held.values()}
        for v in known[:-keep]:
            remove(self.spark, f"{self.root}/commits/{v:020d}.json")
        for name in self.tables:
            if files.exists(self._path(name)):
                for status in files.listStatus(self._path(name)):
                    if f"{name}/{status.getPath().getName()}" not in named:
                        files.delete(status.getPath(), True)
