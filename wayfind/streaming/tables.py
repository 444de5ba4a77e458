"""Keyed tables in hash buckets for streams that run for long.

A batch reads and rewrites only the buckets its keys fall in, as files of its own version: `table/batch=7/bucket=3`. A manifest
per committed batch says which version of each bucket holds. What a batch writes is of no account before its manifest is there,
and it reads by the manifest before it; so a batch that died between two tables is simply run again. Versions that neither of
the last two manifests names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Versions = dict[str, dict[int, int]]


class Files:
    """The few things done with folders themselves, in whatever store they lie."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def names(self, path: str) -> list[str]:
        p, fs = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def remove(self, path: str) -> None:
        p, fs = self.at(path)
        fs.delete(p, True)

    def put(self, path: str, text: str) -> None:
        """Whole or not at all: written beside, then renamed."""
        p, fs = self.at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(path + ".new")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(p, False)
        fs.rename(beside, p)

    def get(self, path: str) -> str:
        p, fs = self.at(path)
        source = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()


class KeyedTables:
    """Tables by name: schema and the columns whose hash is the bucket."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, tuple[str, ...]]], buckets: int = 64) -> None:
        self.spark, self.root, self.tables, self.buckets, self.files = spark, root.rstrip("/"), tables, buckets, Files(spark)

    def bucket(self, table: str, **instead: Column) -> Column:
        """The bucket of a row; columns may be given under the key columns' names."""
        keys = [instead.get(c, F.col(c)).cast("string") for c in self.tables[table][1]]
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _commits(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.root}/commits") if n.isdigit())

    def _manifest(self, n: int) -> Versions:
        held = json.loads(self.files.get(f"{self.root}/commits/{n}"))
        return {t: {int(b): v for b, v in own.items()} for t, own in held.items()}

    def last(self, before: int | None = None) -> tuple[int, Versions]:
        """The last committed batch (of those before one), -1 if none, and its manifest."""
        done = [n for n in self._commits() if before is None or n < before]
        return (done[-1], self._manifest(done[-1])) if done else (-1, {})

    def read(self, table: str, versions: Versions, buckets: Iterable[int] | None = None) -> DataFrame:
        own = versions.get(table, {})
        wanted = own if buckets is None else {b: own[b] for b in buckets if b in own}
        schema = self.tables[table][0]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/batch={v}/bucket={b}" for b, v in sorted(wanted.items())])

    def write(self, table: str, n: int, rows: DataFrame, touched: Iterable[int]) -> dict[int, int]:
        """Writes what the touched buckets hold after batch n; gives the version of each that is not empty."""
        path = f"{self.root}/{table}/batch={n}"
        if not (touched := set(touched)):
            return {}
        columns = [f.name for f in self.spark.createDataFrame([], self.tables[table][0]).schema.fields]
        rows.select(*columns, self.bucket(table).alias("bucket")).repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(path)
        found = {int(name.split("=")[1]) for name in self.files.names(path) if name.startswith("bucket=")}
        if not found <= touched:
            raise ValueError(f"{table}: rows in buckets that batch {n} did not read")
        return dict.fromkeys(found, n)

    def commit(self, n: int, before: Versions, changed: dict[str, tuple[Iterable[int], dict[int, int]]]) -> None:
        """Makes the batch's versions hold: of each changed table the touched buckets and what write gave for them. Then removes what is not named any more."""
        after = {t: dict(own) for t, own in before.items()}
        for table, (touched, versions) in changed.items():
            own = after.setdefault(table, {})
            for b in touched:
                own.pop(b, None)
            own.update(versions)
        self.files.put(f"{self.root}/commits/{n}", json.dumps(after))
        *older, last = [k for k in self._commits() if k < n] or [-1]
        for k in older:
            kept = [after] + ([self._manifest(last)] if last >= 0 else [])
            for table, own in self._manifest(k).items():
                for b, v in own.items():
                    if all(m.get(table, {}).get(b) != v for m in kept):
                        self.files.remove(f"{self.root}/{table}/batch={v}/bucket={b}")
            self.files.remove(f"{self.root}/commits/{k}")
