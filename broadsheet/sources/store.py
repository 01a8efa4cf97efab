"""Several tables that change together: versioned commits, keyed tables in buckets, changes between versions, retention."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Key = str | list[str]


def _columns(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


#: The column that names a row's bucket, a folder of a part; the one that tells a deleted row.
BUCKET, GONE = "_bucket", "_gone"


class Store:
    """A commit writes new files beside the old ones and then one manifest under the next number, by a rename; the
    highest number is the state. A failure before the rename leaves the old state, and of two commits at once
    the second fails, on file systems where a rename doesn't replace a file. (An object store needs a writer
    that creates the manifest exclusively in its place.)

    A table is a list of parts. ``commit(name=df)`` replaces it; ``upsert`` adds a part whose rows take the place
    of older rows with the same key, so that a small change writes little. A table begun with ``keyed`` is laid
    out by a hash of its key in ``16 ** digits`` buckets, a folder each; its manifest entry lists the buckets of
    each part, so a read ``among`` given keys opens the folders of their buckets and lists no others. Its parts are
    merged by size, and a deletion is a row that says so, until it is merged with the oldest part: a part never stands before one that has over half its rows, so there are as many
    parts as the table's size has doublings, and a row is written anew that often at most. A key may be several
    columns; the first of them decides the bucket."""

    #: Parts after which an upsert writes a table without buckets anew.
    PARTS = 16
    #: Keys that a join may send to every task. More are shuffled: Spark goes by their bytes as compressed files, of
    #: which sorted keys take few, and builds the table of a broadcast in the driver.
    SENT = 100_000

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of the commits that can be read, oldest first."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(self._path(self.root)))
        return sorted(int(n.removeprefix("MANIFEST-")) for n in names if n.removeprefix("MANIFEST-").isdigit())

    def _entries(self, version: int | None = None) -> dict:
        numbers = self.versions()
        if version is None:
            version = numbers[-1] if numbers else None
        elif version not in numbers:
            raise ValueError(f"version {version} was never committed, or retention has removed it")
        if version is None:
            return {"tables": {}, "keyed": {}, "parts": {}, "marks": {}}
        return json.loads(self.spark.read.text(f"{self.root}/MANIFEST-{version:012d}", wholetext=True).first()[0])

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """The parts of each table."""
        return self._entries(version)["tables"]

    def mark(self, name: str) -> int | None:
        """A number that was committed along with tables, such as a stream's batch."""
        return self._entries()["marks"].get(name)

    def keys(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """A side of a join by key, which isn't broadcast unless it is known to have few ``rows``."""
        return df if rows is not None and rows <= self.SENT else df.hint("merge")

    def rows(self, name: str, version: int | None = None, without: Iterable[str] = ()) -> int | None:
        """Rows and deletions in the parts of a keyed table, but for some parts; None where they weren't counted."""
        entries = self._entries(version)
        return self._count(entries, [p for p in entries["tables"][name] if p not in without])

    @staticmethod
    def _count(entries: dict, parts: Iterable[str]) -> int | None:
        counted = [entries["parts"].get(part) for part in parts]
        return None if None in counted else sum(about["rows"] for about in counted)

    def _bucket(self, key: Key, digits: int) -> Column:
        return F.right(F.lpad(F.hex(F.xxhash64(_columns(key)[0])), 16, "0"), F.lit(digits))

    def _part(self, entries: dict, part: str, buckets: set[str] | None) -> DataFrame | None:
        """A part, or what it holds of some buckets; None if it has none of them."""
        path = f"{self.root}/{part}"
        about = entries["parts"].get(part)
        if about is None:
            return self.spark.read.parquet(path)
        own = about["buckets"] if buckets is None else [b for b in about["buckets"] if b in buckets]
        if not own:
            return None
        schema = f"{about['schema']}, {BUCKET} string"
        paths = [path] if len(own) == len(about["buckets"]) else [f"{path}/{BUCKET}={b}" for b in own]
        return self.spark.read.schema(schema).option("basePath", path).parquet(*paths).drop(BUCKET)

    def _latest(self, entries: dict, parts: Iterable[str], key: Key | None, buckets: set[str] | None = None, gone: bool = False) -> DataFrame | None:
        """The rows of parts, oldest first, of which a later row with the same key takes the place; ``gone``: with deletions."""
        frames = [(part, df) for part in parts if (df := self._part(entries, part, buckets)) is not None]
        out, later, seen = None, None, []
        for part, df in reversed(frames):
            kept = df if later is None else df.join(self.keys(later, self._count(entries, seen)), _columns(key), "left_anti")
            out = kept if out is None else kept.unionByName(out)
            seen.append(part)
            if key is not None:
                later = df.select(*_columns(key)) if later is None else later.union(df.select(*_columns(key)))
        return out if out is None or gone or GONE not in out.columns else out.where(~F.col(GONE)).drop(GONE)

    def read(self, name: str, key: Key | None = None, among: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """A table at a version (the last one, unless told). ``key``: that of its upserts, if it has any. ``among``: a
        table with the key; of a keyed table, only the buckets of its keys are read, of others all."""
        entries = self._entries(version)
        key, digits = entries["keyed"].get(name, (key, 0))
        buckets = None
        if among is not None and digits:
            # As many as there are buckets, at most.
            buckets = {r.b for r in among.select(self._bucket(key, digits).alias("b")).distinct().collect()}
        out = self._latest(entries, entries["tables"][name], key, buckets)
        if out is None:
            about = entries["parts"][entries["tables"][name][0]]
            return self.spark.createDataFrame([], about["schema"]).drop(GONE)
        return out

    def _write(self, entries: dict, name: str, df: DataFrame) -> tuple[str, int]:
        """Writes a part; of a keyed table, in buckets. Returns its name and, of a keyed table, its rows."""
        part = f"{name}-{uuid.uuid4().hex}"
        if name not in entries["keyed"]:
            df.write.parquet(f"{self.root}/{part}")
            return part, 0
        key, digits = entries["keyed"][name]
        df = df if GONE in df.columns else df.withColumn(GONE, F.lit(False))
        df.withColumn(BUCKET, self._bucket(key, digits)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *_columns(key)).write.partitionBy(BUCKET).parquet(f"{self.root}/{part}")
        names = (x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/{part}")))
        buckets = sorted(n.removeprefix(f"{BUCKET}=") for n in names if n.startswith(f"{BUCKET}="))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        entries["parts"][part] = {"buckets": buckets, "schema": schema, "rows": 0}
        if not buckets:
            return part, 0
        rows = entries["parts"][part]["rows"] = self._part(entries, part, None).count()  # from the files' footers
        return part, rows

    def _upsert(self, entries: dict, name: str, key: Key, df: DataFrame | None, gone: DataFrame | None) -> None:
        """Adds rows and deletions of keys."""
        parts = entries["tables"][name]
        if name not in entries["keyed"]:
            if gone is not None or len(parts) >= self.PARTS:
                old = self._latest(entries, parts, key)
                new = old.limit(0) if df is None else df
                for keys in (new, gone):
                    old = old if keys is None else old.join(keys.select(*_columns(key)), _columns(key), "left_anti")
                df, parts = old.unionByName(new), []
            entries["tables"][name] = [*parts, self._write(entries, name, df)[0]]
            return
        rows = None if df is None else df.withColumn(GONE, F.lit(False))
        if gone is not None:
            dead = gone.select(*_columns(key)).distinct().withColumn(GONE, F.lit(True))
            # A row that is deleted and upserted at once stays.
            dead = dead if rows is None else dead.join(self.keys(rows.select(*_columns(key))), _columns(key), "left_anti")
            rows = (self._part(entries, parts[0], None).limit(0) if rows is None else rows).unionByName(dead, allowMissingColumns=True)
        part, n = self._write(entries, name, rows)
        if not n:
            del entries["parts"][part]
            return
        parts = [*parts, part]
        while len(parts) > 1 and entries["parts"][parts[-2]]["rows"] < 2 * entries["parts"][parts[-1]]["rows"]:
            merged, _ = self._write(entries, name, self._latest(entries, parts[-2:], key, gone=len(parts) > 2))
            for old in parts[-2:]:
                del entries["parts"][old]
            parts = [*parts[:-2], merged]
        entries["tables"][name] = parts

    def commit(self, upsert: dict[str, tuple[Key, DataFrame]] | None = None, keyed: dict[str, tuple[Key, DataFrame]] | None = None, delete: dict[str, tuple[Key, DataFrame]] | None = None, marks: dict[str, int] | None = None, digits: int = 3, **tables: DataFrame) -> int:
        """Replaces ``tables``, begins or replaces ``keyed`` tables (key, rows), upserts (key, rows) and deletes (key, keys)
        of others and sets marks, in one step. Returns the number of the version."""
        numbers, entries = self.versions(), self._entries()
        for name in dict.fromkeys([*(upsert or {}), *(delete or {})]):
            key = (upsert or delete).get(name, (delete or {}).get(name))[0]
            self._upsert(entries, name, key, *((d or {}).get(name, (key, None))[1] for d in (upsert, delete)))
        for name in [*(keyed or {}), *tables]:
            for part in entries["tables"].pop(name, []):
                entries["parts"].pop(part, None)
            entries["keyed"].pop(name, None)
        for name, (key, df) in (keyed or {}).items():
            entries["keyed"][name] = (key, digits)
            entries["tables"][name] = [self._write(entries, name, df)[0]]
        for name, df in tables.items():
            entries["tables"][name] = [self._write(entries, name, df)[0]]
        entries["marks"] |= marks or {}
        number = numbers[-1] + 1 if numbers else 1
        self._publish(number, uuid.uuid4().hex, json.dumps(entries))
        return number

    def _publish(self, number: int, version: str, text: str) -> None:
        fresh = self._path(f"{self.root}/.manifest-{version}")
        out = self._fs.create(fresh)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(f"{self.root}/MANIFEST-{number:012d}")
        if self._fs.exists(target) or not self._fs.rename(fresh, target):
            raise RuntimeError(f"another commit came first: {target}")

    def changes(self, name: str, key: Key, old: int, new: int | None = None) -> DataFrame:
        """(key, change, before, after) of the rows that differ between two versions: ``insert``, ``delete`` or
        ``update``, with the rows as structs. Parts that both versions have are compared with nothing: only keys of
        the other parts can have changed, and of a keyed table only their buckets are read."""
        a, b = self._entries(old), self._entries(new)
        shared = set(a["tables"][name]) & set(b["tables"][name])
        keys, on = None, _columns(key)
        for entries in (a, b):
            for part in entries["tables"][name]:
                if part not in shared:
                    own = self._part(entries, part, None)
                    if own is not None:
                        keys = own.select(*on) if keys is None else keys.union(own.select(*on))
        if keys is None:
            keys = self.read(name, key, version=new).select(*on).limit(0)
        touched, counts, sides = keys.distinct(), [self.rows(name, version, shared) for version in (old, new)], []
        own = self.keys(touched, None if None in counts else sum(counts))
        for version, side in ((old, "before"), (new, "after")):
            rows = self.read(name, key, touched, version).join(own, on, "left_semi")
            sides.append(rows.select(*on, F.struct(*rows.columns).alias(side)))
        both = sides[0].join(sides[1], on, "full")
        kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
        return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(*on, kind.alias("change"), "before", "after")

    def vacuum(self, keep: int = 2, grace: float = 86_400.0) -> list[str]:
        """Forgets all but the last ``keep`` versions and removes the parts that none of those has. Readers of a
        version that is kept aren't disturbed. What is younger than ``grace`` seconds stays, since a commit may
        be about to publish it. Returns the parts removed."""
        numbers = self.versions()
        kept = set()
        for number in numbers[-keep:]:
            kept.update(part for parts in self.manifest(number).values() for part in parts)
        for number in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/MANIFEST-{number:012d}"), False)
        gone, young = [], (time.time() - grace) * 1000
        for x in self._fs.listStatus(self._path(self.root)) if numbers else []:
            name = x.getPath().getName()
            stray = x.isDirectory() and name not in kept or name.startswith(".manifest-")
            if stray and x.getModificationTime() <= young:
                self._fs.delete(x.getPath(), True)
                gone.append(name)
        return sorted(gone)
