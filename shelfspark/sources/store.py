"""Tables of fixed columns in buckets, changed by snapshots, and the passage table among them."""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats as fm

SCHEMA = "id string, book_id string, title string, author string, source_path string, format string, chapter string, page long, loc_start long, loc_end long, text string, vector array<float>"
META = ("id", "book_id", "title", "author", "source_path", "format", "chapter")
#: Buckets of a table. A change of few keys rewrites few of them.
BUCKETS = 256
#: Bits of the filter that a folder has for a column; folders of a bucket beyond which it is compacted, and the size that makes a folder
#: large enough to be left alone; snapshots that stay.
FILTER_BITS, MOST_FOLDERS, TARGET_BYTES, KEEP = 32_768, 4, 128 << 20, 3


class Files:
    """What is done to files and folders, by Hadoop's file systems, so on any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def fs(self):
        return self.at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, *parts: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs().listStatus(self.at(*parts))) if self.fs().exists(self.at(*parts)) else []

    def read_text(self, *parts: str) -> str:
        stream = self.fs().open(self.at(*parts))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, text: str, *parts: str, overwrite: bool = False) -> bool:
        """Write a file in one step; False if it is there already and not to be overwritten."""
        temporary, target = self.at(*parts[:-1], f".{uuid.uuid4().hex}"), self.at(*parts)
        out = self.fs().create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs().exists(target):
            if not overwrite:
                self.fs().delete(temporary, False)
                return False
            self.fs().delete(target, False)
        return bool(self.fs().rename(temporary, target))

    def lock(self, *parts: str) -> bool:
        """Make an empty file; False if it is there already. The store decides between two who try at once."""
        self.fs().mkdirs(self.at(*parts[:-1]))
        try:
            return bool(self.fs().createNewFile(self.at(*parts)))
        except Exception:  # some stores raise instead
            return False

    def delete(self, *parts: str) -> None:
        self.fs().delete(self.at(*parts), True)

    def sizes(self, *parts: str) -> dict[str, int]:
        """The bytes below each folder of a folder."""
        return {n: self.fs().getContentSummary(self.at(*parts, n)).getLength() for n in self.names(*parts)}


class Stale(RuntimeError):
    """Another writer changed the same buckets in the meantime."""


@dataclass(frozen=True)
class Folder:
    """A folder of a bucket, its size, and for some columns the bits of the hashes of their values."""

    name: str
    size: int = 0
    keys: dict[str, str] = field(default_factory=dict)

    def bits(self, column: str) -> bytes | None:
        return zlib.decompress(base64.b64decode(self.keys[column])) if column in self.keys else None


def packed(folders: list[Folder], target: int) -> list[list[Folder]]:
    """Folders in bins of the target size, the largest first into the first bin with room; those that are large enough stay alone."""
    bins: list[tuple[int, list[Folder]]] = []
    for f in sorted(folders, key=lambda f: (-f.size, f.name)):
        for i, (size, held) in enumerate(bins):
            if size + f.size <= target:
                bins[i] = size + f.size, [*held, f]
                break
        else:
            bins.append((f.size, [f]))
    return [held for _, held in bins]


Folders = dict[int, list[Folder]]


class Table:
    """A table whose rows lie in buckets by a hash of one column.

    A snapshot is a file that names the folders of each bucket, with filters of the columns by
    which rows are looked up. A change writes the buckets that it touches into new folders, and then the next
    snapshot, so that readers and a job that fails half way never see a mixture, and work does not grow
    with the buckets that stay. Only one writer can write a number's snapshot; the other sees whether its buckets still
    stand as they were, and then goes on from the newer snapshot.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str, buckets: int = BUCKETS, filters: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.by, self.buckets, self.filters = spark, path.rstrip("/"), schema, by, buckets, filters
        self.files = Files(spark, path)
        self.columns = [x.split()[0] for x in schema.split(", ")]

    def snapshots(self) -> list[str]:
        return sorted((n for n in self.files.names("snapshots") if n.endswith(".json")), key=self._number)

    @staticmethod
    def _number(name: str) -> int:
        return int(re.match(r"\d+", name)[0])

    def _parsed(self, name: str) -> Folders:
        held = json.loads(self.files.read_text("snapshots", name))
        return {int(k): [Folder(**f) if isinstance(f, dict) else Folder(f) for f in v] for k, v in held.items()}

    def snapshot(self) -> tuple[int, Folders]:
        """The number of the newest snapshot, -1 if there is none, and the folders of each bucket."""
        names = self.snapshots()
        return (self._number(names[-1]), self._parsed(names[-1])) if names else (-1, {})

    def folders(self) -> dict[int, list[str]]:
        """The names of the folders of each bucket in the newest snapshot."""
        return {k: [f.name for f in v] for k, v in self.snapshot()[1].items()}

    def _load(self, folders: list[Folder]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f.name}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; an empty table if there is none yet."""
        return self._load([f for k, v in self.snapshot()[1].items() if buckets is None or k in buckets for f in v])

    def bucket(self, column: str | None = None) -> Column:
        return F.pmod(F.xxhash64(column or self.by), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of some values of the column of the buckets, at most all."""
        return sorted(r[0] for r in keys.select(self.bucket(keys.columns[0])).distinct().collect())

    def may_hold(self, column: str, keys: DataFrame) -> list[int]:
        """The buckets that may hold rows with some values of a column that has filters."""
        slots = [r[0] for r in keys.select(F.pmod(F.xxhash64(keys.columns[0]), F.lit(FILTER_BITS)).cast("int")).distinct().collect()]  # FILTER_BITS at most

        def may(f: Folder) -> bool:
            bits = f.bits(column)
            return bool(slots) and (bits is None or any(bits[s >> 3] >> (s & 7) & 1 for s in slots))

        return sorted(k for k, v in self.snapshot()[1].items() if any(map(may, v)))

    def _put(self, rows: DataFrame) -> Folders:
        """Write rows into folders of their own, one for each bucket."""
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*self.columns, self.bucket().alias("bucket")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        found = {int(n.removeprefix("bucket=")): (f"{name}/{n}", size) for n, size in self.files.sizes(name).items() if n.startswith("bucket=")}
        keys: dict[int, dict[str, str]] = {k: {} for k in found}
        if self.filters and found:
            slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("long")
            written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/{name}")
            for r in written.groupBy("bucket").agg(*[F.bitmap_construct_agg(slot(c)).alias(c) for c in self.filters]).collect():  # a row for each bucket at most
                keys[r["bucket"]] = {c: base64.b64encode(zlib.compress(bytes(r[c]))).decode() for c in self.filters}
        return {k: [Folder(f, size, keys[k])] for k, (f, size) in found.items()}

    def _commit(self, change: Callable[[Folders], Folders]) -> None:
        """Write the next snapshot, made by change from the newest; again from the start if another writer is faster."""
        while True:
            number, now = self.snapshot()
            held = json.dumps({k: [asdict(f) for f in v] for k, v in change(now).items() if v})
            if self.files.create(held, "snapshots", f"{number + 1}.json"):
                return

    def _unchanged(self, before: Folders, now: Folders, buckets) -> None:
        if any(before.get(k) != now.get(k) for k in buckets):
            raise Stale(f"{self.path}: a bucket was changed by another writer")

    def write(self, rows: DataFrame) -> None:
        """Make rows the table, and so compact it: a bucket has one folder again."""
        _, before = self.snapshot()
        fresh = self._put(rows)

        def change(now: Folders) -> Folders:
            self._unchanged(before, now, {*before, *now})
            return fresh

        self._commit(change)

    def append(self, rows: DataFrame) -> None:
        fresh = self._put(rows)
        self._commit(lambda now: {k: now.get(k, []) + fresh.get(k, []) for k in {*now, *fresh}})

    def replace(self, rows: DataFrame, on: list[str]) -> None:
        """rows in place of those with the same values of the columns on, among which is the one of the buckets."""
        if self.by not in on:
            raise ValueError(f"{self.by} decides the bucket, so rows are replaced by it and others")
        (_, before), fresh = self.snapshot(), self._put(rows)
        old = [f for k in fresh for f in before.get(k, [])]
        if old:
            keys = self._load([f for v in fresh.values() for f in v]).select(*on).distinct()
            same = [F.col(f"_o.{c}").eqNullSafe(F.col(f"_k.{c}")) for c in on]
            condition = same[0]
            for c in same[1:]:
                condition = condition & c
            kept = self._put(self._load(old).alias("_o").join(keys.alias("_k"), condition, "left_anti"))
            fresh = {k: v + kept.get(k, []) for k, v in fresh.items()}

        def change(now: Folders) -> Folders:
            self._unchanged(before, now, fresh)
            return now | fresh

        self._commit(change)

    def put_buckets(self, buckets: list[int], rows: DataFrame) -> None:
        """rows in place of all that these buckets hold; rows of other buckets are added to theirs."""
        (_, before), fresh = self.snapshot(), self._put(rows)

        def change(now: Folders) -> Folders:
            self._unchanged(before, now, buckets)
            rest = {k: v for k, v in now.items() if k not in buckets}
            return {k: rest.get(k, []) + fresh.get(k, []) for k in {*rest, *fresh}}

        self._commit(change)

    def touched(self, matching: DataFrame, on: list[str]) -> list[int]:
        """The buckets that hold a row with the keys of matching; only those are read that may."""
        keys = matching.select(*on).distinct()
        some: set[int] | None = None
        for c in on:
            if c == self.by or c in self.filters:
                may = set(self.buckets_of(keys.select(c)) if c == self.by else self.may_hold(c, keys.select(c)))
                some = may if some is None else some & may
        rows = self.read(None if some is None else sorted(some))
        return [r[0] for r in rows.join(keys, on, "left_semi").select(self.bucket()).distinct().collect()]  # a row for each bucket at most

    def change(self, matching: DataFrame, on: list[str], transform) -> list[int]:
        """Put transform(rows) in place of the rows of all buckets that hold a row with the keys of matching; gives the buckets."""
        touched = self.touched(matching, on)
        if touched:
            self.put_buckets(touched, transform(self.read(touched)))
        return touched

    def count(self) -> int:
        return self.read().count()

    def compact(self, most: int = MOST_FOLDERS, target: int = TARGET_BYTES) -> int:
        """Merge the folders of buckets that have more than most into bins of the target size; gives the number of folders that went.

        All is committed at once. Folders that were added in the meantime stay; if one that was merged is gone, nothing is changed.
        """
        _, before = self.snapshot()
        bins = {k: [b for b in packed(v, target) if len(b) > 1] for k, v in before.items() if len(v) > most}
        merged: list[tuple[set[str], Folders]] = []
        for i in range(max(map(len, bins.values()), default=0)):  # the first bins of all buckets, then the second ones
            some = [f for b in bins.values() if len(b) > i for f in b[i]]
            merged.append(({f.name for f in some}, self._put(self._load(some))))
        if not merged:
            return 0

        def change(now: Folders) -> Folders:
            out = dict(now)
            for gone, fresh in merged:
                if not gone <= {f.name for v in out.values() for f in v}:
                    raise Stale(f"{self.path}: a folder that was merged is gone")
                out = {k: [f for f in out.get(k, []) if f.name not in gone] + fresh.get(k, []) for k in {*out, *fresh}}
            return out

        self._commit(change)
        return sum(len(gone) for gone, _ in merged) - sum(len(v) for _, fresh in merged for v in fresh.values())

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest snapshots, and the folders that none of those names. No other writer may be at work."""
        for name in self.snapshots()[:-keep]:
            self.files.delete("snapshots", name)
        used = {f.name.split("/")[1] for n in self.snapshots() for v in self._parsed(n).values() for f in v}
        for name in self.files.names("data"):
            if name not in used:
                self.files.delete("data", name)

    def tidy(self, keep: int = KEEP) -> None:
        """What the only writer does after a batch: compact what has too many folders, and let old snapshots go."""
        self.compact()
        self.vacuum(keep)


class Store(Table):
    """The passage table, in buckets by path, with a full-text index beside it if it is asked for.

    Whatever changes passages brings the index up to date in the buckets that were changed.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None, buckets: int = BUCKETS, indexed: bool = False):
        from .postings import Postings  # which has tables of this module

        super().__init__(spark, path, SCHEMA, "source_path", buckets, ("book_id",))
        self.dim = dim
        self.index = Postings(spark, f"{self.path}/postings", buckets) if indexed else None

    def reindex(self, buckets: list[int] | None = None) -> None:
        """Bring the index up to date in some buckets, or in all."""
        if self.index is not None:
            self.index.follow(self, list(range(self.buckets)) if buckets is None else buckets)

    def meta(self) -> DataFrame:
        return self.read().select(*META)

    def view(self) -> DataFrame:
        """With nulls for the empty author and chapter and for page -1."""
        t = self.read()
        return t.withColumn("author", F.nullif("author", F.lit(""))).withColumn("chapter", F.nullif("chapter", F.lit(""))).withColumn("page", F.when(F.col("page") >= 0, F.col("page")))

    def checked(self, rows: DataFrame) -> DataFrame:
        """rows in the table's columns; fails on an unknown format or a vector of the wrong length, naming the row."""
        family = fm.family(F.col("format"))
        rows = rows.withColumn("format", F.when(family.isNull(), F.raise_error(F.concat(F.lit("unknown format "), F.coalesce("format", F.lit("null")), F.lit(" of book "), "book_id")).cast("string")).otherwise(family))
        if self.dim is not None:
            wrong = F.coalesce(F.size("vector") != self.dim, F.lit(True))
            rows = rows.withColumn("vector", F.when(wrong, F.raise_error(F.concat(F.lit("vector of the wrong length at "), "id")).cast("array<float>")).otherwise(F.col("vector")))
        blank = {"author": "", "chapter": "", "page": -1}
        return rows.fillna(blank).select(*[F.col(n).cast(k) for n, k in (x.split(" ", 1) for x in SCHEMA.split(", "))]).toDF(*self.columns)

    def _commit(self, change: Callable[[Folders], Folders]) -> None:
        before = self.snapshot()[1]
        super()._commit(change)
        now = self.snapshot()[1]
        changed = [k for k in {*before, *now} if before.get(k) != now.get(k)]
        if changed:
            self.reindex(changed)

    def append(self, rows: DataFrame) -> None:
        super().append(self.checked(rows))

    def replace(self, rows: DataFrame, on: list[str] | None = None) -> None:
        """rows in place of all rows at their paths, whatever their ids."""
        super().replace(self.checked(rows), on or ["source_path"])

    def tidy(self, keep: int = KEEP) -> None:
        super().tidy(keep)
        if self.index is not None:
            self.index.tidy(keep)

    def import_parquet(self, path: str) -> int:
        rows = self.spark.read.parquet(path)
        self.append(rows)
        return rows.count()
