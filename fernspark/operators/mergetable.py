"""A table by id that is merged when it is read: commits add files, a manifest names those that count.

A commit writes its rows to a folder of their own, then a manifest of the next version, which lists all folders. The manifest is put in place by a rename that fails if
there is one already, so of two writers one takes the version and the other lists its folder in the next; what a killed writer leaves isn't listed and
isn't read. An upsert or a removal writes in proportion to its own rows. Readers take the newest row of each id; compaction writes what they see as one
folder, in as many files as it has rows for.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspark.operators import sinks

#: Rows of a file, about.
FILE_ROWS = 1_000_000
#: Folders that a manifest lists before a commit compacts the table.
MOST_FOLDERS = 32
#: How often a writer tries to take the next version.
TRIES = 100


@dataclass(frozen=True)
class MergeTable:
    """A table in the folder ``path``, with one row for each ``key``; null keys are an error.

    Versions count from 1. On a store whose rename isn't atomic two writers at the same moment can lose a commit; on HDFS they can't.
    """

    spark: SparkSession
    path: str
    key: str = "id"
    file_rows: int = FILE_ROWS
    most_folders: int = MOST_FOLDERS

    # --- manifests ---

    def _hadoop(self):
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return jvm, folder.getFileSystem(conf), folder

    def version(self) -> int:
        """The newest version; 0 without a table."""
        _, fs, folder = self._hadoop()
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        jvm, fs, folder = self._hadoop()
        if version == 0:
            return {"base": None, "changes": []}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, f"{version:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, version: int, manifest: dict) -> bool:
        """Whether the manifest could be put in place as this version: written whole beside it, then renamed."""
        jvm, fs, folder = self._hadoop()
        Path = jvm.org.apache.hadoop.fs.Path
        aside, to = Path(folder, f"new-{uuid.uuid4().hex}"), Path(folder, f"{version:020d}")
        fs.mkdirs(folder)
        out = fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            options = self.spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            context.rename(aside, to, options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(aside, False)
            return False

    # --- reading ---

    def _changes(self, manifest: dict) -> DataFrame | None:
        """All changed rows with ``_version`` and ``_gone``."""
        out = None
        for c in manifest["changes"]:
            one = self.spark.read.parquet(f"{self.path}/data/{c['folder']}").withColumn("_version", F.lit(c["version"]).cast("long")).withColumn("_gone", F.lit(c["gone"]))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, by default the newest; None where there is none.

        Only changed rows since the last compaction are ranked by id; the base loses their ids by an anti-join, for which few ids are broadcast.
        """
        manifest = self.manifest(self.version() if version is None else version)
        base = self.spark.read.parquet(f"{self.path}/data/{manifest['base']}") if manifest["base"] else None
        changes = self._changes(manifest)
        if changes is None:
            return base
        rest = [c for c in changes.columns if c != self.key]
        newest = changes.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_version").alias("_row")).select(self.key, "_row.*")
        kept = newest.where("not _gone").drop("_version", "_gone")
        return kept if base is None else base.join(newest.select(self.key), self.key, "left_anti").unionByName(kept, allowMissingColumns=True)

    # --- writing ---

    def _write(self, rows: DataFrame, n: int) -> str:
        folder = uuid.uuid4().hex
        rows.repartition(max(1, -(-n // self.file_rows)), self.key).write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _commit(self, rows: DataFrame, gone: bool) -> int:
        checked = rows.withColumn(self.key, F.coalesce(self.key, F.raise_error(F.lit("a row without a key")).cast(rows.schema[self.key].dataType))).persist()
        try:
            n = checked.count()
            if n == 0:
                return 0
            folder = self._write(checked, n)
        finally:
            checked.unpersist()
        for _ in range(TRIES):
            at = self.version()
            manifest = self.manifest(at)
            manifest["changes"].append({"folder": folder, "version": at + 1, "gone": gone})
            if self._put(at + 1, manifest):
                if len(manifest["changes"]) >= self.most_folders:
                    self.compact()
                return n
        raise RuntimeError(f"{TRIES} other writers were faster")

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows by id, of several with one id the last by ``order``, in place of those that are there; gives their number. Other rows are neither read nor written."""
        return self._commit(sinks.first_wins(rows, self.key, (F.desc_nulls_last(order),) if order else ()), gone=False)

    def insert(self, rows: DataFrame) -> int:
        """Rows whose id the table lacks."""
        return self._commit(sinks.insert_if_absent(self.read(), rows, self.key), gone=False)

    def remove(self, keys: DataFrame) -> int:
        """The rows of these ids go; gives the number of ids."""
        return self._commit(keys.select(self.key).distinct(), gone=True)

    def compact(self) -> None:
        """Writes the table as one folder and lists it in place of all before it; what others commit meanwhile stays listed after it."""
        at = self.version()
        rows = self.read(at)
        if rows is None:
            return
        folder = self._write(rows, rows.count())
        for _ in range(TRIES):
            now = self.version()
            later = [c for c in self.manifest(now)["changes"] if c["version"] > at]
            if self._put(now + 1, {"base": folder, "changes": later}):
                return
        raise RuntimeError(f"{TRIES} other writers were faster")

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the newest ``keep`` manifests lists, and older manifests; gives the number of folders. No one may be writing or reading older versions."""
        jvm, fs, folder = self._hadoop()
        Path = jvm.org.apache.hadoop.fs.Path
        names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True)
        versions = [n for n in names if n.isdigit()]
        listed: set[str] = set()
        for v in versions[:keep]:
            m = self.manifest(int(v))
            listed |= {m["base"]} | {c["folder"] for c in m["changes"]}
        for n in [*versions[keep:], *(n for n in names if not n.isdigit())]:
            fs.delete(Path(folder, n), False)
        old = [s.getPath() for s in fs.listStatus(Path(f"{self.path}/data")) if s.getPath().getName() not in listed]
        for p in old:
            fs.delete(p, True)
        return len(old)


@dataclass(eq=False)
class MergeSink(sinks.ParquetSink):
    """A :class:`~fernspark.operators.sinks.ParquetSink` whose table is merged when it is read: ``insert`` and ``upsert`` write the rows that they change alone."""

    parts: int = field(default=0, repr=False)

    def setup(self, spark: SparkSession) -> None:
        if self.mode not in ("insert", "upsert"):
            raise ValueError("modes are insert and upsert")

    def read(self, spark: SparkSession) -> DataFrame | None:
        return MergeTable(spark, self.path).read()

    def store(self, df: DataFrame) -> int:
        table = MergeTable(df.sparkSession, self.path)
        return (table.upsert if self.mode == "upsert" else table.insert)(self.shaped(df))
