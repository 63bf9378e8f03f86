"""A table in slices by document, every change of which is one commit.

Rows are written to ``data/version=<v>/slice=<n>`` and never changed there. A manifest,
``manifests/<v>.json``, says which version of each slice counts; it is the pointer that is
committed last, by renaming a finished file to a name that must not exist. Readers that
have opened a version keep it; a writer that dies before the rename leaves the version
before it, and of two writers of one version the later one gets an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionConflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class SlicedTable:
    spark: SparkSession
    path: str
    slices: int = 64
    key: str = "doc_id"

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The committed version; 0 for a table that does not exist yet."""
        system, path = self._files("manifests")
        if not system.exists(path):
            return 0
        names = [status.getPath().getName() for status in system.listStatus(path)]
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"schema": None, "slices": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the committed one), with their ``slice``."""
        manifest = self._manifest(self.version() if version is None else version)
        if manifest["schema"] is None:
            raise ValueError(f"no version at {self.path}")
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/data/version={v}/slice={n}" for n, v in manifest["slices"].items()]
        whole = T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("slice", T.IntegerType())])
        if not folders:
            return self.spark.createDataFrame([], whole).drop("version")
        # At most ``slices`` folders.
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*folders).drop("version")

    def slice_of(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.slices)).cast("int")

    def replace(self, fresh: DataFrame, replaced: DataFrame, files: int | None = None) -> int:
        """Commit a version without the documents ``replaced`` (ids) and with the rows
        ``fresh``, whose documents replace their old rows too; returns its number.

        Only slices that hold such a document are rewritten. Ids without rows are
        deletions; a slice without rows leaves the manifest.
        """
        base = self.version()
        manifest, columns = self._manifest(base), fresh.columns
        ids = replaced.select(self.key).union(fresh.select(self.key)).distinct()
        # At most ``slices`` numbers.
        touched = sorted(r[0] for r in ids.select(self.slice_of()).distinct().collect())
        rows = fresh
        if base:
            old = self.read(base).filter(F.col("slice").isin(touched)).select(*columns)
            rows = old.join(ids, self.key, "left_anti").select(*columns).unionByName(fresh)
        version = base + 1
        self._write(rows, version, files)
        slices = {n: v for n, v in manifest["slices"].items() if int(n) not in touched}
        slices |= {str(n): version for n in self._written(version)}
        self._commit(version, {"schema": fresh.schema.jsonValue(), "slices": slices})
        return version

    def _write(self, rows: DataFrame, version: int, files: int | None) -> None:
        # What an earlier attempt at this version left is no part of any manifest. A slice
        # with very many rows spans several files.
        files = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        sliced = rows.withColumn("slice", self.slice_of()).repartitionByRange(files, "slice", self.key)
        sliced.write.mode("overwrite").partitionBy("slice").parquet(f"{self.path}/data/version={version}")

    def _written(self, version: int) -> list[int]:
        system, path = self._files(f"data/version={version}")
        names = [s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()]
        return sorted(int(n.removeprefix("slice=")) for n in names if n.startswith("slice="))

    def _commit(self, version: int, manifest: dict) -> None:
        system, final = self._files(f"manifests/{version}.json")
        _, draft = self._files(f"manifests/_draft-{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if system.exists(final) or not system.rename(draft, final):
            system.delete(draft, False)
            raise VersionConflict(f"version {version} of {self.path} is taken")

    def vacuum(self, keep: int = 1) -> None:
        """Delete the manifests before the last ``keep`` and data that none of the rest names."""
        last = self.version()
        kept = range(max(1, last - keep + 1), last + 1)
        used = {(int(n), v) for k in kept for n, v in self._manifest(k)["slices"].items()}
        system, data = self._files("data")
        for folder in system.listStatus(data) if system.exists(data) else []:
            version = int(folder.getPath().getName().removeprefix("version="))
            for part in system.listStatus(folder.getPath()):
                name = part.getPath().getName()
                if version <= last and name.startswith("slice=") and (int(name.removeprefix("slice=")), version) not in used:
                    system.delete(part.getPath(), True)
        for number in range(1, kept.start):
            system.delete(self._files(f"manifests/{number}.json")[1], False)
