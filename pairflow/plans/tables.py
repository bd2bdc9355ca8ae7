"""Cutting lineage and keeping step results in the cluster's shared folder."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset in local mode, a folder of our own. A cluster without it is an error: executors don't share disks."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own[sc.applicationId]


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: lineage ends, and file sizes replace the plan's estimates,
    which a checkpoint would carry on (in a loop of self-joins they double their digits each round)."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class StaleStep(ValueError):
    """A kept step that is missing, half-written, or was made from other inputs, settings or earlier steps."""


def fingerprint(df: DataFrame) -> str:
    """The number of rows and the sum of their hashes, whatever their order."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


class Store:
    """Step results as Parquet tables under one folder, so that a run may start from any step.

    A table is written beside its place together with a manifest (``_manifest.json``: what it was made from, and figures observed while it was
    written) and then renamed, so a step is there whole or not at all. The folder's file system must rename in one go.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, name: str, df: DataFrame, made_from: dict | None = None) -> DataFrame:
        """Commits ``df`` under ``name``. Rows, first and last ``date`` and about how many entities and groups are observed on the way, without a
        job of their own. A table saved without ``made_from`` counts as given: it depends on nothing."""
        seen = Observation()
        figures = [F.count(F.lit(1)).alias("rows")]
        figures += [F.approx_count_distinct(c, 0.01).alias(f"about_{c}") for c in ("entity", "grp") if c in df.columns]
        figures += [e for c in ("date",) if c in df.columns for e in (F.min(F.col(c).cast("string")).alias("first_date"), F.max(F.col(c).cast("string")).alias("last_date"))]
        half, whole, files = f"{self.folder}/_half-{name}-{uuid.uuid4().hex}", f"{self.folder}/{name}", self._files()
        df.observe(seen, *figures).write.parquet(half)
        manifest = {"id": uuid.uuid4().hex, "made_from": made_from, "observed": seen.get}
        out = files.create(self._path(f"{half}/_manifest.json"))
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        files.delete(self._path(whole), True)
        if not files.rename(self._path(half), self._path(whole)):
            raise OSError(f"{half} could not be renamed to {whole}")
        return self.load(name)

    def manifest(self, name: str) -> dict:
        files, path = self._files(), self._path(f"{self.folder}/{name}/_manifest.json")
        if not files.exists(path.getParent()):
            raise StaleStep(f"step {name} was never written")
        if not files.exists(path):
            raise StaleStep(f"step {name} is half-written: it has no manifest")
        stream = files.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def load(self, name: str) -> DataFrame:
        self.manifest(name)
        return self.spark.read.parquet(f"{self.folder}/{name}")


def steps_of(text: str, last: int = 9) -> tuple[int, int]:
    """``all``, ``a-b``, ``a,b,..`` (from the least to the greatest) or ``n`` as first and last step."""
    text = text.strip().lower()
    if text in ("", "all"):
        return 1, last
    numbers = [int(x) for x in text.replace("-", ",").split(",")]
    if not all(1 <= n <= last for n in numbers):
        raise ValueError(f"steps are 1 to {last}, not {text!r}")
    return min(numbers), max(numbers)
