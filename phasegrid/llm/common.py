"""What the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns all other ASCII but digits and letters into spaces.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Lower-cases A-Z and nothing else.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Paths in the shared folder that this process made and hasn't deleted yet.
_LEFT: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one
    machine, where that is unset, a temporary folder of our own; on a cluster
    its absence is an error, as executors don't see the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="phasegrid-")
        atexit.register(shutil.rmtree, found[7:], True)
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    """Delete what shared_path gave."""
    _LEFT.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    """What results still read when they were returned goes with the process."""
    for path, spark in list(_LEFT.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone before us
            delete(spark, path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


@contextlib.contextmanager
def tidy():
    """What is made in the shared folder inside, and isn't gone by the end of
    it, goes then: for a result that is written before the end."""
    before = set(_LEFT)
    yield
    for path in set(_LEFT) - before:
        delete(_LEFT[path], path)


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """Shuffle files of a query planned and run inside go when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _checkpoint_file(df: DataFrame) -> str | None:
    found = df._jdf.logicalPlan().rdd().getCheckpointFile()
    return found.get() if found.isDefined() else None


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder: what follows doesn't depend
    on the executors that made it, and its shuffle files are gone. See forget.
    A checkpoint keeps the estimated size of its plan; over many rounds of
    joins that number would grow without bound, so it is left behind."""
    spark = df.sparkSession
    shared_dir(spark)
    with _shuffles_go(spark):
        made = df.select("*").checkpoint(eager=True)._jdf
    kept = DataFrame(spark._jsparkSession.internalCreateDataFrame(made.logicalPlan().rdd(), made.schema(), False), spark)
    if path := _checkpoint_file(kept):
        _LEFT[path] = spark
    return kept


def forget(*cuts: DataFrame) -> None:
    """Delete checkpoints, made by cut, that nothing will read again."""
    for df in cuts:
        if path := _checkpoint_file(df):
            delete(df.sparkSession, path)


class Scratch:
    """df as a Parquet table in the shared folder, for large results that are
    read more than once; gone after drop(), or with the process."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, shared_path(df.sparkSession, name)
        with _shuffles_go(self.spark):
            df.select("*").write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


class Bucketed(Scratch):
    """df as a table in the shared folder, dealt into as many buckets as there
    are shuffle partitions: joins and groups on `keys` don't move its rows."""

    def __init__(self, df: DataFrame, name: str, *keys: str):
        self.spark, self.path = df.sparkSession, shared_path(df.sparkSession, name)
        self.name = f"phasegrid_{self.path.rpartition('-')[2]}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with _shuffles_go(self.spark):
            df.select("*").write.bucketBy(n, *keys).option("path", self.path).option("compression", "zstd").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        super().drop()


def utf8(name: str) -> Column:
    """The text of a column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def strings(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class WordIds(dict):
    """Words to 64-bit fingerprints, kept for the words seen last."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(words: list[bytes], width: int, ids: WordIds):
    """Fingerprints of the distinct runs of `width` words, sorted; of fewer
    words, the whole sequence is the one run; of none there is none."""
    import numpy as np

    if not words:
        return np.empty(0, np.uint64)
    x = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    if len(x) < width:
        width = len(x)
    h = np.full(len(x) - width + 1, width, np.uint64)
    for j in range(width):
        h ^= x[j : len(x) - width + 1 + j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(df: DataFrame, *wanted: str) -> list[str]:
    """Names that df has no column of, ignoring case, one for each wanted."""
    used, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
