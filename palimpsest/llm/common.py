"""What the operators share: the shared folder, written tables, word rules."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters (space, \t, \n, \v, \f, \r).
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of at most so many bytes may be broadcast; callers count rows and know a row's width.
BROADCAST_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent, a local master gets a temporary folder; on a
    cluster that would be a machine-local path, so it is an error there.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        root = known.get().rsplit("/", 1)[0] if known.isDefined() else None
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(root)
    return root if re.match(r"[a-z][a-z0-9+.-]*:", root) else "file://" + root


_made: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new path below the shared folder; removed when the driver ends."""
    base = f"{shared_root(spark)}/palimpsest-{spark.sparkContext.applicationId}"
    if base not in _made:
        _made[base] = spark
        atexit.register(remove, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a path of this module's making; a stopped session is no error."""
    try:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - clean-up at exit, when the JVM may be gone
        pass


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    at = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.palimpsest_path = at
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    if at := getattr(df, "palimpsest_path", None):
        remove(df.sparkSession, at)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as often as it likes."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does the same on pure ASCII, faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(batches, *names: str) -> Iterator[tuple]:
    """Python rows of Arrow batches, a batch at a time."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))
