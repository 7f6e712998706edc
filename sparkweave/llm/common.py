"""What several operators share: inputs, shared folder, word arrays, connected components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a worker remembers before it starts anew, and words that are handled in one go.
CACHED_WORDS, FLAT_WORDS = 1_000_000, 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session or its context names it. Where neither does, a
    temporary one if all runs on this machine; on a cluster that is an error, as executors couldn't read it."""
    sc = spark.sparkContext
    at = lambda: sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (at().get() if at().isDefined() else None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="sparkweave-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not at().isDefined():
        sc.setCheckpointDir(named)
        return shared_dir(spark) if not spark.conf.get("spark.checkpoint.dir", None) else named.rstrip("/")
    return named.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that were written() and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under names of our own, so that no other column can clash."""
    return docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).cast("string").alias("_text"))


def per_batch(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


class Words(dict):
    """Word to a small number; hashes[number] is the word's 64-bit hash."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.empty(1 << 16, np.uint64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty(n, np.uint64)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = n
        return n

    def of(self, words: list[str]) -> np.ndarray:
        """Hashes of words; forgets all words first if there are too many."""
        if len(self) > CACHED_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[at]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n words; of all the words, if there are fewer than n; none of none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + len(out)])
    return out


def named(*columns: str) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col(quoted(c)) for c in columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), as (node, root); root is the component's least node. Rounds grow with the
    logarithm of a component's size; should they run out, that is an error and not a result.

    Alternates large-star and small-star steps. Each step reduces every node's neighbours to their minimum
    (partial aggregates before the shuffle) and joins it back. The minima are a plain table by then, as the edges are, so
    Spark splits the rows of a hub, and no neighbourhood is gathered in one row or task.
    Each step is checkpointed. The edges are stars, and done, once each node that has a lesser neighbour has no other: that is
    read from the minima of the next step, so no round is run only to see that nothing changes. Loops and repeated edges do no
    harm; no edges give no rows.
    """

    def least(e: DataFrame) -> DataFrame:
        return checkpointed(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))

    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    for done in range(rounds + 1):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both)
        if not low.agg(F.count_if(F.expr("m < a and n > 1"))).first()[0]:
            break
        if done == rounds:
            raise RuntimeError(f"components are unfinished after {rounds} rounds")
        large = checkpointed(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct())
        small = large.join(least(large), "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = checkpointed(small.filter("a > b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def digest_text(column: Column) -> Column:
    return F.sha2(F.coalesce(column, F.lit("")), 256)
