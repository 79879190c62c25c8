"""Reading tables, cutting lineage in the shared folder, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Tables that save() has written inside each open `scratch`.
_SCOPES: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (as in tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN[app]


#: Whole documents that an Arrow batch holds, at most.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Rows here are whole documents, and 10000 of them a batch (the default) would be copied several times over
    in each worker; a size that the session has set itself is left alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def save(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and return a scan of it: later steps no longer
    depend on what executors hold.  The driver then lets go of shuffle files that only
    the written plan used."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    spark.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that save() wrote, once everything that reads it has been written itself."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class scratch:
    """What save() writes inside `with scratch() as keep` is deleted at its end, but for tables passed to keep()."""

    def __enter__(self):
        _SCOPES.append([])
        return self.keep

    @staticmethod
    def keep(df: DataFrame) -> DataFrame:
        _SCOPES[-1].remove(df)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(df)
        return df

    @staticmethod
    def drop(df: DataFrame) -> None:
        """Delete a table before the end."""
        _SCOPES[-1].remove(df)
        discard(df)

    def __exit__(self, *_):
        for df in _SCOPES.pop():
            discard(df)


def with_names(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that whatever else a table carries can't clash with ours."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def crc_mod(column: str, n: int) -> Column:
    """crc32(column as text) mod n; a null counts as the empty text (crc32 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a table of links between long ids: (node, component), the
    component being its smallest node; nodes without links are not listed.

    Alternating large-star and small-star steps (Kiveris et al., 2014).  Minima are pre-aggregated before the
    shuffle and written before they are joined, so that both sides of a join are plain exchanges, and the engine can split a
    node with very many links.  Rounds are written to the shared folder, and deleted once the next one is."""
    linked = lambda u, v: (F.col(u).alias("u"), F.col(v).alias("v"))
    with scratch() as keep:
        e = save(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
        while True:
            roots = e.select(F.col("v").alias("u")).distinct()
            stars = e.agg(F.count("u").alias("n"), F.countDistinct("u").alias("d")).first()
            if stars.n == stars.d and e.join(roots, "u", "left_semi").isEmpty():
                return keep(save(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component")))))
            both = e.unionByName(e.select(*linked("v", "u")))
            least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            large = save(both.join(least, "u").where("v > u and v != m").select(*linked("v", "m")).distinct())
            lower = save(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.join(lower, "u").where("v != m").select(*linked("v", "m"))
            last, e = e, save(small.unionByName(lower.select(*linked("u", "m"))).distinct())
            for done in (last, least, large, lower):
                scratch.drop(done)
