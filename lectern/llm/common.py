"""What the operators share: reliable lineage cuts, partition counts, exchange rows and components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: U+0020 and U+0009 to U+000D, which is what ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame, *, of_round: bool = False) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor costs nothing.

    Spark keeps its estimate of the size with the rows, and estimates of joins are products: over the rounds of a loop they
    become numbers of millions of digits.  What is kept ``of_round`` has no estimate; real sizes are known when it is read.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local master may leave it unset and gets a temporary one:
    elsewhere such a folder would be one machine's own disk.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-"))
    kept = df.checkpoint(eager=True)
    if of_round:
        rows = kept._jdf.queryExecution().logical().rdd()
        kept = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
    return kept


def released(df: DataFrame) -> None:
    """Deletes the files of a checkpointed ``df`` that nothing will read again, such as a round's once the next is kept."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes in an Arrow batch on its way to Python; rows of text differ too much for a number of rows to bound them.
BATCH_BYTES = 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set so that Arrow batches hold at most about ``BATCH_BYTES``, in the JVM's buffers as in Python's."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: From this size on, an estimate is Spark's mark for "unknown" (2^63 - 1, or what a plan makes of it).
UNKNOWN_BYTES = 1 << 60


def buckets_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Partitions for work on ``df``: the session's shuffle partitions, or more if a partition would exceed ``bytes_each`` of input.

    Spark gives rows that don't come from files (such as ``createDataFrame``) the session's default size, which stands for
    unknown; then the session's number holds.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_BYTES:
        return shuffle_partitions(df.sparkSession)
    return max(shuffle_partitions(df.sparkSession), min(100_000, -(-size // bytes_each)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every end of ``edges(a, b)``; ``component`` is the smallest id reachable.

    Edges hang larger ids ``u`` on smaller ones ``v``.  Rounds alternate a large-star and a small-star step, so a chain of n
    edges needs O(log n) rounds.  An id with very many edges is a hot key of the joins, never of the aggregations, which combine
    on the map side: the smallest ids are therefore kept before they are joined, so that both sides of a join are
    plain exchanges and the adaptive planner can split a hot key's edges over tasks.  Nothing but a count of
    unsettled edges comes to the driver, and a round's files go when the next round is kept.
    Loops and repeated edges count for nothing; null ends must not occur; no edges give no rows.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), of_round=True)
    for _ in range(max_rounds):
        low = checkpointed(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), of_round=True)
        # settled: a star forest, in which no id is both a root and a leaf and each leaf hangs on one root
        if not low.where("n > 1").limit(1).count() and not e.join(low.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            released(low)
            break
        hung = e.join(low.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        low2 = checkpointed(hung.groupBy("u").agg(F.min("v").alias("m")), of_round=True)
        others = hung.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = checkpointed(low2.select("u", F.col("m").alias("v")).unionAll(others).distinct(), of_round=True)
        for old in (e, low, low2):
            released(old)
        e = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
