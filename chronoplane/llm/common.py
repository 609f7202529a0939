"""Shared pieces of the training-text operators: input reading, durable intermediate tables, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINISH = 16_384  # links that one task joins


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``. A local one is made where that is unset and Spark runs
    in one process; on a cluster that is an error, because executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronoplane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, so a lost executor costs no recomputation of what it held."""
    spark = df.sparkSession
    path = path or fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nobody reads any more."""
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        delete(df.sparkSession, name)


def delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """The intermediate tables of one run of an operator: ``keep`` writes one, and leaving the block deletes all."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.written = spark, fresh_path(spark, tag), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.written += 1
        return materialize(df, name, f"{self.folder}/{self.written}-{name}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.folder)


def modest_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """df, after setting the session's Arrow batches to at most so many rows: with texts, Spark's 10,000 are tens of MB."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= rows:
        conf.set(name, str(rows))
    return df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def one_task_labels(links: DataFrame) -> DataFrame:
    """(node, rep) of the nodes of links (a, b) few enough for one task: rep is a smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(find, nodes)), pa.int64())], names=["node", "rep"])

    return links.select("a", "b").repartition(1).mapInArrow(run, "node long, rep long")


def connected_components(edges: DataFrame, tag: str = "components", finish: int = FINISH, rounds: list[int] | None = None) -> DataFrame:
    """Map each node of ``edges`` (src, dst: long) to ``component``, the smallest node reachable from it.

    Randomized contraction. In each round every node is merged into the one among itself and its neighbours that comes
    first in that round's random order; links are carried over to the merged nodes, loops and repeats go. Whatever the
    graph, a chain numbered at random or a star, at most 2/3 of the linked nodes are expected to be left by a round, so
    rounds are logarithmic in the number of nodes and tables shrink geometrically. Once at most ``finish`` links are
    left, one task joins their ends. Then labels are carried back from the last round to the first. Each round is
    written to the shared folder; no group, edge list or label reaches the driver. Self loops keep an isolated node;
    an empty input gives an empty result; repeated edges do no harm, null ends are left out. The numbers of links
    before each round are appended to ``rounds`` if that is given.
    """
    with Scratch(edges.sparkSession, tag) as own:
        given = own.keep(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
        oriented = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        links = own.keep(given.filter("src <> dst").select(*oriented("src", "dst")).distinct(), "links")
        steps: list[DataFrame] = []
        while n := links.count():
            if rounds is not None:
                rounds.append(n)
            if n <= finish:
                steps.append(own.keep(one_task_labels(links), "step"))
                break
            first = lambda c, seed=len(steps): F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("order"), F.col(c).alias("id"))
            both = links.select("a", "b").union(links.select("b", "a"))
            nearest = both.groupBy("a").agg(F.min(first("b")).alias("near"))
            step = own.keep(nearest.select(F.col("a").alias("node"), F.least("near", first("a"))["id"].alias("rep")), "step")
            steps.append(step)
            ends = links.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b")
            new = own.keep(ends.filter("x <> y").select(*oriented("x", "y")).distinct(), "links")
            discard(links)
            links = new
        labels: DataFrame | None = None
        for step in reversed(steps):
            if labels is not None:
                step = own.keep(step.join(labels.toDF("rep", "label"), "rep", "left").select("node", F.coalesce("label", "rep").alias("rep")), "labels")
            labels = step
        nodes = given.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        if labels is None:
            return materialize(nodes.select("node", F.col("node").alias("component")), tag)
        named = own.keep(nodes.join(labels, "node", "left").select("node", F.coalesce("rep", "node").alias("label")), "named")
        lowest = named.groupBy("label").agg(F.min("node").alias("component"))
        return materialize(named.join(lowest, "label").select("node", "component"), tag)


def block_pairs(members: DataFrame, keys: list[str], item: str, size: int) -> DataFrame:
    """Deal each group of ``members`` over cells of two blocks with about ``size`` rows each, so no task holds a group.

    A group of n rows gets b = ceil(n / size) blocks and its rows go to the b cells of their block; every two rows
    of a group meet in exactly one cell (lo, hi), lo <= hi, rows of the same block in cell (lo, lo). Small groups have
    the one cell (0, 0). Adds columns lo, hi and mine, the row's block.
    """
    large = members.groupBy(*keys).count().filter(F.col("count") > size).select(*keys, F.ceil(F.col("count") / F.lit(size)).cast("int").alias("blocks"))
    dealt = members.join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64(F.lit(11), F.col(item)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")}).drop("other", "blocks")
