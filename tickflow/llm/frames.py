"""DataFrame helpers shared by the operators: carried columns, shared folders, components."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.session import own_folder_if_local, shared_path


#: Bytes of an Arrow batch on its way to Python: long texts make short batches.
ARROW_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, and see to it that the Python workers find this package.

    A local session, and a cluster whose PYTHONPATH names the checkout, use
    its path; another gets the package itself, as a zip file in the shared folder.
    """
    own_folder_if_local(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    package = Path(__file__).resolve().parents[1]
    root, context = str(package.parent), spark.sparkContext
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root in paths or getattr(context, "_tickflow_shipped", False):
        return
    if context.master.startswith("local[") or context.master == "local" or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])
    else:
        _ship(spark, package)
        context._tickflow_shipped = True


def _ship(spark: SparkSession, package: Path) -> None:
    """Add ``package`` to the session's Python files, by way of the shared folder."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    where = shared_path(spark, f"{package.name}-{uuid.uuid4().hex}.zip")
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    stream = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path)
    try:
        stream.write(bytearray(raw.getvalue()))
    finally:
        stream.close()
    spark.sparkContext.addPyFile(where)


def outputs_last(df: DataFrame, row: str, **outputs) -> DataFrame:
    """The fields of struct column ``row`` but those named like an output, then the outputs.

    Operators carry a caller's row in one struct, so columns of any name pass
    through unharmed; an output replaces an input column of its own name.
    """
    names = {name.lower() for name in outputs}
    fields = [f.name for f in df.schema[row].dataType.fields if f.name.lower() not in names]
    return df.select(*[F.col(row)[name].alias(name) for name in fields],
                     *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in outputs.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh table in the shared folder and read back (cuts the lineage).

    The write's shuffle files are removed as soon as it is done: nothing
    needs them again, and a job of many steps would fill the disks.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, spark: SparkSession, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, root), root the smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    is one shuffle with partial aggregation, a node's neighbours are never
    gathered in one place, and the number of edges never grows beyond the
    input's.  Rounds are cut by written tables; it stops when a round of both
    changes no edge.  Self loops and nulls are ignored.
    """
    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .where("u > v").distinct())
    e = written(e, "components")
    before = None
    for _ in range(rounds):
        # large star: every neighbour larger than u points to u's smallest neighbour (or u)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        e = written(small, "components")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
