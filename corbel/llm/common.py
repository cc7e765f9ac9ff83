"""Shared helpers of the training-data operators.

Intermediate tables that are read more than once are written as Parquet to the
folder that the session names in ``spark.checkpoint.dir``, which every executor
and the driver can reach, so a lost executor costs a re-read and not a recompute.
"""

from __future__ import annotations

import atexit
import getpass
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: separators of words, once A-Z is lower-cased.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The folders that staged tables go to, the innermost scope last.
_SCOPES: list[str] = ["tables"]
_AT_EXIT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where none is set in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/corbel-{getpass.getuser()}"


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corbel/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str, batch: tuple[int, int] | None = None, scope: str | None = None) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: computed once, lineage cut, safe against lost executors.

    `batch` bounds the rows and megabytes of the Arrow batches that Python workers get meanwhile;
    `scope` names an outer scope for what is to outlive the innermost one.
    """
    spark = df.sparkSession
    home = _home(spark)
    if home not in _AT_EXIT:
        _AT_EXIT.add(home)
        atexit.register(_released_at_exit, spark, home)
    path = f"{home}/{scope or _SCOPES[-1]}/{name}-{uuid.uuid4().hex}"
    with _batches(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _batches(spark: SparkSession, batch: tuple[int, int] | None) -> Iterator[None]:
    """Arrow bounds that hold for one write; the session's own come back."""
    if batch is None:
        yield
        return
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch[0]), "spark.sql.execution.arrow.maxBytesPerBatch": str(batch[1] << 20)}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that are staged within are deleted at the end; gives the name of the outer scope, for those that are to stay."""
    outer, inner = _SCOPES[-1], f"scope-{uuid.uuid4().hex}"
    _SCOPES.append(inner)
    try:
        yield outer
    finally:
        _SCOPES.remove(inner)
        _delete(spark, f"{_home(spark)}/{inner}")


def dropped(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes all that this application has staged; it happens by itself at the end of the driver's process."""
    _delete(spark, _home(spark))


def _released_at_exit(spark: SparkSession, home: str) -> None:
    with suppress(Exception):  # the session may be gone already
        if spark.sparkContext._jsc is not None:
            _delete(spark, home)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names of columns that `docs` has not, whatever its case."""
    have, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The rows with two further columns (of fresh names) that tell each row from all others, repeated ones too: its file and its place there.

    Rows of a table that is read as it stands have them already; others are staged first.
    """
    file, row = fresh(docs, "_file", "_row")

    def marked(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(row))

    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return marked(docs), file, row
        except Exception as e:  # noqa: BLE001  a source without places of rows
            if "FIELD_NOT_FOUND" not in str(e) and "UNRESOLVED" not in str(e):
                raise
    return marked(staged(docs, "rows")), file, row


def shuffled(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str = "left") -> DataFrame:
    """An equi-join by shuffle at every size, `right` the smaller side and its keys unique; adaptive execution splits keys that many rows of `left` have."""
    on = reduce(lambda x, y: x & y, (left[a] == right[b] for a, b in zip(left_keys, right_keys, strict=True)))
    return left.join(right.hint("shuffle_hash"), on, how)


def skew_lookup(left: DataFrame, right: DataFrame, key: str, count: str, total: int, cols: list[str], salt: Column, share: int = 1000) -> DataFrame:
    """Left lookup of `cols` by `key`, one right row for each key, for keys that may hold a third of the rows.

    `count` says how many left rows a right row has. At most `share` keys hold a
    1/`share` of the rows each; those rows of `right` are broadcast (a proven
    bound), so that rows with a hot key never meet in one task. The others join
    by shuffle; hot rows take a key of `salt` there, which matches nothing.
    """
    bar = max(2, -(-total // share))
    wanted = right.select(F.col(key).alias("_key"), count, *[F.col(c).alias(f"_{c}") for c in cols])
    heavy = wanted.filter(F.col(count) >= bar).drop(count).withColumn("_hot", F.lit(True))
    light = wanted.filter(F.col(count) < bar).drop(count)
    light = light.select(F.col("_key").alias("_key2"), *[F.col(f"_{c}").alias(f"_2{c}") for c in cols])
    out = left.join(F.broadcast(heavy), left[key] == heavy["_key"], "left")
    out = out.withColumn("_probe", F.when(F.col("_hot") | F.col(key).isNull(), salt).otherwise(F.col(key)))
    out = out.join(light, out["_probe"] == light["_key2"], "left")
    return out.select(*[left[c] for c in left.columns], *[F.coalesce(f"_{c}", f"_2{c}").alias(c) for c in cols])


def words(text: Column) -> Column:
    """Words of a text whose A-Z are lower-cased; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def hashed(text: Column, digits: int = 15) -> Column:
    """The first hex digits of a text's md5 as a number: 60 bits at 15 digits, and the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where `body` uses it within the lambdas of array functions, which compute a nested expression again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b) as (node, label): the smallest node of each.

    Each edge is turned to its smaller end, and a node's smaller neighbours are
    hung on the smallest of them: as many edges as nodes are left, but for a few,
    where a group's members had met in many buckets. Callers give a node a bounded
    number of smaller neighbours (one for each band, or block). Then labels go
    along edges and through one pointer jump a round until none changes; minima
    are taken before the shuffle, and the joins are plain equi-joins that adaptive
    execution splits where a hub has many edges.
    """
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = F.min("b").over(Window.partitionBy("a"))
    pairs = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y"))))
    few = staged(down.withColumn("m", low).select(pairs.alias("e")).select("e.x", "e.y").filter("x <> y").distinct(), "edges")
    both = few.select(F.col("x").alias("a"), F.col("y").alias("b")).union(few.select(F.col("y"), F.col("x")))
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = staged(step.join(jump, step["label"] == jump["via"], "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        moved = new.filter("old <> label").limit(1).count()
        dropped(labels)
        labels = new.select("node", "label")
        if not moved:
            dropped(few)
            return labels
