"""What the operators share: tables, stashed intermediate results, labelled samples, logistic fits."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) mod 4 has this value are never learnt from.
HELD_OUT = 2


#: Rows in an Arrow batch: texts are long, and a worker holds a batch in several forms at once.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run on one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives the loss of executors.

    The shuffle files of the write go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def release(*stashed: DataFrame) -> None:
    """Deletes stashed tables that nothing will read again."""
    for df in stashed:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stashed)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key of more rows is dealt to several tasks, if it is one of the HOT_KEYS most frequent; others have fewer than that share.
HOT_ROWS, HOT_KEYS, MOST_PARTS = 1024, 1000, 4096


def dealt_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """big joined to small, where one key may hold a great part of big's rows (inner, left or left_semi).

    The most frequent keys of big (HOT_KEYS at most, so that they can be broadcast) are dealt to parts of about HOT_ROWS
    rows, and small's rows of these keys are repeated for each part. Many rows with a null key don't travel at all.
    """
    keys, spark = [on] if isinstance(on, str) else list(on), big.sparkSession
    counts = big.groupBy(*keys).agg(F.count("*").alias("_parts")).where(F.col("_parts") > HOT_ROWS)
    parts = F.least(F.ceil(F.col("_parts") / HOT_ROWS), F.lit(MOST_PARTS)).cast("int").alias("_parts")
    counts = counts.orderBy(F.desc("_parts"), *keys).limit(HOT_KEYS).select(*keys, parts)
    hot = counts.collect()
    blank = [r for r in hot if None in r[: len(keys)]]
    if blank:
        hot = [r for r in hot if r not in blank]
        null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in keys))
        nulls, big = big.where(null), big.where(~null)
    if not hot:
        out = big.join(small, keys, how)
        return out.unionByName(nulls, allowMissingColumns=True) if blank and how == "left" else out
    few = F.broadcast(spark.createDataFrame(hot, counts.schema))
    dealt = big.withColumn("_salt", F.monotonically_increasing_id()).join(few, keys, "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod("_salt", "_parts"), F.lit(0)).cast("int")).drop("_parts")
    each = small.join(few, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    out = dealt.join(each, [*keys, "_salt"], how).drop("_salt")
    return out.unionByName(nulls, allowMissingColumns=True) if blank and how == "left" else out


#: A table of up to so many rows of a few numbers and a name is broadcast.
SMALL_ROWS = 200_000


def lookup(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """big joined to small (one row a key, a name and a few numbers), which is broadcast if its counted rows are few."""
    if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return big.join(F.broadcast(small), on, how)
    return dealt_join(big, small, on, how)


#: Name of a unique key of rows.
ROW = "_row_key"


def keyed(df: DataFrame) -> DataFrame:
    """df with a unique key of its rows, written, so that every reading of df gives a row the same key."""
    return stash(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def fold(doc_id: Column, n: int, salt: str = "fold") -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), doc_id), F.lit(n))


def labelled(documents: DataFrame, labels: DataFrame, label: str, max_per_class: int, columns: list[str]) -> DataFrame:
    """Documents with a 0/1 label, about max_per_class of each class at most, without the held-out rows.

    The sample is chosen by a hash of doc_id. It is bounded, so that its ids can be broadcast: the text side of
    the join is read once and only the sample's texts are shuffled. A doc_id with both labels counts as 1; of several
    texts of a doc_id the smallest counts.
    """
    return sampled(documents, labels, label, max_per_class, columns)[0]


def sampled(documents: DataFrame, labels: DataFrame, label: str, max_per_class: int, columns: list[str]) -> tuple[DataFrame, dict[int, float]]:
    """The rows of labelled(), and each class's sampling rate: the share of its labels, held-out ones aside, that are in."""
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rates = {y: min(1.0, max_per_class / n) for y, n in sizes.items()}
    share = F.lit(0.0)
    for y, rate in rates.items():
        share = F.when(F.col("y") == y, F.lit(rate)).otherwise(share)
    known = known.where(fold(F.col("doc_id"), 1_000_000, "sample") < share * 1_000_000)
    rows = documents.select("doc_id", *columns).join(F.broadcast(known), "doc_id")
    least = rows.groupBy("doc_id", "y").agg(F.min(F.struct(*columns)).alias("r"))  # of repeated ids one text
    return least.select("doc_id", *(F.col(f"r.{c}").alias(c) for c in columns), "y"), rates


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights (the intercept last) of a ridge logistic regression by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def pieces_of(frame, columns: list[str], chars: int = 4_000_000):
    """Slices of a pandas batch with about so many characters each, so that very long texts don't add up."""
    at = total = 0
    lengths = [sum(len(v) for v in row if isinstance(v, str)) for row in zip(*(frame[c] for c in columns), strict=True)]
    for i, n in enumerate(lengths):
        if total and total + n > chars:
            yield frame.iloc[at:i]
            at, total = i, 0
        total += n
    if at < len(frame):
        yield frame.iloc[at:]


class WordTable(dict):
    """Vectors of words, computed once while they stay in a bounded table; vectors: words to their rows."""

    def __init__(self, vectors, width: int, size: int = 100_000, chunk: int = 20_000):
        super().__init__()
        self.vectors, self.at, self.size, self.chunk = vectors, np.zeros((size, width)), size, chunk

    def rows(self, tokens: list[str]):
        """The tokens' vectors, in blocks of at most `chunk` tokens."""
        for i in range(0, len(tokens), self.chunk):
            part = tokens[i : i + self.chunk]
            fresh = [w for w in set(part) if w not in self]
            if len(self) + len(fresh) > self.size:
                self.clear()
                fresh = list(set(part))
            if fresh:
                n = len(self)
                self.at[n : n + len(fresh)] = self.vectors(fresh)
                self.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            yield self.at[np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))]


class Shared:
    """A broadcast value that executors can read without having this package's modules. Read value once a task."""

    def __init__(self, spark: SparkSession, value):
        from pyspark import cloudpickle

        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        import pickle

        return pickle.loads(self._sent.value)

    def release(self) -> None:
        """The value will not be read again."""
        self._sent.unpersist()
