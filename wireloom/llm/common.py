"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wireloom.session import scratch_path

# words end at ASCII white space only, as ``bytes.split()`` does in Python
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CLEAN_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by position, so that other columns of like or equal name do no harm.

    An exact match wins over one that differs in case, the first over later ones.
    """
    have = list(df.columns)
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    lower = [c.lower() for c in have]
    out = []
    for name in names:
        at = have.index(name) if name in have else lower.index(name.lower())
        out.append(F.col(f"_c{at}").alias(name))
    return plain.select(*out)


class Guarded:
    """``df`` with the needed columns under their names and all others as ``_x0``, ``_x1`` and so on.

    Whatever names the caller's extra columns have, they cannot clash with an operator's own.
    ``restore`` gives them their names back; columns called like an added one are replaced.
    """

    def __init__(self, df: DataFrame, needs: Sequence[str], added: Sequence[str]):
        have = list(df.columns)
        lower = [c.lower() for c in have]
        at = {(have.index(n) if n in have else lower.index(n.lower())): n for n in needs}
        self.inner = [at.get(i, f"_x{i}") for i in range(len(have))]
        taken = {n.lower() for n in added}
        self.order = [(self.inner[i], c) for i, c in enumerate(have) if i in at or c.lower() not in taken]
        self.work = df.toDF(*self.inner).select(*[i for i, _ in self.order])

    def restore(self, df: DataFrame, *added: Column | str) -> DataFrame:
        extra = [F.col(a) if isinstance(a, str) else a for a in added]
        names = [n for _, n in self.order]
        out = df.select(*[F.col(i) for i, _ in self.order], *extra)
        return out.toDF(*names, *out.columns[len(names):])


class Temporary:
    """Scratch tables stored within a ``with`` block go when it ends, but those that it returns with ``keep``.

    For steps whose result is stored itself: what they were made of is not read again then.
    """

    _open: list[Temporary] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Temporary:
        Temporary._open.append(self)
        return self

    def keep(self, df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
        """Store ``df`` for longer than the block lasts."""
        out = stored(df, purpose, compression)
        path = self.paths.pop()
        if len(Temporary._open) > 1:
            Temporary._open[-2].paths.append(path)
        return out

    def __exit__(self, kind, *rest) -> None:
        Temporary._open.remove(self)
        if kind is None:
            for path in self.paths:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """Write once as a scratch table in the shared folder and go on from there.

    Later steps read single columns of it, and a lost executor costs no recomputation. Nothing
    reads the write's shuffle files again, so they go as soon as it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    if Temporary._open:
        Temporary._open[-1].paths.append(path)
    before = spark.conf.get(CLEAN_SHUFFLE, None)
    spark.conf.set(CLEAN_SHUFFLE, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLE)
        else:
            spark.conf.set(CLEAN_SHUFFLE, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def id_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; an unknown id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % parts


def arrow_schema(fields: Sequence[tuple[str, str]]) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))


def extended(df: DataFrame, added: Sequence[tuple[str, str]]) -> T.StructType:
    """The columns of ``df`` followed by added ones, all nullable, for Arrow functions."""
    extra = arrow_schema(added)
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields] + list(extra.fields))


def spans_of(sizes: Sequence[int], most: int) -> list[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``most``; one row at least each."""
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            out.append((start, i))
            start, total = i, 0
        total += size
    if len(sizes) > start:
        out.append((start, len(sizes)))
    return out
