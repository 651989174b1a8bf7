"""Scratch tables in the shared folder and joins that survive hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import redress
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redress.session import checkpoint_dir

#: Keys that :func:`attach` joins by broadcast: at most this many rows, whatever the input.
HOT_KEYS = 1000
#: Groups of up to so many rows are left to the ordinary join.
HOT_ROWS = 1000

#: Decisions on so many documents (about 50 MB) go to the tasks that hold the
#: texts; beyond, the texts are shuffled to the decisions.
FEW_DECISIONS = 500_000

#: The white space that the text operators know: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    they can import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(redress.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="redress-ship-"), "redress.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    z.write(whole, os.path.relpath(whole, os.path.dirname(top)))
    sc.addPyFile(path)  # served by the driver to the executors
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor re-reads files and recomputes
    nothing that came before.  The folder lives as long as the run's
    checkpoint folder.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: DataFrame | list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be
    no column of ``taken``, whatever the case of its letters."""
    used = {c.lower() for c in (taken if isinstance(taken, list) else taken.columns)}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def attach(left: DataFrame, groups: DataFrame, key: str, size: str, few: int = 0) -> DataFrame:
    """``left`` left-joined to ``groups`` (one row per ``key``) on ``key``.

    ``size`` is the column of ``groups`` that says how many rows of ``left``
    share the key.  The :data:`HOT_KEYS` largest groups (a fixed number of
    rows) are joined by broadcast, so a key that holds a third of the rows is
    never shuffled to one task; the others go through an ordinary join.
    Rows with a null key get nulls.  ``left`` is read twice: give it stored.
    Where ``groups`` (stored: it is counted) has at most ``few`` rows, all of
    them are broadcast and ``left`` is not shuffled at all.  Columns of
    ``groups`` have other names than those of ``left``.
    """
    names = [*left.columns, *[c for c in groups.columns if c != key]]
    if few and groups.count() <= few:
        return left.join(F.broadcast(groups), key, "left").select(*names)
    (mark,) = fresh(names, "_hot")
    hot = groups.where(F.col(size) > HOT_ROWS).orderBy(F.desc(size), key).limit(HOT_KEYS).withColumn(mark, F.lit(True))
    marked = left.join(F.broadcast(hot), key, "left")
    first = marked.where(F.col(mark)).select(*names)
    rest = marked.where(F.col(mark).isNull()).select(*left.columns).join(groups, key, "left").select(*names)
    return first.unionByName(rest)


def sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About ``rows`` rows of ``df``, at most twice as many; all if it has no
    more.  Rows are chosen by the hash of the columns ``by``, where they are:
    nothing is sorted or gathered."""
    total = df.count()
    if total <= rows:
        return df
    drawn = F.pmod(F.xxhash64(*by), F.lit(1 << 31)) < int(rows / total * (1 << 31))
    return df.where(drawn).limit(2 * rows)
