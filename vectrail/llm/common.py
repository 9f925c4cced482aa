"""What several operators share: Arrow helpers, rows told apart by hashes of
themselves, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.sources.shared import Stored, fresh_path, shared_dir, stored

__all__ = ["KEY", "Plain", "Stored", "components", "fresh_path", "named", "shared_dir", "stored", "table", "whole_keys"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


#: A column that tells rows apart where ids may be null or repeated.
KEY = "__key"


class Plain:
    """A table with its columns renamed to ``c0``, ``c1``, ..., so that names of any
    kind are safe and none of them meets a name of ours."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.df = docs.toDF(*[f"c{k}" for k in range(len(self.names))])

    def __call__(self, name: str) -> str:
        """What the column is called in ``df``; the name's case counts only where two differ in nothing else."""
        found = [k for k, n in enumerate(self.names) if n == name] or [k for k, n in enumerate(self.names) if n.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name!r} among {self.names}")
        return f"c{found[0]}"

    def keyed(self) -> DataFrame:
        """``df`` with ``KEY``, a 128-bit hash of the whole row, the same however often a
        task runs; only rows that are equal throughout share it."""
        parts = [x for f in self.df.schema for x in (F.isnull(f.name), hashable(f.name, f.dataType))]
        return self.df.withColumn(KEY, F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(k), *parts)) for k in (1, 2)]))

    def named(self, df: DataFrame) -> DataFrame:
        """A table with the columns of ``df`` (and others) under their own names again."""
        return df.select(*self.df.columns).toDF(*self.names)


def hashable(name: str, kind: T.DataType) -> Column:
    """The column, as text where it holds maps, which have no hash."""
    return F.to_json(F.struct(name), {"ignoreNullFields": "false"}) if holds_map(kind) else F.col(name)


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and holds_map(kind.elementType)


def whole_keys(batches):
    """Batches of rows sorted by ``key``, cut anew so that no key is split."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a BIGINT, b BIGINT)``.

    Returns ``(node, root)`` for every node that has an edge; root is the
    smallest node of the component. Each round points every node at its
    smallest neighbour, follows the pointers twice, and contracts the graph;
    what is left shrinks at every round. All state lives in stored tables.
    """
    one = edges.where("a <> b")
    e = Stored(one.union(one.select("b", "a")).distinct(), "edges")
    labels: Stored | None = None
    while not e.df.isEmpty():
        p = Stored(e.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "up")
        for _ in range(2):
            old, up = p, p.df.select(F.col("node").alias("root"), F.col("root").alias("top"))
            p = Stored(p.df.join(up, "root").select("node", F.col("top").alias("root")), "up")
            old.drop()
        if labels is None:
            new_labels = Stored(p.df, "labels")
        else:
            up = p.df.select(F.col("node").alias("root"), F.col("root").alias("top"))
            new_labels = Stored(labels.df.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
            labels.drop()
        labels = new_labels
        pa = p.df.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        pb = p.df.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = e.df.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        old, e = e, Stored(left, "edges")
        old.drop()
        p.drop()
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))
    return labels.df
