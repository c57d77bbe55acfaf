"""Components of merge pairs, guarded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge_roots(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest member (doc_id, node, root) of each node's component; edges (doc_id, a, b) never leave a document.

    Nodes and edges of a document lie together in one partition; many documents at once are lowered in numpy until they
    settle, in about the logarithm of the longest chain's length. A task holds a batch of rows and the lines of a document.
    Edges to nodes that are not there are dropped.
    """
    none = F.lit(None).cast("long")
    rows = nodes.select("doc_id", F.col("node").cast("long").alias("a"), none.alias("b")).unionByName(edges.select("doc_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))

    def lowered(t: pa.Table) -> pa.RecordBatch:
        doc = t["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        a, b = t["a"].to_numpy(), t["b"].fill_null(-1).to_numpy()
        is_node = t["b"].is_null().to_numpy()
        first, many = (int(a[is_node].min()), int(np.ptp(a[is_node])) + 1) if is_node.any() else (0, 1)
        code = lambda x, m: doc[m] * many + (x[m] - first)
        names, at = np.unique(code(a, is_node), return_index=True)
        known = ~is_node & (np.minimum(a, b) >= first) & (np.maximum(a, b) < first + many)
        ends = [code(x, known) for x in (a, b)]
        there = np.isin(ends[0], names) & np.isin(ends[1], names)
        x, y = (np.searchsorted(names, e[there]) for e in ends)
        root = np.arange(len(names))
        while len(x):
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            apart = low < high
            x, y, low, high = x[apart], y[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        of = np.flatnonzero(is_node)[at]
        node = a[of]
        return pa.RecordBatch.from_arrays([t["doc_id"].take(pa.array(of)).combine_chunks(), pa.array(node), pa.array(node[root])], names=["doc_id", "node", "root"])

    def fold(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            doc = t["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            begin = int(np.searchsorted(doc, doc[-1]))  # the last document may go on
            if begin:
                yield lowered(t.slice(0, begin))
            held = t.slice(begin)
        if held is not None and held.num_rows:
            yield lowered(held)

    kind = nodes.schema["doc_id"].dataType.simpleString()
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(fold, f"doc_id {kind}, node long, root long")


def guarded_merge(roots: DataFrame, least: float = 0.5) -> DataFrame:
    """The merge of a document is ignored if it would leave fewer than half as many components as nodes."""
    count = roots.groupBy("doc_id").agg((F.countDistinct("root") >= F.count(F.lit(1)) * least).alias("ok"))
    return roots.join(count, "doc_id").select("doc_id", "node", F.when(F.col("ok"), F.col("root")).otherwise(F.col("node")).alias("root"))
