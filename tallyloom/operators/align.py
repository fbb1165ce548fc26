"""Nearest tables, aligned fields, scores and clusters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import expressions as X
from .fieldstats import FieldStats, group_of

#: Vectors of a block; blocks of queries meet blocks of items. So many queries are compared at a time.
BLOCK, ROWS = 4096, 256
SIZE_RATIO, COVERAGE = (0.7, 1.3), 0.95


def _blocks(df: DataFrame, id_column: str, vector: str, name: str) -> tuple[DataFrame, int]:
    """name (number of the block) and its ids and vectors, a row a block; and how many blocks there are. Floats stay floats until they are compared."""
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    known = df.where(F.col(vector).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector).cast(kind).alias("vector"))
    n = max(1, -(-known.count() // BLOCK))
    return known.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)).agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("vector")).alias(f"{name}_flat")), n


def _matrix(block: pa.Table, ids: str, flat: str) -> tuple[pa.Array, np.ndarray]:
    names = block[ids].chunk(0)[0].values
    return names, block[flat].chunk(0)[0].values.to_numpy(zero_copy_only=False).reshape(len(names), -1).astype(np.float64)


def _best(left: pa.Table, right: pa.Table, k: int, target: pa.Schema) -> pa.Table:
    """The k best items (right) of each query (left) of two blocks, ROWS queries at a time."""
    if not left.num_rows or not right.num_rows:
        return target.empty_table()
    (q_ids, m), (i_ids, own) = _matrix(left, "q_ids", "q_flat"), _matrix(right, "i_ids", "i_flat")
    by_name = np.argsort(i_ids.to_numpy(zero_copy_only=False), kind="stable")
    own = own[by_name]
    length, finite = np.linalg.norm(own, axis=1), bool(np.isfinite(m).all() and np.isfinite(own).all())
    found = []
    for at in range(0, len(m), ROWS):
        part = m[at : at + ROWS]
        s = part @ own.T
        s /= np.maximum(np.linalg.norm(part, axis=1)[:, None] * length[None, :], 1e-6)
        if finite and k < len(own):  # no more than those that may be among the k best once they are rounded are put in order
            bar = np.partition(s, -k, axis=1)[:, -k] - 1e-9
            row, item = np.nonzero(s >= bar[:, None])
            value = np.round(s[row, item], 12)
            order = np.lexsort((item, -value, row))
            row, item, value = row[order], item[order], value[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, item, value = row[first], item[first], value[first]
        else:
            s = np.round(s, 12)
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            row, item, value = np.repeat(np.arange(len(part)), order.shape[1]), order.ravel(), np.take_along_axis(s, order, 1).ravel()
        found.append(pa.table([q_ids.take(pa.array(at + row)), i_ids.take(pa.array(by_name[item])), pa.array(value)], schema=target))
    return pa.concat_tables(found)


def nearest(queries: DataFrame, items: DataFrame, k: int, id_column: str = "id", vector: str = "vector") -> DataFrame:
    """query_id, item_id, similarity (cosine) and rank of each query's k nearest items; equals go by id. An item may be its own query.

    Both sides are cut into blocks of bounded size. Each block of items meets every block of queries; a task holds one pair of
    blocks at a time, and the similarities of ROWS queries, keeping the k best of each, so what goes on is k rows a query and block of items.
    Neither side comes to the driver. A null vector is left out.
    """
    q, n = _blocks(queries, id_column, vector, "q")
    i, m = _blocks(items, id_column, vector, "i")
    left = q.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).groupBy("q", "i")
    right = i.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).groupBy("q", "i")
    kinds = StructType([StructField("query_id", queries.schema[id_column].dataType), StructField("item_id", items.schema[id_column].dataType), StructField("similarity", DoubleType())])
    target = to_arrow_schema(kinds)
    found = left.cogroup(right).applyInArrow(lambda a, b: _best(a, b, k, target), kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mutual_best(pairs: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Of pairs (q_table, q_field, c_table, c_field, similarity): those that are best for both sides, and similar enough.

    Pairs are of the fields of candidate table pairs only. Equals go by the fields' order.
    """
    near = pairs.where(F.col("similarity") >= threshold)
    there = Window.partitionBy("q_table", "c_table", "q_field").orderBy(F.desc("similarity"), "c_field")
    back = Window.partitionBy("q_table", "c_table", "c_field").orderBy(F.desc("similarity"), "q_field")
    return near.withColumn("r1", F.row_number().over(there)).withColumn("r2", F.row_number().over(back)).where("r1 = 1 AND r2 = 1").drop("r1", "r2")


def field_pairs(fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs of fields of the candidate table pairs (q_table, c_table), with their cosine. fields: table_id, field, vector."""
    q = fields.select(F.col("table_id").alias("q_table"), F.col("field").alias("q_field"), F.col("vector").alias("qv"))
    c = fields.select(F.col("table_id").alias("c_table"), F.col("field").alias("c_field"), F.col("vector").alias("cv"))
    return candidates.select("q_table", "c_table").distinct().join(q, "q_table").join(c, "c_table").select("q_table", "c_table", "q_field", "c_field", X.cosine(F.col("qv"), F.col("cv")).alias("similarity"))


def table_scores(aligned: DataFrame, sizes: DataFrame) -> DataFrame:
    """0.4 mean similarity + 0.3 query coverage + 0.15 candidate coverage + 0.15 size ratio for each pair of tables. sizes: table_id, n_fields."""
    each = aligned.groupBy("q_table", "c_table").agg(F.avg("similarity").alias("mean_similarity"), F.count_distinct("q_field").alias("q_hit"), F.count_distinct("c_field").alias("c_hit"))
    q = sizes.select(F.col("table_id").alias("q_table"), F.col("n_fields").alias("q_n"))
    c = sizes.select(F.col("table_id").alias("c_table"), F.col("n_fields").alias("c_n"))
    out = each.join(q, "q_table").join(c, "c_table").withColumn("q_coverage", F.col("q_hit") / F.col("q_n")).withColumn("c_coverage", F.col("c_hit") / F.col("c_n"))
    score = 0.4 * F.col("mean_similarity") + 0.3 * F.col("q_coverage") + 0.15 * F.col("c_coverage") + 0.15 * F.least("q_n", "c_n") / F.greatest("q_n", "c_n")
    return out.withColumn("score", score)


def richness(s: FieldStats) -> float:
    """How much a column's values spread, from 0.001 to 1."""
    group = group_of(s.source)
    if group == "number" and not s.source.startswith("decimal"):
        low, high = (s.min_val, s.max_val) if s.min_val is not None and s.max_val is not None else (0.001, 0.002)
    elif group == "text":
        low, high = (s.char_min_length, s.char_max_length) if s.char_min_length is not None and s.char_max_length is not None else (0.001, 0.002)
    elif group in ("stamp", "date"):
        return min(1.0, max(0.001, 1.0 if s.histogram_entropy is None else s.histogram_entropy))
    else:
        return 1.0
    return min(1.0, max(0.001, (high - low) / (high - low + 1.0)))


def field_weight(s: FieldStats) -> float:
    """A field's part in its table's vector, 0.001 at least. The cardinality is a ratio of at most 1, whose logarithm is taken as 0.001: so all weights come out equal but for rounding, as in the reference."""
    if not s.sample_size:
        return 0.001
    validity = 1.0 - s.null_count / s.sample_size
    spread = max(float(s.distinct_count) if s.cardinality is None else s.cardinality, 1.0)
    info = max(s.entropy if not math.isnan(s.entropy) else 0.001, 0.001) * max(math.log(spread), 0.001)
    variety = 0.001 if s.distinct_count <= 1 else min(1.0, max(0.001, s.distinct_count / s.sample_size))
    w = validity * info * richness(s) * variety
    return max(w, 0.001) if math.isfinite(w) else 0.001


def table_vectors(fields: DataFrame) -> DataFrame:
    """table_id and the normalised mean of its fields' vectors, weighted if there is a column weight. fields: table_id, vector."""
    weight = F.col("weight") if "weight" in fields.columns else F.lit(1.0)
    mean = fields.select("table_id", weight.alias("w"), F.posexplode("vector").alias("pos", "x")).groupBy("table_id", "pos").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("x"))
    whole = mean.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return whole.select("table_id", X.normalised(F.col("v")).alias("vector"))
