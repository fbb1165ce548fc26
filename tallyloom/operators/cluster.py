"""From aligned fields to scored tables and clusters, for each query table, as frames.

A query table's scores hold the tables that cover it, and itself with score 1. Two of them are
joined by an edge if the vectors of their similarities to the query's fields have a cosine, and the sets of matched
query fields a Jaccard index, of at least the threshold. Connected tables are a cluster.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import align


def covered(aligned: DataFrame, scores: DataFrame, least: float = align.COVERAGE) -> DataFrame:
    """The aligned pairs of tables that cover each other."""
    good = scores.where((F.col("q_coverage") >= least) & (F.col("c_coverage") >= least)).select("q_table", "c_table")
    return aligned.join(good, ["q_table", "c_table"], "left_semi")


def with_query(aligned: DataFrame, fields: DataFrame) -> DataFrame:
    """aligned, and each query table against itself: every field with similarity 1. fields: table_id, field."""
    own = fields.select(F.col("table_id").alias("q_table"), F.col("table_id").alias("c_table"), F.col("field").alias("q_field"), F.col("field").alias("c_field"), F.lit(1.0).alias("similarity"))
    return aligned.select("q_table", "c_table", "q_field", "c_field", "similarity").unionByName(own)


def similarity_vectors(members: DataFrame, ordinals: DataFrame) -> DataFrame:
    """q_table, table_id, matched (indices of the query's fields) and vector: at each index the best similarity, 0 where nothing matched.

    members: with_query's rows; ordinals: table_id, field, ordinal (from 0).
    """
    at = ordinals.select(F.col("table_id").alias("q_table"), F.col("field").alias("q_field"), "ordinal")
    placed = members.join(at, ["q_table", "q_field"])
    size = placed.groupBy("q_table").agg((F.max("ordinal") + 1).alias("size"))
    found = placed.groupBy("q_table", F.col("c_table").alias("table_id")).agg(F.collect_list(F.struct(F.col("ordinal").alias("i"), F.col("similarity").alias("sim"))).alias("pairs"))
    vector = X.similarity_vector(F.col("pairs"), F.col("size"))
    return found.join(size, "q_table").select("q_table", "table_id", F.array_sort(F.array_distinct(F.transform("pairs", lambda p: p["i"]))).alias("matched"), vector.alias("vector"))


def edges(vectors: DataFrame, threshold: float) -> DataFrame:
    """q_table, a, b (a < b), cosine and jaccard of the pairs of a query's tables that both measures join. The tables of one query are few: its nearest ones."""
    a = vectors.select("q_table", F.col("table_id").alias("a"), F.col("matched").alias("am"), F.col("vector").alias("av"))
    b = vectors.select("q_table", F.col("table_id").alias("b"), F.col("matched").alias("bm"), F.col("vector").alias("bv"))
    both = a.join(b, "q_table").where("a < b").select("q_table", "a", "b", X.cosine(F.col("av"), F.col("bv")).alias("cosine"), X.jaccard(F.col("am"), F.col("bm")).alias("jaccard"))
    return both.where((F.col("cosine") >= threshold) & (F.col("jaccard") >= threshold))


def _labels(tables: pa.Table, joined: pa.Table) -> pa.Table:
    names = tables["table_id"].to_pylist()
    label = {n: n for n in names}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in zip(joined["a"].to_pylist(), joined["b"].to_pylist()):
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return pa.table([tables["q_table"], tables["table_id"], pa.array([root(n) for n in names], tables["table_id"].type)], ["q_table", "table_id", "group"])


def components(vectors: DataFrame, joined: DataFrame) -> DataFrame:
    """q_table, table_id and group (the smallest table that edges reach). One query's tables, its nearest ones, are looked at together; queries are apart."""
    kind = dict(vectors.dtypes)["table_id"]
    left = vectors.select(F.col("q_table").alias("q_table"), F.col("table_id").alias("table_id")).groupBy("q_table")
    right = joined.select(F.col("q_table").alias("q"), "a", "b").groupBy("q")
    return left.cogroup(right).applyInArrow(_labels, f"q_table {kind}, table_id {kind}, group {kind}")


def clusters(members: DataFrame, scores: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table clusters (q_table, group, tables, confidence, coverage_score) and field clusters (q_table, group, q_field, fields, confidence).

    A field cluster is what a query's field matched within a group; its confidence is the mean similarity times the share of
    the group's tables it reaches. scores: q_table, c_table, score, q_coverage; a query's own are 1.
    """
    one = F.lit(1.0)
    known = scores.select("q_table", F.col("c_table").alias("table_id"), F.col("score").cast("double").alias("score"), F.col("q_coverage").cast("double").alias("cover"))
    placed = groups.join(known, ["q_table", "table_id"], "left").select("q_table", "table_id", "group", F.when(F.col("table_id") == F.col("q_table"), one).otherwise(F.col("score")).alias("score"), F.when(F.col("table_id") == F.col("q_table"), one).otherwise(F.col("cover")).alias("cover"))
    tables = placed.groupBy("q_table", "group").agg(F.array_sort(F.collect_list("table_id")).alias("tables"), F.avg("score").alias("confidence"), F.avg("cover").alias("coverage_score"))
    # a field of the query belongs to its own cluster only if it matched something
    matched = members.where("q_table <> c_table").select("q_table", "q_field").distinct()
    of = groups.withColumnRenamed("table_id", "c_table")
    size = groups.groupBy("q_table", "group").agg(F.count("*").alias("n_tables"))
    each = members.join(matched, ["q_table", "q_field"], "left_semi").join(of, ["q_table", "c_table"]).join(size, ["q_table", "group"])
    fields = each.groupBy("q_table", "group", "q_field").agg(
        F.array_sort(F.collect_list(F.struct(F.col("c_table").alias("table_id"), F.col("c_field").alias("field"), "similarity"))).alias("fields"),
        (F.avg("similarity") * F.count_distinct("c_table") / F.first("n_tables")).alias("confidence"),
    )
    return tables, fields


def deduplicated(tables: DataFrame, fields: DataFrame) -> DataFrame:
    """Clusters of equal tables and equal fields once: tables, field_clusters (fields, confidence), confidence, coverage_score. Of equal ones the most confident stays, then that of the first query."""
    key = F.array_sort(F.collect_list(F.struct("q_field", "fields", "confidence"))).alias("field_clusters")
    whole = tables.join(fields.groupBy("q_table", "group").agg(key), ["q_table", "group"], "left")
    names = F.array_sort(F.flatten(F.transform("field_clusters", lambda f: F.transform(f["fields"], lambda x: F.struct(x["table_id"], x["field"])))))
    marked = whole.withColumn("same", F.sha2(F.to_json(F.struct("tables", names.alias("names"))), 256))
    best = F.min_by(F.struct("tables", "field_clusters", "confidence", "coverage_score", "q_table"), F.struct(-F.col("confidence"), "q_table"))
    return marked.groupBy("same").agg(best.alias("s")).select("s.*")
