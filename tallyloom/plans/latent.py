"""The latent store: definitions of tables and fields with their vectors, as Parquet tables."""

from __future__ import annotations

from dataclasses import fields as dataclass_fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align
from ..sources.catalog import FieldDef, TableRep

FIELD_DEF = "id string NOT NULL, table_id string NOT NULL, name string NOT NULL, canonical_type string NOT NULL, type_confidence float, column_default string, is_nullable boolean NOT NULL, char_max_length int, numeric_precision int, numeric_scale int, datetime_precision int, vector array<float>"
TABLE_DEF = "id string NOT NULL, silo_id string NOT NULL, table_schema string NOT NULL, name string NOT NULL, fields array<string> NOT NULL, num_fields smallint NOT NULL, vector array<float>"
SCHEMAS = {"table_def": TABLE_DEF, "field_def": FIELD_DEF}


class LatentStore:
    """Two tables below a path: that given, or `latent` in the session's warehouse. There is no index: search is exact, in blocks."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{spark.conf.get('spark.sql.warehouse.dir')}/latent"

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def initialize(self) -> None:
        """Both tables, empty; what they held goes."""
        for name, schema in SCHEMAS.items():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self._at(name))

    clear = initialize

    def append(self, name: str, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(self._at(name))

    def frame(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self._at(name))

    def store(self, tables: list[tuple[TableRep, list[tuple[FieldDef, list[float] | None, float]]]]) -> None:
        """Appends tables and their fields: definitions, vectors and weights. A table's vector is the weighted mean of its fields' ones, of length one."""
        columns = [f.name for f in dataclass_fields(FieldDef)]
        self.append("field_def", [(*(getattr(f, c) for c in columns), v) for _, fs in tables for f, v, _ in fs])
        weighed = [(t.id, v, w) for t, fs in tables for _, v, w in fs if v is not None]
        vectors = {r.table_id: list(r.vector) for r in align.table_vectors(self.spark.createDataFrame(weighed, "table_id string, vector array<double>, weight double")).collect()} if weighed else {}
        self.append("table_def", [(t.id, t.silo_id, t.table_schema, t.name, t.fields, t.num_fields, vectors.get(t.id)) for t, _ in tables])

    def load_fields(self, table_ids: list[str], columns: list[str] | None = None) -> DataFrame:
        """The fields of these tables; both the rows and the columns are chosen in the scan."""
        return self.frame("field_def").where(F.col("table_id").isin(table_ids)).select(*(columns or ["*"]))

    def field_defs(self, table_ids: list[str]) -> list[FieldDef]:
        rows = self.load_fields(table_ids, [f.name for f in dataclass_fields(FieldDef)]).orderBy("table_id", "id").collect()
        return [FieldDef(**r.asDict()) for r in rows]

    def table_reps(self, ids: list[str] | None = None) -> list[TableRep]:
        found = self.frame("table_def").drop("vector")
        rows = (found.where(F.col("id").isin(ids)) if ids is not None else found).orderBy("id").collect()
        return [TableRep(r.id, r.silo_id, r.table_schema, r.name, list(r.fields), r.num_fields) for r in rows]

    def search(self, ids: list[str], k: int, other_silos: bool = False) -> DataFrame:
        """query_id, item_id, confidence (cosine) and rank of the k nearest tables of each of these, itself among them unless only other silos are wanted; of those, tables of unlike sizes are left out."""
        tables = self.frame("table_def").where("vector IS NOT NULL")
        silo = tables.select(F.col("id").alias("item_id"), F.col("silo_id").alias("item_silo"), F.col("num_fields").alias("item_n"))
        own = tables.select(F.col("id").alias("query_id"), F.col("silo_id").alias("query_silo"), F.col("num_fields").alias("query_n"))
        queries = tables.where(F.col("id").isin(ids))
        if other_silos:
            found = None
            for (s,) in queries.select("silo_id").distinct().orderBy("silo_id").collect():  # one search a silo, against all others
                one = align.nearest(queries.where(F.col("silo_id") == s), tables.where(F.col("silo_id") != s), k)
                found = one if found is None else found.unionAll(one)
        else:
            found = align.nearest(queries, tables, k)
        if found is None:
            return self.spark.createDataFrame([], "query_id string, item_id string, confidence double, rank int")
        ratio = F.col("item_n") / F.col("query_n")
        return found.join(own, "query_id").join(silo, "item_id").where(ratio.between(*align.SIZE_RATIO)).select("query_id", "item_id", F.col("similarity").alias("confidence"), "rank")
