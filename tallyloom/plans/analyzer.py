"""From data stores to clusters of tables and fields that hold the same information."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import describe
from ..operators import align, cluster, promote
from ..operators.fieldstats import FieldStats, field_stats
from ..sources import catalog
from ..sources.stores import Source, SourceError
from .latent import LatentStore

#: Types whose columns are promoted when tables are read.
PROMOTED = ("string", "int", "bigint", "double")


@dataclass(frozen=True)
class Similarity:
    threshold: float = 0.55
    top_k: int | None = None
    other_silos: bool = False


@dataclass(frozen=True)
class Scoring:
    type_weight: float = 1.0
    structure_weight: float = 0.0

    def __post_init__(self) -> None:
        if abs(self.type_weight + self.structure_weight - 1) > 1e-6:
            raise SourceError("scoring weights add up to 1")


@dataclass
class Stats:
    sources_analyzed: int = 0
    tables_found: int = 0
    tables_inferred: int = 0
    fields_inferred: int = 0
    errors: list[str] = field(default_factory=list)


@dataclass
class Profile:
    """A field: its definition, statistics, paragraph and vector."""

    definition: catalog.FieldDef
    stats: FieldStats
    paragraph: str
    vector: list[float]


@dataclass
class Cluster:
    cluster_id: int
    tables: list[str]
    field_clusters: list[dict]
    confidence: float
    coverage_score: float


@dataclass
class Report:
    stats: Stats
    clusters: list[Cluster]


def profile_table(df: DataFrame, table: catalog.TableDef, embedder: describe.Embedder) -> list[Profile]:
    """Statistics, promotion, casts, statistics of what was cast, and words for every column. table: definitions where a catalog has them; other columns get new ones."""
    df = df.cache()
    try:
        declared = {f.name: f for f in table.fields}
        stats = field_stats(df)
        able = [c for c, k in df.dtypes if k in PROMOTED or k.startswith("timestamp")]
        chosen = {p.column: p for p in promote.promote(df.select(*(F.col(f"`{c}`") for c in able)), stats={c: stats[c] for c in able})} if able else {}
        after = promote.apply(df, list(chosen.values()))
        changed = [c for (c, a), (_, b) in zip(df.dtypes, after.dtypes) if a != b]
        if changed:
            stats |= field_stats(after.select(*(F.col(f"`{c}`") for c in changed)))
        found = []
        for c, kind in df.dtypes:
            s, p = stats[c], chosen.get(c)
            f = declared.get(c) or catalog.FieldDef(catalog.stable_id(table.id, c), table.id, c, promote.logical(kind), catalog.DECLARED)
            target, sure = (p.target, p.confidence) if p else (f.canonical_type, 1.0)
            f = catalog.promoted(f, target, sure, s.is_null, promote.meta_for(target, s, f.char_max_length))
            length = f.char_max_length if f.char_max_length is not None else s.char_max_length
            say = describe.paragraph(f.canonical_type, f.type_confidence, f.is_nullable, s, f.column_default, length, f.numeric_precision, f.numeric_scale, f.datetime_precision)
            found.append((f, s, say))
        vectors = embedder([say for _, _, say in found])
        return [Profile(f, s, say, v) for (f, s, say), v in zip(found, vectors)]
    finally:
        df.unpersist()


class SchemaAnalyzer:
    """Reconciles the schemas of two or more sources.

    threads: tables that are profiled side by side. persist_path: where the latent store is; it is emptied when an analysis begins.
    """

    def __init__(self, spark: SparkSession, sources: list[Source], similarity: Similarity = Similarity(), embedder: describe.Embedder = describe.hashed, persist_path: str | None = None, threads: int = 3, name: str = "analysis", scoring: Scoring = Scoring()):
        if len(sources) < 2:
            raise SourceError("at least two sources are needed")
        if threads < 1:
            raise SourceError("threads is 1 or more")
        self.spark, self.sources, self.similarity, self.embedder, self.threads, self.name, self.scoring = spark, sources, similarity, embedder, threads, name, scoring
        self.latent_store = LatentStore(spark, persist_path)
        self.stats = Stats()
        self.profiles: dict[str, list[Profile]] = {}

    def discover(self) -> list[catalog.TableDef]:
        """All tables of all sources, profiled and stored. A source or table that can't be read is noted and left out; one without columns too."""
        self.latent_store.initialize()
        jobs = []
        for source in self.sources:
            self.stats.sources_analyzed += 1
            try:
                found = source.tables(self.spark, self.stats.errors)
                known = {t.name: t for t in source.catalog(self.spark)}
            except Exception as e:
                self.stats.errors.append(f"{source.silo_id}: {e}")
                continue
            for name, df in found.items():
                self.stats.tables_found += 1
                blank = catalog.TableDef(catalog.stable_id(source.silo_id, name), source.silo_id, "default", name)
                jobs.append((source, df, known.get(name, blank)))

        def one(job) -> tuple[catalog.TableDef, list[Profile]] | str:
            source, df, table = job
            try:
                return table, profile_table(df, table, self.embedder)
            except Exception as e:
                return f"{source.silo_id}.{table.name}: {e}"

        with ThreadPoolExecutor(self.threads) as pool:
            results = list(pool.map(one, jobs))
        tables = []
        for r in results:
            if isinstance(r, str) or not r[1]:
                self.stats.errors.append(r if isinstance(r, str) else f"{r[0].silo_id}.{r[0].name}: no columns")
                continue
            table, own = r
            table.fields = [p.definition for p in own]
            self.profiles[table.id] = own
            self.stats.tables_inferred += 1
            self.stats.fields_inferred += len(own)
            tables.append(table)
        self.latent_store.store([(t.rep(), [(p.definition, p.vector, align.field_weight(p.stats)) for p in self.profiles[t.id]]) for t in tables])
        return tables

    def analyze(self) -> Report:
        """Tables that are near, cover each other's fields by mutual best matches, and match the same fields alike, are one cluster."""
        tables = self.discover()
        if not tables:
            return Report(self.stats, [])
        ordinals = self.spark.createDataFrame([(t.id, f.id, k) for t in tables for k, f in enumerate(t.fields)], "table_id string, field string, ordinal int")
        vectors = self.latent_store.frame("field_def").select("table_id", F.col("id").alias("field"), "vector").join(ordinals, ["table_id", "field"])
        found = self.latent_store.search([t.id for t in tables], (self.similarity.top_k or len(self.sources)) + (not self.similarity.other_silos), self.similarity.other_silos)
        candidates = found.where("query_id <> item_id").select(F.col("query_id").alias("q_table"), F.col("item_id").alias("c_table"))
        tables_frame, fields_frame = cluster_tables(vectors, candidates, ordinals, self.similarity.threshold)
        rows = cluster.deduplicated(tables_frame, fields_frame).collect()
        names, of = {f.id: f for t in tables for f in t.fields}, {t.id: t for t in tables}
        out = []
        for r in sorted(rows, key=lambda r: (-len(r.tables), r.tables, r.q_table)):
            label = lambda i: f"{of[i].silo_id}.{of[i].name}"
            own = [{"fields": [f"{label(f.table_id)}.{names[f.field].name}" for f in x.fields], "confidence": round(x.confidence, 6)} for x in r.field_clusters or []]
            own = own or [{"fields": [f"{label(t)}.{f.name}"], "confidence": 1.0} for t in r.tables for f in of[t].fields]
            out.append(Cluster(len(out), sorted(map(label, r.tables)), own, r.confidence, r.coverage_score))
        return Report(self.stats, out)


def cluster_tables(fields: DataFrame, candidates: DataFrame, ordinals: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Table and field clusters of each query table. fields: table_id, field, vector and ordinal; candidates: q_table, c_table; ordinals: table_id, field, ordinal."""
    aligned = align.mutual_best(align.field_pairs(fields, candidates), threshold)
    sizes = ordinals.groupBy("table_id").agg(F.count("*").alias("n_fields"))
    scores = align.table_scores(aligned, sizes)
    members = cluster.with_query(cluster.covered(aligned, scores), ordinals).cache()
    found = cluster.similarity_vectors(members, ordinals)
    groups = cluster.components(found, cluster.edges(found, threshold))
    return cluster.clusters(members, scores, groups)
