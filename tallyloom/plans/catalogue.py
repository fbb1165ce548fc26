"""One query for each operator over the given tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X, formats
from ..operators import align, cluster, profile as P, promote as R
from ..operators.fieldstats import field_stats, stats_frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def over(name: str, operator: Callable[..., DataFrame], table: str, column: str, sql: str | None) -> None:
    """Registers operator(table, column); in sql, {t} and {c} are the table and the column."""
    QUERIES[name] = lambda spark, d: rounded(operator(spark.read.parquet(f"{d}/{table}.parquet"), column))
    if sql:
        SQL[name] = sql.format(t=table, c=column)


COUNTS = "SELECT count({c}) AS sample_size, count(*) - count({c}) AS null_count, count(*) > count({c}) AS is_null, round(coalesce((count(*) - count({c})) / nullif(count({c}), 0), 0)::DOUBLE, 6) AS null_ratio, round({card}::DOUBLE, 6) AS cardinality FROM {t}"
for t, c, card in (("orders", "o_custkey", None), ("customer", "c_mktsegment", None), ("events", "props", None), ("lineitem", "l_quantity", "1.0")):
    over(f"profile_counts_{c}", P.counts, t, c, COUNTS.replace("{card}", card or "(count(DISTINCT {c}) / count(*))"))

MOMENTS = """WITH v AS (SELECT {c}::DOUBLE AS x FROM {t} WHERE {c} IS NOT NULL), m AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mu, var_pop(x) AS s2, min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS d FROM v),
p AS (SELECT sum(power(x - mu, 3)) AS d3, sum(power(x - mu, 4)) AS d4 FROM v, m)
SELECT n::BIGINT AS n, round(mu, 6) AS avg, round(lo, 6) AS min, round(hi, 6) AS max, d AS distinct_count, round(n / ((n - 1) * (n - 2)) * d3 / power(s2, 1.5), 6) AS skewness,
round(n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * d4 / (s2 * s2) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)), 6) AS kurtosis FROM m, p"""
over("moments_totalprice", P.moments, "orders", "o_totalprice", MOMENTS)
over("moments_value", P.moments, "events", "value", MOMENTS)

QUANTILES = "SELECT " + ", ".join(f"round(quantile_cont({{c}}::DOUBLE, {i}.0 / 12), 6) AS q{i}" for i in range(1, 12)) + " FROM {t}"
over("quantiles_totalprice", P.quantiles, "orders", "o_totalprice", QUANTILES)
over("quantiles_extendedprice", P.quantiles, "lineitem", "l_extendedprice", QUANTILES)
RANKS = "WITH s AS (SELECT {c}::DOUBLE AS x, row_number() OVER (ORDER BY {c}) - 1 AS k, count(*) OVER () AS n FROM {t} WHERE {c} IS NOT NULL) SELECT round(max(x) FILTER (WHERE k = least(floor(n * 0.1), n - 1)), 6) AS p10, round(max(x) FILTER (WHERE k = least(floor(n * 0.9), n - 1)), 6) AS p90 FROM s"
over("percentiles_totalprice", P.percentiles, "orders", "o_totalprice", RANKS)
over("percentiles_quantity", P.percentiles, "lineitem", "l_quantity", RANKS)

_DELTAS = "WITH s AS (SELECT {c}::DOUBLE - lag({c}::DOUBLE) OVER (ORDER BY {c}) AS d FROM {t} WHERE {c} IS NOT NULL), h AS (SELECT d, count(*)::DOUBLE AS n FROM s WHERE d IS NOT NULL GROUP BY d)"
ENTROPY = _DELTAS + ", e AS (SELECT sum(n) AS t, count(*) AS k, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM h) SELECT round(CASE WHEN k <= 1 THEN 0 ELSE e / log2(k) * (SELECT count(DISTINCT {c}::DOUBLE) / count({c}) FROM {t}) END, 6) AS entropy FROM e"
over("delta_entropy_quantity", P.delta_entropy, "lineitem", "l_quantity", ENTROPY)
over("delta_entropy_orderkey", P.delta_entropy, "lineitem", "l_orderkey", ENTROPY)
HISTOGRAM = "WITH b AS (SELECT min({c})::DOUBLE AS lo, (max({c}) - min({c}))::DOUBLE / 6 AS w FROM {t}), h AS (SELECT least(floor(({c} - lo) / w), 5) AS k, count(*)::DOUBLE AS n FROM {t}, b WHERE {c} IS NOT NULL GROUP BY 1) SELECT round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) * ln(2), 6) AS histogram_entropy FROM h"
over("histogram_entropy_value", P.histogram_entropy, "events", "value", HISTOGRAM)
over("histogram_entropy_acctbal", P.histogram_entropy, "customer", "c_acctbal", HISTOGRAM)
AUTO = "WITH s AS (SELECT {c}::DOUBLE AS x, lag({c}::DOUBLE) OVER (ORDER BY {c}) AS y, avg({c}::DOUBLE) OVER () AS mu FROM {t} WHERE {c} IS NOT NULL) SELECT round(sum((x - mu) * (y - mu)) / sum((x - mu) * (x - mu)), 6) AS autocorrelation FROM s"
over("autocorrelation_retailprice", P.autocorrelation, "part", "p_retailprice", AUTO)
over("autocorrelation_quantity", P.autocorrelation, "lineitem", "l_quantity", AUTO)
GCD = _DELTAS + " SELECT list_reduce(list(DISTINCT abs(d)::BIGINT), lambda a, b: gcd(a, b))::BIGINT AS delta_gcd FROM h WHERE d <> 0"
over("delta_gcd_orderkey", P.delta_gcd, "orders", "o_orderkey", GCD)
over("delta_gcd_size", P.delta_gcd, "part", "p_size", GCD)
FLAGS = "WITH v AS (SELECT {c}::DOUBLE AS x FROM {t} WHERE {c} IS NOT NULL) SELECT bool_and(x - trunc(x) < 1e-9 AND round(x) IN (0, 1)) AS all_int_bools, bool_and(abs(x - trunc(x)) < 2.2e-16) AND NOT bool_and(round(x) IN (0, 1)) AS all_integers FROM v"
for t, c in (("labels", "quality"), ("lineitem", "l_quantity"), ("lineitem", "l_tax")):
    over(f"number_flags_{c}", P.number_flags, t, c, FLAGS)
BANDS = " UNION ALL ".join(
    f"SELECT * EXCLUDE (inside) FROM (SELECT '{u}' AS unit, " + ", ".join(f"count(*) FILTER (WHERE a BETWEEN {lo} AND {hi}) AS band{i}" for i, (lo, hi) in enumerate(P.BANDS)) + ", bool_and(" + " OR ".join(f"a BETWEEN {lo} AND {hi}" for lo, hi in P.BANDS) + f") AS inside FROM (SELECT abs({{c}}::DOUBLE) / {s} AS a FROM {{t}} WHERE {{c}} IS NOT NULL)) WHERE inside"
    for u, s in P.UNITS.items()
)
over("timestamp_bands_user", P.timestamp_bands, "events", "user_id", BANDS)
over("timestamp_bands_orderkey", P.timestamp_bands, "orders", "o_orderkey", BANDS)

LENGTHS = "SELECT count({c}) AS sample_size, round(avg(strlen({c})), 6) AS avg, min(strlen({c}))::INT AS char_min_length, max(strlen({c}))::INT AS char_max_length, count(DISTINCT strlen({c})) AS distinct_count, bool_and(trim({c}) LIKE '[%]') AS all_array, bool_and(trim({c}) LIKE '{{%}}') AS all_json FROM {t}"
for t, c in (("customer", "c_name"), ("events", "props"), ("documents", "text")):
    over(f"text_lengths_{c}", lambda df, c: P.text_profile(df, c).select("sample_size", "avg", "char_min_length", "char_max_length", "distinct_count", "all_array", "all_json"), t, c, LENGTHS)
_SEEN = "try_strptime({c}, [" + ", ".join(repr(x) for x in ("%Y-%m-%d", "%d-%m-%Y", "%Y%m%d", "%H:%M:%S", "%Y-%m-%d %H:%M:%S")) + "]) IS NOT NULL"
FLAGS_OF_TEXT = (
    "SELECT count({c}) AS sample_size, round(avg(strlen({c})), 6) AS avg, min(strlen({c}))::INT AS char_min_length, max(strlen({c}))::INT AS char_max_length, count(DISTINCT strlen({c})) AS distinct_count, bool_and(trim({c}) LIKE '[%]') AS all_array, bool_and(trim({c}) LIKE '{{%}}') AS all_json, "
    "bool_and(try_cast({c} AS DOUBLE) IS NOT NULL) AS all_floats, coalesce(bool_and(try_cast({c} AS DOUBLE) = trunc(try_cast({c} AS DOUBLE))), false) AS all_integers, bool_and(regexp_full_match({c}, '[0-9a-fA-F-]{{32,36}}')) AS all_uuid, bool_and({c} IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', '1', '0')) AS all_utf8_bools, "
    f"bool_and({_SEEN}) AS all_date32, bool_and({_SEEN}) AS all_timestamp, bool_and({_SEEN}) AS all_time FROM {{t}}"
)
for t, c in (("nation", "n_name"), ("customer", "c_name"), ("events", "props"), ("conversations", "role")):
    over(f"text_flags_{c.removeprefix('n_')}", P.text_profile, t, c, FLAGS_OF_TEXT)
CLASSES = r"WITH n AS (SELECT sum(length({c})) AS n, " + ", ".join(f"sum(length(regexp_replace({{c}}, '[^{k}]', '', 'g'))) AS {a}" for a, k in (("d", "0-9"), ("l", r"\p{{L}}"), ("b", r" \t\n\f\r"), ("m", r"!-/:-@\[-`{{-~"))) + " FROM {t}) SELECT round(d / n, 6) AS digit, round(l / n, 6) AS alpha, round(b / n, 6) AS blank, round(m / n, 6) AS mark, round((n - d - l - b - m) / n, 6) AS other FROM n"
for t, c in (("part", "p_name"), ("customer", "c_name"), ("documents", "text")):
    over(f"char_classes_{c}", P.char_classes, t, c, CLASSES)
CHARS = "WITH h AS (SELECT ch, count(*)::DOUBLE AS n FROM (SELECT unnest(string_split({c}, '')) AS ch FROM {t}) WHERE ch <> '' GROUP BY ch) SELECT round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)), 6) AS entropy FROM h"
over("char_entropy_name", P.char_entropy, "part", "p_name", CHARS)
over("char_entropy_priority", P.char_entropy, "orders", "o_orderpriority", CHARS)
BOOLEAN = "WITH h AS (SELECT ({c}::INT <> 0)::INT AS v, count(*)::DOUBLE AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1) SELECT count(*) AS distinct_count, min(v) AS min, max(v) AS max, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM h"
over("boolean_toxic", P.boolean_profile, "labels", "toxic", BOOLEAN)
over("boolean_quality", P.boolean_profile, "labels", "quality", BOOLEAN)
BINARY = "WITH h AS (SELECT strlen({c}) AS l, count(*)::DOUBLE AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1), e AS (SELECT CASE WHEN count(*) <= 1 THEN 0 ELSE (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) END AS entropy FROM h) SELECT count(DISTINCT {c}) AS distinct_count, min(strlen({c}))::INT AS min, max(strlen({c}))::INT AS max, round(avg(strlen({c})), 6) AS avg, round(any_value(entropy), 6) AS entropy FROM {t}, e"
over("binary_name", P.binary_profile, "supplier", "s_name", BINARY)
MIDNIGHT = "SELECT bool_and({c} = date_trunc('day', {c})) AS all_timestamp_date32 FROM {t}"
for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
    over(f"date_alignment_{c}", P.date_alignment, t, c, MIDNIGHT)

# --- vectors ---------------------------------------------------------------------------

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return rounded(align.nearest(v.where("id % 50 = 0"), v, 5))


SQL["nearest_vectors"] = f"SELECT query_id, item_id, round(s, 6) AS similarity, rank::INT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 12) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 5"


def table_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each label's vectors as the fields of a table."""
    v = align.table_vectors(_vectors(spark, d).select(F.col("label").alias("table_id"), "vector"))
    return v.select("table_id", F.posexplode("vector").alias("pos", "x")).select("table_id", "pos", F.round("x", 6).alias("x"))


SQL["table_vectors"] = "WITH e AS (SELECT label AS table_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT table_id, pos, avg(x) AS x FROM e GROUP BY ALL) SELECT table_id, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY table_id)), 6) AS x FROM m"


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Tables of 8 fields: the vectors in order."""
    return _vectors(spark, d).select(F.expr("int(id div 8)").alias("table_id"), F.expr("int(id % 8)").alias("field"), "vector")


def _candidates(fields: DataFrame) -> DataFrame:
    t = fields.select("table_id").distinct()
    return t.select(F.col("table_id").alias("q_table")).join(t.select(F.col("table_id").alias("c_table")), F.col("c_table").between(F.col("q_table") + 1, F.col("q_table") + 2))


def field_alignment(spark: SparkSession, d: str) -> DataFrame:
    f = _fields(spark, d)
    return rounded(align.mutual_best(align.field_pairs(f, _candidates(f)), 0.1))


_PAIRS = f"WITH f AS (SELECT (vec_id // 8)::INT AS t, (vec_id % 8)::INT AS f, embedding FROM embeddings), p AS (SELECT a.t AS q_table, b.t AS c_table, a.f AS q_field, b.f AS c_field, {_COS} AS s FROM f a JOIN f b ON b.t BETWEEN a.t + 1 AND a.t + 2), m AS (SELECT *, row_number() OVER (PARTITION BY q_table, c_table, q_field ORDER BY s DESC, c_field) AS r1, row_number() OVER (PARTITION BY q_table, c_table, c_field ORDER BY s DESC, q_field) AS r2 FROM p WHERE s >= 0.1), b AS (SELECT q_table, c_table, q_field, c_field, s FROM m WHERE r1 = 1 AND r2 = 1)"
SQL["field_alignment"] = _PAIRS + " SELECT q_table, c_table, q_field, c_field, round(s, 6) AS similarity FROM b"


def table_scores(spark: SparkSession, d: str) -> DataFrame:
    f = _fields(spark, d)
    sizes = f.groupBy("table_id").agg(F.count("*").alias("n_fields"))
    return rounded(align.table_scores(align.mutual_best(align.field_pairs(f, _candidates(f)), 0.1), sizes).select("q_table", "c_table", "mean_similarity", "q_coverage", "c_coverage", "score"))


SQL["table_scores"] = _PAIRS + ", n AS (SELECT t, count(*) AS k FROM f GROUP BY t) SELECT q_table, c_table, round(avg(s), 6) AS mean_similarity, round(count(DISTINCT q_field) / any_value(q.k), 6) AS q_coverage, round(count(DISTINCT c_field) / any_value(c.k), 6) AS c_coverage, round(0.4 * avg(s) + 0.3 * count(DISTINCT q_field) / any_value(q.k) + 0.15 * count(DISTINCT c_field) / any_value(c.k) + 0.15 * least(any_value(q.k), any_value(c.k)) / greatest(any_value(q.k), any_value(c.k)), 6) AS score FROM b JOIN n q ON q.t = q_table JOIN n c ON c.t = c_table GROUP BY q_table, c_table"


def jaccard_customers(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard index of neighbouring nations' sets of market segments and account hundreds."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    s = c.groupBy("c_nationkey").agg(F.collect_set(F.floor(F.col("c_acctbal") / 100).cast("long")).alias("s"))
    a, b = s.select(F.col("c_nationkey").alias("a"), F.col("s").alias("sa")), s.select(F.col("c_nationkey").alias("b"), F.col("s").alias("sb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(X.jaccard(F.col("sa"), F.col("sb")), 6).alias("jaccard"))


SQL["jaccard_customers"] = "WITH s AS (SELECT c_nationkey AS k, list(DISTINCT floor(c_acctbal / 100)::BIGINT) AS s FROM customer GROUP BY 1) SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM s a JOIN s b ON b.k = a.k + 1"



def _members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = _fields(spark, d)
    aligned = align.mutual_best(align.field_pairs(f, _candidates(f)), 0.1)
    scores = align.table_scores(aligned, f.groupBy("table_id").agg(F.count("*").alias("n_fields")))
    ordinals = f.select("table_id", "field", F.col("field").alias("ordinal"))
    return cluster.with_query(cluster.covered(aligned, scores, 0.4), ordinals), scores, ordinals


def similarity_vectors(spark: SparkSession, d: str) -> DataFrame:
    members, _, ordinals = _members(spark, d)
    v = cluster.similarity_vectors(members, ordinals)
    return v.select("q_table", "table_id", F.size("matched").alias("n_matched"), F.posexplode("vector").alias("at", "x")).select("q_table", "table_id", "n_matched", "at", F.round("x", 6).alias("x"))


_SCORED = ", n AS (SELECT t, count(*) AS k FROM f GROUP BY t), g AS (SELECT q_table, c_table, 0.4 * avg(s) + 0.3 * count(DISTINCT q_field) / any_value(q.k) + 0.15 * count(DISTINCT c_field) / any_value(c.k) + 0.15 * least(any_value(q.k), any_value(c.k)) / greatest(any_value(q.k), any_value(c.k)) AS score, count(DISTINCT q_field) / any_value(q.k) AS qc, count(DISTINCT c_field) / any_value(c.k) AS cc FROM b JOIN n q ON q.t = q_table JOIN n c ON c.t = c_table GROUP BY q_table, c_table)"
_MEMBERS = _PAIRS + _SCORED + ", m2 AS (SELECT b.* FROM b JOIN g USING (q_table, c_table) WHERE qc >= 0.4 AND cc >= 0.4 UNION ALL SELECT t, t, f, f, 1.0 FROM f)"
_SPACE = _MEMBERS + ", size AS (SELECT t, max(f) + 1 AS k FROM f GROUP BY t), known AS (SELECT q_table, c_table, q_field, max(s) AS s FROM m2 GROUP BY ALL), who AS (SELECT q_table, c_table, count(*) AS n FROM known GROUP BY ALL)"
SQL["similarity_vectors"] = _SPACE + " SELECT q_table, c_table AS table_id, n::INT AS n_matched, i::INT AS at, round(coalesce(s, 0), 6)::DOUBLE AS x FROM (SELECT who.*, unnest(range(k)) AS i FROM who JOIN size ON t = q_table) LEFT JOIN (SELECT q_table, c_table, q_field AS i, s FROM known) USING (q_table, c_table, i)"


def table_edges(spark: SparkSession, d: str) -> DataFrame:
    members, _, ordinals = _members(spark, d)
    return rounded(cluster.edges(cluster.similarity_vectors(members, ordinals), 0.3))


_EDGES = _SPACE + ", norm AS (SELECT q_table, c_table, sqrt(sum(s * s)) AS r FROM known GROUP BY ALL), e AS (SELECT x.q_table, x.c_table AS a, y.c_table AS b, sum(x.s * y.s) AS dot, count(*) AS together FROM known x JOIN known y ON x.q_table = y.q_table AND x.q_field = y.q_field AND x.c_table < y.c_table GROUP BY ALL), edge AS (SELECT e.q_table, a, b, dot / (na.r * nb.r) AS cosine, together / (wa.n + wb.n - together) AS jaccard FROM e JOIN norm na ON na.q_table = e.q_table AND na.c_table = a JOIN norm nb ON nb.q_table = e.q_table AND nb.c_table = b JOIN who wa ON wa.q_table = e.q_table AND wa.c_table = a JOIN who wb ON wb.q_table = e.q_table AND wb.c_table = b WHERE dot / (na.r * nb.r) >= 0.3 AND together / (wa.n + wb.n - together) >= 0.3)"
SQL["table_edges"] = _EDGES + " SELECT q_table, a, b, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard FROM edge"


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    members, scores, ordinals = _members(spark, d)
    v = cluster.similarity_vectors(members, ordinals)
    return cluster.clusters(members, scores, cluster.components(v, cluster.edges(v, 0.3)))


def table_clusters(spark: SparkSession, d: str) -> DataFrame:
    t, _ = _clusters(spark, d)
    return rounded(t.select("q_table", F.col("group").alias("first_table"), F.size("tables").alias("n_tables"), F.array_join("tables", ",").alias("tables"), "confidence", "coverage_score"))


# a query has at most three tables, so labels settle after two steps
_GROUPS = _EDGES + ", pair AS (SELECT q_table, a AS x, b AS y FROM edge UNION ALL SELECT q_table, b, a FROM edge), l1 AS (SELECT w.q_table, w.c_table, least(w.c_table, coalesce(min(y), w.c_table)) AS l FROM who w LEFT JOIN pair ON pair.q_table = w.q_table AND x = w.c_table GROUP BY w.q_table, w.c_table), l2 AS (SELECT w.q_table, w.c_table, least(any_value(w.l), coalesce(min(o.l), any_value(w.l))) AS l FROM l1 w LEFT JOIN pair ON pair.q_table = w.q_table AND x = w.c_table LEFT JOIN l1 o ON o.q_table = w.q_table AND o.c_table = y GROUP BY w.q_table, w.c_table)"
SQL["table_clusters"] = _GROUPS + " SELECT l2.q_table, l AS first_table, count(*)::INT AS n_tables, string_agg(l2.c_table::VARCHAR, ',' ORDER BY l2.c_table) AS tables, round(avg(CASE WHEN l2.c_table = l2.q_table THEN 1 ELSE score END), 6) AS confidence, round(avg(CASE WHEN l2.c_table = l2.q_table THEN 1 ELSE qc END), 6) AS coverage_score FROM l2 LEFT JOIN g USING (q_table, c_table) GROUP BY l2.q_table, l"


def field_clusters(spark: SparkSession, d: str) -> DataFrame:
    _, f = _clusters(spark, d)
    return rounded(f.select("q_table", F.col("group").alias("first_table"), "q_field", F.size("fields").alias("n_fields"), "confidence"))


SQL["field_clusters"] = _GROUPS + ", hit AS (SELECT DISTINCT q_table, q_field FROM m2 WHERE q_table <> c_table), total AS (SELECT q_table, l, count(*) AS k FROM l2 GROUP BY ALL) SELECT m2.q_table, l2.l AS first_table, m2.q_field, count(*)::INT AS n_fields, round(avg(s) * count(DISTINCT m2.c_table) / any_value(k), 6) AS confidence FROM m2 JOIN hit USING (q_table, q_field) JOIN l2 ON l2.q_table = m2.q_table AND l2.c_table = m2.c_table JOIN total ON total.q_table = m2.q_table AND total.l = l2.l GROUP BY m2.q_table, l2.l, m2.q_field"


def latent_search(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as tables of 8 fields, stored, read again by id and searched for the 3 nearest ones of each tenth table."""
    from uuid import uuid4

    from ..sources.catalog import FieldDef, TableRep
    from .latent import LatentStore

    store = LatentStore(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/latent-{uuid4().hex}")
    store.initialize()
    rows: dict[int, list] = {}
    for r in _fields(spark, d).orderBy("table_id", "field").collect():
        rows.setdefault(r.table_id, []).append((FieldDef(f"{r.table_id}.{r.field}", str(r.table_id), f"f{r.field}", "Float32"), list(r.vector), 0.001))
    store.store([(TableRep(str(t), "silo", "default", f"t{t}", [f.id for f, _, _ in fs], len(fs)), fs) for t, fs in rows.items()])
    found = store.search([str(t) for t in rows if t % 10 == 0], 3)
    return found.select(F.col("query_id").cast("int").alias("query_id"), F.col("rank"), F.round("confidence", 5).alias("confidence"))


SQL["latent_search"] = "WITH e AS (SELECT (vec_id // 8)::INT AS t, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT t, pos, avg(x) AS x FROM e GROUP BY ALL), v AS (SELECT t, list(x ORDER BY pos) AS v FROM m GROUP BY t), n AS (SELECT (vec_id // 8)::INT AS t, count(*) AS k FROM embeddings GROUP BY 1), r AS (SELECT a.t AS query_id, row_number() OVER (PARTITION BY a.t ORDER BY list_cosine_similarity(a.v, b.v) DESC) AS rank, list_cosine_similarity(a.v, b.v) AS s, nb.k / na.k AS ratio FROM v a, v b, n na, n nb WHERE a.t % 10 = 0 AND na.t = a.t AND nb.t = b.t) SELECT query_id, rank::INT AS rank, round(s, 5) AS confidence FROM r WHERE rank <= 3 AND ratio BETWEEN 0.7 AND 1.3"

# --- all statistics of whole tables -----------------------------------------------------

COLUMNS = {
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
    "region": {"r_regionkey": "int", "r_name": "text"},
    "nation": {"n_nationkey": "int", "n_name": "text", "n_regionkey": "int"},
    "supplier": {"s_suppkey": "int", "s_name": "text", "s_nationkey": "int", "s_acctbal": "float"},
    "customer": {"c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "text"},
    "part": {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "float"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "float", "o_orderdate": "stamp", "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "stamp"},
    "events": {"event_id": "int", "ts": "stamp", "user_id": "int", "event_type": "text", "value": "float", "props": "text"},
    "documents": {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int"},
    "benchmark": {"item_id": "int", "text": "text"},
    "pages": {"page_id": "int", "url": "text", "html": "text"},
    "conversations": {"conv_id": "int", "turn": "int", "role": "text", "text": "text"},
}
_TOLD = ["sample_size", "null_count", "null_ratio", "cardinality", "distinct_count", "avg", "min_val", "max_val", "char_min_length", "char_max_length", "p10", "p90", "delta_gcd", "entropy", "kurtosis", "skewness", "histogram_entropy", "autocorrelation", "is_monotonic", "all_int_bools", "all_integers", "all_timestamp_date32", "signature"]


def _near(x: str) -> str:
    """Six digits after the point; of huge numbers the last nine before it say nothing."""
    return f"CASE WHEN abs({x}) >= 1e12 THEN round({x} / 1e9) * 1e9 ELSE round({x}, 6) END"


def stats_of(table: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = stats_frame(spark.read.parquet(f"{d}/{table}.parquet"))
        kinds = dict(s.dtypes)
        more = [F.expr(_near(f"quantiles[{i}]")).alias(f"q{i + 1}") for i in (0, 5, 10)] + [F.round(F.expr(f"char_classes[{i}]"), 6).alias(n) for i, n in enumerate(("digit", "alpha", "blank", "mark", "other"))]
        return s.select("column_name", *(F.expr(_near(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in _TOLD), *more)

    return run


def _stats_sql(table: str, c: str, kind: str) -> str:
    n = f"(SELECT count({c}) FROM {table})"
    text = kind == "text"
    x = f"strlen({c})::DOUBLE" if text else f"epoch_us({c})::DOUBLE" if kind == "stamp" else f"{c}::DOUBLE"
    null, no = "NULL::DOUBLE", "NULL::BOOLEAN"
    v = f"v AS (SELECT {x} AS x, lag({x}) OVER (ORDER BY {c if not text else x}) AS y, row_number() OVER (ORDER BY {c if not text else x}) - 1 AS k, count(*) OVER () AS n FROM {table} WHERE {c} IS NOT NULL)"
    m = "m AS (SELECT count(*) AS n, avg(x) AS mu, var_pop(x) AS s2, min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS d FROM v)"
    p = "p AS (SELECT sum(power(x - mu, 3)) AS d3, sum(power(x - mu, 4)) AS d4, sum((x - mu) * (y - mu)) AS lagged, sum((x - mu) * (x - mu)) AS whole FROM v, m)"
    e = "e AS (SELECT count(*) AS kinds, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT x - y AS delta, count(*)::DOUBLE AS c FROM v WHERE y IS NOT NULL GROUP BY 1))"
    b = "b AS (SELECT (log2(sum(c)) - sum(c * log2(c)) / sum(c)) * ln(2) AS h FROM (SELECT least(floor((x - lo) / ((hi - lo) / 6)), 5) AS k, count(*)::DOUBLE AS c FROM v, m WHERE hi > lo GROUP BY 1))"
    g = "g AS (SELECT list_reduce(list(DISTINCT abs(x - y)::BIGINT), lambda a, b: gcd(a, b))::BIGINT AS gcd FROM (SELECT x, y, trunc(abs(x - y)) AS d FROM v) WHERE x <> y AND d > 0)".replace("abs(x - y)::BIGINT", "d::BIGINT")
    ch = f"ch AS (SELECT CASE WHEN count(*) = 1 THEN 'nan'::DOUBLE WHEN count(*) = 0 THEN 0 ELSE (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*)) END AS h FROM (SELECT z, count(*)::DOUBLE AS c FROM (SELECT unnest(string_split({c}, '')) AS z FROM {table}) WHERE z <> '' GROUP BY z))"
    cls = f"cls AS (SELECT sum(length({c})) AS n, " + ", ".join(f"sum(length(regexp_replace({c}, '[^{k}]', '', 'g'))) AS {a}" for a, k in (("d", "0-9"), ("l", r"\p{L}"), ("b", r" \t\n\f\r"), ("m", r"!-/:-@\[-`{-~"))) + f" FROM {table})"
    quant = {i: f"(SELECT quantile_cont(x, {i}.0 / 12) FROM v HAVING count(*) > 20)" for i in (1, 6, 11)}
    rank = {q: f"(SELECT max(x) FROM v WHERE k = least(floor(n * {q}), n - 1))" for q in (0.1, 0.9)}
    card = f"count(DISTINCT {c}) / count(*)" if kind in ("int", "text") else "1.0"
    cells = {
        "column_name": f"'{c}'", "sample_size": f"count({c})", "null_count": f"count(*) - count({c})", "null_ratio": f"round((count(*) - count({c})) / count({c}), 6)", "cardinality": f"round(({card})::DOUBLE, 6)", "distinct_count": "any_value(m.d)",
        "avg": _near("any_value(mu)"), "min_val": null if text else _near("any_value(lo)"), "max_val": null if text else _near("any_value(hi)"), "char_min_length": "any_value(lo)::INT" if text else "NULL::INT", "char_max_length": "any_value(hi)::INT" if text else "NULL::INT",
        "p10": null if text else _near(rank[0.1]), "p90": null if text else _near(rank[0.9]), "delta_gcd": "NULL::BIGINT" if text else "(SELECT gcd FROM g)",
        "entropy": "round((SELECT h FROM ch), 6)" if text else f"round((SELECT CASE WHEN kinds <= 1 THEN 0 ELSE h / log2(kinds) END FROM e) * any_value(m.d) / {n}, 6)",
        "kurtosis": null if text else "round(any_value(CASE WHEN s2 = 0 THEN 0 ELSE m.n * (m.n + 1) / ((m.n - 1) * (m.n - 2) * (m.n - 3)::DOUBLE) * d4 / (s2 * s2) - 3 * (m.n - 1) * (m.n - 1) / ((m.n - 2) * (m.n - 3)::DOUBLE) END), 6)",
        "skewness": null if text else "round(any_value(CASE WHEN s2 = 0 THEN 0 ELSE m.n / ((m.n - 1) * (m.n - 2)::DOUBLE) * d3 / power(s2, 1.5) END), 6)",
        "histogram_entropy": null if text else "round(coalesce((SELECT h FROM b), 0), 6)", "autocorrelation": null if text else "round(any_value(lagged / nullif(whole, 0)), 6)", "is_monotonic": "false" if text else "count(*) >= 2",
        "all_int_bools": no if text else "(SELECT bool_and(x - trunc(x) < 1e-9 AND round(x) IN (0, 1)) FROM v)", "all_integers": f"(SELECT CASE WHEN bool_and(try_cast({c} AS DOUBLE) IS NOT NULL) THEN bool_and(try_cast({c} AS DOUBLE) = trunc(try_cast({c} AS DOUBLE))) END FROM {table})" if text else "(SELECT bool_and(abs(x - trunc(x)) < 2.2e-16) AND NOT bool_and(round(x) IN (0, 1)) FROM v)",
        "all_timestamp_date32": f"bool_and({c} = date_trunc('day', {c}))" if kind == "stamp" else no, "signature": "'charclass'" if text else "'temporal'" if kind == "stamp" else "'numeric'",
        **{f"q{i}": _near(quant[i]) for i in (1, 6, 11)}, **{a: f"round((SELECT {k} / cls.n FROM cls), 6)" if text else null for a, k in (("digit", "d"), ("alpha", "l"), ("blank", "b"), ("mark", "m"), ("other", "(cls.n - d - l - b - m)"))},
    }
    parts = [v, m, p, ch, cls] if text else [v, m, p, e, b, g]
    return f"SELECT * FROM (WITH {', '.join(parts)} SELECT {', '.join(f'{sql} AS {name}' for name, sql in cells.items())} FROM {table}, m, p)"


for t, columns in COLUMNS.items():
    QUERIES[f"field_stats_{t}"] = stats_of(t)
    SQL[f"field_stats_{t}"] = " UNION ALL ".join(_stats_sql(t, c, kind) for c, kind in columns.items())

# --- texts in all formats -----------------------------------------------------------------


def _texts(spark: SparkSession, table: str, d: str, key: str, moment: str, shapes: list[str], read: Callable) -> DataFrame:
    """Each moment written in every shape, and what it is read as."""
    java = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "b": "MMM", "w": "EEE", "H": "HH", "I": "hh", "p": "a", "M": "mm", "S": "ss", "f": ".SSSSSS", "z": "'+02:00'"}
    pattern = lambda s: re.sub(r"'(\+02:00)'", r"'\1'", re.sub(r"\{(\w)\}|([A-Z]+)", lambda m: java[m[1]] if m[1] else f"'{m[2]}'", s))
    df = spark.read.parquet(f"{d}/{table}.parquet").select(key, moment)
    written = F.array(*(F.struct(F.lit(i).alias("shape"), F.date_format(moment, pattern(s)).alias("t")) for i, s in enumerate(shapes)))
    return df.select(key, F.explode(written).alias("w")).select(key, "w.shape", read(F.col("w.t")).alias("value"))


def text_dates(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, "orders", d, "o_orderkey", "o_orderdate", formats.DATES, X.to_date)


def text_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, "events", d, "event_id", "ts", formats.TIMESTAMPS, X.to_timestamp)


def text_times(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, "events", d, "event_id", "ts", formats.TIMES, X.to_time)


_fine = lambda shapes: "[" + ", ".join("true" if "{f}" in s else "false" for s in shapes) + "]"
SQL["text_dates"] = f"SELECT o_orderkey, unnest(range({len(formats.DATES)}))::INT AS shape, o_orderdate::DATE AS value FROM orders"
SQL["text_timestamps"] = f"SELECT event_id, shape::INT AS shape, CASE WHEN {_fine(formats.TIMESTAMPS)}[shape + 1] THEN ts::TIMESTAMP ELSE date_trunc('second', ts::TIMESTAMP) END AS value FROM (SELECT event_id, ts, unnest(range({len(formats.TIMESTAMPS)})) AS shape FROM events)"
_clock = "(epoch_us(ts::TIMESTAMP) - epoch_us(date_trunc('day', ts::TIMESTAMP)))"
SQL["text_times"] = f"SELECT event_id, shape::INT AS shape, CASE WHEN {'[' + ', '.join('true' if '{S}' not in s else 'false' for s in formats.TIMES) + ']'}[shape + 1] THEN {_clock} // 60000000 * 60000 WHEN {_fine(formats.TIMES)}[shape + 1] THEN {_clock} // 1000 ELSE {_clock} // 1000000 * 1000 END AS value FROM (SELECT event_id, ts, unnest(range({len(formats.TIMES)})) AS shape FROM events)"


def boolean_words(spark: SparkSession, d: str) -> DataFrame:
    """Beginnings of the texts: whether they stand for a truth value, and for which."""
    df = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lower(F.substring("text", 1, 1)).alias("t"))
    return df.select("doc_id", F.col("t").isin(X.BOOLEAN_WORDS).alias("is_boolean"), R.cast_column(F.col("t"), "string", "Boolean").alias("value"))


SQL["boolean_words"] = "SELECT doc_id, substr(lower(text), 1, 1) IN ('t', 'y', '1', 'f', 'n', '0') AS is_boolean, CASE WHEN substr(lower(text), 1, 1) IN ('t', 'y', '1') THEN true WHEN substr(lower(text), 1, 1) IN ('f', 'n', '0') THEN false END AS value FROM documents"


def uuid_texts(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of names in the spellings of UUIDs, back as bytes; one of five is no UUID."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.md5("c_name").alias("h"))
    dashed = F.regexp_replace("h", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    t = F.element_at(F.array(F.col("h"), dashed, F.concat(F.lit("{"), dashed, F.lit("}")), F.concat(F.lit("urn:uuid:"), dashed), F.substring("h", 1, 31)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select("c_custkey", F.lower(F.hex(X.to_uuid(t))).alias("value"))


SQL["uuid_texts"] = "SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN md5(c_name) END AS value FROM customer"


def number_texts(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    t = F.when(F.col("o_orderkey") % 4 == 0, F.concat("o_custkey", F.lit("f"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" "), "o_custkey")).when(F.col("o_orderkey") % 4 == 2, F.concat("o_custkey", F.lit("e2"))).otherwise(F.concat(F.lit("-"), "o_custkey", F.lit(".25")))
    return o.select("o_orderkey", X.to_number(t).alias("value"))


SQL["number_texts"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN o_custkey * 100.0 WHEN o_orderkey % 4 = 3 THEN -(o_custkey + 0.25) END::DOUBLE AS value FROM orders"


def epoch_times(spark: SparkSession, d: str) -> DataFrame:
    """Moments as whole numbers of each unit, and back."""
    e = spark.read.parquet(f"{d}/events.parquet")
    micros = P.value(e, "ts").cast("long")
    unit = {"s": F.floor(micros / 1_000_000), "ms": F.floor(micros / 1000), "us": micros, "ns": micros * 1000}
    return e.select("event_id", *(R.cast_column(v.cast("long"), "long", f"Timestamp({u})").alias(f"from_{u}") for u, v in unit.items()))


SQL["epoch_times"] = "SELECT event_id, date_trunc('second', ts::TIMESTAMP) AS from_s, date_trunc('millisecond', ts::TIMESTAMP) AS from_ms, ts::TIMESTAMP AS from_us, ts::TIMESTAMP AS from_ns FROM events"

# --- types and whole analyses ------------------------------------------------------------

TABLES = tuple(COLUMNS)
_NAMES = {"int": "Int64", "float": "Float64", "text": "Utf8", "stamp": "Timestamp(us)"}


def promoted_types(spark: SparkSession, d: str) -> DataFrame:
    with ThreadPoolExecutor(6) as pool:
        found = dict(zip(TABLES, pool.map(lambda t: R.promote(spark.read.parquet(f"{d}/{t}.parquet")), TABLES)))
    rows = [(t, p.column, p.target, p.confidence) for t in TABLES for p in found[t]]
    return spark.createDataFrame(rows, "table_name string, column_name string, target string, confidence double")


def _promoted_sql(t: str, c: str, kind: str) -> str:
    test, target = {"int": (f"bool_and({c} IN (0, 1))", "Boolean"), "float": (f"bool_and({c} = trunc({c}))", "Int64"), "text": ("count(*) < 0", ""), "stamp": (f"bool_and({c} = date_trunc('day', {c}))", "Date32")}[kind]
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, CASE WHEN {test} THEN '{target}' ELSE '{_NAMES[kind]}' END AS target, CASE WHEN {test} THEN 0.86 ELSE 1.0 END::DOUBLE AS confidence FROM {t}"


#: No whole number here is spread like a clock's, so the rules for times never win; texts hold no other type.
SQL["promoted_types"] = " UNION ALL ".join(_promoted_sql(t, c, k) for t, cs in COLUMNS.items() for c, k in cs.items())


def promoted_texts(spark: SparkSession, d: str) -> DataFrame:
    """What columns of texts that stand for other types, and whole numbers that are moments, are promoted to."""
    e = spark.read.parquet(f"{d}/events.parquet")
    ts, h = F.col("ts"), F.md5(F.col("event_id").cast("string"))
    micros = P.value(e, "ts").cast("long")
    wide = e.select(h.alias("uuid"), F.date_format(ts, "dd-MM-yyyy").alias("day"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("moment"), F.date_format(ts, "HH:mm:ss").alias("clock"), (F.col("user_id") * 3 + 7).cast("string").alias("whole"), F.col("value").cast("string").alias("measured"), F.concat(F.lit("["), "user_id", F.lit("]")).alias("list"), "props", F.when(F.col("user_id") % 2 == 0, "yes").otherwise("no").alias("answer"), F.date_trunc("day", ts).cast("timestamp_ntz").alias("midnight"), F.floor(micros / 1000).cast("long").alias("millis"), (F.col("user_id") % 2).cast("int").alias("bit"))
    return spark.createDataFrame([(p.column, p.target, p.confidence) for p in R.promote(wide)], "column_name string, target string, confidence double")


SQL["promoted_texts"] = "SELECT * FROM (VALUES ('uuid', 'FixedSizeBinary(16)', 0.86::DOUBLE), ('day', 'Date32', 0.86), ('moment', 'Timestamp(us)', 0.86), ('clock', 'Utf8', 1.0), ('whole', 'Int64', 0.86), ('measured', 'Float64', 0.86), ('list', 'List(Utf8)', 0.86), ('props', 'Utf8', 1.0), ('answer', 'Boolean', 0.86), ('midnight', 'Date32', 0.86), ('millis', 'Timestamp(ms)', 0.86), ('bit', 'Boolean', 0.86)) t(column_name, target, confidence)"


def type_names(spark: SparkSession, d: str) -> DataFrame:
    """Logical types of databases' type names."""
    from ..sources.names import canonical_type

    names = ["tinyint", "smallint", "int4", "BIGINT", "bool", "real", "float4", "numeric", "date", "timestamp", "uuid", "jsonb", "bytea", "text", "varchar(20)", "vector", " Integer "]
    return spark.createDataFrame([(n, canonical_type(n)) for n in names], "name string, canonical_type string")


SQL["type_names"] = "SELECT * FROM (VALUES ('tinyint', 'Int8'), ('smallint', 'Int16'), ('int4', 'Int32'), ('BIGINT', 'Int64'), ('bool', 'Boolean'), ('real', 'Float64'), ('float4', 'Float32'), ('numeric', 'Decimal128(38, 10)'), ('date', 'Date32'), ('timestamp', 'Timestamp(us)'), ('uuid', 'FixedSizeBinary(16)'), ('jsonb', 'LargeBinary'), ('bytea', 'Binary'), ('text', 'Utf8'), ('varchar(20)', 'Utf8'), ('vector', 'List(Utf8)'), (' Integer ', 'Int32')) t(name, canonical_type)"


def merged_types(spark: SparkSession, d: str) -> DataFrame:
    """The type that holds values of both, for all pairs of these."""
    from ..sources.names import merged_type

    some = ["Null", "Int32", "Int64", "Float32", "Float64", "Decimal128(38, 10)", "Boolean", "Utf8"]
    return spark.createDataFrame([(a, b, merged_type(a, b)) for a in some for b in some], "a string, b string, merged string")


SQL["merged_types"] = "WITH t AS (SELECT unnest(['Null', 'Int32', 'Int64', 'Float32', 'Float64', 'Decimal128(38, 10)', 'Boolean', 'Utf8']) AS t) SELECT a.t AS a, b.t AS b, CASE WHEN a.t = b.t OR b.t = 'Null' THEN a.t WHEN a.t = 'Null' THEN b.t WHEN a.t LIKE 'Decimal%' AND regexp_matches(b.t, '^(Int|Float)') THEN a.t WHEN b.t LIKE 'Decimal%' AND regexp_matches(a.t, '^(Int|Float)') THEN b.t WHEN a.t = 'Int32' AND b.t IN ('Int64', 'Float32', 'Float64') THEN b.t WHEN b.t = 'Int32' AND a.t IN ('Int64', 'Float32', 'Float64') THEN a.t ELSE 'Utf8' END AS merged FROM t a, t b"


def cast_safeties(spark: SparkSession, d: str) -> DataFrame:
    some = ["Int8", "Int32", "Int64", "Float64", "Utf8", "Boolean", "Date32", "Timestamp(us)", "Binary"]
    return spark.createDataFrame([(a, b, R.cast_safety(a, b)) for a in some for b in some], "a string, b string, safety double")


SQL["cast_safeties"] = "WITH t AS (SELECT unnest(['Int8', 'Int32', 'Int64', 'Float64', 'Utf8', 'Boolean', 'Date32', 'Timestamp(us)', 'Binary']) AS t) SELECT a.t AS a, b.t AS b, CASE WHEN a.t = b.t OR (a.t, b.t) IN (('Int8', 'Int32'), ('Int8', 'Int64'), ('Int32', 'Int64'), ('Timestamp(us)', 'Int64'), ('Date32', 'Int32'), ('Utf8', 'Binary')) THEN 0.98 WHEN (a.t, b.t) IN (('Int64', 'Int32'), ('Int64', 'Int8'), ('Float64', 'Int64'), ('Int64', 'Timestamp(us)'), ('Timestamp(us)', 'Date32'), ('Int32', 'Date32'), ('Utf8', 'Timestamp(us)'), ('Utf8', 'Date32'), ('Utf8', 'Float64'), ('Utf8', 'Int64'), ('Utf8', 'Boolean'), ('Float64', 'Boolean'), ('Int8', 'Boolean'), ('Int32', 'Boolean'), ('Int64', 'Boolean')) THEN 0.86 ELSE 0.48 END::DOUBLE AS safety FROM t a, t b"


def field_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weights of the columns of four tables in their tables' vectors: the logarithm of a ratio leaves the least weight for each."""
    rows = [(t, c, round(align.field_weight(s), 6)) for t in ("nation", "customer", "orders", "events") for c, s in field_stats(spark.read.parquet(f"{d}/{t}.parquet")).items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, weight double")


SQL["field_weights"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, 0.001::DOUBLE AS weight" for t in ("nation", "customer", "orders", "events") for c in COLUMNS[t])


def promoted_labels(spark: SparkSession, d: str) -> DataFrame:
    """A table after its promotions: 0/1 columns are booleans, midnights are dates."""
    df = spark.read.parquet(f"{d}/labels.parquet")
    return R.apply(df, R.promote(df, ["quality", "toxic"]))


SQL["promoted_labels"] = "SELECT doc_id, quality <> 0 AS quality, toxic <> 0 AS toxic FROM labels"


def promoted_dates(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    return R.apply(df, R.promote(df, ["o_orderdate"]))


SQL["promoted_dates"] = "SELECT o_orderkey, o_orderdate::DATE AS o_orderdate FROM orders"


def reconciled(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of two silos that hold the same tables, all of them whole: each table and its twin."""
    from uuid import uuid4

    from ..sources.stores import Source
    from .analyzer import SchemaAnalyzer

    every = "[.]parquet$"
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/latent-{uuid4().hex}"
    report = SchemaAnalyzer(spark, [Source("parquet", d, None, pattern=every), Source("parquet", f"{d}/.", None, pattern=every)], persist_path=path, threads=6).analyze()
    rows = [(t.split(".", 1)[1], len(c.tables), len(c.field_clusters), round(c.confidence, 6), round(c.coverage_score, 6)) for c in report.clusters for t in c.tables]
    return spark.createDataFrame(sorted(set(rows)), "table_name string, n_tables int, n_field_clusters int, confidence double, coverage_score double")


# two columns of labels, and two of lineitem, are described alike: of such twins the first takes both matches, so these tables don't cover their twins
SQL["reconciled"] = "SELECT * FROM (VALUES " + ", ".join(f"('{t}.parquet', {1 if t in ('labels', 'lineitem') else 2}::INT, {n}::INT, 1.0::DOUBLE, 1.0::DOUBLE)" for t, n in sorted({**{t: len(c) for t, c in COLUMNS.items()}, "embeddings": 3}.items())) + ") t(table_name, n_tables, n_field_clusters, confidence, coverage_score)"

for f in (nearest_vectors, table_vectors, field_alignment, table_scores, similarity_vectors, table_edges, table_clusters, field_clusters, latent_search, jaccard_customers, text_dates, text_timestamps, text_times, boolean_words, uuid_texts, number_texts, epoch_times, promoted_types, promoted_texts, type_names, merged_types, cast_safeties, field_weights, promoted_labels, promoted_dates, reconciled):
    QUERIES[f.__name__] = f
