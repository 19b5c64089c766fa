"""Retrieval and citation metrics over ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranking as K
from ..registry import query
from ..views import table

N = 10


def ranked(spark, sf_dir):
    """Each order is a query: its parts, in line order, are the retrieved items; parts of large quantity are relevant."""
    li = table(spark, sf_dir, "lineitem")
    item = (F.col("l_partkey") % 7).cast("long")
    rows = li.groupBy(F.col("l_orderkey").alias("query")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("item")))).alias("r"),
        F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 25, item))).alias("relevant"),
    )
    return rows.select("query", F.transform("r", lambda x: x["item"]).alias("items"), "relevant")


BASE = """
x AS (SELECT l_orderkey AS query, l_linenumber AS rank, l_partkey % 7 AS item FROM lineitem),
y0 AS (SELECT query, item, rank, row_number() OVER (PARTITION BY query ORDER BY rank, item) AS pos FROM x),
y AS (SELECT *, row_number() OVER (PARTITION BY query, item ORDER BY pos) AS seen FROM y0),
rel AS (SELECT DISTINCT l_orderkey AS query, l_partkey % 7 AS item FROM lineitem WHERE l_quantity > 25),
n AS (SELECT query, count(*) AS n_rel FROM rel GROUP BY query),
z AS (SELECT y.*, rel.item IS NOT NULL AS hit FROM y LEFT JOIN rel USING (query, item)),
w AS (SELECT *, sum((hit AND seen = 1)::INT) OVER (PARTITION BY query ORDER BY pos) AS hits FROM z)"""


@query(f"""WITH {BASE}
SELECT query, round(sum((hit AND pos <= 3)::INT) / least(3, count(*)), 9) AS precision, round(count(DISTINCT CASE WHEN hit AND pos <= 3 THEN item END) / n_rel, 9) AS recall,
 CASE WHEN n_rel IS NULL THEN NULL ELSE coalesce(max((hit AND pos <= 3)::INT), 0)::DOUBLE END AS hit_rate,
 round(CASE WHEN n_rel IS NOT NULL THEN coalesce(1 / min(CASE WHEN hit THEN pos END), 0) END, 9) AS reciprocal_rank,
 round(CASE WHEN n_rel IS NOT NULL THEN coalesce(sum(CASE WHEN hit AND seen = 1 THEN hits / pos END), 0) / n_rel END, 9) AS average_precision
FROM w LEFT JOIN n USING (query) GROUP BY query, n_rel""")
def rag01_ranking_metrics(spark, sf_dir):
    r = ranked(spark, sf_dir)
    i, rel = F.col("items"), F.col("relevant")
    return r.select(
        "query",
        F.round(K.precision_at(i, rel, 3), 9).alias("precision"),
        F.round(K.recall_at(i, rel, 3), 9).alias("recall"),
        K.hit_at(i, rel, 3).alias("hit_rate"),
        F.round(K.reciprocal_rank(i, rel), 9).alias("reciprocal_rank"),
        F.round(K.average_precision(i, rel), 9).alias("average_precision"),
    )


@query(f"""WITH {BASE},
d AS (SELECT query, sum(CASE WHEN hit AND seen = 1 AND pos <= {N} THEN (pow(2, 1.0) - 1) / log2(pos + 1) ELSE 0 END) AS dcg, sum((seen > 1)::INT) / count(*) AS dup, count(DISTINCT item) AS uniq, count(DISTINCT CASE WHEN hit THEN item END) AS found FROM w GROUP BY query),
i AS (SELECT query, sum(1 / log2(k + 1)) AS ideal FROM n, range(1, {N} + 1) r(k) WHERE k <= n_rel GROUP BY query)
SELECT query, round(dcg / ideal, 9) AS ndcg, round(found / n_rel, 9) AS coverage, round(dup, 9) AS duplicate_rate, round(found / uniq, 9) AS utilization FROM d LEFT JOIN i USING (query) LEFT JOIN n USING (query)""")
def rag06_ndcg_and_coverage(spark, sf_dir):
    r = ranked(spark, sf_dir)
    i, rel = F.col("items"), F.col("relevant")
    gains = F.map_from_entries(F.transform(rel, lambda x: F.struct(x, F.lit(1.0))))
    return r.select(
        "query",
        F.round(K.ndcg(i, gains, N), 9).alias("ndcg"),
        F.round(K.coverage(i, rel), 9).alias("coverage"),
        F.round(K.duplicate_rate(i), 9).alias("duplicate_rate"),
        F.round(K.utilization(i, rel), 9).alias("utilization"),
    )


@query("""WITH a AS (SELECT l_orderkey AS query, string_agg('[source:p' || (l_partkey % 7) || ']', ' ' ORDER BY l_linenumber, l_partkey % 7) AS answer, list(DISTINCT 'p' || (l_suppkey % 7)) AS known FROM lineitem GROUP BY l_orderkey),
c AS (SELECT query, known, regexp_extract_all(answer, '\\[source:([A-Za-z0-9._:/-]{1,200})\\]', 1) AS cited FROM a)
SELECT query, array_to_string(cited, ',') AS citations, (len(cited) > 0)::INT::DOUBLE AS presence, round(len([x FOR x IN cited IF list_contains(known, x)]) / len(cited), 9) AS validity FROM c""")
def rag11_citation_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    mark = F.concat(F.lit("[source:p"), (F.col("l_partkey") % 7).cast("string"), F.lit("]"))
    a = li.groupBy(F.col("l_orderkey").alias("query")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", mark.alias("m")))), lambda x: x["m"]), " ").alias("answer"),
        F.collect_set(F.concat(F.lit("p"), (F.col("l_suppkey") % 7).cast("string"))).alias("known"),
    )
    c = a.select("query", "known", K.citations(F.col("answer")).alias("cited"))
    return c.select("query", F.array_join("cited", ",").alias("citations"), (F.size("cited") > 0).cast("double").alias("presence"), F.round(K.citation_validity(F.col("cited"), F.col("known")), 9).alias("validity"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS query, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) <= 10""")
def rag13_nearest_vectors(spark, sf_dir):
    """The ten nearest vectors of every query, a vector whose id is divisible by 50, among all rows."""
    from ..operators.search import nearest

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return nearest(e.where("vec_id % 50 = 0"), e, "vec_id", 10).withColumnRenamed("vec_id", "query")


@query("""WITH a AS (SELECT l_orderkey AS query, string_agg('[source:p' || (l_partkey % 7) || ']', ' ' ORDER BY l_linenumber, l_partkey % 7) AS answer, list(DISTINCT 'p' || (l_suppkey % 7)) AS known,
 list(DISTINCT 'p' || (l_partkey % 5)) FILTER (l_linenumber > 2) AS needed FROM lineitem GROUP BY l_orderkey),
c AS (SELECT *, regexp_extract_all(answer, '\\[source:([A-Za-z0-9._:/-]{1,200})\\]', 1) AS cited FROM a), u AS (SELECT *, list_distinct(cited) AS ids FROM c)
SELECT query, 1.0::DOUBLE AS presence, round(len(list_filter(cited, lambda x: list_contains(known, x))) / len(cited), 9) AS validity,
 CASE WHEN needed IS NOT NULL THEN round(len(list_filter(ids, lambda x: list_contains(known, x) AND list_contains(needed, x))) / len(ids), 9) END AS correctness,
 CASE WHEN needed IS NOT NULL THEN round(len(list_filter(ids, lambda x: list_contains(needed, x))) / len(needed), 9) END AS completeness FROM u""")
def rag11b_labelled_citations(spark, sf_dir):
    """Citations against the sources that labelled claims need; orders of one or two lines have no labels."""
    li = table(spark, sf_dir, "lineitem")
    name = lambda c, m: F.concat(F.lit("p"), (F.col(c) % m).cast("string"))
    cite = F.struct("l_linenumber", F.concat(F.lit("[source:"), name("l_partkey", 7), F.lit("]")).alias("c"))
    a = li.groupBy(F.col("l_orderkey").alias("query")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(cite)), lambda x: x["c"]), " ").alias("answer"),
        F.collect_set(name("l_suppkey", 7)).alias("known"),
        F.collect_set(F.when(F.col("l_linenumber") > 2, name("l_partkey", 5))).alias("needed"),
    )
    made = a.select("query", K.citation_scores(F.col("answer"), F.col("known"), F.col("needed")).alias("s")).select("query", "s.*")
    return made.select("query", *[F.round(c, 9).alias(c) for c in made.columns[1:]])


@query("""SELECT l_orderkey AS answer, count(*) AS n_claims, round(avg(l_discount * 10), 9) AS faithfulness, round(avg((l_discount = 0)::INT), 9) AS unsupported_claim_rate FROM lineitem GROUP BY ALL""")
def rag13b_claim_support(spark, sf_dir):
    """Judged claims of each answer: mean support, and the share without any."""
    score = K.checked_judgment(F.col("l_discount") * 10, F.col("l_tax"), F.col("l_linestatus"))
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), score.alias("score")).groupBy("answer").agg(F.count("*").alias("n_claims"), *K.claim_support(F.col("score")))
    return made.select("answer", "n_claims", *[F.round(c, 9).alias(c) for c in ("faithfulness", "unsupported_claim_rate")])
