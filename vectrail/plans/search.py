"""Registered queries over the stored cell index, other metrics and margins over all identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrail.operators import cell_index, enrolment, gallery
from vectrail.plans import fixtures as X
from vectrail.plans.queries import query, rounded
from vectrail.sources.shared import fresh_path


def _all(spark, sf):
    return X.vectors(spark, sf).where("v is not null").select(F.col("vec_id").alias("entry_index"), F.concat(F.lit("id_"), F.floor(F.col("vec_id") / 3).cast("bigint").cast("string")).alias("identity"), F.col("v").alias("vector"))


def _asked(spark, sf):
    return _all(spark, sf).where("entry_index % 100 = 0").select(F.col("entry_index").alias("query_id"), "vector")


@query()
def indexed_top5(spark, sf):
    index = cell_index.write(_all(spark, sf), fresh_path(spark, "index"), least=0)
    return rounded(cell_index.search(index, _asked(spark, sf)), "similarity")


@query("SELECT count(*) AS n_queries, 5 * count(*) AS n_hits, true AS reached FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL")
def index_recall(spark, sf):
    entries, asked = _all(spark, sf), _asked(spark, sf)
    index = cell_index.write(entries, fresh_path(spark, "index"), least=0)
    found = cell_index.recall(cell_index.search(index, asked), gallery.top_hits(asked, entries))
    return found.select("n_queries", "n_hits", (F.col("recall") >= 0.9).alias("reached"))


@query(f"""WITH {X.SEARCH}, r AS (SELECT query_id, entry_index, identity, 1 - list_sum(list_transform(list_zip(p.vector, g.vector), lambda x: (x[1] - x[2]) ** 2)) / 2 AS similarity FROM probes p, gallery g), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_index) AS rank FROM r)
SELECT query_id, rank, entry_index, identity, round(similarity, 6) AS similarity FROM n WHERE rank <= 5""")
def nearest_by_distance(spark, sf):
    hits = gallery.top_hits(X.probes(spark, sf), X.gallery(spark, sf), metric="l2")
    return rounded(hits, "similarity").withColumn("rank", F.col("rank").cast("bigint"))


# an identity here has a seventh of all entries or so, more than the list is long
@query(f"""WITH {X.SEARCH}, few AS (SELECT entry_index, 'id_' || (entry_index % 7) AS identity, vector FROM gallery), s AS (SELECT query_id, identity, max(list_dot_product(p.vector, g.vector)) AS similarity FROM probes p, few g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, identity) AS rank FROM s) SELECT query_id, max(identity) FILTER (WHERE rank = 1) AS identity, round(max(similarity) FILTER (WHERE rank = 1), 6) AS similarity, round(max(similarity) FILTER (WHERE rank = 1) - max(similarity) FILTER (WHERE rank = 2), 6) AS margin FROM r GROUP BY query_id""")
def margin_all_identities(spark, sf):
    entries = X.gallery(spark, sf).withColumn("identity", F.concat(F.lit("id_"), (F.col("entry_index") % 7).cast("string")))
    best = gallery.best_and_margin(gallery.identity_hits(X.probes(spark, sf), entries))
    return rounded(best.select("query_id", "identity", "similarity", "margin"), "similarity", "margin")


# one entry of each identity first, then others, by the hash of the index
@query(f"""WITH {X.SEARCH}, {X.IMPOSTORS}, f AS (SELECT *, md5(entry_index::VARCHAR) AS h, row_number() OVER (PARTITION BY identity ORDER BY md5(entry_index::VARCHAR)) AS r FROM gallery), s AS (SELECT * FROM f ORDER BY r > 1, h LIMIT 250),
i AS (SELECT round(list_dot_product(a.vector, b.vector), 6) AS similarity FROM s a JOIN s b ON a.entry_index < b.entry_index AND a.identity <> b.identity)
SELECT (SELECT count(*) FROM s) AS n_entries, count(*) AS n_pairs, round(quantile_cont(similarity, 0.99), 5) AS quantile, round((SELECT quantile_cont(similarity, 0.99) FROM impostors), 5) AS exact, true AS enclosed FROM i""")
def sampled_calibration(spark, sf):
    entries = X.gallery(spark, sf)
    some = gallery.sampled_threshold(entries, 250, far=0.01)
    exact = gallery.impostor_quantile(entries, 0.99).select(F.col("quantile").alias("exact"))
    both = some.join(F.broadcast(exact))  # one row each
    return rounded(both.select("n_entries", "n_pairs", "quantile", "exact", ((F.col("low") <= F.col("exact")) & (F.col("exact") <= F.col("high"))).alias("enclosed")), "quantile", "exact", digits=5)


@query(f"WITH {X.SEARCH}, {X.IMPOSTORS} SELECT count(*) AS n_pairs, round(max(similarity), 5) AS largest, CASE WHEN max(similarity) > 0.35 THEN 'one person under two names?' END AS warning FROM impostors")
def impostor_report(spark, sf):
    figures = gallery.impostor_quantile(X.gallery(spark, sf), 0.99)
    return rounded(enrolment.impostor_report(figures, high=0.35), "largest", digits=5).select("n_pairs", "largest", "warning")
