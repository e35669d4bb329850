"""Sampling diagnostics, with ``events`` as a stream of batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import rounded
from ..operators import diagnostics as D
from .registry import ORACLE_SQL, query, table

N, SIZE, SHARDS, WINDOW = 16, 150, 16, 10

BATCHES = "batches AS (SELECT event_id // 100 AS step, user_id AS index, event_id // 1000 AS shard, event_type AS target FROM events)"
BUCKETS = {
    "mod": f"index % {N}",
    "div": f"least(greatest(index // {SIZE // N}, 0), {N - 1})",
    "hash": f"(index * {D.MULTIPLIER}) % {N}",
    "shard": "shard",
}


def batches(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.expr("event_id div 100").alias("step"), F.col("user_id").alias("index"), F.expr("event_id div 1000").alias("shard"), F.col("event_type").alias("target")
    )


def _key(method: str):
    return F.col("shard") if method == "shard" else D.bucket(F.col("index"), N, method, SIZE)


def _n(method: str) -> int:
    return SHARDS if method == "shard" else N


def _hist(method: str) -> str:
    return f"{BATCHES}, h AS (SELECT step, CAST({BUCKETS[method]} AS BIGINT) AS bucket, count(*) AS n FROM batches GROUP BY ALL)"


for _method in ("mod", "div", "hash"):
    query(
        f"WITH {_hist(_method)}, g AS (SELECT step, CAST(b AS BIGINT) AS bucket FROM (SELECT DISTINCT step FROM h), (SELECT unnest(range({N})) AS b)) "
        "SELECT step, bucket, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (step, bucket)",
        f"hist_{_method}",
    )(lambda spark, sf_dir, m=_method: D.full_histogram(D.histogram(batches(spark, sf_dir), _key(m)), N))

for _method in ("mod", "div", "hash", "shard"):
    _m = _n(_method)
    query(
        f"WITH {_hist(_method)} SELECT step, round(sum(n * n) / (sum(n) / {_m}.0::DOUBLE) - sum(n), 6) AS chi2 FROM h GROUP BY step",
        f"chi2_{_method}",
    )(lambda spark, sf_dir, m=_method: D.chi_square(D.histogram(batches(spark, sf_dir), _key(m)), _n(m)).withColumn("chi2", F.round("chi2", 6)))
    query(
        f"""WITH {_hist(_method)}, g AS (SELECT step, CAST(b AS BIGINT) AS bucket FROM (SELECT DISTINCT step FROM h), (SELECT unnest(range({_m})) AS b)),
        f AS (SELECT step, bucket, coalesce(n, 0)::DOUBLE AS x FROM g LEFT JOIN h USING (step, bucket)),
        p AS (SELECT step, x, lag(x) OVER (PARTITION BY bucket ORDER BY step) AS y FROM f),
        s AS (SELECT step, count(y) AS k, avg(x) AS mx, avg(y) AS my, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy FROM p GROUP BY step)
        SELECT step, CASE WHEN k = 0 OR sqrt(greatest(xx - mx * mx, 0) * greatest(yy - my * my, 0)) * {_m} < 1e-10 THEN 1.0::DOUBLE
          ELSE round((xy - mx * my) / sqrt(greatest(xx - mx * mx, 0) * greatest(yy - my * my, 0)), 6) END AS acf FROM s""",
        f"acf_{_method}",
    )(lambda spark, sf_dir, m=_method: D.lag1_correlation(D.histogram(batches(spark, sf_dir), _key(m)), _n(m)).withColumn("acf", rounded("acf", 6)))


@query(f"WITH {BATCHES} SELECT step, count(DISTINCT index) AS n_unique FROM batches GROUP BY step")
def n_unique(spark, sf_dir):
    return D.distinct_per_step(batches(spark, sf_dir))


_OVERLAP = """, b AS (SELECT step + 1 AS step, bucket, n AS m FROM h)
SELECT s.step, CAST(coalesce(sum(least(n, m)), 0) AS BIGINT) AS overlap
FROM (SELECT DISTINCT step FROM h) s LEFT JOIN (SELECT h.step, n, m FROM h JOIN b USING (step, bucket)) x ON s.step = x.step GROUP BY s.step"""


@query(f"WITH {BATCHES}, h AS (SELECT step, index AS bucket, count(*) AS n FROM batches GROUP BY ALL)" + _OVERLAP)
def overlap_exact(spark, sf_dir):
    return D.overlap(D.histogram(batches(spark, sf_dir), F.col("index")))


@query(f"WITH {BATCHES}, h AS (SELECT step, (index * {D.MULTIPLIER}) % 4096 AS bucket, count(*) AS n FROM batches GROUP BY ALL)" + _OVERLAP)
def overlap_bucket(spark, sf_dir):
    return D.overlap(D.histogram(batches(spark, sf_dir), D.bucket(F.col("index"), 4096, "hash", SIZE)))


_SLIDING = f"""WITH {BATCHES} SELECT s.step, count(DISTINCT b.index) AS n_unique
FROM (SELECT DISTINCT step FROM batches) s JOIN batches b ON b.step <= s.step AND b.step > s.step - {WINDOW} GROUP BY s.step"""


@query(_SLIDING)
def sliding_unique(spark, sf_dir):
    return D.sliding_distinct(batches(spark, sf_dir), WINDOW)


@query(f"WITH {BATCHES}, s AS (SELECT step, count(*) AS b FROM batches GROUP BY step) SELECT step, round({SIZE}.0::DOUBLE * (1 - power(1 - 1 / {SIZE}.0::DOUBLE, {WINDOW} * b)), 6) AS expected FROM s")
def expected_unique(spark, sf_dir):
    sizes = batches(spark, sf_dir).groupBy("step").agg(F.count("*").alias("b"))
    return sizes.select("step", F.round(D.expected_distinct(F.lit(float(SIZE)), WINDOW * F.col("b")), 6).alias("expected"))


@query(f"""WITH {BATCHES}, s AS (SELECT step, count(*)::DOUBLE AS b, count(*) / 4096.0::DOUBLE AS l FROM batches GROUP BY step), r AS (SELECT DISTINCT b, l FROM s),
p AS (SELECT b, k + 1 AS m, 1 - sum(exp(-l + k * ln(l) - lgamma(k + 1))) OVER (PARTITION BY b ORDER BY k) AS beyond FROM r, (SELECT unnest(range(60)) AS k)),
o AS (SELECT b, sum(power(greatest(beyond, 0), 2)) AS least FROM p GROUP BY b)
SELECT step, 1.0::DOUBLE AS chi2_normal, 0.0::DOUBLE AS acf, {SHARDS - 1}.0::DOUBLE AS chi2_shard, round({SIZE} * (1 - exp(-b / {SIZE})), 6) AS n_unique, round(b * b / {SIZE}, 6) AS overlap, round(4096 * least, 6) AS overlap_bucket,
  round({SIZE} * (1 - exp(-{WINDOW} * b / {SIZE})), 6) AS sliding_unique, round({SIZE} * (1 - power(1 - 1 / {SIZE}.0::DOUBLE, {WINDOW} * b)), 6) AS sliding_exact FROM s JOIN o USING (b)""")
def expected_metrics(spark, sf_dir):
    rows = D.expected_metrics(batches(spark, sf_dir), SIZE, SHARDS, WINDOW)
    return rows.select("step", *(F.round(c, 6).alias(c) for c in rows.columns if c != "step"))


_ENTROPY = f"""WITH {BATCHES}, c AS (SELECT step, target, count(*) AS n FROM batches GROUP BY ALL),
p AS (SELECT step, n / sum(n) OVER (PARTITION BY step) AS p, sum(n) OVER (PARTITION BY step) AS b FROM c)
SELECT step, round(sum(-p * ln(p + 1e-10::DOUBLE)), 6) AS entropy,
  CASE WHEN max(b) > 1 THEN round(sum(-p * ln(p + 1e-10::DOUBLE)) / log2(CAST(max(b) AS DOUBLE)), 6) ELSE 0 END AS fraction FROM p GROUP BY step"""


@query(_ENTROPY)
def batch_entropy(spark, sf_dir):
    return D.label_entropy(batches(spark, sf_dir)).select("step", F.round("entropy", 6).alias("entropy"), F.round("fraction", 6).alias("fraction"))


@query(f"""WITH {BATCHES}, u AS (SELECT step, count(DISTINCT index) AS n_unique FROM batches GROUP BY step), e AS ({_ENTROPY.replace('WITH ' + BATCHES + ',', 'WITH')}),
w AS ({_SLIDING.replace('WITH ' + BATCHES, '')}),
h AS (SELECT step, index % {N} AS bucket, count(*) AS n FROM batches GROUP BY ALL), c AS (SELECT step, round(sum(n * n) / (sum(n) / {N}.0::DOUBLE) - sum(n), 6) AS chi2_mod FROM h GROUP BY step)
SELECT u.step, u.n_unique, w.n_unique AS sliding_unique, chi2_mod, entropy, fraction FROM u JOIN e USING (step) JOIN w USING (step) JOIN c USING (step)""")
def batch_metrics(spark, sf_dir):
    rows = D.batch_metrics(batches(spark, sf_dir), N, SIZE, SHARDS, WINDOW)
    return rows.select("step", "n_unique", "sliding_unique", *(F.round(c, 6).alias(c) for c in ("chi2_mod", "entropy", "fraction")))


_PARTS = {
    "n_unique": "n_unique", "chi2_mod": "chi2", "acf_mod": "acf", "chi2_div": "chi2", "acf_div": "acf", "chi2_hash": "chi2", "acf_hash": "acf", "chi2_shard": "chi2", "acf_shard": "acf",
    "overlap_exact": "overlap", "overlap_bucket": "overlap", "sliding_unique": "n_unique", "batch_entropy": "entropy, fraction",
}
_ALL = " JOIN ".join(f"(SELECT step, {', '.join(f'{c} AS {n}' for c, n in _NAMES)} FROM ({ORACLE_SQL[q]}))" + (" USING (step)" if k else "") for k, (q, _NAMES) in enumerate(
    (q, [(c, c) for c in cols.split(", ")] if ", " in cols else [(cols, "overlap" if q == "overlap_exact" else q)]) for q, cols in _PARTS.items()
))


@query(f"SELECT * FROM {_ALL}")
def batch_metrics_all(spark, sf_dir):
    rows = D.batch_metrics(batches(spark, sf_dir), N, SIZE, SHARDS, WINDOW)
    exact = ("step", "n_unique", "overlap", "overlap_bucket", "sliding_unique")
    return rows.select(*(c if c in exact else rounded(c, 6).alias(c) for c in rows.columns))
