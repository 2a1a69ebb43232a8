"""Queries over latents, moments, pairing and reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkline.functions import series as A
from chunkline.operators import metrics
from chunkline.operators.chunks import clips_per_chunk
from chunkline.operators.frames import zero_filled
from chunkline.operators import report as R
from chunkline.operators import stats as S
from chunkline.plans.fixtures import view
from chunkline.plans.notes import BEATS, PAIR, pairs
from chunkline.plans.registry import Family
from chunkline.sources.catalog import manifest_diff
from chunkline.sources.storage import staged

family = Family()
query = family.query


def rounded(df, *names):
    return df.select(*[A.signed_round(F.col(c), 6).alias(c) if c in names else c for c in df.columns])


STATUS = """f AS (SELECT clip_id, frame, CASE WHEN clip_id % 11 = 0 AND frame = 1 THEN embedding[1:10] ELSE embedding END AS v, clip_id % 13 = 0 AND frame = 2 AS nan FROM fx_clips WHERE NOT (clip_id % 7 = 0 AND frame = 4)),
    st AS (SELECT clip_id, CASE WHEN bool_or(len(v) <> 64) THEN 'bad_shape' WHEN count(*) < 5 THEN 'short' WHEN bool_or(nan) THEN 'non_finite' ELSE 'ok' END AS status FROM f GROUP BY clip_id)"""


def faulty(spark, sf):
    """Clips of which some lack a frame, have one of another width, or numbers that are not finite."""
    c = view(spark, sf, "fx_clips").where("not (clip_id % 7 = 0 and frame = 4)")
    v = F.when((F.col("clip_id") % 11 == 0) & (F.col("frame") == 1), F.slice("embedding", 1, 10)).when((F.col("clip_id") % 13 == 0) & (F.col("frame") == 2), F.transform("embedding", lambda x: F.lit(float("nan")).cast("float")))
    return c.withColumn("v", v.otherwise(F.col("embedding")))


@query("c7_latent_validity", f"WITH {STATUS} SELECT clip_id, status FROM st")
def c7(spark, sf):
    return S.latent_status(faulty(spark, sf), "clip_id", "v", 64, 5)


@query("e6_valid_stats", f"WITH {STATUS}, x AS (SELECT unnest(range(64)) AS d, unnest(v)::DOUBLE AS v FROM f JOIN st USING (clip_id) WHERE status = 'ok') SELECT d, count(*) AS n, round(avg(v), 6) AS mean, round(sqrt(var_pop(v) + 1e-6), 6) AS std FROM x GROUP BY d")
def e6_valid(spark, sf):
    return rounded(S.valid_channel_stats(faulty(spark, sf), "clip_id", "frame", "v", 64, 5)[0], "mean", "std")


@query("e6_reject_counts", f"WITH {STATUS}, n AS (SELECT status, count(*) AS n FROM st GROUP BY 1), r AS (SELECT clip_id, status, row_number() OVER (ORDER BY clip_id::VARCHAR) AS k FROM st WHERE status <> 'ok') SELECT status, n, coalesce((SELECT list(clip_id::VARCHAR ORDER BY clip_id::VARCHAR) FROM r WHERE k <= 10 AND r.status = n.status), []) AS first FROM n")
def e6_rejects(spark, sf):
    _, report = S.valid_channel_stats(faulty(spark, sf), "clip_id", "frame", "v", 64, 5)
    rows = [(s, n, [k for k, t in report["first"] if t == s]) for s, n in report["counts"].items() if n]
    return spark.createDataFrame(rows, "status string, n long, first array<string>")


@query("e6_channel_stats", "SELECT d, count(*) AS n, round(avg(v::DOUBLE), 6) AS mean, round(sqrt(var_pop(v::DOUBLE) + 1e-6), 6) AS std FROM fx_latent_dims GROUP BY d")
def e6(spark, sf):
    return rounded(S.require_sound_stats(S.channel_stats(view(spark, sf, "fx_latent_dims"))), "mean", "std")


@query("e7_stats_guard", "WITH x AS (SELECT d, CASE WHEN d % 7 = 0 THEN 1.0 WHEN d % 11 <> 0 THEN v::DOUBLE END AS v FROM fx_latent_dims) SELECT d, count(*) AS n, CASE WHEN count(v) = 0 THEN 'non_finite' WHEN var_pop(v) = 0 THEN 'flat' ELSE 'ok' END AS status FROM x GROUP BY d")
def e7(spark, sf):
    v = F.when(F.col("d") % 7 == 0, F.lit(1.0)).when(F.col("d") % 11 != 0, F.col("v").cast("double"))
    stats = S.channel_stats(view(spark, sf, "fx_latent_dims").withColumn("v", v), eps=0.0)
    return stats.select("d", "n", S.stats_status(F.col("mean"), F.col("std")).alias("status"))


@query("b19_normalize", "WITH s AS (SELECT d, avg(v::DOUBLE) AS m, sqrt(var_pop(v::DOUBLE) + 1e-6) AS sd FROM fx_latent_dims GROUP BY d) SELECT clip_id, frame, f.d, round((v - m) / sd, 5) AS z, round(v::DOUBLE, 5) AS back FROM fx_latent_dims f JOIN s ON f.d = s.d")
def b19(spark, sf):
    dims = view(spark, sf, "fx_latent_dims").withColumn("v", F.col("v").cast("double"))
    stats = staged(S.channel_stats(dims), "stats")
    z = S.normalize(dims, stats).withColumn("z", F.col("v"))
    return S.normalize(z, stats, inverse=True).select("clip_id", "frame", "d", A.signed_round(F.col("z"), 5).alias("z"), A.signed_round(F.col("v"), 5).alias("back"))


@query("b20_dot_similarity", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def b20(spark, sf):
    e = view(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", A.signed_round(A.unit_similarity(F.col("embedding"), F.col("other")), 6).alias("s"))


def wholes(spark, sf):
    return view(spark, sf, "fx_clips").select("side", F.col("embedding").alias("v"))


@query("e10_moments", "SELECT a.side, (a.d)::INT AS i, (b.d)::INT AS j, round(covar_samp(a.v::DOUBLE, b.v::DOUBLE), 6) AS cov FROM fx_latent_dims a JOIN fx_latent_dims b ON a.clip_id = b.clip_id AND a.frame = b.frame GROUP BY ALL")
def e10(spark, sf):
    return rounded(S.covariances(S.moments(wholes(spark, sf), "side", "v"), "side"), "cov")


@query("k6_moments_agg", "SELECT side, count(*) // 64 AS n, round(sum(v::DOUBLE), 6) AS total FROM fx_latent_dims GROUP BY side")
def k6(spark, sf):
    m = S.moments(wholes(spark, sf), "side", "v")
    return m.select("side", "n", F.round(F.aggregate("sx", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("e11_frechet_kl")
def e11(spark, sf):
    c = view(spark, sf, "fx_clips").withColumnRenamed("embedding", "v")
    m = S.moments(c, "side", "v").withColumn("part", F.lit("all"))
    return rounded(S.distribution_distances(m, "side", "part"), "fd", "kl_real_gen", "kl_gen_real")


#: Distances of two Gaussians of two dimensions in closed form: the trace of the root of a 2 x 2 matrix is the root of its trace plus twice the root of its determinant.
TWO = """x AS (SELECT side, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM fx_clips),
g AS (SELECT side, avg(x) AS mx, avg(y) AS my, covar_samp(x, x) + 1e-6 AS a, covar_samp(x, y) AS b, covar_samp(y, y) + 1e-6 AS d FROM x GROUP BY side),
p AS (SELECT r.mx - q.mx AS u, r.my - q.my AS v, r.a AS a, r.b AS b, r.d AS d, q.a AS e, q.b AS f, q.d AS h FROM g r, g q WHERE r.side = 'real' AND q.side = 'gen')"""


@query(
    "e11_two_dimensions",
    f"""WITH {TWO} SELECT round(u * u + v * v + a + d + e + h - 2 * sqrt(a * e + 2 * b * f + d * h + 2 * sqrt((a * d - b * b) * (e * h - f * f))), 6) AS fd,
    round(0.5 * ((a * h - 2 * b * f + d * e + u * u * h - 2 * u * v * f + v * v * e) / (e * h - f * f) - 2 + ln((e * h - f * f) / (a * d - b * b))), 6) AS kl_real_gen,
    round(0.5 * ((a * h - 2 * b * f + d * e + u * u * d - 2 * u * v * b + v * v * a) / (a * d - b * b) - 2 + ln((a * d - b * b) / (e * h - f * f))), 6) AS kl_gen_real FROM p""",
)
def e11_two(spark, sf):
    c = view(spark, sf, "fx_clips").select("side", F.slice("embedding", 1, 2).alias("v"))
    m = S.moments(c, "side", "v").withColumn("part", F.lit("all"))
    return rounded(S.distribution_distances(m, "side", "part"), "fd", "kl_real_gen", "kl_gen_real").drop("part")


PAIRED = """c AS (SELECT sample_id, metric_key, score FROM fx_scores WHERE arm = 'cond' AND NOT isnan(score)), n AS (SELECT sample_id, metric_key, score FROM fx_scores WHERE arm = 'null' AND NOT isnan(score)),
p AS (SELECT metric_key, avg(c.score) FILTER (c.score IS NOT NULL AND n.score IS NOT NULL) AS cond, avg(n.score) FILTER (c.score IS NOT NULL AND n.score IS NOT NULL) AS "null",
  count(*) FILTER (c.score IS NOT NULL AND n.score IS NOT NULL) AS valid, count(*) FILTER (c.score IS NULL OR n.score IS NULL) AS unpaired FROM c FULL JOIN n USING (sample_id, metric_key) GROUP BY metric_key)"""


@query("d15_pair_arms", f'WITH {PAIRED} SELECT metric_key, round(cond, 6) AS cond, round("null", 6) AS "null", round(cond - "null", 6) AS delta, valid, unpaired FROM p')
def d15(spark, sf):
    return rounded(R.pair_arms(view(spark, sf, "fx_scores"), ["metric_key"]), "cond", "null", "delta")


@query(
    "e23_influence_table",
    f"""WITH {PAIRED}, a AS (SELECT metric_key, count(DISTINCT sample_id) FILTER (arm = 'cond') AS attempted, count(*) FILTER (arm = 'cond' AND isnan(score)) AS non_finite FROM fx_scores GROUP BY metric_key)
    SELECT metric_key, attempted, non_finite, round(cond, 6) AS cond, round("null", 6) AS "null", round(cond - "null", 6) AS delta, valid, unpaired, CASE WHEN metric_key = 'error' THEN 'lower' ELSE 'higher' END AS better FROM a JOIN p USING (metric_key)""",
)
def e23(spark, sf):
    return rounded(R.influence_table(view(spark, sf, "fx_scores"), ["metric_key"], ("error",)), "cond", "null", "delta")


@query("h3_symmetric_difference", "SELECT sample_id, metric_key FROM (SELECT DISTINCT sample_id, metric_key, arm FROM fx_scores) GROUP BY ALL HAVING count(*) = 1")
def h3(spark, sf):
    s = view(spark, sf, "fx_scores").select("sample_id", "metric_key", "arm")
    return R.symmetric_difference(*[s.where(F.col("arm") == a).drop("arm") for a in ("cond", "null")])


CONDS = ["click", "error", "purchase", "signup", "view"]


@query("h4_condition_subsets", """WITH k AS (SELECT list(DISTINCT metric_key ORDER BY metric_key) AS a FROM fx_scores), s AS (SELECT 'all' AS label, a AS members FROM k UNION ALL SELECT 'no_' || x, list_filter(a, lambda y: y <> x) FROM (SELECT a, unnest(a) AS x FROM k) UNION ALL SELECT 'click+view', ['click', 'view'])
SELECT label, members, count(*) AS n FROM s JOIN fx_scores f ON list_contains(members, f.metric_key) GROUP BY ALL""")
def h4(spark, sf):
    s = R.condition_subsets(spark, ["all", "LOO", ["click", "view"], "all"], CONDS)
    return view(spark, sf, "fx_scores").join(F.broadcast(s), F.array_contains("members", F.col("metric_key"))).groupBy("label", "members").agg(F.count("*").alias("n"))


@query(
    "e24_influence_matrix",
    "WITH g AS (SELECT *, CASE WHEN sample_id % 2 = 0 THEN 'all' ELSE 'no_view' END AS label FROM fx_scores WHERE NOT isnan(score)), c AS (SELECT label, metric_key, sample_id, max(score) FILTER (arm = 'cond') AS c, max(score) FILTER (arm = 'null') AS n FROM g GROUP BY ALL), d AS (SELECT label, metric_key, avg(c - n) AS delta FROM c WHERE c IS NOT NULL AND n IS NOT NULL GROUP BY ALL) SELECT label, "
    + ", ".join(f"round(max(delta) FILTER (metric_key = '{c}'), 6) AS \"{c}\", {'label = ' + repr('all') if c == 'view' else 'true'} AS {c}_given" for c in CONDS)
    + " FROM d GROUP BY label",
)
def e24(spark, sf):
    s = view(spark, sf, "fx_scores").withColumn("label", F.when(F.col("sample_id") % 2 == 0, "all").otherwise("no_view"))
    deltas = R.pair_arms(s, ["label", "metric_key"]).select("label", F.col("metric_key").alias("cond"), "delta")
    return rounded(R.influence_matrix(deltas, R.condition_subsets(spark, ["all", "loo"], CONDS), CONDS), *CONDS)


@query("b22_window_spans", "SELECT clip_id, w AS \"window\", count(*) AS n FROM fx_clips, (VALUES ('1_0-0.5', 0, 2), ('2_0.2-0.4+0.6-1', 1, 2), ('2_0.2-0.4+0.6-1', 3, 5)) s(w, lo, hi) WHERE frame >= lo AND frame < hi GROUP BY ALL")
def b22(spark, sf):
    spans = R.window_spans(spark, [[(0, 0.5)], [(0.2, 0.4), (0.6, 1)]], 5)
    return R.in_windows(view(spark, sf, "fx_clips"), spans).groupBy("clip_id", "window").agg(F.count("*").alias("n"))


@query("b22_sample_clock", "SELECT clip_id, start, rate, round_even(start * (512 * rate / 44100), 0)::BIGINT AS lo, round_even((start + 20) * (512 * rate / 44100), 0)::BIGINT AS hi FROM (SELECT clip_id, unnest(range(count(*) // 20)) * 20 AS start, CASE WHEN clip_id % 3 = 0 THEN 44100 WHEN clip_id % 3 = 1 THEN 48000 ELSE 22050 END AS rate FROM fx_samples GROUP BY clip_id)")
def b22_clock(spark, sf):
    per = view(spark, sf, "fx_samples").groupBy("clip_id").agg(F.count("*").alias("frames"))
    rate = F.when(F.col("clip_id") % 3 == 0, 44100).when(F.col("clip_id") % 3 == 1, 48000).otherwise(22050)
    return R.sample_spans(clips_per_chunk(per, 20).withColumn("rate", rate), 20, 512, 44100).select("clip_id", "start", "rate", "lo", "hi")


@query(
    "e25_windowed_eval",
    """WITH w AS (SELECT clip_id, w, frame, embedding FROM fx_clips, (VALUES ('1_0-0.5', 0, 2), ('2_0.6-1', 3, 5)) s(w, lo, hi) WHERE frame >= lo AND frame < hi)
    SELECT w AS "window", a.clip_id // 2 AS pair, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score FROM w a JOIN w b USING (w, frame) WHERE a.clip_id % 2 = 0 AND b.clip_id = a.clip_id + 1 GROUP BY ALL""",
)
def e25(spark, sf):
    from chunkline.operators.scores import cosine_fidelity
    frames = R.in_windows(pairs(spark, sf), R.window_spans(spark, [[(0, 0.5)], [(0.6, 1)]], 5))
    return rounded(cosine_fidelity(frames, ["window", "pair"], "real", "gen"), "score")


@query("e25_windowed_distances")
def e25_distances(spark, sf):
    c = view(spark, sf, "fx_clips").select("side", "frame", F.col("embedding").alias("v"))
    c = R.in_windows(c, R.window_spans(spark, [[(0, 0.5)], [(0.6, 1)]], 5)).withColumn("k", F.concat_ws("|", "window", "side"))
    m = S.moments(c, "k", "v").withColumn("window", F.substring_index("k", "|", 1)).withColumn("side", F.substring_index("k", "|", -1))
    return rounded(S.distribution_distances(m, "side", "window"), "fd", "kl_real_gen", "kl_gen_real")


@query("e26_weighted_mean", "SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL")
def e26(spark, sf):
    return rounded(R.weighted_mean(view(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", "l_quantity"), "mean")


@query(
    "a8_report",
    f"""WITH {PAIRED}, s AS (SELECT label::VARCHAR AS entry, round(avg(list_avg(embedding::DOUBLE[])), 6) AS mean FROM embeddings GROUP BY 1)
    SELECT 'influence' AS part, metric_key AS entry, m.metric, m.value FROM p, LATERAL (VALUES ('cond', round(cond, 6)), ('null', round("null", 6)), ('delta', round(cond - "null", 6)), ('valid', valid::DOUBLE), ('unpaired', unpaired::DOUBLE)) m(metric, value)
    UNION ALL SELECT 'latents', entry, 'mean', mean FROM s""",
)
def a8(spark, sf):
    influence = rounded(R.pair_arms(view(spark, sf, "fx_scores"), ["metric_key"]), "cond", "null", "delta")
    latents = view(spark, sf, "embeddings").groupBy("label").agg(F.round(F.avg(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x) / F.size("embedding")), 6).alias("mean"))
    return R.long_report(("influence", influence), ("latents", latents))


@query("g8_first_k_examples", "SELECT change, count(*) AS n, list_sort(list(rel_path))[1:5] AS first FROM (SELECT coalesce(p.rel_path, s.rel_path) AS rel_path, CASE WHEN p.rel_path IS NULL THEN 'added' WHEN s.rel_path IS NULL THEN 'removed' WHEN p.size_bytes <> s.size_bytes OR p.mtime_ns <> s.mtime_ns THEN 'changed' ELSE 'same' END AS change FROM fx_manifest_prev p FULL JOIN fx_sources s ON p.rel_path = s.rel_path) GROUP BY change")
def g8(spark, sf):
    return R.examples(manifest_diff(view(spark, sf, "fx_manifest_prev"), view(spark, sf, "fx_sources")), ["change"], "rel_path", 5)


@query(
    "k5_metric_registry",
    f"""WITH {PAIR} SELECT 'chroma' AS cond, 'score' AS metric, pair AS sample_id, round(avg(list_cosine_similarity(t::DOUBLE[], g::DOUBLE[])), 6) AS value FROM p GROUP BY pair
    UNION ALL SELECT 'energy', 'score', clip_id, round(CASE WHEN stddev_pop(target) > 0 AND stddev_pop(generated) > 0 THEN corr(target, generated) ELSE 'NaN'::DOUBLE END, 6) FROM fx_curves GROUP BY clip_id""",
)
def k5(spark, sf):
    frames = {"chroma": pairs(spark, sf).select(F.col("pair").alias("sample"), F.col("real").alias("target"), F.col("gen").alias("generated"))}
    frames["energy"] = view(spark, sf, "fx_curves").select(F.col("clip_id").alias("sample"), "target", "generated")
    return rounded(metrics.evaluate(frames, "sample", "target", "generated"), "value")


@query(
    "k5_mir_metrics",
    f"""WITH RECURSIVE {BEATS}, {PAIR}, f AS (SELECT pair, len(list_filter(range(1, 13), lambda i: t[i] >= 0.5 AND g[i] >= 0.5)) AS tp, len(list_filter(t[1:12], lambda x: x >= 0.5)) AS r, len(list_filter(g[1:12], lambda x: x >= 0.5)) AS e FROM p),
    k AS (SELECT pair, sum(tp) AS tp, sum(r) AS r, sum(e) AS e FROM f GROUP BY pair),
    s AS (SELECT 'chord' AS cond, 'precision' AS metric, pair AS sample_id, CASE WHEN e > 0 THEN tp / e ELSE 'NaN' END::DOUBLE AS value FROM k UNION ALL SELECT 'chord', 'recall', pair, CASE WHEN r > 0 THEN tp / r ELSE 'NaN' END FROM k
    UNION ALL SELECT 'rhythm', 'beat_f_measure', clip_id, CASE WHEN len(r) = 0 THEN 'NaN' ELSE coalesce(2 * bm.m / (len(r) + len(e)), 0) END FROM bt LEFT JOIN bm USING (clip_id)
    UNION ALL SELECT 'rhythm', 'downbeat_f_measure', clip_id, CASE WHEN len(rd) = 0 THEN 'NaN' ELSE coalesce(2 * dm.m / (len(rd) + len(ed)), 0) END FROM bt LEFT JOIN dm USING (clip_id))
    SELECT cond, metric, sample_id, round(value, 6) AS value FROM s""",
)
def k5_mir(spark, sf):
    """Chords and rhythm by their MIR metrics (the others of the same run have no SQL)."""
    c = zero_filled(view(spark, sf, "fx_curves"), "clip_id", 31, "target", "generated")
    both = lambda v: F.array(F.col(v) / 100, F.when(F.col("frame") % 3 == 0, F.col(v) / 100).otherwise(0.0))
    rhythm = c.select(F.col("clip_id").alias("sample"), "frame", both("target").alias("target"), both("generated").alias("generated"))
    frames = {"chord": pairs(spark, sf).select(F.col("pair").alias("sample"), F.col("real").alias("target"), F.col("gen").alias("generated")), "rhythm": rhythm}
    out = metrics.evaluate(frames, "sample", "target", "generated", "mir", fps=10.0)
    return rounded(out.where(F.col("metric").isin("precision", "recall", "beat_f_measure", "downbeat_f_measure")), "value")
