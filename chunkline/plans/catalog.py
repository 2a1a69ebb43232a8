"""Queries over source listings, sidecars, manifests and splits, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkline.functions import text as T
from chunkline.functions.ranking import dense_index
from chunkline.operators import chunks as C
from chunkline.operators import splits as S
from chunkline.plans.fixtures import view
from chunkline.plans.registry import Family
from chunkline.sources import catalog as K
from chunkline.sources import digest as G
from chunkline.sources.storage import new_path, staged

family = Family()
query = family.query

CLASS = "coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9_\\s-]', '', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'unknown')"
STEM = "regexp_replace(regexp_replace({0}, '^.*/', ''), '\\.[^.]*$', '')"
FILE = "coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(" + STEM + "), '[^a-z0-9_\\s-]', '', 'g'), '[\\s-]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'unknown')"
PARENT = "regexp_replace({0}, '/[^/]*$', '')"
GROUP = "(" + PARENT + " || '/' || " + FILE + " || '_' || substr(sha1({0}), 1, 8))"
KEY = "lower(ltrim(regexp_replace(replace(trim(nfc_normalize({0})), '\\', '/'), '^(\\./)+', ''), '/'))"


def sql(template: str, **parts: str) -> str:
    for name, (text, column) in {k: v.split("@") for k, v in parts.items()}.items():
        template = template.replace(f"[{name}]", {"CLASS": CLASS, "FILE": FILE, "GROUP": GROUP, "KEY": KEY, "PARENT": PARENT, "STEM": STEM}[text].replace("{0}", column))
    return template


def sources(spark, sf):
    return view(spark, sf, "fx_sources")


def keyed(spark, sf):
    return sources(spark, sf).withColumn("group_key", T.group_key(F.col("rel_path")))


@query("a1_source_catalog", sql("SELECT rel_path, [P] AS rel_parent, regexp_replace([P], '^.*/', '') AS class_name, substr(sha1(rel_path), 1, 8) AS src_id, size_bytes, mtime_ns FROM fx_sources", P="PARENT@rel_path"))
def a1(spark, sf):
    return K.source_catalog(sources(spark, sf), extensions=("txt",))


def versioned(rows, key):
    """A new versioned table that holds ``rows``."""
    rows = staged(rows, "rows")
    table = G.VersionedTable(rows.sparkSession, new_path(rows.sparkSession, "table"), rows.schema, key)
    table.write(rows)
    return table


@query("a3_manifest_io", "SELECT rel_path, size_bytes, mtime_ns FROM fx_manifest_prev")
def a3(spark, sf):
    return versioned(view(spark, sf, "fx_manifest_prev"), "rel_path").read()


@query("a3_manifest_versions", "SELECT 0 AS version, rel_path, size_bytes, mtime_ns FROM fx_manifest_prev UNION ALL SELECT 1, rel_path, size_bytes, mtime_ns FROM fx_sources")
def a3_versions(spark, sf):
    """Both versions, the first read by a reader that holds on to it."""
    table = versioned(view(spark, sf, "fx_manifest_prev").select("rel_path", "size_bytes", "mtime_ns"), "rel_path")
    first = table.read(0).withColumn("version", F.lit(0))
    now = sources(spark, sf).select("rel_path", "size_bytes", "mtime_ns")
    for _ in range(2):  # the second write finds nothing new
        table.write(now)
    return first.unionByName(table.read(1).withColumn("version", F.lit(table.version())))


SPLIT_SQL = """
g AS (SELECT [G] AS group_key, class_name AS bucket, doc_id, size_bytes FROM fx_sources),
a AS (SELECT bucket, n, CASE WHEN n <= 1 THEN 0 ELSE greatest(round_even(n * 0.1, 0), 1) END AS te FROM (SELECT bucket, count(*) AS n FROM g GROUP BY bucket)),
b AS (SELECT bucket, n, te, CASE WHEN n <= 1 THEN 0 WHEN n - te >= 2 THEN greatest(round_even(n * 0.1, 0), 1) ELSE round_even(n * 0.1, 0) END AS va FROM a),
r AS (SELECT g.*, n, te, va, row_number() OVER (PARTITION BY g.bucket ORDER BY sha1('42:' || g.bucket || ':' || group_key), group_key) AS rk FROM g JOIN b ON g.bucket = b.bucket),
s AS (SELECT group_key, bucket, doc_id, size_bytes, CASE WHEN rk <= n - te - va THEN 'train' WHEN rk <= n - te THEN 'val' ELSE 'test' END AS split FROM r)
"""
SPLIT_SQL = sql(SPLIT_SQL, G="GROUP@rel_path")


def splits(spark, sf):
    return S.assign_splits(keyed(spark, sf).select("group_key", F.col("class_name").alias("bucket")))


@query("g3_assign_splits", f"WITH {SPLIT_SQL} SELECT group_key, split FROM s")
def g3(spark, sf):
    return splits(spark, sf)


GROWN_SQL = SPLIT_SQL.replace("FROM fx_sources)", "FROM fx_sources WHERE doc_id % 10 <> 3)").replace("s AS (", "s0 AS (") + """,
w AS (SELECT [G] AS group_key, class_name AS bucket FROM fx_sources),
h AS (SELECT w.*, s0.split AS was FROM w LEFT JOIN s0 USING (group_key)),
n AS (SELECT bucket, count(*) AS n, count(*) FILTER (was = 'val') AS hv, count(*) FILTER (was = 'test') AS ht FROM h GROUP BY bucket),
t AS (SELECT bucket, greatest(greatest(round_even(n * 0.1, 0), 1) - ht, 0) AS dt, greatest(greatest(round_even(n * 0.1, 0), 1) - hv, 0) AS dv FROM n),
k AS (SELECT h.group_key, dt, dv, row_number() OVER (PARTITION BY h.bucket ORDER BY sha1('42:' || h.bucket || ':' || group_key), group_key) AS rk FROM h JOIN t ON h.bucket = t.bucket WHERE was IS NULL)
SELECT group_key, split FROM s0
UNION ALL SELECT group_key, CASE WHEN rk <= dt THEN 'test' WHEN rk <= dt + dv THEN 'val' ELSE 'train' END FROM k"""


@query("g3_grown_splits", "WITH " + sql(GROWN_SQL, G="GROUP@rel_path"))
def g3_grown(spark, sf):
    every = keyed(spark, sf).select("doc_id", "group_key", F.col("class_name").alias("bucket"))
    first = staged(S.assign_splits(every.where("doc_id % 10 <> 3")), "splits")
    return S.assign_splits(every, existing=first)


@query("a4_splits_io", f"WITH {SPLIT_SQL} SELECT group_key, split, '0.8,0.1,0.1' AS ratios, '42' AS seed FROM s")
def a4(spark, sf):
    params = spark.createDataFrame([("0.8,0.1,0.1", "42")], "ratios string, seed string")
    return versioned(splits(spark, sf).crossJoin(F.broadcast(params)), "group_key").read()


@query("a6_split_scoped_export", f"WITH {SPLIT_SQL} SELECT group_key, size_bytes FROM s WHERE split IN ('val', 'test')")
def a6(spark, sf):
    return S.scoped(keyed(spark, sf).select("group_key", "size_bytes"), splits(spark, sf), ("val", "test"))


@query("b1_sanitize_class", sql("SELECT doc_id, [C] AS name FROM fx_sources", C="CLASS@rel_path"))
def b1(spark, sf):
    return sources(spark, sf).select("doc_id", T.sanitize_class(F.col("rel_path")).alias("name"))


@query("b2_sanitize_file", sql("SELECT page_id, [F] AS name FROM pages", F="FILE@regexp_replace(url, '[?#].*$', '')"))
def b2(spark, sf):
    return view(spark, sf, "pages").select("page_id", T.sanitize_file(F.regexp_replace("url", "[?#].*$", "")).alias("name"))


@query("b3_path_key", sql("SELECT pos, [K] AS key FROM fx_sidecar", K="KEY@file"))
def b3(spark, sf):
    return view(spark, sf, "fx_sidecar").select("pos", T.path_key(F.col("file")).alias("key"))


@query("b4_clean_text", "SELECT pos, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS text FROM fx_sidecar")
def b4(spark, sf):
    return view(spark, sf, "fx_sidecar").select("pos", T.clean_text(F.col("text")).alias("text"))


@query("b5_chunk_names", sql("SELECT rel_path, [G] || '__c' || lpad((doc_id % 7)::VARCHAR, 4, '0') AS chunk, [G] AS group_key FROM fx_sources", G="GROUP@rel_path"))
def b5(spark, sf):
    chunk = sources(spark, sf).select("rel_path", T.chunk_name(F.col("rel_path"), F.col("doc_id") % 7).alias("chunk"))
    return chunk.withColumn("group_key", T.chunk_group(F.col("chunk")))


@query("b6_seed_hash", "SELECT rel_path, ('0x' || right(sha1('7:' || rel_path), 8))::BIGINT AS h FROM fx_sources")
def b6(spark, sf):
    return sources(spark, sf).select("rel_path", T.seed_hash(7, F.col("rel_path")).alias("h"))


@query("b7_hash_decile_split", "SELECT vec_id, CASE WHEN d < 8 THEN 'train' WHEN d = 8 THEN 'val' ELSE 'test' END AS split FROM (SELECT vec_id, ('0x' || substr(sha1(file_name), 1, 8))::BIGINT % 10 AS d FROM fx_bank)")
def b7(spark, sf):
    return view(spark, sf, "fx_bank").select("vec_id", T.hash_decile_split(F.col("file_name")).alias("split"))


@query(
    "b8_allocate_three",
    """WITH n AS (SELECT folder, class_name, count(*) AS n FROM fx_sources GROUP BY ALL),
    a AS (SELECT *, greatest(round_even(n * 0.1, 0), 1) AS te FROM n), b AS (SELECT *, CASE WHEN n - te >= 2 THEN greatest(round_even(n * 0.1, 0), 1) ELSE round_even(n * 0.1, 0) END AS va FROM a)
    SELECT folder, class_name, n, CASE WHEN n <= 1 THEN n ELSE n - te - va END::BIGINT AS train, CASE WHEN n <= 1 THEN 0 ELSE va END::BIGINT AS val, CASE WHEN n <= 1 THEN 0 ELSE te END::BIGINT AS test FROM b""",
)
def b8(spark, sf):
    per = sources(spark, sf).groupBy("folder", "class_name").agg(F.count("*").alias("n"))
    return per.select("folder", "class_name", "n", *[c.alias(k) for k, c in S.allocate_three(F.col("n"), (0.8, 0.1, 0.1)).items()])


ATTACH = """k AS (SELECT rel_path, [S] AS key FROM fx_sources), r AS (SELECT pos, label, text, [R] AS key FROM fx_sidecar),
x AS (SELECT r.*, k.rel_path FROM r LEFT JOIN k USING (key)),
m AS (SELECT rel_path, pos, label, text FROM x WHERE rel_path IS NOT NULL
  UNION ALL SELECT k.rel_path, pos, label, text FROM x JOIN k ON regexp_replace(x.key, '^.*/', '') = regexp_replace(k.key, '^.*/', '') WHERE x.rel_path IS NULL),
l AS (SELECT rel_path, list(label ORDER BY pos) AS labels FROM (SELECT rel_path, label, min(pos) AS pos FROM m GROUP BY ALL) GROUP BY rel_path),
t AS (SELECT rel_path, list(text ORDER BY pos) AS texts FROM (SELECT rel_path, text, min(pos) AS pos FROM m GROUP BY ALL) GROUP BY rel_path)"""
ATTACH = sql(ATTACH, S="KEY@rel_path", R="KEY@file")


def attached(spark, sf):
    return K.attach_sidecar(sources(spark, sf), view(spark, sf, "fx_sidecar"))[0]


@query("d1_attach_sidecar", f"WITH {ATTACH} SELECT s.rel_path, coalesce(labels, []) AS labels, coalesce(texts, []) AS texts FROM fx_sources s LEFT JOIN l USING (rel_path) LEFT JOIN t USING (rel_path)")
def d1(spark, sf):
    return attached(spark, sf)


DIFF = "SELECT coalesce(p.rel_path, s.rel_path) AS rel_path, CASE WHEN p.rel_path IS NULL THEN 'added' WHEN s.rel_path IS NULL THEN 'removed' WHEN p.size_bytes <> s.size_bytes OR p.mtime_ns <> s.mtime_ns THEN 'changed' ELSE 'same' END AS change FROM fx_manifest_prev p FULL JOIN fx_sources s ON p.rel_path = s.rel_path"


@query("d2_manifest_diff", DIFF)
def d2(spark, sf):
    return K.manifest_diff(view(spark, sf, "fx_manifest_prev"), sources(spark, sf))


@query("d3_orphans", "SELECT p.rel_path, p.size_bytes, p.mtime_ns FROM fx_manifest_prev p ANTI JOIN fx_sources s ON p.rel_path = s.rel_path")
def d3(spark, sf):
    return K.orphans(view(spark, sf, "fx_manifest_prev"), sources(spark, sf))


@query(
    "d4_manifest_merge",
    """WITH d AS (SELECT rel_path, size_bytes, mtime_ns FROM fx_sources WHERE doc_id % 3 = 0) SELECT * FROM d
    UNION ALL SELECT p.* FROM fx_manifest_prev p ANTI JOIN d ON p.rel_path = d.rel_path WHERE p.rel_path IN (SELECT rel_path FROM fx_sources)""",
)
def d4(spark, sf):
    src = sources(spark, sf)
    produced = src.where("doc_id % 3 = 0").select("rel_path", "size_bytes", "mtime_ns")
    return K.manifest_merge(view(spark, sf, "fx_manifest_prev"), produced, live=src)


@query(
    "d5_pending_sources",
    """SELECT rel_path, size_bytes, mtime_ns FROM fx_sources s WHERE NOT EXISTS (SELECT 1 FROM fx_manifest_prev p
    WHERE p.rel_path = s.rel_path AND p.size_bytes = s.size_bytes AND p.mtime_ns = s.mtime_ns) OR doc_id % 13 = 0 OR doc_id % 17 = 0""",
)
def d5(spark, sf):
    src = sources(spark, sf).select("rel_path", "size_bytes", "mtime_ns", "doc_id")
    known = view(spark, sf, "fx_manifest_prev").join(src.select("rel_path", "doc_id"), "rel_path", "left")
    name = F.concat("rel_path", F.lit("#"))
    chunks = F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(name, F.lit("0")), F.concat(name, F.lit("1"))))
    manifest = known.withColumn("chunks", chunks).drop("doc_id")
    done = src.select("doc_id", F.explode(F.array(F.concat(name, F.lit("0")), F.concat(name, F.lit("1")))).alias("rel_chunk"), F.explode(F.array(F.lit("latent"))).alias("output"))
    more = done.withColumn("output", F.lit("energy")).where("doc_id % 17 <> 0 or rel_chunk like '%#0'")
    needed = spark.createDataFrame([("latent",), ("energy",)], "output string")
    return K.pending_sources(src.drop("doc_id"), manifest, done.unionByName(more).drop("doc_id"), needed)


@query(
    "d7_companion_match",
    """WITH f AS (SELECT 'en/src' || (page_id % 20) AS folder, 'Doc ' || (page_id * 4) || '-v1' AS stem, 'en/src' || (page_id % 20) || '/Doc ' || (page_id * 4) || '-v1.' || s.x AS file FROM pages, (VALUES ('mid'), ('midi')) s(x) WHERE s.x = 'mid' OR page_id % 5 = 0),
    g AS (SELECT folder, stem, list(file ORDER BY file) AS found FROM f GROUP BY ALL)
    SELECT rel_path, CASE WHEN found IS NULL THEN 'missing' WHEN len(found) = 1 THEN 'found' ELSE 'ambiguous' END AS status, coalesce(found, []) AS found
    FROM fx_sources LEFT JOIN g ON [P] = g.folder AND [S] = g.stem""".replace("[P]", PARENT.replace("{0}", "rel_path")).replace("[S]", STEM.replace("{0}", "rel_path")),
)
def d7(spark, sf):
    p = view(spark, sf, "pages")
    base = F.concat(F.lit("en/src"), (F.col("page_id") % 20).cast("string"), F.lit("/Doc "), (F.col("page_id") * 4).cast("string"), F.lit("-v1."))
    ends = F.when(F.col("page_id") % 5 == 0, F.array(F.lit("mid"), F.lit("midi"))).otherwise(F.array(F.lit("mid")))
    return K.companion_match(sources(spark, sf), p.select(F.explode(F.transform(ends, lambda e: F.concat(base, e))).alias("rel_path")))


@query("e1_class_histogram", "WITH c AS (SELECT folder AS class_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, folder) AS r FROM fx_sources GROUP BY 1) SELECT class_name, n, 1 AS classes FROM c WHERE r <= 5 UNION ALL SELECT NULL, coalesce(sum(n), 0)::BIGINT, count(*) FROM c WHERE r > 5")
def e1(spark, sf):
    return S.class_histogram(sources(spark, sf).select(F.col("folder").alias("class_name")), 5)


@query("e2_split_counts", f"WITH {SPLIT_SQL} SELECT split, count(s.group_key) AS n FROM (VALUES ('train'), ('val'), ('test')) v(split) LEFT JOIN s USING (split) GROUP BY split")
def e2(spark, sf):
    return S.split_counts(splits(spark, sf))


@query("e3_chunk_counts", f"WITH {SPLIT_SQL} SELECT split, sum(CASE WHEN size_bytes >= 512 THEN (size_bytes - 512) // 448 + 1 ELSE 0 END)::BIGINT AS n FROM s GROUP BY split")
def e3(spark, sf):
    """Sources are split, cut into chunks of 512 with 64 in common, and their chunks counted by split."""
    src = keyed(spark, sf)
    parts = S.assign_splits(src.select("group_key", F.col("class_name").alias("bucket")))
    cut = src.select("group_key", F.posexplode(C.window_starts(F.col("size_bytes"), 512, 64)).alias("idx", "start"))
    return S.chunk_counts(cut.select(F.concat("group_key", F.lit("__c"), F.format_string("%04d", "idx")).alias("rel_chunk")), parts)


@query("e3_rollup", f"WITH {SPLIT_SQL} SELECT split, bucket AS class_name, count(*) AS n FROM s GROUP BY ROLLUP (split, bucket)")
def e3_rollup(spark, sf):
    src = keyed(spark, sf).select("group_key", "class_name")
    return splits(spark, sf).join(src, "group_key").rollup("split", "class_name").agg(F.count("*").alias("n"))


@query("d8_latents_to_split", f"WITH {SPLIT_SQL} SELECT group_key || '__c' || lpad(i::VARCHAR, 4, '0') AS rel_chunk, group_key, split FROM (SELECT *, unnest(range(CASE WHEN size_bytes >= 512 THEN (size_bytes - 512) // 448 + 1 ELSE 0 END)) AS i FROM s)")
def d8(spark, sf):
    src = keyed(spark, sf)
    cut = src.select("group_key", F.posexplode(C.window_starts(F.col("size_bytes"), 512, 64)).alias("idx", "start"))
    chunks = cut.select(F.concat("group_key", F.lit("__c"), F.format_string("%04d", "idx")).alias("rel_chunk"))
    return S.require_assigned(S.with_split(chunks, splits(spark, sf))).select("rel_chunk", "group_key", "split")


@query("b9_ratio_check", """WITH c AS (SELECT l_partkey, (count(*) FILTER (l_returnflag = 'A'))::DOUBLE AS a, (count(*) FILTER (l_returnflag = 'N'))::DOUBLE AS n, (count(*) FILTER (l_returnflag = 'R'))::DOUBLE AS r, count(*) AS t FROM lineitem GROUP BY 1),
s AS (SELECT l_partkey, CASE WHEN l_partkey % 5 = 0 THEN a - n WHEN l_partkey % 3 <> 0 THEN a END / t AS a, n / t AS n, CASE WHEN l_partkey % 7 = 0 THEN r / 2 ELSE r END / t AS r FROM c)
SELECT l_partkey, CASE WHEN a IS NULL THEN 'missing' WHEN least(a, n, r) < 0 THEN 'negative' WHEN abs(a + n + r - 1) > 1e-6 THEN 'sum' ELSE 'ok' END AS status FROM s""")
def b9(spark, sf):
    """The shares of return flags of each part, some of them spoilt."""
    of = lambda f: F.count(F.when(F.col("l_returnflag") == f, 1)).cast("double").alias(f.lower())
    c = view(spark, sf, "lineitem").groupBy("l_partkey").agg(of("A"), of("N"), of("R"), F.count("*").alias("t"))
    k = F.col("l_partkey")
    a = F.when(k % 5 == 0, F.col("a") - F.col("n")).when(k % 3 != 0, F.col("a")) / F.col("t")
    r = F.when(k % 7 == 0, F.col("r") / 2).otherwise(F.col("r")) / F.col("t")
    return c.select("l_partkey", S.ratio_status(a, F.col("n") / F.col("t"), r).alias("status"))


TREE = """l AS (SELECT sha1(rel_path) AS k, sha256({ROW}) AS h FROM {T}), c AS (SELECT k, h, count(*) AS n FROM l GROUP BY ALL),
d2 AS (SELECT substr(k, 1, 2) AS path, sum(n)::BIGINT AS n, sha256(string_agg(k || ' ' || h || ' ' || n, chr(10) ORDER BY k, h)) AS digest FROM c GROUP BY 1),
d1 AS (SELECT substr(path, 1, 1) AS path, sum(n)::BIGINT AS n, sha256(string_agg(path || ' ' || digest, chr(10) ORDER BY path)) AS digest FROM d2 GROUP BY 1),
d0 AS (SELECT '' AS path, sum(n)::BIGINT AS n, sha256(string_agg(path || ' ' || digest, chr(10) ORDER BY path)) AS digest FROM d1)"""
ROW = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("rel_path", "size_bytes", "mtime_ns"))


def tree_sql(table):
    return TREE.format(ROW=ROW, T=table)


def tree(df, digits=2):
    return G.digest_tree(df, "rel_path", "size_bytes", "mtime_ns", digits=digits)


@query("e12_fingerprint", f"WITH {tree_sql('fx_sources')} SELECT digest, n FROM d0")
def e12(spark, sf):
    return G.fingerprint(sources(spark, sf), "rel_path", "size_bytes", "mtime_ns")


@query("e12_leaf_digests", f"WITH {tree_sql('fx_sources')} SELECT path, n, digest FROM d2")
def e12_leaves(spark, sf):
    return tree(sources(spark, sf)).where("length(path) = 2")


@query("e12_changed_ranges", f"WITH a AS (WITH {tree_sql('fx_manifest_prev')} SELECT path, digest FROM d2), b AS (WITH {tree_sql('fx_sources')} SELECT path, digest FROM d2) SELECT path, a.digest AS was, b.digest AS now FROM a FULL JOIN b USING (path) WHERE a.digest IS DISTINCT FROM b.digest")
def e12_changed(spark, sf):
    return G.changed_ranges(tree(view(spark, sf, "fx_manifest_prev")), tree(sources(spark, sf)), 2)


@query("e13_meta_conflicts", """WITH a AS (SELECT class_name AS key, sum(size_bytes)::VARCHAR AS was FROM fx_sources GROUP BY 1),
b AS (SELECT class_name AS key, sum(CASE WHEN class_name = 'fr' THEN size_bytes + 1 ELSE size_bytes END)::VARCHAR AS now FROM fx_sources WHERE class_name <> 'de' GROUP BY 1)
SELECT key, was, now FROM a JOIN b USING (key) WHERE was <> now""")
def e13(spark, sf):
    src = sources(spark, sf)
    as_map = lambda d: d.agg(F.map_from_entries(F.collect_list(F.struct("class_name", F.col("v").cast("string")))).alias("meta"))
    old = as_map(src.groupBy("class_name").agg(F.sum("size_bytes").alias("v")))
    grown = F.when(F.col("class_name") == "fr", F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    return K.meta_conflicts(old, as_map(src.where("class_name <> 'de'").groupBy("class_name").agg(F.sum(grown).alias("v"))))


@query("g1_dense_index", "SELECT rel_path, row_number() OVER (ORDER BY rel_path) - 1 AS idx FROM fx_sources")
def g1(spark, sf):
    return dense_index(sources(spark, sf).select("rel_path"), "rel_path")


@query("g2_linspace_sample", """WITH i AS (SELECT rel_path, row_number() OVER (ORDER BY rel_path) - 1 AS idx, count(*) OVER () AS total FROM fx_sources),
p AS (SELECT DISTINCT floor(k * (total - 1) / 49.0)::BIGINT AS idx FROM (SELECT DISTINCT total FROM i), range(50) r(k))
SELECT rel_path, idx FROM i JOIN p USING (idx)""")
def g2(spark, sf):
    rows = dense_index(sources(spark, sf).select("rel_path"), "rel_path")
    at = rows.agg(F.count("*").alias("total")).select(F.explode(S.linspace_positions(50, F.col("total"))).alias("idx"))
    return rows.join(F.broadcast(at), "idx").select("rel_path", "idx")


@query("g4_capped_sample", "SELECT rel_path FROM fx_sources ORDER BY sha1('5:' || rel_path), rel_path LIMIT 100")
def g4(spark, sf):
    return S.capped_sample(sources(spark, sf).select("rel_path"), 100, 5, "rel_path")


@query("g9_round_robin_shards", "SELECT rel_path, (row_number() OVER (ORDER BY rel_path) - 1) % 7 AS shard FROM fx_sources")
def g9(spark, sf):
    return S.round_robin(dense_index(sources(spark, sf).select("rel_path"), "rel_path"), 7).select("rel_path", "shard")


@query("h1_union_keys", "SELECT rel_path FROM fx_sources UNION SELECT rel_path FROM fx_manifest_prev")
def h1(spark, sf):
    return sources(spark, sf).select("rel_path").union(view(spark, sf, "fx_manifest_prev").select("rel_path")).distinct()


@query("h2_keep_existing", "SELECT coalesce(s.rel_path, p.rel_path) AS rel_path, coalesce(s.size_bytes, p.size_bytes) AS size_bytes FROM (SELECT * FROM fx_sources WHERE doc_id % 2 = 0) s FULL JOIN fx_manifest_prev p ON s.rel_path = p.rel_path")
def h2(spark, sf):
    new = sources(spark, sf).where("doc_id % 2 = 0").select("rel_path", "size_bytes")
    return K.manifest_merge(view(spark, sf, "fx_manifest_prev").select("rel_path", "size_bytes"), new)
