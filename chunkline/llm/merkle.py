"""A Merkle manifest of a dataset with witnesses that grow as it is appended to.

A tree joins every FAN consecutive nodes of a level. Nodes are appended from the left: a node waits in its open run, and
with it the witnesses of all that lies below; when the run is full its nodes become siblings, each waiting witness is
extended by those of its own node, and the run's digest is appended one level up. Closing the tree completes the
runs that are still open.

Spark deals the leaves in aligned blocks of FAN ** HEIGHT: a task appends the leaves of a block, and the roots of blocks
are appended in further rounds, until one node of a tree is left. The witness of a leaf is its own in the block, then
that of the block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkline.llm.common import sha256_text, staged

FAN, HEIGHT = 8, 3
BLOCK = FAN**HEIGHT
STEPS = "array<struct<left: string, right: string>>"


class Tree:
    """An append-only tree. ``witness[i]`` is the list of (left siblings, right siblings) of leaf i, as far as they are known."""

    def __init__(self):
        self.witness: list[list[tuple[str, str]]] = []
        #: by level, the nodes of the open run: (digest, numbers of the leaves below)
        self.open: list[list[tuple[str, range]]] = []

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._put(0, digest, range(len(self.witness) - 1, len(self.witness)))

    def _put(self, level: int, digest: str, leaves: range) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((digest, leaves))
        if len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _ in run]
        for i, (_, leaves) in enumerate(run):
            step = ("".join(digests[:i]), "".join(digests[i + 1 :]))
            for leaf in leaves:
                self.witness[leaf].append(step)
        whole = "".join(digests)
        self._put(level + 1, hashlib.sha256(whole.encode()).hexdigest(), range(run[0][1].start, run[-1][1].stop))

    def close(self, height: int) -> str:
        """Completes the open runs of the levels below ``height``; the one node that is left there is the root."""
        for level in range(height):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[height][0][0]


def height_of(n: int) -> int:
    """Levels until n nodes are one."""
    height = 0
    while n > 1:
        n, height = -(-n // FAN), height + 1
    return height


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``pos`` (each row's place in its ``tree``) and ``n`` (the tree's size), by ranges and their counts.

    A range holds rows of several trees; a large tree lies in several.
    """
    # rows are numbered as they lie in their range
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = staged(dealt.withColumn("_part", F.shiftright("_at", 33)), "ordered")
    counts = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    of = Window.partitionBy("tree")
    before = F.sum("_n").over(of.orderBy("_part")) - F.col("_n")
    counts = counts.select("tree", "_part", "_first", before.alias("_before"), F.sum("_n").over(of).alias("n"))
    return dealt.join(counts, ["tree", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def append_all(nodes: pa.Table) -> tuple[Tree, str]:
    """The tree of a block's nodes and its root. A block that is its whole tree ends at one node, others at HEIGHT."""
    tree = Tree()
    for digest in nodes["digest"].to_pylist():
        tree.append(digest)
    n = nodes["n"][0].as_py()
    return tree, tree.close(height_of(n) if n <= BLOCK else HEIGHT)


def blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def grown(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, pos, n, digest, ...), the roots of their blocks, those of the blocks of these, to one node of each tree."""

    def root(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = -(-block["n"][0].as_py() // BLOCK)
        return pa.table({"tree": block["tree"].slice(0, 1), "pos": block["block"].slice(0, 1), "n": pa.array([n]), "digest": pa.array([append_all(block)[1]])})

    levels = [nodes]
    while True:
        keyed = blocks(levels[-1].select("tree", "pos", "n", "digest"))
        above = staged(keyed.groupBy("tree", "block").applyInArrow(root, "tree string, pos long, n long, digest string"), "block-roots")
        levels.append(above)
        if above.where("n > 1").isEmpty():
            return levels


def witnessed(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The first of ``levels`` with ``subroot``, ``root`` and ``steps``; ``roots`` (tree, subroot, root, steps) go on from the last."""
    top = levels[-1].join(roots, "tree").select("tree", F.col("pos").alias("block"), "subroot", "root", "steps")
    for nodes in reversed(levels[:-1]):
        own = [f for f in nodes.schema.fields if f.name not in ("n", "digest") or nodes is levels[0]]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + f", subroot string, root string, steps {STEPS}"
        top = blocks(nodes).groupBy("tree", "block").cogroup(top.groupBy("tree", "block")).applyInArrow(extender([f.name for f in own]), schema)
        if nodes is not levels[0]:
            top = top.withColumnRenamed("pos", "block")
    return top


def extender(names: list[str]):
    """A function of a block's nodes and of its own witness: each node's witness goes on with that of the block."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def extended(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        upper = above["steps"][0].as_py()
        steps = [[{"left": a, "right": b} for a, b in known] + upper for known in append_all(block)[0].witness]
        out = block.select(names)
        for name in ("subroot", "root"):
            out = out.append_column(name, pa.array([above[name][0].as_py()] * len(steps), pa.string()))
        return out.append_column("steps", pa.array(steps, kind))

    return extended


def leaf_digest(*columns: Column) -> Column:
    """Hash of the values, each as `-` if null, else its byte count, a colon and itself."""
    text = [c.cast("string") for c in columns]
    return sha256_text(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(steps, leaf, lambda h, s: sha256_text(F.concat(s["left"], h, s["right"])))


def siblings(steps: Column) -> Column:
    """All siblings of a witness in one text, from the leaf up and from left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(rows: DataFrame, *, by: str, order: str, columns: list[str], keep: list[Column]) -> DataFrame:
    """(``keep``, leaf, subroot, root, steps) of each row; steps are the siblings from its leaf by its subroot to the root.

    A tree for each value of ``by`` (as text; null is a value of its own and comes first, the others in the order of
    their UTF-8 bytes), its leaves by ``order`` (null first; equal ones by their digests). The subroots are the leaves of
    a last tree. A lone leaf is its tree's root and adds no step. Rows with equal leaves (repeated rows) are
    interchangeable. An empty table gives an empty table. Other columns are ignored, whatever their names.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    kept = F.struct(*keep)
    leaves = rows.select(tree.alias("tree"), F.col(order).alias("_order"), leaf_digest(*[F.col(c) for c in columns]).alias("digest"), kept.alias("row"))
    leaves = numbered(leaves, F.col("_order").asc_nulls_first(), F.col("digest")).select("tree", "pos", "n", "digest", "row")
    levels = grown(leaves)
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = grown(numbered(subroots, F.col("name")))
    end = upper[-1].select("tree", F.lit("").alias("subroot"), F.col("digest").alias("root"), F.array().cast(STEPS).alias("steps"))
    roots = witnessed(upper, end).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "steps")
    return witnessed(levels, staged(roots, "subroots")).select("row.*", F.col("digest").alias("leaf"), "subroot", "root", "steps")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*LEAF)
    return verified(docs)


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, and whether each leads to the root after texts of some ids are lower-cased."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(changed, leaf_digest(*[F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in LEAF]))
    done = manifest(docs, by="lang", order="doc_id", columns=LEAF, keep=[F.col("doc_id"), tampered.alias("tampered")])
    done = done.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    return done.select("doc_id", "leaf", "subroot", "root", sha256_text(siblings(F.col("steps"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEVELS = """{name} AS (SELECT tree, 0 AS lvl, row_number() OVER (PARTITION BY tree ORDER BY {order}) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, h FROM {source}
  UNION ALL SELECT tree, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 8, n),
{name}_steps AS (SELECT tree, lvl, idx, coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1)"""
_PART = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
_LEAF, _LOW = (" || ".join(_PART.format(c=t if c == "text" else c) for c in LEAF) for t in ("text", f"translate(text, '{UPPER}', '{LOWER}')"))
_CRC = "xor(list_reduce(flatten([[4294967295::BIGINT], flatten([[ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR b IN string_split(doc_id::VARCHAR, '')])]), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
OP13_SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_LEAF}) AS h, CASE WHEN {_CRC} % 3 = 0 THEN sha256({_LOW}) ELSE sha256({_LEAF}) END AS t FROM documents),
{_LEVELS.format(name="nodes", order="doc_id", source="leaves")},
subs AS (SELECT tree AS name, '' AS tree, h FROM nodes WHERE n = 1),
{_LEVELS.format(name="tops", order="name", source="subs")},
placed AS (SELECT doc_id, tree, h, t, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx FROM leaves),
walk AS (SELECT doc_id, tree, 0 AS lvl, idx, h AS leaf, t AS f, '' AS proof FROM placed
  UNION ALL SELECT doc_id, w.tree, w.lvl + 1, w.idx // 8, leaf, sha256(l || f || r), proof || l || r FROM walk w JOIN nodes_steps s ON w.tree = s.tree AND w.lvl = s.lvl AND w.idx = s.idx),
ended AS (SELECT doc_id, tree, leaf, f, proof FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1),
sub_at AS (SELECT name, h, row_number() OVER (ORDER BY name) - 1 AS idx FROM subs),
up AS (SELECT doc_id, 0 AS lvl, a.idx, leaf, a.h AS subroot, f, proof FROM ended JOIN sub_at a ON a.name = ended.tree
  UNION ALL SELECT doc_id, u.lvl + 1, u.idx // 8, leaf, subroot, sha256(l || f || r), proof || l || r FROM up u JOIN tops_steps s ON u.lvl = s.lvl AND u.idx = s.idx)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1), (SELECT h AS root FROM tops WHERE n = 1)"""
