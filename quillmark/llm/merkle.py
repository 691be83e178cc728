"""A Merkle tree over a dataset: a tree for each source, one over their roots, and a proof for each row.

Rows are numbered in their source by a distributed sort. Nodes are dealt into aligned blocks of FAN_OUT ** LEVELS; a task
walks its block's subtree recursively in postorder, which returns the subtree's digest and, on the way back, appends a
node's siblings to the proofs of the leaves below it. The digests of blocks are the leaves of the next distributed walk,
until a tree has one node. Proofs then go down the same blocks: a block gets what its own root has as siblings further up
once, and its walk prefixes the siblings inside; no row carries its proof through a shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import discard, documents, written
from quillmark.llm.ordering import CRC32, numbered

FAN_OUT, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PROOF = "array<struct<l: string, r: string>>"
_PROOF_TYPE = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth_of(n: int, fan_out: int) -> int:
    """Levels above n nodes until one is left."""
    depth = 0
    while n > 1:
        n, depth = -(-n // fan_out), depth + 1
    return depth


def walk(nodes: list[str], level: int, fan_out: int, proofs: list[list[tuple[str, str]]] | None = None) -> str:
    """The digest of the subtree of so many levels over nodes; each node's siblings, left and right, are appended to its proof."""

    def visit(lo: int, hi: int, level: int) -> str:
        if not level:
            return nodes[lo]
        step = fan_out ** (level - 1)
        spans = [(a, min(a + step, hi)) for a in range(lo, hi, step)]
        below = [visit(a, b, level - 1) for a, b in spans]
        if proofs is not None:
            for i, (a, b) in enumerate(spans):
                beside = ("".join(below[:i]), "".join(below[i + 1 :]))
                for leaf in range(a, b):
                    proofs[leaf].append(beside)
        return digest("".join(below))

    return visit(0, len(nodes), level)


def folded(leaf: str, proof: list[tuple[str, str]]) -> str:
    for left, right in proof:
        leaf = digest(left + leaf + right)
    return leaf


def leaf_digest(fields: dict[str, Column]) -> Column:
    """The digest of a row's fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = lambda c: c.cast("string")
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c))) for c in fields.values()]
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Tree:
    """One or more trees: nodes(tree, pos, n, digest, ..) of each level, the leaves first; a tree's last level has one node."""

    levels: list[DataFrame]
    fan_out: int
    reach: int

    def tops(self) -> DataFrame:
        return self.levels[-1]


def _ordered(part: pa.Table) -> pa.Table:
    return part.take(pa.array(np.argsort(part["pos"].to_numpy(), kind="stable")))


def grow(leaves: DataFrame, fan_out: int = FAN_OUT, reach: int = LEVELS, name: str = "merkle") -> Tree:
    """The trees over leaves(tree, pos, n, digest, ..): pos counts from 0 in each tree, n is the tree's number of leaves."""
    width = fan_out**reach

    def up(part: pa.Table) -> pa.Table:
        part = _ordered(part)
        n = part["n"][0].as_py()
        top = walk(part["digest"].to_pylist(), min(reach, depth_of(n, fan_out)), fan_out)
        return pa.table({"tree": part["tree"][:1], "pos": [part["pos"][0].as_py() // width], "n": [-(-n // width)], "digest": [top]})

    levels = [leaves]
    while not levels[-1].where("n > 1").isEmpty():
        nodes = levels[-1].select("tree", "pos", "n", "digest").withColumn("block", F.floor(F.col("pos") / width))
        levels.append(written(nodes.groupBy("tree", "block").applyInArrow(up, "tree string, pos long, n long, digest string"), f"{name}-nodes"))
    return Tree(levels, fan_out, reach)


def descend(tree: Tree, above: DataFrame, name: str = "merkle") -> DataFrame:
    """tree, block, upper, and above's other columns for each block of leaves: what a leaf's proof has after its own block.

    above(tree, upper, ..) has what follows a tree's root. Blocks of leaves without a level above are whole trees.
    """
    width, fan_out, reach = tree.fan_out**tree.reach, tree.fan_out, tree.reach
    more = [f for f in above.schema.fields if f.name not in ("tree", "upper")]
    down = above.withColumn("block", F.lit(0).cast("long"))
    schema = "tree string, block long, upper " + _PROOF + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)

    def spread_down(nodes: pa.Table, over: pa.Table) -> pa.Table:
        nodes = _ordered(nodes)
        n = nodes["n"][0].as_py()
        proofs: list[list[tuple[str, str]]] = [[] for _ in range(len(nodes))]
        walk(nodes["digest"].to_pylist(), min(reach, depth_of(n, fan_out)), fan_out, proofs)
        upper = [(p["l"], p["r"]) for p in over["upper"][0].as_py()]
        rest = {f.name: [over[f.name][0].as_py()] * len(nodes) for f in more}
        full = pa.array([[{"l": a, "r": b} for a, b in [*p, *upper]] for p in proofs], _PROOF_TYPE)
        return pa.table({"tree": nodes["tree"], "block": nodes["pos"], "upper": full} | rest)

    for nodes in reversed(tree.levels[1:-1]):
        blocked = nodes.withColumn("block", F.floor(F.col("pos") / width))
        down = written(blocked.groupBy("tree", "block").cogroup(down.groupBy("tree", "block")).applyInArrow(spread_down, schema), f"{name}-proofs")
    return down


def prove(tree: Tree, above: DataFrame, keep: list[str], claim: str | None = None, name: str = "merkle") -> DataFrame:
    """Of each leaf: the columns keep, digest, proof (its siblings), proof_sha256, folded_root and above's other columns.

    folded_root comes from the column claim, a digest that is held against the tree, or from the leaf's own digest where
    claim is null.
    """
    leaves, fan_out, reach = tree.levels[0], tree.fan_out, tree.reach
    width = fan_out**reach
    down = descend(tree, above, name)
    more = [f for f in above.schema.fields if f.name not in ("tree", "upper")]
    kept = [leaves.schema[c] for c in keep]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "digest string, proof_sha256 string, folded_root string", *[f"{f.name} {f.dataType.simpleString()}" for f in more]])

    def unwind(nodes: pa.Table, over: pa.Table) -> pa.Table:
        nodes = _ordered(nodes)
        n, own = nodes["n"][0].as_py(), nodes["digest"].to_pylist()
        proofs: list[list[tuple[str, str]]] = [[] for _ in own]
        walk(own, min(reach, depth_of(n, fan_out)), fan_out, proofs)
        upper = [(p["l"], p["r"]) for p in over["upper"][0].as_py()]
        tail = "".join(a + b for a, b in upper)
        shas = [digest("".join(a + b for a, b in p) + tail) for p in proofs]
        held = own if claim is None else [c or d for c, d in zip(nodes[claim].to_pylist(), own, strict=True)]
        roots = [folded(folded(h, p), upper) for h, p in zip(held, proofs, strict=True)]
        rest = {f.name: [over[f.name][0].as_py()] * len(own) for f in more}
        return pa.table({f.name: nodes[f.name] for f in kept} | {"digest": own, "proof_sha256": shas, "folded_root": roots} | rest)

    blocked = leaves.withColumn("block", F.floor(F.col("pos") / width))
    return blocked.groupBy("tree", "block").cogroup(down.groupBy("tree", "block")).applyInArrow(unwind, schema)


def dataset_leaves(docs: DataFrame, claim: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """tree, pos, n, digest, claim, doc_id and source of each row of docs, numbered in its source by doc_id.

    claim is an expression of docs that gives the text to hold against the tree, null where it is the row's own. Rows that
    share an id are ordered by their digest; a null id comes first and a null source is a tree of its own.
    """
    columns = {c: F.col(f"`{c}`") for c in fields}
    other = F.lit(None).cast("string") if claim is None else F.when(claim.isNotNull(), leaf_digest(columns | {"text": claim}))
    tree = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("n"))  # "n" is before all "s:"
    rows = docs.select(tree.alias("tree"), F.col("doc_id"), F.col("source"), leaf_digest(columns).alias("digest"), other.alias("claim"), F.monotonically_increasing_id().alias("tie"))
    hashed = written(rows, "merkle-leaves")
    placed = numbered(hashed, [F.asc("tree"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("tie")], "merkle-placed")
    firsts = placed.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    out = placed.join(firsts, "tree").select("tree", (F.col("place") - F.col("first")).alias("pos"), "n", "digest", "claim", "doc_id", "source")
    leaves = written(out, "merkle-numbered")
    discard(hashed)
    return leaves


def merkle_manifest(docs: DataFrame, claim: Column | None = None, fields: tuple[str, ...] = FIELDS, fan_out: int = FAN_OUT, reach: int = LEVELS) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs.

    verified says whether the row, with the text of claim where that isn't null, folds to the root by its siblings. Null
    fields are told from empty ones. Rows that repeat are leaves each. Ids are numbers or strings, ordered as such. An
    empty table gives no rows; columns that aren't fields play no part.
    """
    leaves = dataset_leaves(docs, claim, fields)
    trees = grow(leaves, fan_out, reach)
    tops = numbered(trees.tops().select("tree", "digest"), [F.asc("tree")], "merkle-tops")
    n = tops.count()
    over = written(tops.select(F.lit("").alias("tree"), F.col("place").alias("pos"), F.lit(n).cast("long").alias("n"), "digest", F.col("tree").alias("below")), "merkle-sources")
    whole = grow(over, fan_out, reach)
    root = whole.tops().select("tree", F.array().cast(_PROOF).alias("upper"), F.col("digest").alias("root"))
    subroots = _proofs_of_tops(whole, root)
    rows = prove(trees, subroots, ["doc_id", "source"], "claim" if claim is not None else None)
    return rows.select("doc_id", "source", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _proofs_of_tops(whole: Tree, root: DataFrame) -> DataFrame:
    """tree, upper, subroot, root for each source's tree: the siblings of its root in the tree over sources."""
    fan_out, reach, width = whole.fan_out, whole.reach, whole.fan_out**whole.reach
    down = descend(whole, root, "merkle-sources")

    def siblings(nodes: pa.Table, over: pa.Table) -> pa.Table:
        nodes = _ordered(nodes)
        n, own = nodes["n"][0].as_py(), nodes["digest"].to_pylist()
        proofs: list[list[tuple[str, str]]] = [[] for _ in own]
        walk(own, min(reach, depth_of(n, fan_out)), fan_out, proofs)
        upper = [(p["l"], p["r"]) for p in over["upper"][0].as_py()]
        full = pa.array([[{"l": a, "r": b} for a, b in [*p, *upper]] for p in proofs], _PROOF_TYPE)
        return pa.table({"tree": nodes["below"], "upper": full, "subroot": own, "root": [over["root"][0].as_py()] * len(own)})

    blocked = whole.levels[0].withColumn("block", F.floor(F.col("pos") / width))
    made = blocked.groupBy("tree", "block").cogroup(down.groupBy("tree", "block")).applyInArrow(siblings, f"tree string, upper {_PROOF}, subroot string, root string")
    return written(made, "merkle-subroots")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merkle_manifest of all documents, holding texts with A-Z lower-cased against it where 5 divides the id's CRC-32."""
    altered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.translate("text", _UPPER, _LOWER))
    rows = merkle_manifest(documents(spark, sf_dir), altered)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql_levels(name: str, source: str, depth: int) -> str:
    """CTEs of the levels of trees over source(tree, pos, d): each has d, its run's digests (ds), and n nodes in its tree."""
    out = []
    for k in range(depth + 1):
        below = f"SELECT tree, pos, d FROM {source}" if not k else f"SELECT DISTINCT tree, CASE WHEN n > 1 THEN pos // 16 ELSE pos END AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE d END AS d FROM {name}{k - 1}"
        out.append(f"{name}{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n, list(d ORDER BY pos) OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ds FROM ({below}))")
    return ",\n".join(out)


def _sql_climb(name: str, start: str, depth: int, prefix: str, keep: str) -> str:
    """CTEs that follow nodes of start(tree, pos, proof, cur, ..) up: siblings go to proof, cur is folded."""
    out = []
    for k in range(depth):
        left, right = "array_to_string(l.ds[:c.pos % 16], '')", "array_to_string(l.ds[c.pos % 16 + 2:], '')"
        out.append(
            f"{prefix}{k + 1} AS (SELECT c.tree, CASE WHEN l.n > 1 THEN c.pos // 16 ELSE c.pos END AS pos, {keep}, CASE WHEN l.n > 1 THEN c.proof || {left} || {right} ELSE c.proof END AS proof, "
            f"CASE WHEN l.n > 1 THEN sha256({left} || c.cur || {right}) ELSE c.cur END AS cur FROM {start if not k else f'{prefix}{k}'} c JOIN {name}{k} l ON c.tree = l.tree AND c.pos = l.pos)"
        )
    return ",\n".join(out)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('s:' || source, 'n') AS tree, sha256({_LEAF} || {_FIELD.format("text")}) AS d,
         sha256({_LEAF} || {_FIELD.format(f"CASE WHEN {CRC32.format(text='doc_id::VARCHAR')} % 5 = 0 THEN {_LOW} ELSE text END")}) AS claim
  FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, d) - 1 AS pos FROM leaves),
{_sql_levels("low", "placed", 5)},
tops AS (SELECT '' AS tree, tree AS below, row_number() OVER (ORDER BY tree) - 1 AS pos, d FROM low5),
{_sql_levels("high", "tops", 3)},
start AS (SELECT tree, pos, doc_id, d AS leaf, '' AS proof, claim AS cur FROM placed),
{_sql_climb("low", "start", 5, "climb", "c.doc_id, c.leaf")},
middle AS (SELECT '' AS tree, t.pos, c.doc_id, c.leaf, t.d AS subroot, c.proof, c.cur FROM climb5 c JOIN tops t ON c.tree = t.below),
{_sql_climb("high", "middle", 3, "top", "c.doc_id, c.leaf, c.subroot")}
SELECT doc_id, leaf, subroot, (SELECT d FROM high3) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT d FROM high3) AS verified FROM top3
"""
