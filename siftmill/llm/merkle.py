"""Merkle manifest of a table: a tree of sha256 for each group, a tree over their roots, and proofs of any set of leaves.

H is the lowercase hex sha256 of its inputs put together, digests as hex text. While more than one node is left, every two that follow
each other become their H; a last one alone becomes its own H. A lone leaf is its tree's root.

Leaves are dealt into parts of ``2 ** BITS`` places. A part gives all levels within it; what comes out at its top are the leaves of the next
round, so the rounds are ``log(n) / BITS``. Proofs are octopus multiproofs: a part computes the smallest set of nodes that its own leaves
cannot give (``missing_nodes``), fetches these once, derives the interiors that its proofs share, and writes out each leaf's proof. Nodes near the
root are asked for by every part: such a node is copied once for ``2 ** BITS`` parts, so no key of the fetch grows with the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, written
from .ordering import numbered

BITS = 9
#: Stands between the siblings of a path in one text.
_SEP = ","


def H(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


def _depth(n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def field(value: Column | str) -> Column:
    """``-`` for null, else the UTF-8 bytes of the value, a colon and the value."""
    value = F.col(value).cast("string") if isinstance(value, str) else value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*values: Column | str) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(column: str) -> Column:
    """A text without null whose byte order is that of the group, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def missing_nodes(places: Sequence[int] | np.ndarray, n: int) -> list[tuple[int, int]]:
    """(level, place) of the fewest nodes from which, with the leaves at ``places`` of ``n``, the root follows."""
    known, width, out = np.unique(np.asarray(places, np.int64)), n, []
    for level in range(depth(n)):
        other = known ^ 1
        out += [(level, int(i)) for i in other[(other < width) & ~np.isin(other, known)]]
        known, width = np.unique(known >> 1), (width + 1) // 2
    return out


def fold(leaf: str, steps: str, proof: Sequence[str]) -> str:
    """The root that follows from a leaf: ``steps`` has ``l`` or ``r`` for a level whose sibling stands left or right, ``-`` for none."""
    others = iter(proof)
    for step in steps:
        leaf = H({"l": lambda: next(others) + leaf, "r": lambda: leaf + next(others), "-": lambda: leaf}[step]())
    return leaf


def _levels(key: tuple, part: pa.Table, bits: int) -> pa.Table:
    """The nodes above a part's nodes, up to the part's top or the tree's."""
    part = part.sort_by("pos")
    tree, n, level, at = part["tree"][0].as_py(), part["n"][0].as_py(), part["level"][0].as_py(), part["pos"][0].as_py()
    row, out = part["digest"].to_pylist(), []
    for up in range(level + 1, min(level + bits, depth(n)) + 1):
        row, at = [H(row[i] + row[i + 1] if i + 1 < len(row) else row[i]) for i in range(0, len(row), 2)], at >> 1
        out += [(up, at + i, d) for i, d in enumerate(row)]
    levels, places, digests = zip(*out) if out else ((), (), ())
    return pa.table({"tree": pa.array([tree] * len(out), pa.string()), "n": pa.array([n] * len(out), pa.int64()), "level": pa.array(levels, pa.int32()), "pos": pa.array(places, pa.int64()), "digest": pa.array(digests, pa.string())})


_NODES = "tree string, n long, level int, pos long, digest string"


def forest(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """All nodes, leaves at level 0, of the trees of ``leaves`` (tree, n, pos, digest): (tree, n, level, pos, digest), written."""
    rows = leaves.select("tree", "n", F.lit(0).alias("level"), "pos", "digest")
    most, nodes, level = leaves.agg(F.max("n")).head()[0] or 0, rows, 0
    while level < depth(most or 1):
        above = written(rows.groupBy("tree", F.shiftright("pos", bits)).applyInArrow(lambda key, part: _levels(key, part, bits), _NODES), f"level{level}")
        nodes, level = nodes.unionByName(above), level + bits
        rows = above.where(F.col("level") == level)
    return nodes


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("level") == _depth(F.col("n"))).select("tree", "n", F.col("digest").alias("subroot"))


def _asked(key: tuple, part: pa.Table, bits: int) -> pa.Table:
    tree, n = part["tree"][0].as_py(), part["n"][0].as_py()
    found = missing_nodes(part["pos"].to_numpy(), n)
    own = part["pos"][0].as_py() >> bits
    levels, places = zip(*found) if found else ((), ())
    return pa.table({"tree": pa.array([tree] * len(found), pa.string()), "part": pa.array([own] * len(found), pa.int64()), "level": pa.array(levels, pa.int32()), "pos": pa.array(places, pa.int64())})


def _shares(level: Column, bits: int) -> Column:
    """How many copies a node has: parts that may ask for it, ``2 ** BITS`` to a copy."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(level - 2 * bits, F.lit(0)))


def _fetched(wanted: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, part, level, pos, digest) of the nodes that each part lacks."""
    asked = written(wanted.select("tree", "n", "pos").groupBy("tree", F.shiftright("pos", bits)).applyInArrow(lambda key, part: _asked(key, part, bits), "tree string, part long, level int, pos long"), "asked")
    least = asked.agg(F.min("level")).head()[0]
    offered = nodes.where(F.col("level") >= (least or 0)).select("tree", "level", "pos", "digest", F.explode(F.sequence(F.lit(0).cast("long"), _shares(F.col("level"), bits) - 1)).alias("share"))
    share = F.pmod(F.shiftright("part", bits), _shares(F.col("level"), bits))
    return asked.withColumn("share", share).join(offered, ["tree", "level", "pos", "share"]).select("tree", "part", "level", "pos", F.col("digest").alias("digest"))


_PROOFS = "id long, pos long, leaf string, offered string, subroot string, folded string, steps string, proof array<string>"


def _proved(key: tuple, leaves: pa.Table, found: pa.Table, bits: int) -> pa.Table:
    """Each leaf's proof from its part's leaves and fetched nodes, and the root that follows from what is offered in its place."""
    columns: list[list] = [[] for _ in range(8)]
    if leaves.num_rows:
        n, places = leaves["n"][0].as_py(), leaves["pos"].to_pylist()
        levels: list[dict[int, str]] = [{} for _ in range(depth(n) + 1)]
        tail_steps, tail = "", []
        for level, pos, digest in zip(*(found[c].to_pylist() for c in ("level", "pos", "digest"))):
            if level < 0:  # the way from the tree's root to the manifest's
                tail_steps, *tail = digest.split(_SEP)
            else:
                levels[level][pos] = digest
        digests = leaves["digest"].to_pylist()
        known = dict(zip(places, digests))
        for level in range(depth(n)):
            row = levels[level] = levels[level] | known
            known = {p: H(row[2 * p] + row.get(2 * p + 1, "")) for p in {i >> 1 for i in known}}
        subroot = known[0]
        kept: dict[tuple[int, str], str] = {}  # the way up from a digest at the part's top is the same for all its leaves
        for of, pos, digest, offered in zip(leaves["id"].to_pylist(), places, digests, leaves["offered"].to_pylist()):
            steps, proof = [], []
            for level in range(depth(n)):
                other = levels[level].get(pos >> level ^ 1)
                steps.append("-" if other is None else "l" if pos >> level & 1 else "r")
                proof += [] if other is None else [other]
            low = min(bits, depth(n))
            cut = low - steps[:low].count("-")
            top = (pos >> low, fold(offered, "".join(steps[:low]), proof))
            if top not in kept:
                kept[top] = fold(top[1], "".join(steps[low:]) + tail_steps, proof[cut:] + tail)
            for column, value in zip(columns, (of, pos, digest, offered, subroot, kept[top], "".join(steps) + tail_steps, proof + tail)):
                column.append(value)
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
    names = [c.split()[0] for c in _PROOFS.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _multiproofs(wanted: DataFrame, nodes: DataFrame, bits: int, tails: DataFrame | None = None) -> DataFrame:
    """Proofs of ``wanted`` (tree, n, pos, id, digest, offered) within their trees, and on by ``tails`` (tree, n, digest)."""
    found = _fetched(wanted, nodes, bits)
    if tails is not None:  # a tree's way to the top, once for each part
        parts = F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, bits))
        found = found.unionByName(tails.select("tree", F.explode(parts).alias("part"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("pos"), "digest"))
    return wanted.withColumn("part", F.shiftright("pos", bits)).groupBy("tree", "part").cogroup(found.groupBy("tree", "part")).applyInArrow(lambda key, leaves, nodes: _proved(key, leaves, nodes, bits), _PROOFS)


class Manifest:
    """The trees of a table.

    ``rows``: id (long), leaf (hex digest) and ``group``; ``offered`` may hold a digest to be checked in the leaf's place. In a group, leaves stand
    by id (null first), then by digest; equal rows are leaves of their own. Groups stand bytewise, null first. More columns are not used.
    Without rows there is no root and every result is empty.
    """

    def __init__(self, rows: DataFrame, id_column: str, group: str, leaf: str = "leaf", offered: str | None = None, bits: int = BITS):
        given = rows.select(group_key(group).alias("tree"), F.col(id_column).cast("long").alias("id"), F.col(leaf).alias("digest"), F.col(offered or leaf).alias("offered"))
        self.leaves = numbered(written(given, "leaves"), "tree", ["id", "digest"], "places")
        self.nodes = forest(self.leaves, bits)
        own = written(roots(self.nodes), "roots").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("leaves"), F.col("subroot").alias("digest"))
        self.trees = numbered(own, "tree", ["name"], "trees")
        self.top = forest(self.trees, bits)
        last = roots(self.top).head()
        self.root: str | None = last["subroot"] if last else None
        self.bits = bits

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """Proofs of the leaves ``wanted`` (rows of ``leaves``, all by default): id, pos, leaf, offered, subroot, folded (the root that follows from ``offered``), steps and proof (see ``fold``)."""
        trees = self.trees.withColumns({"id": F.col("pos"), "offered": F.col("digest")})
        ways = _multiproofs(trees, self.top, self.bits).select(F.col("id").alias("place"), F.concat_ws(_SEP, F.array(F.col("steps")), "proof").alias("digest"))
        tails = written(trees.select(F.col("name").alias("tree"), F.col("leaves").alias("n"), F.col("pos").alias("place")).join(ways, "place").drop("place"), "ways")
        return _multiproofs(self.leaves if wanted is None else wanted, self.nodes, self.bits, tails)


def dataset_manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, pos, steps) of every row, a tree for each language.

    Where 7 divides the crc32 of the decimal doc_id, the leaf offered to the proof is that of the row with 1 added to n_chars: it fails unless
    n_chars is null. Rows without doc_id come first and are never changed; repeated rows are leaves of their own, so they have different proofs.
    Null, empty and very long texts are hashed as they are; an empty table has no rows.
    """
    row = lambda n_chars: leaf_digest("doc_id", "source", "lang", n_chars, "text")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", row(F.col("n_chars").cast("long")).alias("leaf"), F.when(changed, row(F.col("n_chars").cast("long") + 1)).alias("changed"))
    manifest = Manifest(leaves.withColumn("offered", F.coalesce("changed", "leaf")), "doc_id", "lang", offered="offered", bits=bits)
    root = F.lit(manifest.root).cast("string")
    return manifest.proofs().select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"), "pos", "steps",
    )


_FIELDS = "concat(" + ", ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_SIBLINGS = """SELECT {at} AS k, list(struct_pack(level := n.level, d := n.d, left_of := n.pos < l.pos >> n.level) ORDER BY n.level) AS way, max(m.depth) AS depth
  FROM {leaves} l JOIN {depths} m USING (tree) LEFT JOIN {nodes} n ON n.tree = l.tree AND n.level < m.depth AND n.pos = xor(l.pos >> n.level, 1) GROUP BY 1"""
_TREES = """SELECT tree, 0 AS level, pos, d FROM {leaves}
  UNION ALL SELECT tree, level + 1, pos >> 1, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS width FROM {name}) WHERE width > 1 GROUP BY tree, level, pos >> 1"""
SQL = f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, sha256({_FIELDS.format(n="n_chars")}) AS d,
  CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN sha256({_FIELDS.format(n="n_chars + 1")}) END AS changed FROM documents),
nodes AS ({_TREES.format(leaves="leaves", name="nodes")}),
depths AS (SELECT tree, max(level) AS depth FROM nodes GROUP BY tree),
subroots AS (SELECT n.tree AS name, '' AS tree, row_number() OVER (ORDER BY n.tree) - 1 AS pos, n.d FROM nodes n JOIN depths m ON n.tree = m.tree AND n.level = m.depth),
top AS ({_TREES.format(leaves="subroots", name="top")}),
tops AS (SELECT '' AS tree, max(level) AS depth, max_by(d, level) AS root FROM top),
own AS ({_SIBLINGS.format(at="l.doc_id", leaves="leaves", depths="depths", nodes="nodes")}),
above AS ({_SIBLINGS.format(at="l.name", leaves="subroots", depths="tops", nodes="top")}),
ways AS (SELECT l.doc_id, l.d AS leaf, s.d AS subroot, t.root, coalesce(l.changed, l.d) AS offered, o.depth + a.depth AS depth,
  list_concat(list_filter(o.way, lambda x: x.d IS NOT NULL), list_transform(list_filter(a.way, lambda x: x.d IS NOT NULL), lambda x: struct_pack(level := x.level + o.depth, d := x.d, left_of := x.left_of))) AS way
  FROM leaves l JOIN own o ON o.k = l.doc_id JOIN subroots s ON s.name = l.tree JOIN above a ON a.k = l.tree, tops t),
folded AS (SELECT doc_id, 0 AS level, offered AS d FROM ways
  UNION ALL SELECT f.doc_id, f.level + 1, CASE WHEN len(x) = 0 THEN sha256(f.d) WHEN x[1].left_of THEN sha256(x[1].d || f.d) ELSE sha256(f.d || x[1].d) END
  FROM (SELECT f.*, list_filter(w.way, lambda y: y.level = f.level) AS x FROM folded f JOIN ways w USING (doc_id) WHERE f.level < w.depth) f)
SELECT w.doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda x: x.d), '')) AS proof_sha256, f.d AS folded_root, f.d = root AS verified, l.pos,
  array_to_string(list_transform(range(w.depth), lambda i: CASE WHEN len(list_filter(way, lambda x: x.level = i)) = 0 THEN '-' WHEN list_filter(way, lambda x: x.level = i)[1].left_of THEN 'l' ELSE 'r' END), '') AS steps
FROM ways w JOIN folded f ON f.doc_id = w.doc_id AND f.level = w.depth JOIN leaves l ON l.doc_id = w.doc_id"""
