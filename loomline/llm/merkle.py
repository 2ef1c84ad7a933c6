"""A Merkle manifest of a dataset, and proofs for any of its rows.

A row is a leaf, a digest of its columns. The leaves of a source, in the order of their ids, are the bottom of a tree in which every `arity`
consecutive nodes have one parent; the roots of the sources, in the order of their names, are the bottom of one more tree.

Trees are built a block at a time: `arity ** HEIGHT` consecutive nodes and all that stands on them are one group, so a round of grouping
climbs HEIGHT levels and a source of any size is spread over as many tasks as it has blocks. Proofs are octopus multiproofs: the wanted leaves of
a block are one leaf partition, which names the minimal union of nodes that it can neither hold nor derive, fetches them by one join, derives
the interiors that its leaves share, and expands each leaf's proof from them in place.

Defined results: null columns are `-`; a null source is a tree of its own, first; rows without an id come first in their source and
are proven like any other; rows that repeat an id are in the order of their leaves, and rows alike in all columns have leaves alike; an empty table
has no node, no root and no proof; texts of any length are hashed whole; columns that the manifest isn't told of take no part.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import pin, release

ARITY = 3
#: Levels that one group climbs: a block is ARITY ** HEIGHT nodes, 2,187.
HEIGHT = 7
#: The tree of the sources' roots.
TOP = ""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, level int, index long, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each with its length in bytes before it, so that no two rows run into one."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def tree_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with `index`, a row's place in its `tree` in this order, and `size`, the tree's rows. Ranges of the order are sorted apart; what a
    range holds of a tree is counted, and the counts of earlier ranges are added."""
    ranges = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    placed = pin(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    runs = placed.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("tree")
    runs = runs.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size"))
    found = placed.join(runs, ["tree", "_part"]).withColumn("index", F.col("_row") - F.col("_first") + F.col("_before"))
    out = pin(found.drop("_part", "_row", "_first", "_before"), name)
    release(placed)
    return out


def level_sizes(size: int, arity: int) -> list[int]:
    """The nodes of each level of a tree, from its leaves to its root."""
    sizes = [size]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def _climb(arity: int, height: int):
    def climb(block: pd.DataFrame) -> pd.DataFrame:
        tree, level, size = block["tree"].iloc[0], int(block["level"].iloc[0]), int(block["size"].iloc[0])
        nodes = dict(zip(block["index"].tolist(), block["digest"].tolist()))
        out = []
        for up, n in enumerate(level_sizes(size, arity)[1 : height + 1], 1):
            runs: dict[int, list[str]] = {}
            for i in sorted(nodes):
                runs.setdefault(i // arity, []).append(nodes[i])
            nodes = {i: digest("".join(run)) for i, run in runs.items()}
            out += [(tree, level + up, i, d, n) for i, d in nodes.items()]
        return pd.DataFrame(out, columns=["tree", "level", "index", "digest", "size"])

    return climb


def interiors(leaves: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """All nodes above `leaves` (tree, index, digest, size), and the trees' roots (tree, digest)."""
    block = F.floor(F.col("index") / F.lit(arity**height)).alias("block")
    current = leaves.select("tree", F.lit(0).alias("level"), "index", "digest", "size")
    built, roots = [], []
    while True:
        roots.append(current.where("size = 1").select("tree", "digest"))
        if current.where("size > 1").isEmpty():
            break
        made = pin(current.where("size > 1").groupBy("tree", block).applyInPandas(_climb(arity, height), f"{NODE}, size long"), "nodes")
        built.append(made.drop("size"))
        climbed = F.when(F.col("size") > 1, F.col("level") % height == 0).otherwise(F.lit(True))
        current = made.where(climbed)
    nodes = built[0] if built else leaves.select("tree", F.lit(0).alias("level"), "index", "digest").where("false")
    for more in built[1:]:
        nodes = nodes.unionByName(more)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return nodes, found


class Manifest:
    """leaves: (tree, index, digest, size, and the columns kept); nodes: (tree, level, index, digest), leaves included; roots: (tree, digest, and
    `at`, its place among the `trees` sources); root: the digest of all, None of an empty table."""

    def __init__(self, leaves, nodes, roots, root, arity, height):
        self.leaves, self.nodes, self.roots, self.root, self.arity, self.height = leaves, nodes, roots, root, arity, height


def manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", source_col: str = "source", keep: dict[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT) -> Manifest:
    """The manifest of all rows; `keep` names columns that go along with the leaves."""
    base = docs.select(
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.col(f"`{id_col}`").alias("doc_id"),
        leaf_digest([F.col(f"`{c}`") for c in fields]).alias("digest"),
        *[c.alias(k) for k, c in (keep or {}).items()],
    ).withColumn("tree", tree_of(F.col("source")))
    leaves = numbered(base, ["source", "doc_id", "digest"], "leaves")
    below, roots = interiors(leaves, arity, height)
    # the sources' roots are leaves themselves, in the order of the sources
    named = roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30)).alias("source"), "digest")
    tops = numbered(named, ["source"], "roots")
    above, top = interiors(tops, arity, height)
    found = top.collect()  # one row, or none of an empty table
    nodes = below
    for more in (leaves.select("tree", F.lit(0).alias("level"), "index", "digest"), above, tops.select("tree", F.lit(0).alias("level"), "index", "digest")):
        nodes = nodes.unionByName(more)
    placed = tops.select(F.col("of").alias("tree"), "digest", F.col("index").alias("at"), F.col("size").alias("trees"))
    return Manifest(leaves, nodes, placed, found[0]["digest"] if found else None, arity, height)


def missing(tree: str, size: int, at: int, trees: int, wanted: list[int], arity: int) -> list[tuple[str, int, int]]:
    """The fewest nodes (tree, level, index) that, with the wanted leaves, give every interior on their way to the root."""
    out, known = [], set(wanted)
    for name, n, start in ((tree, size, None), (TOP, trees, {at})):
        known = start or known
        for level, n_level in enumerate(level_sizes(n, arity)[:-1]):
            runs = {i // arity for i in known}
            out += [(name, level, i) for r in runs for i in range(r * arity, min((r + 1) * arity, n_level)) if i not in known]
            known = runs
    return sorted(out)


def _requests(arity: int):
    def requests(block: pd.DataFrame) -> pd.DataFrame:
        x = block.iloc[0]
        found = missing(x["tree"], int(x["size"]), int(x["at"]), int(x["trees"]), block["index"].tolist(), arity)
        return pd.DataFrame([(x["tree"], int(x["block"]), *f) for f in found], columns=["of", "block", "tree", "level", "index"])

    return requests


def _expanded(arity: int, kept: list[str]):
    def expand(key, wanted: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        names = [*kept, "leaf", "subroot", "root", "siblings", "before"]
        if wanted.empty:
            return pd.DataFrame(columns=names)
        x = wanted.iloc[0]
        tree, sizes, top_sizes, at = x["tree"], level_sizes(int(x["size"]), arity), level_sizes(int(x["trees"]), arity), int(x["at"])
        nodes = dict(zip(zip(fetched["tree"], fetched["level"].tolist(), fetched["index"].tolist()), fetched["digest"]))
        for i, d in zip(wanted["index"].tolist(), wanted["digest"]):
            nodes[tree, 0, i] = d
        # interiors that the leaves share, each derived once
        known = set(wanted["index"].tolist())
        for name, own_sizes, start in ((tree, sizes, known), (TOP, top_sizes, {at})):
            known = start
            if name == TOP:
                nodes[TOP, 0, at] = nodes[tree, len(sizes) - 1, 0]
            for level, n in enumerate(own_sizes[:-1]):
                known = {i // arity for i in known}
                for r in known:
                    nodes[name, level + 1, r] = digest("".join(nodes[name, level, i] for i in range(r * arity, min((r + 1) * arity, n))))
        root = nodes[TOP, len(top_sizes) - 1, 0]
        out = []
        for i in wanted["index"].tolist():
            siblings, before = [], []
            for name, own_sizes, place in ((tree, sizes, i), (TOP, top_sizes, at)):
                for level, n in enumerate(own_sizes[:-1]):
                    run = range(place // arity * arity, min((place // arity + 1) * arity, n))
                    siblings.append([nodes[name, level, j] for j in run if j != place])
                    before.append(place - run.start)
                    place //= arity
            out.append((nodes[tree, 0, i], nodes[tree, len(sizes) - 1, 0], root, siblings, before))
        return pd.concat([wanted[kept].reset_index(drop=True), pd.DataFrame(out, columns=names[len(kept) :])], axis=1)

    return expand


def proofs(of: Manifest, wanted: DataFrame, kept: list[str]) -> DataFrame:
    """A row per wanted leaf, rows of `of.leaves`: the columns kept, leaf, subroot, root, and its proof: the siblings of each level, and how many of
    them stand before it. A leaf partition is what is wanted of one block, at most `arity ** height` leaves."""
    block = F.floor(F.col("index") / F.lit(of.arity**of.height)).alias("block")
    leaves = wanted.join(of.roots.drop("digest"), "tree").withColumn("block", block)
    needs = leaves.select("tree", "index", "size", "at", "trees", "block").groupBy("tree", "block").applyInPandas(
        _requests(of.arity), "of string, block long, tree string, level int, index long"
    )
    fetched = needs.join(of.nodes, ["tree", "level", "index"]).groupBy("of", "block")
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "leaf string, subroot string, root string, siblings array<array<string>>, before array<int>"])
    return leaves.groupBy("tree", "block").cogroup(fetched).applyInPandas(_expanded(of.arity, kept), schema)


def folded(leaf: Column, siblings: Column, before: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    level = F.arrays_zip(siblings.alias("siblings"), before.alias("before"))
    up = lambda own, x: F.sha2(F.concat(F.array_join(F.slice(x["siblings"], F.lit(1), x["before"]), ""), own, F.array_join(F.slice(x["siblings"], x["before"] + 1, F.size(x["siblings"])), "")), 256)
    return F.aggregate(level, leaf, up)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's leaf and proof, held against a text that lost its line ends where its id says so."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampers = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampers, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    given = leaf_digest([text if c == "text" else F.col(c) for c in FIELDS])
    made = manifest(docs, keep={"given": given})
    proven = proofs(made, made.leaves, ["doc_id", "given"])
    shown = proven.withColumn("folded_root", folded(F.col("given"), F.col("siblings"), F.col("before")))
    return shown.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(F.flatten("siblings"), ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


OP12_SQL = """
WITH RECURSIVE
said AS (
  SELECT doc_id, source, text,
         list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
             lambda c: list_concat([ascii(c)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) & 1 AS odd,
         coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
           || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head
  FROM documents),
leafed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END AS shown, head FROM said),
leaves AS (
  SELECT doc_id, source, leaf, sha256(head || coalesce(strlen(shown)::VARCHAR || ':' || shown, '-')) AS given,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n
  FROM leafed),
low AS (
  SELECT source, 0 AS level, i, n, leaf AS d FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY source, level, i // 3, n),
tops AS (SELECT source, level AS height, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, i, n, subroot AS d FROM tops
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 3, n),
path AS (
  SELECT source, i AS leaf_i, i, 0 AS level, n FROM leaves
  UNION ALL
  SELECT source, leaf_i, i // 3, level + 1, (n + 2) // 3 FROM path WHERE n > 1),
top_path AS (
  SELECT source, i, 0 AS level, n FROM tops
  UNION ALL
  SELECT source, i // 3, level + 1, (n + 2) // 3 FROM top_path WHERE n > 1),
steps AS (
  SELECT p.source, p.leaf_i, p.level, coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (x.i < p.i), '') AS before,
         coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (x.i > p.i), '') AS after
  FROM path p JOIN low x ON p.source IS NOT DISTINCT FROM x.source AND p.level = x.level AND p.i // 3 = x.i // 3
  WHERE p.n > 1 GROUP BY ALL),
top_steps AS (
  SELECT p.source, p.level, coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (x.i < p.i), '') AS before,
         coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (x.i > p.i), '') AS after
  FROM top_path p JOIN high x ON p.level = x.level AND p.i // 3 = x.i // 3
  WHERE p.n > 1 GROUP BY ALL),
every AS (
  SELECT source, leaf_i, level, before, after FROM steps
  UNION ALL
  SELECT l.source, l.i, t.height + s.level, s.before, s.after
  FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source JOIN top_steps s ON l.source IS NOT DISTINCT FROM s.source),
fold AS (
  SELECT source, i AS leaf_i, 0 AS level, given AS d FROM leaves
  UNION ALL
  SELECT f.source, f.leaf_i, f.level + 1, sha256(e.before || f.d || e.after)
  FROM fold f JOIN every e ON f.source IS NOT DISTINCT FROM e.source AND f.leaf_i = e.leaf_i AND f.level = e.level),
last AS (SELECT source, leaf_i, arg_max(d, level) AS folded_root FROM fold GROUP BY ALL),
proof AS (SELECT source, leaf_i, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM every GROUP BY ALL)
SELECT l.doc_id, l.leaf, t.subroot, r.d AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.d AS verified
FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source
JOIN last f ON l.source IS NOT DISTINCT FROM f.source AND l.i = f.leaf_i
LEFT JOIN proof p ON l.source IS NOT DISTINCT FROM p.source AND l.i = p.leaf_i
CROSS JOIN (SELECT d FROM high WHERE n = 1) r
"""
