"""Merkle manifest of a dataset that stores only every third level and regenerates the rest for proofs.

Rows become leaves, leaves of one tree (say a language) are hashed in runs of eight until one node is left, its subroot, and the
subroots are the leaves of a last tree with the root. Stored are the leaves and every third level above them, so a stored
node stands for an aligned subtree of 512 stored nodes below it. A proof needs siblings from all levels: each subtree is read
as one row of at most 512 digests, its two missing levels are computed again, every node takes its siblings from them and
the proof of the stored node above, and the regenerated levels are gone with the row.

Digests are lower-case hex SHA-256, and what is hashed are concatenated hex digests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelake.llm.common import stored

FAN, STEP = 8, 3  # children of a node, levels between stored ones
SPAN = FAN**STEP


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: each value as its length in UTF-8 bytes, a colon and its text, or ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    fields = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*fields), 256)


def parent(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def fold(node: Column, proof: Column) -> Column:
    """Root that a leaf and the siblings of its way up lead to."""
    return F.aggregate(
        proof, node, lambda h, s: parent(F.concat(F.slice(s.others, F.lit(1), s.at), F.array(h), F.slice(s.others, s.at + 1, F.lit(FAN))))
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place``, from 0 without gaps in each ``tree`` along ``order`` (nulls first), and ``size``, the rows of the tree.

    Rows are laid out by range, so no tree is sorted in one task however large it is; what runs over a tree as a whole is one count
    per task. Rows that are equal in ``order`` are told apart by their place in the input and may be split as well.
    """
    by = [F.col(c).asc_nulls_first() for c in ["tree", *order, "__row"]]
    laid = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__row")
    laid = stored(laid.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = laid.groupBy("tree", "__part").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select("tree", "__part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")))
    return laid.join(counts, ["tree", "__part"]).withColumn("place", F.col("__at") + F.col("shift")).drop("__part", "__at", "shift")


def _subtrees(nodes: DataFrame, *carried: str) -> DataFrame:
    """One row per aligned subtree of nodes (tree, place, digest, size): the stored ``nodes`` in order, the levels ``l0`` to ``l3`` that
    are computed from them, and ``s0`` to ``s3``, the nodes that the whole tree has there. A level of one node is its own parent level."""
    group = F.floor(F.col("place") / SPAN).alias("above")
    rows = nodes.groupBy("tree", group).agg(F.sort_array(F.collect_list(F.struct("place", "digest", *carried))).alias("nodes"), F.max("size").alias("s0"))
    rows = rows.withColumn("l0", F.transform("nodes", lambda x: x.digest))
    for i in range(STEP):
        below, size = F.col(f"l{i}"), F.col(f"s{i}")
        runs = F.sequence(F.lit(0), F.ceil(F.size(below) / FAN).cast("int") - 1)
        up = F.transform(runs, lambda r: parent(F.slice(below, r * FAN + 1, F.lit(FAN))))
        rows = rows.withColumns({f"l{i + 1}": F.when(size > 1, up).otherwise(below), f"s{i + 1}": F.floor((size + FAN - 1) / FAN).cast("long")})
    return rows


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The stored levels (tree, place, digest, size) above the given one, which comes first; the last has one node in each tree."""
    found = [nodes]
    while (found[-1].agg(F.max("size")).first()[0] or 1) > 1:
        rows = _subtrees(found[-1].select("tree", "place", "digest", "size"))
        found.append(stored(rows.select("tree", F.col("above").alias("place"), F.element_at(f"l{STEP}", 1).alias("digest"), F.col(f"s{STEP}").alias("size"))))
    return found


def _proofs(nodes: DataFrame, above: DataFrame, *carried: str) -> DataFrame:
    """Nodes with ``proof`` and the columns of ``above`` (tree, place, proof, further ones), which is the stored level above."""
    further = [c for c in above.columns if c not in ("tree", "place", "proof")]
    rows = _subtrees(nodes, *carried).join(above.withColumnRenamed("place", "above"), ["tree", "above"])
    none = F.array().cast(above.schema["proof"].dataType)

    def step(i: int, at: Column) -> Column:
        at = F.floor(at / FAN**i).cast("int")
        run = F.slice(F.col(f"l{i}"), F.floor(at / FAN).cast("int") * FAN + 1, F.lit(FAN))
        at = at % FAN
        others = F.concat(F.slice(run, F.lit(1), at), F.slice(run, at + 2, F.lit(FAN)))
        return F.when(F.col(f"s{i}") > 1, F.array(F.struct(at.alias("at"), others.alias("others")))).otherwise(none)

    full = F.transform("nodes", lambda x, at: F.struct(x.alias("node"), F.concat(*[step(i, at) for i in range(STEP)], F.col("proof")).alias("proof")))
    out = rows.select("tree", *further, F.explode(full).alias("n"))
    return out.select("tree", "n.node.place", "n.node.digest", *[F.col(f"n.node.{c}") for c in carried], "n.proof", *further)


PROOF = "array<struct<at: int, others: array<string>>>"


def manifest(docs: DataFrame, columns: list[str], tree: str, order: str, **carry: Column) -> dict[str, list[DataFrame]]:
    """Stored levels of the trees of ``docs``, one per value of ``tree``, and of the tree over their subroots.

    Leaves hash ``columns`` in their order and lie along ``order``; rows equal there lie by their digests, so repeated rows are
    leaves of their own, and which of them is which makes no difference. Nulls in any column are values (a null tree is a tree, the
    first one; null order values lie first). Texts of any length are one value; they are hashed where they are read and never
    shuffled. No rows give no root. Further columns of ``docs`` take no part and may have any name; ``carry`` are columns computed
    from ``docs`` that stay with the leaves (in the struct ``carried``).
    """
    # Null comes first: "-" sorts before "=".
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))
    carried = F.struct(F.col(tree).alias("tree"), F.col(order).alias("key"), *[c.alias(n) for n, c in carry.items()])
    # Laying out by range reads its input twice, so the texts are hashed before.
    leaves = stored(docs.select(name.alias("tree"), F.col(order).alias("order"), leaf([F.col(c) for c in columns]).alias("digest"), carried.alias("carried")))
    low = levels(placed(leaves, ["order", "digest"]).select("tree", "place", "digest", "size", "carried"))
    tops = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    return {"leaves": low, "subroots": levels(placed(tops, ["name"]).select("tree", "place", "digest", "size", "name"))}


def proofs(found: dict[str, list[DataFrame]]) -> DataFrame:
    """(carried, leaf, subroot, root, proof) of every leaf. ``proof`` lists the levels where the node has a run of its own, from the
    leaf to the root: ``at``, its place in the run, and ``others``, the digests of the others in order."""
    def down(chain: list[DataFrame], above: DataFrame, *carried: str) -> DataFrame:
        for i, nodes in reversed(list(enumerate(chain[:-1]))):
            above = _proofs(nodes, above.drop("digest"), *(carried if i == 0 else ()))
        return above

    top = found["subroots"]
    empty = F.array().cast(PROOF).alias("proof")
    above = down(top, top[-1].select("tree", "place", "digest", *(["name"] if len(top) == 1 else []), empty, F.col("digest").alias("root")), "name")
    tops = above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("subroot"), "root", "proof")
    low = found["leaves"]
    if len(low) == 1:
        out = low[0].join(tops.drop("place"), "tree")
    else:
        out = down(low, tops, "carried")
    return out.select("carried", F.col("digest").alias("leaf"), "subroot", "root", "proof")


def siblings(proof: Column) -> Column:
    """All digests of a proof in order, as one text."""
    return F.array_join(F.flatten(F.transform(proof, lambda s: s.others)), "")


def lowered(text: Column) -> Column:
    """A to Z lower-cased, nothing else."""
    upper = "".join(chr(c) for c in range(65, 91))
    return F.translate(text, upper, upper.lower())


def sql(docs: str, columns: list[str], tree: str, order: str, tampered: str, depth: int = 8, top_depth: int = 4) -> str:
    """DuckDB SQL for the digests of a table's leaves, with ``tampered`` (condition) rows checked with a lower-cased ``text``. It has
    levels for 8^depth leaves of a tree and 8^top_depth trees."""
    def hashed(text: str) -> str:
        fields = [text if c == "text" else c for c in columns]
        return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in fields) + ")"

    def chain(name: str, nodes: str, high: int) -> list[str]:
        parts = [f"{name}0 AS ({nodes})"]
        for k in range(high):
            run = f"list(h ORDER BY i) OVER (PARTITION BY t, i // {FAN} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            parts.append(f"{name}r{k} AS (SELECT *, {run} AS run, CAST(i % {FAN} AS INTEGER) AS pos, count(*) OVER (PARTITION BY t) AS n FROM {name}{k})")
            parts.append(f"""{name}s{k} AS (SELECT t, i, n > 1 AS up, CASE WHEN n > 1 THEN array_to_string(run[1:pos], '') ELSE '' END AS a,
                CASE WHEN n > 1 THEN array_to_string(run[pos + 2:], '') ELSE '' END AS b FROM {name}r{k})""")
            parts.append(f"""{name}{k + 1} AS (SELECT t, i // {FAN} AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h
                FROM {name}r{k} GROUP BY t, i // {FAN})""")
        return parts

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d AS (SELECT {order} AS k, coalesce('=' || {tree}, '-') AS t, {hashed('text')} AS h, CASE WHEN {tampered} THEN {hashed(lower)} END AS bad FROM {docs})",
        "p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY k NULLS FIRST, h) - 1 AS i FROM d)",
        *chain("a", "SELECT t, i, h FROM p", depth),
        *chain("b", f"SELECT 0 AS t, row_number() OVER (ORDER BY encode(t)) - 1 AS i, h FROM a{depth}", top_depth),
        f"tops AS (SELECT t, row_number() OVER (ORDER BY encode(t)) - 1 AS j, h AS subroot FROM a{depth})",
        "f0 AS (SELECT p.*, j, subroot, coalesce(bad, h) AS f, '' AS proof FROM p JOIN tops USING (t))",
    ]
    steps = [("a", k, f"s.t = f.t AND s.i = f.i // {FAN**k}") for k in range(depth)] + [("b", k, f"s.i = f.j // {FAN**k}") for k in range(top_depth)]
    for n, (name, k, on) in enumerate(steps):
        parts.append(f"""f{n + 1} AS (SELECT f.* REPLACE (CASE WHEN s.up THEN sha256(s.a || f.f || s.b) ELSE f.f END AS f, f.proof || s.a || s.b AS proof)
            FROM f{n} f JOIN {name}s{k} s ON {on})""")
    return "WITH " + ",\n".join(parts) + f"""
        SELECT k AS {order}, h AS leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
        FROM f{len(steps)}, (SELECT h AS root FROM b{top_depth})"""
