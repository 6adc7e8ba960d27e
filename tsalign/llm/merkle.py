"""Merkle manifest of a dataset: leaf digests, a tree for each source, one root, and an inclusion proof for every row.

A row's leaf is the digest of its fields. Inside a source the leaves ascend by
id; runs of ``FAN`` consecutive nodes are hashed into one until one is left, the
subroot. The subroots, ordered by source, form the tree of the root in the same
way.

1. Leaves are digested where the texts are read; only digests move from there on.
   A leaf's rank comes from one range shuffle, so a source with a third of all
   rows spreads like any others.
2. The digits of the rank (base ``FAN``) are columns. ``DIGITS`` of them are
   grouped away one after the other inside blocks of ``FAN ** DIGITS`` ranks, each
   time nesting the children's structs in their parent's: one shuffle by block,
   three aggregations on it, at most 4,096 leaves in a row.
3. Block roots are the nodes of the next round, and so on up to the root, whose
   way down meets the blocks by grouping the union of both.
4. Exploding the nested structs level by level gives every leaf the runs it lies
   in, from which a projection folds its root. Nothing is joined.

Defined results: NULL in any field is part of the leaf; a NULL source is a source,
before all others; rows with a NULL id come before all others of their source and
are never tampered with; rows that repeat an id are leaves each, ordered by leaf;
equal rows have equal leaves but their own places and proofs; empty and very
long texts are digested whole; other columns are ignored, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsalign.operators.chunk import row_index
from tsalign.operators.durable import durable

#: Children of a node, and levels that one block holds.
FAN, DIGITS = 16, 3
#: Columns of a row that its leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<pos: int, run: array<string>>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over the fields: ``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tampered_text(row_id: Column, text: Column) -> Column:
    """The text a tamperer leaves: every fifth id by checksum loses its capitals A-Z."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(row_id.cast("string")) % 5 == 0, lowered).otherwise(text)


def _levels(n: Column) -> Column:
    """Times that ``n`` nodes must be grouped until one is left."""
    powers = F.array(*[F.lit(FAN**k) for k in range(15)])
    return F.size(F.filter(powers, lambda p: p < n))


def _run_digest(run: Column) -> Column:
    return F.sha2(F.array_join(run, ""), 256)


def _rolled(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of ``nodes`` (``keys, idx, deep, hash, own``): ``keys, block, deep, hash, kids``.

    ``kids`` nests the block's nodes ``DIGITS`` levels deep. A level above the top
    of its tree holds one node and passes it on unchanged.
    """
    digits = [F.floor(F.col("idx") / FAN**k).cast("long") % FAN for k in range(DIGITS)]
    rows = nodes.select(
        *keys,
        F.floor(F.col("idx") / FAN**DIGITS).cast("long").alias("block"),
        "deep",
        *[d.cast("int").alias(f"d{k}") for k, d in enumerate(digits)],
        "hash",
        F.col("own").alias("kids"),
    )
    rows = rows.repartition(*[F.col(k) for k in keys], F.col("block"))
    for level in range(DIGITS):
        rest = [f"d{k}" for k in range(level + 1, DIGITS)]
        child = F.struct(F.col(f"d{level}").alias("pos"), "hash", "kids")
        rows = rows.groupBy(*keys, "block", "deep", *rest).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        joined = _run_digest(F.col("kids.hash"))
        rows = rows.withColumn("hash", F.when(F.col("deep") > level, joined).otherwise(F.col("kids")[0]["hash"]))
    return rows


def _unrolled(blocks: DataFrame, keys: Sequence[str], tops: Sequence[str]) -> DataFrame:
    """Every node of the blocks with its path: ``keys, idx, own, path, tops``; ``up`` is the path of the block's root."""
    rows = blocks.select(*keys, F.col("block").alias("idx"), "deep", "kids", F.col("up").alias("path"), *tops)
    for level in reversed(range(DIGITS)):
        runs = rows.withColumn("run", F.col("kids.hash"))
        child = runs.select(*keys, "idx", "deep", "run", "path", *tops, F.explode("kids").alias("kid"))
        step = F.array(F.struct(F.col("kid.pos").alias("pos"), "run"))
        path = F.when(F.col("deep") > level, F.concat(step, "path")).otherwise(F.col("path"))
        rows = child.select(
            *keys, (F.col("idx") * FAN + F.col("kid.pos")).alias("idx"), "deep", F.col("kid.kids").alias("kids"), path.alias("path"), *tops
        )
    return rows.withColumnRenamed("kids", "own")


def paths(
    nodes: DataFrame, keys: Sequence[str], deepest: int, above: Callable[[DataFrame], DataFrame], tops: Sequence[str]
) -> DataFrame:
    """Every node (``keys, idx, deep, hash, own``) with the runs on its way up: ``keys, idx, own, path, tops``.

    ``deep`` is the number of levels of the node's tree and ``deepest`` the
    greatest of them. ``above`` takes the top node of each tree (``keys, block,
    hash``) and returns its own way up (``keys, block, up, tops``).
    """
    blocks = durable(_rolled(nodes, keys), "blocks")
    ends = blocks.select(*keys, "block", "deep", "hash")
    if deepest > DIGITS:
        upper = ends.select(*keys, F.col("block").alias("idx"), F.greatest(F.col("deep") - DIGITS, F.lit(0)).alias("deep"), "hash", F.lit(None).cast("int").alias("own"))
        higher = paths(upper, keys, deepest - DIGITS, above, tops)
        higher = higher.select(*keys, F.col("idx").alias("block"), F.col("path").alias("up"), *tops)
    else:
        higher = above(ends)
    both = blocks.drop("hash").unionByName(higher, allowMissingColumns=True)
    met = both.groupBy(*keys, "block").agg(*[F.first(c, True).alias(c) for c in ("deep", "kids", "up", *tops)])
    return _unrolled(met, keys, tops)


def _root(ends: DataFrame) -> DataFrame:
    """The way up ends here."""
    return ends.select("block", F.array().cast(_PATH).alias("up"), F.col("hash").alias("root"))


def _source_tree(ends: DataFrame) -> DataFrame:
    """The way of every subroot to the root."""
    nodes = row_index(ends.select("source", F.struct("source", F.col("hash").alias("subroot")).alias("own"), "hash"), [], ["source"], "idx", total="n")
    nodes = durable(nodes.withColumn("deep", _levels(F.col("n"))), "sources")
    deepest = nodes.agg(F.max("deep")).first()[0] or 0
    way = paths(nodes, [], deepest, _root, ["root"])
    return way.select("own.source", F.lit(0).cast("long").alias("block"), F.col("path").alias("up"), "own.subroot", "root")


def proofs(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, source, leaf, tampered, path, subroot, root`` for each row.

    ``tampered`` is the leaf of the row as the tamperer leaves it; ``path`` holds,
    from the leaf up, the row's place in each run and the run's digests.
    """
    text = tampered_text(F.col(id_col), F.col(text_col))
    leaves = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        leaf_digest(*[F.col(c) for c in fields]).alias("hash"),
        leaf_digest(*[text if c == text_col else F.col(c) for c in fields]).alias("tampered"),
    )
    leaves = durable(leaves, "leaves")
    nodes = row_index(leaves, ["source"], ["doc_id", "hash"], "idx", total="n")
    nodes = nodes.select("source", "idx", _levels(F.col("n")).alias("deep"), "hash", F.struct("doc_id", F.col("hash").alias("leaf"), "tampered").alias("own"))
    deepest = leaves.groupBy("source").count().agg(F.max(_levels(F.col("count")))).first()[0] or 0
    way = paths(nodes, ["source"], deepest, _source_tree, ["subroot", "root"])
    return way.select("own.doc_id", "source", "own.leaf", "own.tampered", "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the other digests of its runs give."""
    def step(node, level):
        return _run_digest(F.transform(level["run"], lambda x, i: F.when(i == level["pos"], node).otherwise(x)))

    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame, **columns) -> DataFrame:
    """Per row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``proof_sha256`` is the digest of all siblings, from the leaf's run up and left
    to right; ``folded_root`` comes from the row's tampered leaf and its siblings.
    """
    siblings = F.transform("path", lambda s: F.array_join(F.filter(s["run"], lambda x, i: i != s["pos"]), ""))
    rows = proofs(docs, **columns).select(
        "doc_id", "leaf", "subroot", "root", _run_digest(siblings).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(source_levels: int = 6, root_levels: int = 4) -> str:
    """The same in SQL, for sources of at most ``FAN ** source_levels`` rows and at most ``FAN ** root_levels`` sources."""
    def leaf(text: str) -> str:
        values = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, key: str, start: str, levels: int) -> tuple[str, str]:
        """Tables of the runs of each level, and of the tops."""
        out, node = [], start
        for k in range(1, levels + 1):
            out.append(
                f"{name}{k} AS (SELECT {key}, n, idx // {FAN} AS idx, list(hash ORDER BY idx) AS run, "
                f"CASE WHEN n > {FAN ** (k - 1)} THEN sha256(string_agg(hash, '' ORDER BY idx)) ELSE min(hash) END AS hash "
                f"FROM {node} GROUP BY {key}, n, idx // {FAN})"
            )
            node = f"{name}{k}"
        return ",\n".join(out), node

    lower, subroots = tree("s", "source", "leaves", source_levels)
    upper, roots = tree("r", "one", "sources", root_levels)
    joins, steps = [], []
    for k in range(1, source_levels + 1):
        joins.append(f"JOIN s{k} ON s{k}.source IS NOT DISTINCT FROM l.source AND s{k}.idx = l.idx // {FAN**k}")
        steps.append((f"l.n > {FAN ** (k - 1)}", f"s{k}.run", f"(l.idx // {FAN ** (k - 1)}) % {FAN}"))
    joins.append("JOIN sources q ON q.source IS NOT DISTINCT FROM l.source")
    for k in range(1, root_levels + 1):
        joins.append(f"JOIN r{k} ON r{k}.idx = q.idx // {FAN**k}")
        steps.append((f"q.n > {FAN ** (k - 1)}", f"r{k}.run", f"(q.idx // {FAN ** (k - 1)}) % {FAN}"))
    others = " || ".join(f"CASE WHEN {on} THEN array_to_string({run}[:{pos}] || {run}[{pos} + 2:], '') ELSE '' END" for on, run, pos in steps)
    folds, before = [], "p"
    columns = ", ".join(f"{on} AS on{k}, {run} AS run{k}, {pos} AS pos{k}" for k, (on, run, pos) in enumerate(steps))
    for k in range(len(steps)):
        folds.append(
            f"f{k} AS (SELECT * REPLACE (CASE WHEN on{k} THEN sha256(array_to_string(run{k}[:pos{k}] || [node] || run{k}[pos{k} + 2:], '')) "
            f"ELSE node END AS node) FROM {before})"
        )
        before = f"f{k}"
    return f"""
        WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
        checked AS (SELECT *, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS crc FROM documents, crc),
        digests AS (SELECT doc_id, source, {leaf("text")} AS hash, {leaf(f"(CASE WHEN crc % 5 = 0 THEN {lowered} ELSE text END)")} AS tampered FROM checked),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM digests),
        {lower},
        sources AS (SELECT source, 1 AS one, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM {subroots}),
        {upper},
        p AS (SELECT doc_id, l.hash AS leaf, q.hash AS subroot, (SELECT hash FROM {roots}) AS root, sha256({others}) AS proof_sha256, l.tampered AS node, {columns}
            FROM leaves l {" ".join(joins)}),
        {", ".join(folds)}
        SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM {before}"""
