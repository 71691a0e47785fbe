"""A Merkle manifest of a table: a digest of each row, a root, and each row's proof.

Leaves of a group (a source) are numbered in order and cut in aligned blocks of ``FAN ** DEPTH``.
A block keeps each of its levels as one string of fixed-width hex digests: substrings of ``FAN``
digests are hashed to the level above, and the parts of such a substring on either side of a node
are that node's siblings. A block's last digest is a leaf of the tree above it, which is cut in
blocks in the same way, until each group has one digest; those of the groups are the leaves of the
last tree. Proofs come down from there by a join of blocks for each tree; rows meet theirs only in
their own block. No task sees a whole group, and the driver sees a count for each range of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, discard, table, written

#: Children of a node, levels in a block, hex digits of a digest.
FAN, DEPTH, HEX = 16, 3, 64
_BLOCK, _RUN = FAN**DEPTH, FAN * HEX
_PATH = "array<struct<left:binary,right:binary>>"


def digest_of(*inputs: Column) -> Column:
    """Lower-case hex SHA-256 of columns, each ``-`` if null, else its UTF-8 bytes' number, a colon and itself."""
    parts = (c.cast("string") for c in inputs)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``at``: their place in the order, from 0, without gaps; and the table that it reads. Ranges of the order are sorted, each
    by itself; a count for each is all that the driver gets. However many rows are equal in
    ``order``, their numbers in the table deal them to ranges too."""
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    keys = [*order, "_row"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    ranged = written(ranged.withColumns({"_range": F.shiftright("_m", 33).cast("int"), "_in": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m", "_row"))
    discard(rows)
    begin, before = [], 0
    for r, n in sorted(tuple(x) for x in ranged.groupBy("_range").agg(F.count("*")).collect()):
        begin.append((r, before))
        before += n
    starts = ranged.sparkSession.createDataFrame(begin, "_range int, _begin long")
    return ranged.join(F.broadcast(starts), "_range").withColumn("at", F.col("_begin") + F.col("_in")).drop("_range", "_begin", "_in"), ranged


def _runs(level: Column) -> Column:
    """A level's string cut in the digests of one parent each."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.length(level) / _RUN).cast("int") - 1), lambda r: F.substring(level, r * _RUN + 1, F.lit(_RUN)))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(grp, block, n, kept, up, r0, r1, ..., top): ``nodes`` (grp, at, n, hash, keep) in aligned blocks. ``n`` counts the
    group's nodes and ``kept`` has each node's ``keep``, in order; ``up`` levels are above the nodes: so
    many that one digest is left, if the group fits in a block, else all ``DEPTH``. Each level is one
    string, of which ``r`` has the runs: those that are parsed for siblings are short."""
    held = nodes.groupBy("grp", F.expr(f"at div {_BLOCK}").alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "keep"))).alias("x"))
    up = F.lit(0)
    for d in range(DEPTH):
        up = F.when(F.col("n") > FAN**d, F.lit(d + 1)).otherwise(up)
    held = held.select("grp", "block", "n", F.transform("x", lambda x: x["keep"]).alias("kept"), up.alias("up"), F.array_join(F.transform("x", lambda x: x["hash"]), "").cast("binary").alias("l0"))
    for d in range(DEPTH):
        held = held.withColumn(f"r{d}", _runs(F.col(f"l{d}")))
        held = held.withColumn(f"l{d + 1}", F.when(F.col("up") > d, F.array_join(F.transform(f"r{d}", lambda run: F.sha2(run, 256)), "").cast("binary")))
    levels = [f"l{d}" for d in range(DEPTH, -1, -1)]
    return held.withColumn("top", F.coalesce(*levels).cast("string")).drop(*levels)


def _run_of(i: Column, d: int) -> tuple[Column, Column]:
    """In level ``d``, the run of the node that ``i`` is below, and where in it that is."""
    at = (i / FAN**d).cast("int")
    return F.get(F.col(f"r{d}"), (at / FAN).cast("int")), F.pmod(at, F.lit(FAN)) * HEX


def _path(i: Column) -> Column:
    """The siblings of a block's node ``i`` on the left and on the right, level by level, and then ``above``."""
    steps = []
    for d in range(DEPTH):
        run, own = _run_of(i, d)
        steps.append(F.struct(F.substring(run, F.lit(1), own).alias("left"), F.substring(run, own + HEX + 1, F.lit(_RUN)).alias("right")))
    return F.concat(F.slice(F.array(*steps), F.lit(1), F.col("up")).cast(_PATH), F.col("above"))


def _trees(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of ``nodes``, of their last digests, and so on, until each group has one; a group that fits in a
    block is not in those that follow."""
    trees = [written(_blocks(nodes))]
    while True:
        above = trees[-1].where(F.col("n") > _BLOCK)
        if above.isEmpty():
            return trees
        trees.append(written(_blocks(above.select("grp", F.col("block").alias("at"), F.ceil(F.col("n") / _BLOCK).alias("n"), F.col("top").alias("hash"), F.lit(0).alias("keep")))))


def _whole(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("n") <= _BLOCK)


def _with_paths(trees: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The blocks of the first of ``trees`` with the columns of ``roots`` (grp, above, ...), which has a row for each
    group; ``above`` is then the path from the block's last digest."""
    more = [c for c in roots.columns if c not in ("grp", "above")]
    done = None
    for tree in reversed(trees):
        met = by_group(_whole(tree), roots.join(_whole(tree).groupBy("grp").agg(F.count("*").alias("_n")), "grp"), ["grp"])
        if done is not None:
            below = done.select("grp", "block", *more, F.posexplode(F.transform("kept", lambda _, i: _path(i))).alias("_i", "above"))
            below = below.select("grp", (F.col("block") * _BLOCK + F.col("_i")).alias("block"), "above", *more)
            met = met.unionByName(tree.where(F.col("n") > _BLOCK).join(below, ["grp", "block"]))
        done = met
    return done


def merkle_manifest(docs: DataFrame, columns: list[str], group: str, order: str, changed: Column | None = None, instead: dict[str, Column] | None = None) -> DataFrame:
    """(``order``, leaf, subroot, root, path, changed_leaf) for every row: its digest, its group's, the table's, and
    the siblings on either side, level by level, from the leaf to the root.

    A leaf is :func:`digest_of` of ``columns``. A ``group``'s leaves ascend by ``order`` (null first), equal
    ones by digest; while several nodes remain, each 16 consecutive ones (the last run: fewer, even
    one) become their digest. Groups ascend by name (null first, bytewise), and their digests go on
    likewise. ``changed_leaf`` is the digest with the columns of ``instead`` where ``changed`` holds, else null.

    Null and empty values, very long texts and repeated rows are leaves like others; other columns,
    whatever their names, are not read; an empty table gives no rows.
    """
    found = {c: F.col(f"`{c}`") for c in columns}
    other = F.lit(None).cast("string") if changed is None else F.when(changed, digest_of(*(found | (instead or {})).values()))
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves, held = numbered(docs.select(name.alias("grp"), F.col(f"`{order}`").alias("key"), digest_of(*found.values()).alias("hash"), other.alias("changed")), ["grp", "key", "hash"])
    groups = written(leaves.groupBy("grp").agg(F.min("at").alias("begin"), F.count("*").alias("n")).withColumn("_n", F.col("n")))
    placed = by_group(leaves, groups, ["grp"])
    trees = _trees(placed.select("grp", (F.col("at") - F.col("begin")).alias("at"), "n", "hash", F.struct("key", "changed").alias("keep")))

    tops = _whole(trees[0])
    for tree in trees[1:]:
        tops = tops.select("grp", "top").union(_whole(tree).select("grp", "top"))
    tops, held_tops = numbered(tops.select("grp", "top"), ["grp"])
    upper = _trees(tops.select(F.lit("").alias("grp"), "at", F.lit(tops.count()).cast("long").alias("n"), F.col("top").alias("hash"), F.struct("grp", "top").alias("keep")))
    root = _whole(upper[-1]).select("grp", F.array().cast(_PATH).alias("above"), F.col("top").alias("root"))
    of_group = F.explode(F.transform("kept", lambda x, i: F.struct(x["grp"].alias("grp"), _path(i).alias("above"), x["top"].alias("subroot"))))
    roots = written(_with_paths(upper, root).select("root", of_group.alias("x")).select("x.*", "root"))
    discard(groups, held, held_tops, *upper)

    row = F.transform("kept", lambda x, i: F.struct(x["key"].alias("key"), F.substring(_run_of(i, 0)[0], _run_of(i, 0)[1] + 1, F.lit(HEX)).cast("string").alias("leaf"), _path(i).alias("path"), x["changed"].alias("changed")))
    rows = _with_paths(trees, roots).select("subroot", "root", F.explode(row).alias("x"))
    return rows.select(F.col("x.key").alias(order), "x.leaf", "subroot", "root", "x.path", F.col("x.changed").alias("changed_leaf"))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from left to right in each level."""
    return F.sha2(F.aggregate(path, F.lit("").cast("binary"), lambda all_, x: F.concat(all_, x["left"], x["right"])), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf.cast("binary"), lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256).cast("binary")).cast("string")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    rows = merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", tampered, {"text": lower_ascii(F.col("text"))})
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB has no CRC-32: it is reduced bit by bit. Levels of all sources rise together, in rounds; a source is done with one node.
OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, crc, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other, head
  FROM (SELECT doc_id, source, text,
    concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc
    FROM documents)),
leaves AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN other IS NULL THEN '-' ELSE strlen(other) || ':' || other END) AS changed FROM d),
base AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
up AS (
  SELECT source, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM base
  UNION ALL
  SELECT source, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), ANY_VALUE((n + 15) // 16) FROM up WHERE n > 1 GROUP BY source, lvl, i // 16),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, s AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), ANY_VALUE((n + 15) // 16) FROM top WHERE n > 1 GROUP BY lvl, i // 16),
side AS (
  SELECT a.source, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.source, a.lvl, a.i),
top_side AS (
  SELECT a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.lvl, a.i),
lower_steps AS (
  SELECT p.source, p.i, list({'l': t.l, 'r': t.r} ORDER BY t.lvl) AS steps
  FROM base p JOIN side t ON p.source IS NOT DISTINCT FROM t.source AND t.i = p.i // (16 ** t.lvl)::BIGINT GROUP BY p.source, p.i),
upper_steps AS (
  SELECT p.source, list({'l': t.l, 'r': t.r} ORDER BY t.lvl) AS steps FROM subroots p JOIN top_side t ON t.i = p.s // (16 ** t.lvl)::BIGINT GROUP BY p.source),
paths AS (
  SELECT p.doc_id, p.leaf, p.changed, r.subroot, coalesce(a.steps, []) || coalesce(b.steps, []) AS steps
  FROM base p JOIN subroots r ON p.source IS NOT DISTINCT FROM r.source
  LEFT JOIN lower_steps a ON a.source IS NOT DISTINCT FROM p.source AND a.i = p.i LEFT JOIN upper_steps b ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(array_to_string(list_transform(steps, lambda x: x.l || x.r), '')) AS proof_sha256,
    list_reduce(list_prepend({'l': changed, 'r': ''}, steps), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l AS folded_root FROM paths)
"""
