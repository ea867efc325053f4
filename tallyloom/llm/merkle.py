"""Merkle manifest of a table: a digest for every row, one for every group, one for all.

Rows of a group are its leaves in order, groups in order make up the whole; at every
level runs of ``FAN`` digests become one. A proof is what stands before and after a
digest in its run, level by level to the root, so one row can be checked alone.

A row's rank in its group is written in base ``FAN``. Ranks are cut into blocks of
``FAN ** LEVELS`` leaves. In a block the digit columns are grouped away one after
the other, each time nesting the structs of the level below into those above, which
takes one shuffle for all levels. The blocks of a group are the leaves of the next
round, until a group has one block; then groups are treated the same way. On the way
back the path of a block is grouped to its nested struct, and transforms and explodes
take it apart into rows with their proofs: no row-level join, and no struct larger
than a block.

Nulls and edge cases: a null field is ``-``, so it differs from an empty text; a null
group is a group and comes first; null order values come first, equal ones are ordered
by digest, and equal rows are leaves each; a leaf alone in its group is the group's
root, a group alone is the root; an empty table has no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.prefix import lay, running
from tallyloom.session import materialise

FAN_BITS = 4
FAN = 1 << FAN_BITS
LEVELS = 3
BLOCK = FAN**LEVELS
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes in front, so that neighbours cannot run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(*[field(c) for c in fields])


def roll(nodes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Blocks with their digest ``h`` and nested ``kids``. ``nodes``: ``_g``, ``n`` (nodes of the group), ``r`` (rank), ``h``, ``carry``."""
    digits = [F.shiftright("r", FAN_BITS * k).bitwiseAND(FAN - 1).alias(f"d{k}") for k in range(LEVELS)]
    out = nodes.select("_g", "n", F.shiftright("r", FAN_BITS * LEVELS).alias("block"), *digits, "h", *carry)
    out, rest = out.repartition("_g", "block"), list(carry)
    for k in range(LEVELS):
        keys = ["_g", "n", "block", *[f"d{j}" for j in range(k + 1, LEVELS)]]
        kids = F.sort_array(F.collect_list(F.struct(f"d{k}", "h", *rest)))
        out = out.groupBy(*keys).agg(kids.alias("kids"))
        joined = F.sha2(F.array_join(F.transform("kids", lambda x: x["h"]), ""), 256)
        out = out.withColumn("h", F.when(F.col("n") > FAN**k, joined).otherwise(F.col("kids")[0]["h"]))
        rest = ["kids"]
    return out


def sided(k: int, rest: Sequence[str]) -> Callable[[Column, Column], Column]:
    """What makes of a kid of level ``k`` and its place one that knows what stands before and after it."""
    digests = F.transform("kids", lambda x: x["h"])

    def make(kid: Column, at: Column) -> Column:
        before, after = F.slice(digests, F.lit(1), at), F.slice(digests, at + 2, F.lit(FAN))
        side = F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))
        return F.struct(kid[f"d{k}"].alias("d"), kid["h"].alias("h"), *[kid[c].alias(c) for c in rest], side.alias("side"))

    return make


def unroll(blocks: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``_g``, ``r``, ``h``, ``carry``, ``path`` and ``up`` of the nodes in ``blocks`` with ``path`` and ``up``."""
    out = blocks.withColumn("r", F.col("block"))
    for k in reversed(range(LEVELS)):
        rest = list(carry) if k == 0 else ["kids"]
        out = out.select("_g", "n", "r", "path", "up", F.explode(F.transform("kids", sided(k, rest))).alias("kid"))
        path = F.when(F.col("n") > FAN**k, F.concat(F.array("kid.side"), "path")).otherwise(F.col("path"))
        out = out.select(
            "_g", "n", (F.col("r") * FAN + F.col("kid.d")).alias("r"), F.col("kid.h").alias("h"),
            *[F.col(f"kid.{c}").alias(c) for c in rest], path.alias("path"), "up",
        )
    return out.drop("n")


def tree(nodes: DataFrame, carry: Sequence[str] = ()) -> list[DataFrame]:
    """The rounds of blocks of all groups, each written; in the last one every group has one block."""
    rounds = [materialise(roll(nodes, carry), "merkle_blocks")]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        most = -(-most // BLOCK)
        above = rounds[-1].select("_g", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("r"), "h")
        rounds.append(materialise(roll(above), "merkle_blocks"))
    return rounds


def with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``blocks`` with the ``path`` and ``up`` of ``above`` (``_g``, ``block``), brought together by grouping."""
    below = blocks.select("_g", "block", F.struct("n", "kids").alias("tree"))
    found = above.select("_g", "block", F.struct("path", "up").alias("above"))
    both = below.unionByName(found, allowMissingColumns=True).groupBy("_g", "block")
    both = both.agg(F.first("tree", True).alias("tree"), F.first("above", True).alias("above"))
    return both.select("_g", "block", "tree.*", "above.*")


def manifest(
    df: DataFrame, fields: Sequence[str], group: str, order: str, carry: dict[str, Column] | None = None
) -> DataFrame:
    """``leaf``, ``subroot``, ``root``, ``proof`` and the columns ``carry`` of every row.

    ``proof`` lists from the leaf's run up to the root what stands before and after in each run.
    """
    carry = carry or {order: F.col(order)}
    leaves = df.select(
        F.col(group).alias("_group"), F.col(order).alias("_order"), leaf_digest([F.col(c) for c in fields]).alias("h"),
        *[c.alias(f"c_{n}") for n, c in carry.items()],
    )
    carried = [f"c_{n}" for n in carry]
    laid = lay(materialise(leaves, "merkle_leaves"), ["_group"], ["_order", "h"], "merkle_laid")
    ranked = running(laid, ["_order", "h"], F.lit(1).cast("long"))
    rounds = tree(ranked.select("_g", F.col("total").alias("n"), F.col("before").alias("r"), "h", *carried), carried)

    subroots = materialise(rounds[-1].select(F.col("_g").alias("c_name"), F.col("_g._group").alias("_name"), "h"), "merkle_subroots")
    laid = lay(subroots, [], ["_name"], "merkle_laid")
    ranked = running(laid, ["_name"], F.lit(1).cast("long"))
    tops = tree(ranked.select("_g", F.col("total").alias("n"), F.col("before").alias("r"), "h", "c_name"), ["c_name"])

    above = tops[-1].withColumn("path", F.array().cast(PATH)).withColumn("up", F.struct(F.lit("").alias("subroot"), F.col("h").alias("root")))
    for lower in reversed(tops[:-1]):
        above = with_paths(lower, unroll(above).select("_g", F.col("r").alias("block"), "path", "up"))
    up = F.struct(F.col("h").alias("subroot"), "up.root")
    above = unroll(above, ["c_name"]).select(F.col("c_name").alias("_g"), F.lit(0).cast("long").alias("block"), "path", up.alias("up"))
    for k in reversed(range(len(rounds))):
        above = with_paths(rounds[k], above)
        above = unroll(above, carried if k == 0 else ()).withColumnRenamed("r", "block")
    return above.select(*[F.col(f"c_{n}").alias(n) for n in carry], F.col("h").alias("leaf"), "up.subroot", "up.root", F.col("path").alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, leaf, lambda now, x: F.sha2(F.concat(x["before"], now, x["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), "")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # One document in five is checked with its text in lower case.
    tampered = [F.col(c) for c in FIELDS[:-1]]
    tampered.append(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    carry = {"doc_id": F.col("doc_id"), "tampered": F.when(chosen, leaf_digest(tampered))}
    out = manifest(docs, FIELDS, "source", "doc_id", carry)
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _oracle(levels: int = 6) -> str:
    """Both trees level by level; ``levels`` runs of 16 hold 16 million leaves."""

    def lift(name: str, key: str) -> str:
        steps = []
        for k in range(levels):
            steps.append(f"""
{name}{k + 1} AS (
  SELECT {key}, r // 16 AS r, any_value(n) AS n, list(h ORDER BY r) AS hs,
         CASE WHEN any_value(n) > {16**k} THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h
  FROM {name}{k} GROUP BY {key}, r // 16
)""")
        # Before, after and the rank above, from the leaf upwards.
        steps.append(f"""
{name}p0 AS (SELECT {key}, r AS leaf, r, n, '' AS proof, []::STRUCT(b VARCHAR, a VARCHAR)[] AS path FROM {name}0)""")
        for k in range(levels):
            side = f"array_to_string(u.hs[1:p.r % 16], ''), array_to_string(u.hs[p.r % 16 + 2:], '')"
            b, a = side.split("), ")[0] + ")", side.split("), ", 1)[1]
            steps.append(f"""
{name}p{k + 1} AS (
  SELECT p.{key}, p.leaf, p.r // 16 AS r, p.n,
         CASE WHEN p.n > {16**k} THEN p.proof || {b} || {a} ELSE p.proof END AS proof,
         CASE WHEN p.n > {16**k} THEN list_append(p.path, {{'b': {b}, 'a': {a}}}) ELSE p.path END AS path
  FROM {name}p{k} p JOIN {name}{k + 1} u ON p.{key} IS NOT DISTINCT FROM u.{key} AND p.r // 16 = u.r
)""")
        return ",".join(steps)

    def leaf(text: str) -> str:
        columns = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"

    crc = (
        "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT), "
        "lambda c, x: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, "
        "xor(c, x)), 4294967295::BIGINT), 4294967295::BIGINT)"
    )
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (
  SELECT doc_id, source, {leaf('text')} AS h,
         CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS t
  FROM documents
), s0 AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS r,
         count(*) OVER (PARTITION BY source) AS n FROM d
),{lift('s', 'source')}, g0 AS (
  SELECT 1 AS one, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n
  FROM s{levels}
),{lift('g', 'one')}, paths AS (
  SELECT s0.doc_id, s0.h AS leaf, coalesce(s0.t, s0.h) AS shown, g0.h AS subroot, g{levels}.h AS root,
         sp{levels}.proof || gp{levels}.proof AS proof, list_concat(sp{levels}.path, gp{levels}.path) AS path
  FROM s0 JOIN sp{levels} ON s0.source IS NOT DISTINCT FROM sp{levels}.source AND s0.r = sp{levels}.leaf
  JOIN g0 ON s0.source IS NOT DISTINCT FROM g0.source
  JOIN gp{levels} ON g0.r = gp{levels}.leaf CROSS JOIN g{levels}
), f AS (
  SELECT *, list_reduce(list_transform(path, lambda x: x), lambda now, x: {{'b': sha256(x.b || now.b || x.a), 'a': ''}},
                        {{'b': shown, 'a': ''}}).b AS folded_root FROM paths
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""


QUERIES = {"op11_merkle": op11_merkle}
ORACLES: dict[str, str] = {"op11_merkle": _oracle()}
