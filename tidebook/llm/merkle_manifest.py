"""Merkle manifest of a document table, with a proof for every row.

Digests are lowercase hex sha256 over concatenated inputs. A leaf covers
doc_id, source, lang, n_chars and text, each as ``-`` when null and otherwise
as its UTF-8 byte count, a colon and the value. The leaves of one lang, by
doc_id, form a tree in which every run of ``fan`` consecutive nodes (the last
run may be shorter) becomes one node until one remains, the subroot; the
subroots, by lang, form the tree of the root.

1. ``ranked`` numbers the leaves of each lang: rows are sorted by range over
   all tasks and numbered there, and one row per task and lang adds what lies
   before. No lang is ever sorted in one task.
2. ``blocks``: the rank's base-``fan`` digits are grouped away one after the
   other, the lowest first, and each grouping nests the child structs in their
   parent. A block is ``fan ** levels`` consecutive nodes, so one shuffle by
   block serves all its groupings and a nested row stays bounded. The block
   tops are the nodes of the next round, until each tree has one node.
3. ``unfold``: from the top down, a transform over each parent's children cuts
   the siblings left and right of each child, and an explode emits it with the
   path so far. Inside a block nothing is joined; only a block's one row meets
   the path of its top, once per round.

A proof is the list of (left siblings, right siblings) from leaf to root;
folding it over a leaf gives the root again, and over a tampered leaf another.

Null doc_ids come first in their lang, a null lang is a lang of its own and
comes first. Repeated ids are ordered by their leaf digest; repeated rows have
equal leaves, so each keeps its own row and proof. An empty table gives no
rows. A row without text gets a leaf like any other. Columns other than the
five, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.keys import ascii_lower
from tidebook.session import cut_lineage

FAN = 8
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    v = c.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_digest(**replaced: Column) -> Column:
    """Digest of a row, with some of its fields replaced."""
    return F.sha2(F.concat(*(_field(replaced.get(f, F.col(f))) for f in FIELDS)), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def ranked(nodes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``r``, the place among the rows of its key by ``order`` (from 0), and ``n``, their number."""
    placed = nodes.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    # Written once: the numbers hold even if a lost task's sort ranges would be drawn anew.
    placed = cut_lineage(placed, "placed").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part", key).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_part").alias("_p"), F.col(key).alias("_k"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    joined = placed.join(runs, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    return joined.select(*nodes.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("r"), "n")


def blocks(nodes: DataFrame, key: str, fan: int, levels: int) -> DataFrame:
    """(key, n, b, kids, digest): nested block ``b`` of each key from ``nodes(key, r, n, digest, item)``."""
    digits = [F.expr(f"(r div {fan**j}) % {fan}").alias(f"d{j}") for j in range(levels)]
    rows = nodes.select(key, "n", F.expr(f"r div {fan**levels}").alias("b"), *digits, "digest", F.col("item").alias("kids"))
    rows = rows.repartition(key, "b")
    for j in range(levels):
        parent = [key, "n", "b", *(f"d{i}" for i in range(j + 1, levels))]
        rows = rows.groupBy(*parent).agg(F.sort_array(F.collect_list(F.struct(F.col(f"d{j}").alias("d"), "digest", "kids"))).alias("kids"))
        # A tree that has one node left at this level has ended: its node passes as it is.
        digest = F.when(F.col("n") > fan**j, F.sha2(_joined(F.col("kids.digest")), 256)).otherwise(F.col("kids")[0]["digest"])
        rows = rows.withColumn("digest", digest)
    return rows


def unfold(rows: DataFrame, fan: int, levels: int, carry: list[str]) -> DataFrame:
    """(carry..., path, digest, item) of every node inside blocks that know the ``path`` of their top."""
    for j in reversed(range(levels)):
        def member(k: Column, i: Column) -> Column:
            digests = F.col("kids.digest")
            return F.struct(k["digest"].alias("digest"), k["kids"].alias("kids"), _joined(F.slice(digests, F.lit(1), i)).alias("left"), _joined(F.slice(digests, i + 2, F.lit(fan))).alias("right"))

        rows = rows.select(*carry, "n", "path", F.explode(F.transform("kids", member)).alias("m"))
        step = F.array(F.struct(F.col("m.left").alias("left"), F.col("m.right").alias("right")))
        path = F.when(F.col("n") > fan**j, F.concat(step, F.col("path"))).otherwise(F.col("path"))
        rows = rows.select(*carry, "n", path.alias("path"), F.col("m.digest").alias("digest"), F.col("m.kids").alias("kids"))
    return rows.select(*carry, "path", "digest", F.col("kids").alias("item"))


def forest(nodes: DataFrame, key: str, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """Block tables of each round, lowest first; the last has one row per key, whose digest is the key's root."""
    size, rounds = fan**levels, []
    left = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        rows = cut_lineage(blocks(nodes, key, fan, levels), "blocks")
        rounds.append(rows)
        left = -(-left // size)
        if left <= 1:
            return rounds
        nodes = rows.select(key, F.col("b").alias("r"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), "digest", F.struct("b").alias("item"))


def proofs(rounds: list[DataFrame], key: str, tops: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(columns of ``tops`` but b, path, digest, item) of every lowest node; ``tops(key, b, path, ...)`` has the path of each key's root."""
    carry = [c for c in tops.columns if c not in ("b", "path")]
    for depth, rows in enumerate(reversed(rounds)):
        named = tops.select(F.col(key).alias("_k"), F.col("b").alias("_b"), *(c for c in tops.columns if c not in (key, "b")))
        rows = rows.join(named, F.col(key).eqNullSafe(F.col("_k")) & (F.col("b") == F.col("_b"))).drop("_k", "_b", "b", "digest")
        rows = unfold(rows, fan, levels, carry)
        if depth < len(rounds) - 1:
            tops = rows.select(*carry, F.col("item.b").alias("b"), "path")
    return rows


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, tampered_text: Column | None = None, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, path, tampered_leaf) of every row of ``docs``.

    ``path`` is the proof: an array of (left, right) sibling digests, leaf level
    first. ``tampered_text`` is the text of rows to be tampered with, null for
    all others; ``tampered_leaf`` is then their leaf, null for the others.
    """
    altered = F.lit(None).cast("string") if tampered_text is None else F.when(tampered_text.isNotNull(), leaf_digest(text=tampered_text))
    leaves = docs.select("doc_id", "lang", leaf_digest().alias("digest"), altered.alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    leaves = ranked(cut_lineage(leaves, "leaves"), "lang", ["doc_id", "digest", "tie"])
    nodes = leaves.select("lang", "r", "n", "digest", F.struct("doc_id", "tampered").alias("item"))
    trees = forest(cut_lineage(nodes, "nodes"), "lang", fan, levels)

    crowns = trees[-1].select(F.lit(0).alias("all"), "lang", F.col("digest"))
    crowns = cut_lineage(ranked(crowns, "all", ["lang"]).select("all", "r", "n", "digest", F.struct("lang").alias("item")), "subroots")
    crown = forest(crowns, "all", fan, levels)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    top = crown[-1].select("all", "b", empty.alias("path"), F.col("digest").alias("root"))
    tops = proofs(crown, "all", top, fan, levels).select(F.col("item.lang").alias("lang"), F.lit(0).cast("long").alias("b"), "path", F.col("digest").alias("subroot"), "root")
    rows = proofs(trees, "lang", cut_lineage(tops, "tops"), fan, levels)
    return rows.select("item.doc_id", "lang", F.col("digest").alias("leaf"), "subroot", "root", "path", F.col("item.tampered").alias("tampered_leaf"))


def lowered_thirds() -> Column:
    """Text with A-Z lower-cased where 3 divides the crc32 of the decimal doc_id, null elsewhere."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text")))


def verified(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang) of a manifest."""
    siblings = _joined(F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("tampered_leaf", "leaf"), F.col("path")).alias("folded_root"), "lang")
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "lang")


def _sql_field(name: str, value: str | None = None) -> str:
    v = value or f"{name}::varchar"
    return f"coalesce(strlen({v})::varchar || ':' || {v}, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join([*(_sql_field(f) for f in FIELDS[:-1]), _sql_field("text", text)]) + ")"


ORACLE = f"""
with recursive crc(doc_id, digits, v) as (
  select doc_id, doc_id::varchar, 4294967295::bigint from (select distinct doc_id from documents where doc_id is not null)
  union all
  select doc_id, substr(digits, 2), list_reduce(list_prepend(xor(v, ascii(digits[1])::bigint), [0::bigint, 1, 2, 3, 4, 5, 6, 7]), lambda x, y: xor(x >> 1, case when x % 2 = 1 then 3988292384::bigint else 0::bigint end)) from crc where digits <> ''),
thirds as (select doc_id from crc where digits = '' and xor(v, 4294967295::bigint) % 3 = 0),
langs as (select lang, row_number() over (order by lang nulls first) - 1 as k from (select distinct lang from documents)),
leaves as (select doc_id, k, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as r, leaf, tleaf from (
  select doc_id, k, {_sql_leaf("text")} as leaf,
    case when third then {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {_sql_leaf("text")} end as tleaf
  from (select *, coalesce(doc_id in (select t.doc_id from thirds t), false) as third from documents) join (select lang as l, k from langs) on lang is not distinct from l)),
nodes(k, lv, i, cnt, digest) as (
  select k, 0, r, count(*) over (partition by k), leaf from leaves
  union all
  select k, lv + 1, i // 8, any_value((cnt + 7) // 8), sha256(string_agg(digest, '' order by i)) from nodes where cnt > 1 group by k, lv, i // 8),
crown(lv, i, cnt, digest) as (
  select 0, k, count(*) over (), digest from nodes where cnt = 1
  union all
  select lv + 1, i // 8, any_value((cnt + 7) // 8), sha256(string_agg(digest, '' order by i)) from crown where cnt > 1 group by lv, i // 8),
steps as (
  select l.doc_id, l.k, l.r, n.lv, n.i, n.digest, n.i = l.r // (8 ** n.lv)::bigint as own from leaves l join nodes n on n.k = l.k and n.cnt > 1 and n.i // 8 = l.r // (8 ** (n.lv + 1))::bigint
  union all
  select l.doc_id, l.k, l.r, 100 + n.lv, n.i, n.digest, n.i = l.k // (8 ** n.lv)::bigint from leaves l join crown n on n.cnt > 1 and n.i // 8 = l.k // (8 ** (n.lv + 1))::bigint),
level as (select k, r, row_number() over (partition by k, r order by lv) as step, string_agg(digest, '' order by i) filter (not own) as siblings,
  coalesce(string_agg(digest, '' order by i) filter (i < mine), '') as before, coalesce(string_agg(digest, '' order by i) filter (i > mine), '') as after
  from (select *, max(i) filter (own) over (partition by k, r, lv) as mine from steps) group by k, r, lv),
fold(k, r, step, node) as (
  select k, r, 0::bigint, tleaf from leaves
  union all
  select f.k, f.r, l.step, sha256(l.before || f.node || l.after) from fold f join level l on l.k = f.k and l.r = f.r and l.step = f.step + 1),
proof as (select k, r, string_agg(siblings, '' order by step) as siblings from level group by k, r),
ends as (select k, r, arg_max(node, step) as node from fold group by k, r)
select l.doc_id, l.leaf, s.digest as subroot, c.digest as root, sha256(coalesce(p.siblings, '')) as proof_sha256, e.node as folded_root, e.node = c.digest as verified, langs.lang
from leaves l join langs using (k) join (select k, digest from nodes where cnt = 1) s using (k) cross join (select digest from crown where cnt = 1) c join ends e using (k, r) left join proof p using (k, r)
"""
