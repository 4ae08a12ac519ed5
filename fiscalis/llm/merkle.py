"""A Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups, and a proof for each row.

Parents are stored by their preimages, the concatenated hashes of their children. Nodes are numbered in their order
without a window over all rows of a group (ranges of rows are counted, and counted on), gathered into pages of SPAN
consecutive nodes, and each page climbs BITS levels at once; its root is one node of the next page. So a tree over n
leaves takes log(n) / BITS shuffles, each of a SPAN-th of the one before, and no page is larger than SPAN nodes.

Downwards, a page joins the path of its root and hands every node the preimages of all its ancestors. A node's siblings
are what is left of a preimage without the node's own 64 characters; folding puts another hash in that place and goes on
with the digest. Everything is built from DataFrame functions; the texts are read once, only digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalis.llm.common import broadcast_if, materialize, pick, table

BITS = 8
SPAN = 1 << BITS
#: Characters of a digest.
WIDE = 64
#: Rows of groups or counted ranges that are broadcast at most.
BROADCAST_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest(*fields: Column) -> Column:
    """The digest of a row: each field as its number of bytes in UTF-8, a colon and the value, a null one as a hyphen."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return sha(F.concat(*map(one, fields)))


def _same(a: DataFrame, group: list[str], prefix: str) -> Column:
    """Equality of group columns with those of the other side, which have a prefix; nulls are equal."""
    on = F.lit(True)
    for c in group:
        on = on & a[c].eqNullSafe(F.col(f"{prefix}{c}"))
    return on


def placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds pos, the place of each row in its group from 0 on (nulls first), and depth, the levels of a tree of pairs over the group.

    Rows are dealt by ranges of (group, order), so the rows of one group may lie in many tasks; a range's rows are counted
    per group, and the counts of the ranges before are added. Rows that are equal in all of these are dealt as well.
    """
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    told = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(*by, F.col("_row")).sortWithinPartitions(*by, F.col("_row")).drop("_row")
    run = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), name)  # the number of the task, and behind it the row's in the task
    part = F.shiftright("_at", 33)
    n = run.groupBy(*group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(*(F.col(c).alias(f"_g_{c}") for c in group), "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("_all"))
    n = materialize(n, f"{name}-counts")
    d = run.join(broadcast_if(n, n.count(), BROADCAST_ROWS), (part == F.col("_part")) & _same(run, group, "_g_"))
    depth = F.when(F.col("_all") > 1, F.length(F.bin(F.col("_all") - 1))).otherwise(F.lit(0))
    return d.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), depth.cast("int").alias("depth"))


def pages(nodes: DataFrame, group: list[str], keep: list[str]) -> DataFrame:
    """Nodes (group, pos, hash, depth, keep) in pages: (group, block, nodes, up, depth, root), up the preimages of the parents within the page, level by level, depth what is left to climb from root."""
    item = F.struct("pos", "hash", *keep)
    d = nodes.groupBy(*group, F.shiftright("pos", BITS).alias("block")).agg(F.max("depth").alias("depth"), F.sort_array(F.collect_list(item)).alias("nodes"))
    lift = F.least("depth", F.lit(BITS))
    levels = F.when(lift > 0, F.sequence(F.lit(1), lift)).otherwise(F.array().cast("array<int>"))
    empty = F.array().cast("array<array<string>>")

    def climbed(s: Column, _: Column) -> Column:
        h = s["hash"]
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / 2).cast("int")), lambda i: F.concat(F.get(h, 2 * i), F.coalesce(F.get(h, 2 * i + 1), F.lit(""))))
        return F.struct(F.transform(pairs, sha).alias("hash"), F.concat(s["up"], F.array(pairs)).alias("up"))

    start = F.struct(F.transform("nodes", lambda x: x["hash"]).alias("hash"), empty.alias("up"))
    d = d.withColumn("_s", F.aggregate(levels, start, climbed))
    return d.select(*group, "block", "nodes", F.col("_s.up").alias("up"), (F.col("depth") - lift).alias("depth"), F.get("_s.hash", F.lit(0)).alias("root"))


def tree(nodes: DataFrame, group: list[str], keep: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(group, pos, hash, keep, path), the path of a node being the preimages of its ancestors from its parent up to the top, and the tops (group, hash). nodes: group, pos, hash, depth, keep, as placed() numbers them."""
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    found = []
    for k in range(max(1, -(-deepest // BITS))):
        found.append(materialize(pages(nodes, group, keep if k == 0 else []), f"{name}-pages"))
        nodes = found[-1].select(*group, F.col("block").alias("pos"), F.col("root").alias("hash"), "depth")
    above = None
    for page in reversed(found):
        d = page
        more = F.array().cast("array<string>")
        if above is not None:
            higher = above.select(*(F.col(c).alias(f"_u_{c}") for c in group), F.col("pos").alias("_u_pos"), F.col("path").alias("_path"))
            d = page.join(higher, _same(page, group, "_u_") & (page["block"] == F.col("_u_pos")))
            more = F.col("_path")
        place = lambda x: (x["pos"] - F.col("block") * SPAN).cast("int")
        own = lambda x: F.transform("up", lambda level, k: F.get(level, F.call_function("shiftright", place(x), k + 1)))
        fields = page.schema["nodes"].dataType.elementType.names
        each = F.transform("nodes", lambda x: F.struct(*(x[c].alias(c) for c in fields), F.concat(own(x), more).alias("path")))
        above = d.select(*group, F.inline(each))
    return above, nodes.select(*group, "hash")


def steps(pos: str, path: str) -> Column:
    """(preimage, the characters before the node's own slot) of each level of a path."""
    at = lambda k: (F.call_function("shiftright", F.col(pos), k) % 2 * WIDE).cast("int")
    return F.transform(path, lambda p, k: F.struct(p.alias("p"), at(k).alias("at")))


def siblings(way: Column) -> Column:
    """The hashes beside a node, level by level: each preimage without the node's own slot."""
    return F.array_join(F.transform(way, lambda s: F.concat(F.substring(s["p"], F.lit(1), s["at"]), F.substring(s["p"], s["at"] + WIDE + 1, F.lit(WIDE)))), "")


def folded(leaf: Column, way: Column) -> Column:
    """The top that follows from a leaf and its siblings: the hash takes its slot in each preimage."""
    return F.aggregate(way, leaf, lambda h, s: sha(F.concat(F.substring(s["p"], F.lit(1), s["at"]), h, F.substring(s["p"], s["at"] + WIDE + 1, F.lit(WIDE)))))


def manifest(rows: DataFrame, id_col: str, group_col: str, leaf: Column, changed: Column | None = None) -> DataFrame:
    """(id, group, leaf, subroot, root, proof, folded, verified) per row: proof has the hashes of all siblings on the way to the root.

    leaf is the digest of a row, changed that of a row that was tampered with since, null where it wasn't; folded is the
    root that follows from the latter, where there is one. In each group rows ascend by id, null ids first, rows of one id
    by their digests; while several nodes are left, every two that follow on each other become their digest, a single last
    one too. The tops of the groups, null group first, then by bytes, are joined likewise. Repeated rows are leaves of
    their own. An empty table gives an empty result.
    """
    own = rows.select(rows[f"`{id_col}`"].alias("id"), rows[f"`{group_col}`"].alias("group"), leaf.alias("hash"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    own = materialize(own, "merkle-leaves")
    leaves, tops = tree(placed(own, ["group"], ["id", "hash"], "merkle-order"), ["group"], ["id", "changed"], "merkle")
    tops = materialize(tops, "merkle-tops")
    ways, root = tree(placed(tops, [], ["group"], "merkle-tops-order"), [], ["group"], "merkle-root")
    top = root.first()  # one row at most
    ways = ways.select(F.col("group").alias("_g_group"), F.col("hash").alias("subroot"), F.col("pos").alias("_top"), F.col("path").alias("_more"))
    d = leaves.join(broadcast_if(ways, tops.count(), BROADCAST_ROWS), F.col("group").eqNullSafe(F.col("_g_group")))
    d = d.withColumn("way", F.concat(steps("pos", "path"), steps("_top", "_more")))
    d = d.select("id", "group", F.col("hash").alias("leaf"), "subroot", F.lit(top.hash if top else None).cast("string").alias("root"), siblings(F.col("way")).alias("proof"), folded(F.coalesce("changed", "hash"), F.col("way")).alias("folded"))
    return d.withColumn("verified", F.col("folded") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language; where 7 divides the CRC-32 of an id, n_chars was tampered with."""
    d = pick(table(spark, sf_dir, "documents"), **{c: c for c in FIELDS})
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = F.when(tampered, digest(*((F.col(c) + 1) if c == "n_chars" else F.col(c) for c in FIELDS)))
    found = manifest(d, "doc_id", "lang", digest(*(F.col(c) for c in FIELDS)), changed)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", sha(F.col("proof")).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")
