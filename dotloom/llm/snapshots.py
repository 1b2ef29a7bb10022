"""Difference of two snapshots of a table whose rows may have changed their key. No joins anywhere.

Both snapshots, tagged by side, are united and grouped once by key; conditional struct aggregates give each key's earlier
and later row. What stands alone is left over. Within each side, leftovers of equal content are ranked, earlier ones by
rising and later ones by falling key, and a second grouping by content and rank pairs them.

A content may be that of a third of all rows, so a rank is the sum of two: the place within a block of keys (a window by
side, content and block), and the number of leftovers in the blocks before it. Blocks are cut at quantiles of all
leftover keys, so none holds more than its share of the rows. The blocks' sums, a row for each content and block, reach
the rows by a union ahead of the same window. Long columns travel as SHA-256 digests, so an exchange holds no text and
equality is that of digests. Nothing but the cuts, one number for ``BLOCK_ROWS`` leftovers, goes through the driver.

Defined results: a key names one row of a snapshot; where rows share a key, the least of them by its columns stands for
it, and ``old_rows`` and ``new_rows`` count them. A row with a null key has no key: it is left over, comes before all
keys in both sides' order, and ties there are broken by the remaining columns. Null columns equal null columns alone.
Empty tables give what the other side has as inserts or deletes. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dotloom.llm.common import stored

#: Columns compared, those that make the content, those that travel as digests.
COLUMNS, CONTENT, LONG = ("text", "lang", "source"), ("text", "lang"), ("text",)
#: Leftover rows of a block of keys, and the least number of blocks.
BLOCK_ROWS, BLOCKS = 200_000, 128


def _row_digest(df: DataFrame, columns) -> Column:
    """SHA-256 of the columns joined by line feeds, null as ~."""
    parts = [x for c in columns for x in (F.lit("\n"), F.coalesce(df[c].cast("string"), F.lit("~")))]
    return F.unhex(F.sha2(F.concat(*parts[1:]), 256))


def tagged(df: DataFrame, side: int, key: str, columns=COLUMNS, long=LONG) -> DataFrame:
    """(key, side, row): ``row`` a struct of the columns c0, c1, ..., long ones as digests, and for side 1 the digest of the whole row."""
    values = [(F.unhex(F.sha2(df[c].cast("string"), 256)) if c in long else df[c]).alias(f"c{i}") for i, c in enumerate(columns)]
    digest = _row_digest(df, columns) if side else F.lit(None).cast("binary")
    return df.select(df[key].cast("long").alias("key"), F.lit(side).alias("side"), F.struct(*values, digest.alias("digest")).alias("row"))


def by_key(earlier: DataFrame, later: DataFrame, key: str, columns=COLUMNS, long=LONG) -> DataFrame:
    """(key, old, new, old_rows, new_rows): each key's rows, one of each snapshot; rows with a null key alone."""
    both = tagged(earlier, 0, key, columns, long).union(tagged(later, 1, key, columns, long))
    alone = F.when(F.col("key").isNull(), F.monotonically_increasing_id())
    sides = [x for i, name in enumerate(("old", "new")) for x in (F.min(F.when(F.col("side") == i, F.col("row"))).alias(name), F.count_if(F.col("side") == i).alias(f"{name}_rows"))]
    return both.withColumn("alone", alone).groupBy("key", "alone").agg(*sides).drop("alone")


def _blocks(left: DataFrame) -> DataFrame:
    """Leftovers with the block of their order ``ord``; blocks follow the order, a null is in the first."""
    n = left.count()
    blocks = max(BLOCKS, n // BLOCK_ROWS)
    cuts = left.approxQuantile("ord", [i / blocks for i in range(1, blocks)], 0.25 / blocks) if n and blocks > 1 else []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        return left.withColumn("block", F.lit(0))
    placed = Bucketizer(splits=splits, inputCol="at", outputCol="in", handleInvalid="keep").transform(left.withColumn("at", F.col("ord").cast("double")))
    return placed.withColumn("block", F.when(F.col("ord").isNull(), -1).otherwise(F.col("in").cast("int"))).drop("at", "in")


def ranked(left: DataFrame, content: list[str], *ties: str) -> DataFrame:
    """Leftovers (side, ord, contents, ...) with ``rank``, their place by ``ord`` and then ``ties`` among those of their side and content."""
    d = _blocks(left)
    part = ["side", *content, "block"]
    before = Window.partitionBy("side", *content).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy(*part).agg(F.count("*").alias("n")).withColumn("ahead", F.sum("n").over(before)).where("ahead > 0").drop("n")
    rows = d.withColumn("ahead", F.lit(None).cast("long")).unionByName(offsets, allowMissingColumns=True)
    # The row of the blocks before comes first and counts for all of them.
    order = Window.partitionBy(*part).orderBy(F.col("ahead").isNull(), F.col("ord").asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("rank", F.sum(F.coalesce("ahead", F.lit(1).cast("long"))).over(order)).where("ahead IS NULL").drop("ahead", "block")


def difference(earlier: DataFrame, later: DataFrame, key: str = "doc_id", columns=COLUMNS, content=CONTENT, long=LONG) -> DataFrame:
    """(key, old_key, op, changed, row_sha256, old_rows, new_rows), a row for each pair and each row that has none.

    ``op`` is same or update for equal keys, rekey for equal content under another key, insert or delete. ``changed``
    names the differing columns of a pair. ``row_sha256`` is the digest of the later row's columns.
    """
    keyed = stored(by_key(earlier, later, key, columns, long), "keyed").df
    paired = F.col("old").isNotNull() & F.col("new").isNotNull()
    names = [f"c{i}" for i in range(len(columns))]
    side = F.col("new").isNotNull().cast("int")
    row = F.coalesce("old", "new")
    left = keyed.where(~paired).select(
        side.alias("side"), F.when(side == 1, F.bitwise_not("key")).otherwise(F.col("key")).alias("ord"), "key", *[row[c].alias(c) for c in names], row["digest"].alias("digest"),
        (F.col("old_rows") + F.col("new_rows")).alias("n"),
    )
    same = [f"c{columns.index(c)}" for c in content]
    rest = [c for c in names if c not in same]
    whole = F.struct("key", F.struct(*names, "digest").alias("row"), "n")
    met = ranked(left, same, *rest, "digest").groupBy(*same, "rank").agg(*[F.max(F.when(F.col("side") == i, whole)).alias(name) for i, name in enumerate(("old", "new"))])
    zero = F.lit(0).cast("long")
    moved = met.select(
        F.when(F.col("new").isNotNull(), F.col("new.key")).otherwise(F.col("old.key")).alias("key"), F.col("old.key").alias("old_key"), F.col("old.row").alias("old"), F.col("new.row").alias("new"),
        F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("rekey").alias("op"), F.coalesce("old.n", zero).alias("old_rows"), F.coalesce("new.n", zero).alias("new_rows"),
    )
    stayed = keyed.where(paired).select("key", F.col("key").alias("old_key"), "old", "new", F.lit(None).cast("string").alias("op"), "old_rows", "new_rows")
    differ = F.concat_ws(",", *[F.when(~F.col(f"old.c{i}").eqNullSafe(F.col(f"new.c{i}")), F.lit(c)) for i, c in enumerate(columns)])
    out = stayed.unionByName(moved).withColumn("changed", F.when(paired, differ).otherwise(F.lit("")))
    op = F.coalesce("op", F.when(F.col("changed") == "", "same").otherwise("update"))
    return out.select("key", "old_key", op.alias("op"), "changed", F.lower(F.hex("new.digest")).alias("row_sha256"), "old_rows", "new_rows")


def later_snapshot(docs: DataFrame) -> DataFrame:
    """A later snapshot of (doc_id, text, lang, source): rows go, change, get a new key or a copy by the CRC-32 of their id."""
    m, copy = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 25, F.col("copy")
    copies = F.when(m == 0, F.array().cast("array<int>")).when(m == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = docs.select("doc_id", "text", "lang", "source").select("*", F.explode(copies).alias("copy"))
    return d.select(
        F.when(m.isin(3, 4) | (copy == 1), -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(m == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(m == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(m == 2, F.col("lang")).when(m != 4, F.col("source")).when(m.isNull(), F.col("source")).alias("source"),
    )


def op13_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How ``documents`` differ from a later snapshot of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return difference(docs, later_snapshot(docs)).select("key", "old_key", "op", "changed", "row_sha256")


_BITS = "list_reduce([{0}, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y : CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
OP13_SQL = r"""WITH o AS (SELECT doc_id, text, lang, source, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c : CAST(ascii(c) AS BIGINT))), lambda a, b : BITS), 4294967295) % 25 AS m FROM documents),
l AS (SELECT CASE WHEN m IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM o WHERE m <> 0
 UNION ALL SELECT -1 - doc_id, text, lang, source FROM o WHERE m = 5),
eu AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS i FROM o WHERE doc_id NOT IN (SELECT doc_id FROM l)),
lu AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id DESC) AS i FROM l WHERE doc_id NOT IN (SELECT doc_id FROM o)),
p AS (SELECT true AS eq, e.doc_id AS ek, l.doc_id AS lk, e.text AS et, l.text AS lt, e.lang AS el, l.lang AS ll, e.source AS es, l.source AS ls FROM o e JOIN l USING (doc_id)
 UNION ALL SELECT false, e.doc_id, l.doc_id, e.text, l.text, e.lang, l.lang, e.source, l.source FROM eu e FULL JOIN lu l ON e.text IS NOT DISTINCT FROM l.text AND e.lang IS NOT DISTINCT FROM l.lang AND e.i = l.i),
q AS (SELECT *, CASE WHEN ek IS NULL OR lk IS NULL THEN '' ELSE concat_ws(',', CASE WHEN et IS DISTINCT FROM lt THEN 'text' END, CASE WHEN el IS DISTINCT FROM ll THEN 'lang' END, CASE WHEN es IS DISTINCT FROM ls THEN 'source' END) END AS changed FROM p)
SELECT coalesce(lk, ek) AS key, ek AS old_key, CASE WHEN ek IS NULL THEN 'insert' WHEN lk IS NULL THEN 'delete' WHEN NOT eq THEN 'rekey' WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed,
CASE WHEN lk IS NOT NULL THEN sha256(coalesce(lt, '~') || chr(10) || coalesce(ll, '~') || chr(10) || coalesce(ls, '~')) END AS row_sha256 FROM q""".replace("BITS", _BITS.format("xor(a, b)"))
