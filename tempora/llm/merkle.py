"""Document fingerprints: a hash tree over blocks of words, paragraphs and sections, in DataFrame functions only.

Sections end at blank lines, paragraphs at line ends; a paragraph's blocks are runs of up to four words. Each level
hashes the level below, and the root hashes the sections and the raw text, so equal roots mean equal texts,
while paragraphs and blocks whose hashes differ show where two texts differ. The fingerprint is a string:
root, then for each section its hash and for each of its paragraphs the paragraph's hash and those of its blocks.

The likeness of two fingerprints is the share of distinct blocks that both have, of the larger count; it is 1 for two
texts without words and 0 if one has none. Nulls are empty texts. Rows without an id come last in
order, rows of one id follow each other by a hash of their texts, and rows that repeat id and text are one
document that is returned as often as it stands. The document after the last is the first; a lone one follows itself.
A text of any length is whole in one task, as long as its blocks fit there. Other columns, whatever their names, aren't read.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import read, repeated, stored

#: Words in a block at most; longer words than this many characters are cut.
BLOCK_WORDS, WORD_CHARS = 4, 200
BLOCK = rf"\S{{1,{WORD_CHARS}}}(?:\s+\S{{1,{WORD_CHARS}}}){{0,{BLOCK_WORDS - 1}}}"


def _hex(x: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << 4 * digits) - 1)))), digits, "0")


def tree(text: Column) -> Column:
    """array of sections, each an array of paragraphs: struct of hash and blocks (array of 24-bit hashes)."""

    def paragraph(p: Column) -> Column:
        blocks = F.transform(F.regexp_extract_all(p, F.lit(BLOCK), F.lit(0)), lambda b: F.xxhash64(b).bitwiseAND(F.lit(0xFFFFFF)).cast("int"))
        return F.struct(F.xxhash64(p).alias("hash"), blocks.alias("blocks"))

    section = lambda s: F.transform(F.filter(F.split(s, "\n"), lambda p: F.length(p) > 0), paragraph)
    return F.transform(F.split(text, r"\n[ \t\r]*\n\s*"), section)


def leaves(nodes: Column) -> Column:
    """The distinct block hashes of a tree."""
    return F.array_distinct(F.flatten(F.transform(F.flatten(nodes), lambda p: p["blocks"])))


def fingerprint(text: Column, nodes: Column) -> Column:
    def section(s: Column) -> Column:
        paragraphs = F.transform(s, lambda p: F.concat(_hex(p["hash"], 8), F.lit("="), F.array_join(F.transform(p["blocks"], lambda b: _hex(b, 6)), "")))
        return F.concat(_hex(F.xxhash64(F.transform(s, lambda p: p["hash"])), 8), F.lit(":"), F.array_join(paragraphs, ","))

    sections = F.transform(nodes, lambda s: F.xxhash64(F.transform(s, lambda p: p["hash"])))
    root = F.md5(F.concat_ws(".", F.transform(sections, lambda h: F.hex(h)), F.hex(F.xxhash64(text)), F.length(text).cast("string")).cast("binary"))
    return F.concat(root, F.lit(";"), F.array_join(F.transform(nodes, section), ";"))


def parsed_leaves(print_: Column) -> Column:
    """The distinct block hashes that a fingerprint string holds."""
    runs = F.regexp_extract_all(print_, F.lit("=([0-9a-f]*)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.regexp_extract_all(r, F.lit("[0-9a-f]{6}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int")))))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of distinct block hashes."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def successors(ids: DataFrame) -> DataFrame:
    """ids (id, mark, ...) with next_id and next_mark, those of the row after it by (id, mark); the first follows the last.

    Rows are range-partitioned; each partition finds successors in itself, and the first rows of partitions,
    one each, stand in for those of its last row.
    """
    ranged = stored(ids.repartitionByRange("id", "mark").withColumn("range", F.spark_partition_id()))
    window = Window.partitionBy("range").orderBy("id", "mark")
    firsts = ranged.groupBy("range").agg(F.min(F.struct("id", "mark")).alias("first"))
    around = Window.orderBy("range")  # a row for each partition
    start = F.first("first").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(around), start).alias("after"))
    after = F.coalesce(F.lead(F.struct("id", "mark")).over(window), F.col("after"))
    return ranged.join(F.broadcast(firsts), "range").withColumn("next", after).drop("range", "after").select("*", F.col("next.id").alias("next_id"), F.col("next.mark").alias("next_mark")).drop("next")


def edited_fingerprints(df: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of texts and of their edited texts, whose last 1/share of code points gives way to the next document's first ones."""
    text = F.coalesce("text", F.lit(""))
    rows = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text).alias("mark"), F.col("doc_id"), text.alias("text"))
    ids = rows.groupBy("id", "mark").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    order = stored(successors(ids))
    number = F.row_number().over(Window.partitionBy("id", "mark").orderBy("id"))
    texts = rows.select("id", "mark", "text").withColumn("copy", number).where("copy = 1").drop("copy")
    take = F.expr(f"cast(n_chars div {share} as int)")
    followed = texts.join(order.select(F.col("next_id").alias("id"), F.col("next_mark").alias("mark"), F.col("id").alias("own_id"), F.col("mark").alias("own_mark"), "n_chars"), ["id", "mark"])
    after = followed.select(F.col("own_id").alias("id"), F.col("own_mark").alias("mark"), F.substring("text", F.lit(1), take).alias("head"), leaves(tree(F.col("text"))).alias("next_leaves"))
    both = texts.join(order.select("id", "mark", "doc_id", "n_chars", "copies"), ["id", "mark"]).join(after, ["id", "mark"])
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - take), F.col("head")))
    both = both.withColumns({"nodes": tree(F.col("text")), "edited_nodes": tree(F.col("edited"))}).withColumns({"own": leaves(F.col("nodes")), "other": leaves(F.col("edited_nodes"))})
    out = both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), F.col("nodes")).alias("fingerprint"), fingerprint(F.col("edited"), F.col("edited_nodes")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_leaves")).alias("near_next"),
        "copies",
    )
    return repeated(out, "copies")


def op1_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))
