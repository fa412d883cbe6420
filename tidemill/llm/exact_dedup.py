"""Operator 7: exact dedup by progressive refinement, in DataFrame operations only.

Texts are equal when identical after each run of ASCII white space became one space. Rows are grouped by length; rows of a
length that occurs again are grouped by the hash of their first characters too; only rows whose length and head occur again
have their whole content hashed and compared by it. One pass over the texts writes length and head (narrow rows), another reads
the survivors' content: those whose head is in a broadcast list or, where that would be too long, in a bitmap of hashed heads of
bounded size, whose few false survivors drop out when narrow rows meet the heads. Groups are aggregations with partial sums
before the shuffle, so a text that a third of all rows share costs one row a task. Texts are shuffled by ``drop_exact_copies``
alone, and there only those of null or repeated ids of which some rows go and some stay.

The bitmap ends at 2^29 bits. Of h heads it lets about 1 - exp(-h / 2^29) of the other rows through: 12 % at 67 million, 61 % at
500 million. Each of these costs a digest of its own text and a narrow row; results stay what they are.

Edge cases: a null text counts as empty, and empty texts are equal to each other; a null doc_id comes after all others when
the row that stays is chosen; rows that repeat a doc_id are rows of their own, of which one stays; an empty table gives an
empty result; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hinted, normal_space, rows_of, small, stored

#: Characters whose hash makes the second level.
HEAD = 256
#: Rows of a key table up to which it is broadcast (16 bytes a row).
BROADCAST_ROWS = 500_000
#: Bits of a bitmap for each head, and in all at most (64 MB); bits of one of its rows.
BITS_A_HEAD, MOST_BITS, ROW_BITS = 8, 1 << 29, 1 << 15


def digest(text_col: str = "text"):
    return F.sha2(normal_space(F.col(text_col)).cast("binary"), 256)


def bitmap(heads: DataFrame) -> tuple[DataFrame, int]:
    """Rows (slot, bits) of a bitmap in which the hash of each head of heads (n2, head2) is set, and its number of bits."""
    wanted = max(1, rows_of(heads)) * BITS_A_HEAD
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (wanted - 1).bit_length()))
    at = place(F.col("n2"), F.col("head2"), bits)
    return heads.groupBy(slot_of(at).alias("slot")).agg(F.bitmap_construct_agg(at % ROW_BITS).alias("bits")), bits


def place(n: Column, head: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(n, head), F.lit(bits))


def slot_of(at: Column) -> Column:
    return F.floor(at / ROW_BITS).cast("bigint")


def is_set(bits: Column, at: Column) -> Column:
    """The bit of a row of the bitmap; false where there is no such row."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at % ROW_BITS / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False))


def surviving(sized: DataFrame, heads: DataFrame) -> DataFrame:
    """sized with survives: true for every row whose length and head are in heads, and few others."""
    if small(heads, BROADCAST_ROWS):
        same = (F.col("n") == F.col("n2")) & (F.col("head") == F.col("head2"))
        return sized.join(F.broadcast(heads), same, "left").withColumn("survives", F.col("n2").isNotNull()).drop("n2", "head2")
    rows, bits = bitmap(heads)
    at = place(F.col("n"), F.col("head"), bits)
    met = sized.join(F.broadcast(stored(rows, "bitmap")), slot_of(at) == F.col("slot"), "left")  # MOST_BITS at most
    return met.withColumn("survives", is_set(F.col("bits"), at)).drop("slot", "bits")


def refined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """From stored tables: row (a number of its own), doc_id, crowded, text_sha256 (null where not needed, unless digest_all)."""
    clean = normal_space(F.col(text_col))
    sized = docs.select(F.col(id_col).alias("doc_id"), clean.alias("clean")).withColumn("n", F.length("clean")).withColumn("head", F.xxhash64(F.substring("clean", 1, HEAD)))
    narrow = stored(sized.select("n", "head"), "narrow")
    # Level 1: lengths that occur again. Level 2: heads of those lengths that occur again.
    lengths = stored(narrow.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").select(F.col("n").alias("n1")), "lengths")
    heads = narrow.join(hinted(lengths, BROADCAST_ROWS), F.col("n") == F.col("n1"), "left_semi")
    heads = stored(heads.groupBy("n", "head").agg(F.count("*").alias("c")).where("c > 1").select(F.col("n").alias("n2"), F.col("head").alias("head2")), "heads")
    # Level 3: the whole content, of survivors only.
    full = F.sha2(F.col("clean").cast("binary"), 256)
    met = surviving(sized.withColumn("row", F.monotonically_increasing_id()), heads)
    met = stored(met.select("row", "doc_id", "n", "head", "survives", (full if digest_all else F.when(F.col("survives"), full)).alias("text_sha256")), "content")
    if small(heads, BROADCAST_ROWS):
        out = met.withColumn("crowded", F.col("survives"))
    else:  # the bitmap's false survivors drop out
        out = met.join(heads, (F.col("n") == F.col("n2")) & (F.col("head") == F.col("head2")), "left").withColumn("crowded", F.col("n2").isNotNull())
    out = out.select("row", "doc_id", "crowded", "text_sha256")
    discard(narrow, lengths)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = True) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = refined(docs, id_col, text_col, digest_all)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    groups = stored(rows.where("crowded").groupBy(F.col("text_sha256").alias("sha")).agg(first.alias("first"), F.count("*").alias("size")).where("size > 1"), "groups")
    # Two plain sides, so that a join of shuffled rows can split a text that a third of them share.
    out = rows.join(hinted(groups, BROADCAST_ROWS), F.col("crowded") & (F.col("text_sha256") == F.col("sha")), "left")
    return out.select(
        "doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of equal texts the one with the smallest doc_id."""
    groups = stored(exact_groups(docs, digest_all=False).where("group_size > 1"), "copies")
    lost = groups.where("not kept").groupBy("doc_id").agg(F.count("*").alias("lost")).select(F.col("doc_id").alias("__id"), "lost")
    lost = stored(lost, "lost")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    # An id goes outright only if each of its rows, also those whose text no other row has, is a copy that goes.
    rows = docs.select("doc_id").join(hinted(lost.select("__id"), BROADCAST_ROWS, lost), F.col("doc_id") == F.col("__id")).groupBy("__id").agg(F.count("*").alias("rows"))
    by_id = stored(lost.join(rows, "__id", "left").select("__id", F.coalesce(F.col("lost") == F.col("rows"), F.lit(False)).alias("all")), "lost-ids", torn=F.count_if(~F.col("all")))
    out = docs.join(hinted(by_id.where("all").select("__id"), BROADCAST_ROWS, by_id), same, "left_anti")
    torn = by_id.where("not all").select("__id")
    if not by_id._tidemill_seen.get("torn", 1):
        return out
    # Null ids and repeated ids, some of whose rows go: these are told apart by their text.
    repeats = hinted(torn, BROADCAST_ROWS, by_id)
    pairs = groups.join(repeats, same, "left_semi").groupBy(F.col("doc_id").alias("__keep"), F.col("text_sha256").alias("__sha")).agg(F.max("kept").alias("stays"))
    own = out.join(repeats, same, "left_semi").withColumn("__digest", digest())
    own = own.join(pairs.where("not stays"), F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.col("__digest") == F.col("__sha")), "left_anti")
    return out.join(repeats, same, "left_anti").unionByName(own.dropDuplicates(["doc_id", "__digest"]).drop("__digest"))
