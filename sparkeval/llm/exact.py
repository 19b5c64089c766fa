"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Groups of rows are split in three steps, and a row leaves as soon as it is alone.  The first
scan counts the classes of one length (in bytes) and one hash of the first characters: these
are narrow keys, summed map-side, and no text is shuffled.  The second scan hashes the whole
text of the rows whose class has two rows or more, and of no others.  Which classes those are
goes to the tasks as a bitmap of a fixed number of bits (``BITS``); two classes may share a bit,
which costs a hash and changes nothing, since groups are those of the full hash.  Then only ids and
hashes are shuffled.

A text that a large part of all rows repeats is no hot key: groups are counted with partial
sums, and those of more than a thousandth of the rows, of which there are fewer than a thousand, are
joined by broadcast; the keys of all other rows are spread.

Reading a Parquet table's text column costs the same for a prefix as for the whole, so the two
scans both read it; what the refinement saves is the hashing and the shuffle of full hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

PREFIX = 64
BITS = 24  # the bitmap: 2^18 rows of 64 bits at most, about 10 MB when it is broadcast
HEAVY = 1000


def _keys(text: Column, prefix: int) -> tuple[Column, Column]:
    return F.octet_length(text), F.xxhash64(F.substring(text, 1, prefix))


def _bit(bits: int) -> Column:
    return F.pmod(F.xxhash64("__len", "__head"), F.lit(1 << bits))


def _bitmap(classes: DataFrame, bits: int) -> DataFrame:
    """``__word, __mask``: the bits of the classes that have more than one row."""
    bit = classes.where("__n > 1").select(_bit(bits).alias("bit"))
    mask = F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))"))
    return bit.groupBy(F.expr("shiftright(bit, 6)").alias("__word")).agg(mask.alias("__mask"))


def groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """A row for each document: its id, ``keep_id``, ``group_size``, ``kept``, ``full_sha256`` and ``carry``.

    Texts are equal when identical, byte for byte; a null text is the empty text, and empty
    texts are equal to each other.  Of a group the largest id stays.  ``full_sha256`` is null for the rows
    that a shorter key told apart from all others, as their text was not hashed.  ``carry`` names further
    expressions of the input row, which must be narrow, as they travel with the id.

    Rows that repeat an id with an equal text are one document: each of them counts in ``group_size``
    and all have the same mark.  Rows of one id with different texts belong to different groups.  A null id is smaller than
    all others; a group of null ids alone keeps them.  An empty table gives an empty table.  Very
    long texts are read whole.  Other columns of the input, whatever their names, take no part.
    """
    carry = carry or {}
    made = {"keep_id", "group_size", "kept", "full_sha256"}
    if clash := ({id_col, *carry} & made) | ({id_col} & set(carry)):
        raise ValueError(f"columns that the result makes itself: {sorted(clash)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    length, head = _keys(text, prefix)
    classes = docs.select(length.alias("__len"), head.alias("__head")).groupBy("__len", "__head").agg(F.count("*").alias("__n"))
    scanned = docs.select(F.col(id_col).alias("__id"), F.struct(F.lit(0).alias("__"), *[c.alias(n) for n, c in carry.items()]).alias("__carry"), text.alias("__text"), length.alias("__len"), head.alias("__head"))
    placed = scanned.withColumn("__bit", _bit(bits)).withColumn("__word", F.expr("shiftright(__bit, 6)"))
    tested = placed.join(F.broadcast(_bitmap(classes, bits)), "__word", "left")
    alive = F.coalesce(F.expr("shiftright(__mask, cast(__bit & 63 as int)) & 1L = 1L"), F.lit(False))
    # narrow from here on: the text stays in the scan
    rows = cut(spark, tested.select("__id", "__carry", F.when(alive, F.sha2("__text", 256)).alias("__full")))

    same = rows.where("__full is not null").groupBy("__full").agg(F.count("*").alias("__n"), F.max("__id").alias("__keep")).where("__n > 1")
    total = same.agg(F.sum("__n").alias("__total"))
    sized = same.join(F.broadcast(total)).withColumn("__hot", F.col("__n") * HEAVY > F.col("__total")).drop("__total")
    hot = sized.where("__hot").select(F.col("__full"), F.struct("__n", "__keep").alias("__h"))
    rest = sized.where("not __hot").select(F.col("__full").alias("__key"), F.struct("__n", "__keep").alias("__g"))
    # a row without a partner to look for takes a key of its own, so that no key is shared by many
    alone = F.concat(F.lit("-"), F.xxhash64("__id", "__carry").cast("string"))
    keyed = rows.join(F.broadcast(hot), "__full", "left").withColumn("__key", F.when(F.col("__h").isNull() & F.col("__full").isNotNull(), F.col("__full")).otherwise(alone))
    found = keyed.join(rest, "__key", "left").withColumn("__f", F.coalesce("__h", "__g"))
    keep = F.when(F.col("__f").isNull(), F.col("__id")).otherwise(F.col("__f.__keep"))
    return found.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("__f.__n", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"),
        F.col("__full").alias("full_sha256"),
        *[F.col(f"__carry.`{n}`").alias(n) for n in carry],
    )


def deduplicate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row goes if an equal text has a larger id.  Rows that repeat an id and a text all stay, as no
    rule tells them apart.
    """
    gone = groups(spark, docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone"), "full_sha256").distinct()
    full = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]) & (full == gone["full_sha256"]), "left_anti")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of query op13; the digest of every text is one more column of the scan."""
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return groups(spark, docs, carry={"text_sha256": sha}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
 doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
