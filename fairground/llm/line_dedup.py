"""Line deduplication with DataFrame functions only.

Lines are exploded, normalised and hashed; distinct documents are counted for each
hash; lines over the threshold go from all but the document with the largest id, and
what stays is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, unpacked

#: The white space that a line's key loses at both ends: space and \x09 to \x0D.
EDGE = " \t\n\x0b\x0c\r"
#: A line is hot if it is more than this part of what is joined.
HOT = 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """``line`` without white space at its ends, A-Z in lower case, other letters as they are."""
    key = F.btrim(line, F.lit(EDGE))
    ascii_only = F.octet_length(key) == F.length(key)
    return F.when(ascii_only, F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with their texts deduplicated, and ``n_lines`` and ``n_dropped``.

    Null or empty text is one empty line. A key of ``min_chars`` code points or more that
    stands in ``min_docs`` distinct ids or more stays only in the largest id holding it;
    there, each of its lines stays. Rows that repeat an id are one document for the count,
    and each is cleaned by itself. Rows with a null id neither count nor lose lines. A
    document that loses all lines becomes an empty text. Extra columns pass unchanged; an
    empty table gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = packed(docs, id=F.col(f"`{id_col}`"), text=text, text_hash=F.xxhash64(text))
    lines = rows.where(F.col("id").isNotNull()).select("id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keys.select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))

    # Two exchanges: a line that stands in most documents is counted in parts.
    counted = hashed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("id").alias("keeper"))
    frequent = stored(counted.where(F.col("n") >= min_docs), "frequent-lines")
    # A line that holds over 1/HOT of all documents' frequent lines is dealt to several tasks. There
    # are fewer than HOT such lines, whatever the table's size, so they can be broadcast.
    total = frequent.agg(F.sum("n")).first()[0] or 0
    salted = frequent.withColumn("salts", F.when(F.col("n") * HOT > total, F.ceil(F.col("n") * HOT / F.lit(max(total, 1)))).otherwise(1).cast("int"))
    hot = salted.where("salts > 1").select("h1", "h2", "salts")
    salt = F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.lit(0))
    dealt = hashed.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", salt).drop("salts")
    keepers = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("h1", "h2", "salt", "keeper")
    dropped = dealt.join(keepers, ["h1", "h2", "salt"]).where(F.col("id") != F.col("keeper"))
    # Rows with one id and one text lose the same lines, so a set of positions is theirs in common.
    places = dropped.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("places"))

    cleaned = rows.join(places, ["id", "text_hash"], "left")
    split = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda p: F.get(F.col("lines"), p)), "\n"))
    out = cleaned.withColumn("lines", split)
    return unpacked(out, docs, **{text_col: kept, "n_lines": F.size("lines").cast("long"), "n_dropped": F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long")})
