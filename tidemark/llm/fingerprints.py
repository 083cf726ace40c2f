"""Document fingerprints: canonical exact digests.

A text is normalised (compatibility composition and full case folding, both repeated so that the
result is stable), runs of white space become one space, and ends are trimmed. The digest is two
64-bit xxhashes with different seeds. Texts and edited texts with equal digests form a bucket, in
which the canonical bytes are compared; where a bucket has several, all but the first in byte order
get a number after the digest. Likeness of two texts is 1 if their canonical bytes are equal and 0
otherwise, compared byte for byte.

The next document, in descending order of doc_id, is found without a global sort: ids are cut into
blocks by their leading bits, a window looks ahead within a block, and the last row of a block takes
the first text of the next block that has rows. Blocks that hold too many rows are cut further, by
more bits and, where many rows share one id or have none, by a hash of the text. All texts are
shuffled once, for that. Buckets are found by counts that combine before their shuffle, and texts
are read a second time only where a bucket has several sources. All of it is JVM-side;
normalisation calls the ICU classes that Spark has.

Defined cases: a null text is empty; an empty text has the digest of no bytes and an empty edit;
rows without doc_id come last; rows with equal doc_id follow each other in the order of a hash of
their texts, then of the texts; a single row is its own next one; an empty table gives no rows; a
doc_id that is no integer raises TypeError; input columns named like a result column are replaced,
and names of inner columns do not meet those of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import integer, only, release, staged

#: rows of a block, about; a block of over four times as many, or four times the mean, is cut
BLOCK_ROWS = 512
#: leading bits of an id that tell the first blocks, at most, and those of each further cut
FIRST_BITS, MORE_BITS, TIE_BITS = 16, 8, 32
RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_ICU = "com.ibm.icu"


def _icu(text: Column) -> Column:
    compose = lambda c: F.reflect(F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit(f"{_ICU}.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return compose(fold(compose(fold(compose(text)))))


def canonical(text: Column) -> Column:
    """Canonical form of a text that is not null."""
    folded = F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(_icu(text))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hex digits."""
    part = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit(1), canon)))


def blocked(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` (bigint ``id``, ``tie``) with ``block``, a struct that sorts like its rows. Blocks that
    are cut are at most four times 2**14 for each cut, so few rows are broadcast."""
    low, high, n = df.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    most = max(4 * block_rows, n >> FIRST_BITS - 2)
    bits = ((low or 0) ^ (high or 0)).bit_length() if (low or 0) >= 0 or (high or 0) < 0 else 64
    shift = max(0, bits - min(FIRST_BITS, (n // block_rows).bit_length()))
    # cuts: by so many bits of the id and of the tie left out
    cuts = [(s, TIE_BITS) for s in (*range(shift, 0, -MORE_BITS), 0)] + [(0, t) for t in range(TIE_BITS - MORE_BITS, -1, -MORE_BITS)]
    cells = [F.struct(F.col("id").isNotNull().cast("int").alias("live"), _floor(F.coalesce("id", F.lit(0)), s).alias("id"), _floor(F.col("tie"), t if t < TIE_BITS else 64).alias("tie")) for s, t in cuts]
    out, narrow, held = df.withColumn("block", cells[0]), df.select("id", "tie"), None
    for cell, finer in zip(cells[:-1], cells[1:], strict=True):
        narrow = narrow.withColumn("cell", cell)
        heavy = narrow.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("cell")
        if heavy.isEmpty():
            return out
        held = staged(heavy, "cells", narrow=True)
        narrow = narrow.join(F.broadcast(held), "cell", "left_semi").drop("cell")
        out = out.withColumn("cell", cell).join(F.broadcast(held.withColumn("cut", F.lit(True))), "cell", "left")
        out = out.withColumn("block", F.when(F.col("cut"), finer).otherwise(F.col("block"))).drop("cell", "cut")
    return out


def _floor(value: Column, bits: int) -> Column:
    return F.shiftleft(F.shiftright(value, bits), bits) if bits < 64 else F.lit(0).cast("bigint")


def with_next(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` (columns ``id, text`` and others) with ``row``, a hash of both, and ``next`` and
    ``next_row``, those of the next document in descending order of id."""
    tie = F.shiftrightunsigned(F.xxhash64("text"), 64 - TIE_BITS)
    rows = blocked(df.withColumns({"tie": tie, "row": F.xxhash64("id", "text")}), block_rows)
    order = Window.partitionBy("block").orderBy(F.col("id").desc_nulls_last(), F.desc("tie"), "text")
    ahead = rows.withColumns({"ahead": F.lead("text").over(order), "ahead_row": F.lead("row").over(order)})
    heads = rows.select("block", "id", "tie", "text", "row").withColumn("rank", F.row_number().over(order)).where("rank = 1")
    # the number of blocks has a fixed bound
    blocks = rows.select("block").distinct()
    line = Window.orderBy(F.desc("block"))
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.lead("block").over(line), F.first("block").over(whole)).alias("after"))
    heads = blocks.join(heads.select(F.col("block").alias("after"), F.col("text").alias("head"), F.col("row").alias("head_row")), "after").drop("after")
    out = ahead.join(heads, "block").withColumns({"next": F.coalesce("ahead", "head"), "next_row": F.coalesce("ahead_row", "head_row")})
    return out.drop("block", "tie", "ahead", "ahead_row", "head", "head_row")


def edited(text: Column, following: Column) -> Column:
    """The later half of a text replaced by as many code points of the next document's beginning."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.substring(following, F.lit(1), half))


def _made(base: DataFrame, digest) -> DataFrame:
    """The result as if no bucket were mixed, staged."""
    rows = with_next(base).withColumn("edit", edited(F.col("text"), F.col("next")))
    rows = rows.select("kept", "row", "next_row", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("edit", "utf-8"), 256).alias("edited_sha256"), canonical(F.col("text")).alias("a"), canonical(F.col("edit")).alias("b"), canonical(F.col("next")).alias("c"))
    made = rows.select(
        "kept",
        "row",
        "next_row",
        "n_chars",
        "edited_sha256",
        digest(F.col("a")).alias("fingerprint"),
        digest(F.col("b")).alias("edited_fingerprint"),
        (F.col("a") == F.col("b")).cast("double").alias("near_edited"),
        (F.col("a") == F.col("c")).cast("double").alias("near_next"),
    )
    return staged(made, "fingerprints")


def _forms(base: DataFrame, made: DataFrame, digest) -> DataFrame:
    """``fingerprint, row, next_row, canon`` of texts (``next_row`` null) and of edited texts that
    differ from their text, in buckets that have several sources (and of some others)."""
    none = F.lit(None).cast("bigint")
    edits = made.where("near_edited = 0").select(F.col("edited_fingerprint").alias("fingerprint"), "row", "next_row")
    sources = made.select("fingerprint", "row", none.alias("next_row")).union(edits)
    mark = F.xxhash64("row", "next_row")
    several = sources.groupBy("fingerprint").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).where("x <> y").select("fingerprint")
    members = staged(sources.join(several, "fingerprint").distinct(), "members", narrow=True)
    texts = base.select(F.xxhash64("id", "text").alias("row"), "text")
    whole = only(texts, members.where("next_row is null").select("row"), "row").select(none.alias("next_row"), "row", canonical(F.col("text")).alias("canon"))
    edits = members.where("next_row is not null")
    named = only(texts, edits.select(F.explode(F.array("row", "next_row")).alias("row")), "row").groupBy("row").agg(F.first("text").alias("text"))
    both = edits.join(named, "row").join(named.select(F.col("row").alias("next_row"), F.col("text").alias("next")), "next_row")
    both = both.select("next_row", "row", canonical(edited(F.col("text"), F.col("next"))).alias("canon"))
    return whole.union(both).select(digest(F.col("canon")).alias("fingerprint"), "row", "next_row", "canon")


def fingerprint_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, digest=digest) -> DataFrame:
    """``df`` (its columns ``keep``; all without the text by default) with ``RESULT``."""
    keep = list(dict.fromkeys([doc_id, *(c for c in keep or df.columns if c not in RESULT and c != text)]))
    base = df.select(F.struct(*keep).alias("kept"), integer(df, doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = _made(base, digest)
    # frames of the text shuffle are gone now, so its files can go
    release(made.sparkSession)
    forms = _forms(base, made, digest)
    mixed = forms.groupBy("fingerprint").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("fingerprint")
    if not mixed.isEmpty():
        mixed = staged(mixed, "mixed-buckets", narrow=True)
        forms = staged(forms.join(mixed, "fingerprint"), "forms")
        rank = F.dense_rank().over(Window.partitionBy("fingerprint").orderBy("canon"))
        ranks = forms.select("fingerprint", "canon").distinct().withColumn("rank", rank).where("rank > 1")
        forms = forms.join(ranks, ["fingerprint", "canon"]).select("fingerprint", "row", "next_row", "rank").distinct()
        numbered = lambda fp, rank: F.concat(fp, F.coalesce(F.concat(F.lit("-"), F.col(rank).cast("string")), F.lit("")))
        own = forms.where("next_row is null").select("fingerprint", "row", F.col("rank").alias("own"))
        other = forms.where("next_row is not null").select(F.col("fingerprint").alias("edited_fingerprint"), "row", "next_row", F.col("rank").alias("other"))
        made = made.join(own, ["fingerprint", "row"], "left").join(other, ["edited_fingerprint", "row", "next_row"], "left")
        made = made.withColumn("fingerprint", numbered(F.col("fingerprint"), "own"))
        made = made.withColumn("edited_fingerprint", F.when(F.col("near_edited") == 1, F.col("fingerprint")).otherwise(numbered(F.col("edited_fingerprint"), "other")))
    return made.select("kept.*", *RESULT)
