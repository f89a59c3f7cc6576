"""Revisit records: made from full records, resolved by an equi-join, merged back.

The reference of a merge is found by id. A revisit whose target isn't there, or whose id several
records have, keeps its one row with an error, so that nothing gets lost or multiplied: records
that nobody refers to are left out and those of one id counted before blocks are joined. Deduplication finds the first capture of a payload by
an aggregate, which merges before the shuffle, however hot a payload is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import digest as D
from ..functions import fields as H
from ..options import FAIL, WarcOptions
from ..schema import IDENTICAL_PROFILES, PROFILE_IDENTICAL_1_1, PROFILES

REF = ("profile", "target_record_id", "target_uri", "target_date")


def _error(kind: str, msg: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(msg).alias("msg"))


def create_revisit_ref(profile: str | Column = PROFILE_IDENTICAL_1_1) -> Column:
    """STRUCT of profile, target id, uri and date that points to the row's record; null for revisits."""
    p = F.lit(profile) if isinstance(profile, str) else profile
    ref = F.struct(p.alias("profile"), H.get_id("headers", "WARC-Record-ID").alias("target_record_id"), H.get("headers", "WARC-Target-URI").alias("target_uri"), H.get("headers", "WARC-Date").alias("target_date"))
    return F.when(F.col("record_type_code") != B.REVISIT, ref)


def revisit_ref() -> Column:
    """The reference that a revisit record holds; null for other records."""
    ref = F.struct(H.get("headers", "WARC-Profile").alias("profile"), H.get_id("headers", "WARC-Refers-To").alias("target_record_id"), H.get("headers", "WARC-Refers-To-Target-URI").alias("target_uri"), H.get("headers", "WARC-Refers-To-Date").alias("target_date"))
    return F.when(F.col("record_type_code") == B.REVISIT, ref)


def to_revisit(df: DataFrame, ref: str = "ref", options: WarcOptions | None = None) -> DataFrame:
    """Turns each record with a reference in column `ref` into a revisit; rows with a null one stay.

    An unknown profile, a missing payload digest or a block that can't be cut leaves an error.
    """
    options = options or WarcOptions()
    r, cols = F.col(ref), df.columns
    identical = r["profile"].isin(*IDENTICAL_PROFILES)
    lend = identical & (F.col("record_type_code") == 4)
    has_digest = H.has("headers", "WARC-Payload-Digest") | ((F.col("record_type_code") == 4) & H.has("headers", "WARC-Block-Digest"))
    wrong = (
        F.when(~F.coalesce(r["profile"].isin(*PROFILES), F.lit(False)), _error("profile", "no revisit has such a profile"))
        .when(identical & ~has_digest, _error("digest", "this profile needs a payload digest"))
        .when(~F.col("block_kind").isin("http_request", "http_response", "generic"), _error("block", "a block of this kind can't be that of a revisit"))
    )
    df = df.withColumn("_wrong", F.when(r.isNotNull(), wrong)).withColumn("_do", r.isNotNull() & F.col("_wrong").isNull())
    df = df.withColumn("_head", F.when(F.col("block_kind") == "generic", F.lit(b"")).otherwise(F.substring("block", F.lit(1), F.col("payload_offset"))))
    block_digest = D.digest_field("_head", options.default_algorithm, options.default_encoding)

    given = lambda name: F.coalesce(r[name], F.lit("")) != ""
    lent = lend & ~H.has("headers", "WARC-Payload-Digest") & H.has("headers", "WARC-Block-Digest")
    changes = [
        ("WARC-Payload-Digest", F.when(lent, H.get("headers", "WARC-Block-Digest"))),
        ("WARC-Type", F.lit("revisit")),
        ("WARC-Profile", r["profile"]),
        ("WARC-Refers-To", F.when(given("target_record_id"), H.bracketed(r["target_record_id"]))),
        ("WARC-Refers-To-Target-URI", F.when(given("target_uri"), r["target_uri"])),
        ("WARC-Refers-To-Date", F.when(given("target_date"), r["target_date"])),
        ("WARC-Truncated", F.lit("length")),
        ("WARC-Block-Digest", block_digest),
        ("Content-Length", F.octet_length("_head").cast("string")),
    ]
    df = df.withColumn("headers", F.when(F.col("_do"), H.set_many("headers", changes)).otherwise(F.col("headers")))
    size = F.octet_length("_head")
    changed = {
        "record_type": F.lit("revisit"), "record_type_code": F.lit(B.REVISIT), "block_kind": F.lit("revisit"), "block": F.col("_head"), "block_size": size.cast("long"),
        "content_length": size.cast("long"), "payload_offset": size, "http": F.lit(None).cast(df.schema["http"].dataType) if "http" in cols else None, "block_digest": block_digest, "payload_digest": H.get("headers", "WARC-Payload-Digest"),
    }
    df = df.withColumns({k: F.when(F.col("_do"), v).otherwise(F.col(k)) for k, v in changed.items() if v is not None and k in cols and k != "payload_digest"} | ({"payload_digest": F.when(F.col("_do"), changed["payload_digest"]).otherwise(F.col("payload_digest"))} if "payload_digest" in cols else {}))
    if "error" in cols:
        df = df.withColumn("error", F.coalesce(F.col("error"), F.col("_wrong")))
    return df.select(*cols)


def _joined(revisits: DataFrame, records: DataFrame) -> DataFrame:
    """revisits with _n, how many records have the id they refer to, and _r, that record if it is one.

    Records are read once: those that nobody refers to are left out first, by their ids alone, and of several with
    one id a task hands on one, with their number.
    """
    own = H.get_id("headers", "WARC-Record-ID")
    r = revisits.withColumn("_to", H.get_id("headers", "WARC-Refers-To"))
    wanted = r.select(F.col("_to").alias("_wanted")).where("_wanted is not null").distinct()
    target = records.select(own.alias("_target"), F.struct("headers", "block", "block_kind", "payload_offset", "record_type", "block_truncated").alias("_r"))
    target = target.where("_target is not null").join(wanted, F.col("_target") == F.col("_wanted"), "left_semi")
    one = target.groupBy("_target").agg(F.count(F.lit(1)).alias("_n"), F.first("_r").alias("_r"))
    return r.join(one, F.col("_to") == F.col("_target"), "left")


def merge(revisits: DataFrame, records: DataFrame, options: WarcOptions | None = None, *, keep_block_digest: bool = False) -> DataFrame:
    """Full records: each revisit's own HTTP header before the payload of the record it refers to.

    records are full ones. What can't be merged keeps its row, with an error. The block digest is computed anew, or
    copied from the referenced record with keep_block_digest.
    """
    options = options or WarcOptions()
    cols = revisits.columns
    d = _joined(revisits, records)
    r = F.col("_r")
    wrong = (
        F.when(H.get("headers", "WARC-Segment-Number") == "1", _error("merge", "records of several segments can't be merged"))
        .when(F.col("record_type_code") != B.REVISIT, _error("merge", "only a revisit can be merged"))
        .when(F.col("_n") > 1, _error("merge", "several records have the id that is referred to"))
        .when(F.col("_target").isNull(), _error("merge", "no record has the id that is referred to"))
        .when(F.col("block_kind") != "revisit", _error("merge", "the block wasn't parsed as that of a revisit"))
        .when(~r["block_kind"].isin("http_request", "http_response"), _error("merge", "only records with HTTP blocks can be merged into"))
        .when(F.coalesce(r["block_truncated"], F.lit(False)), _error("merge", "a row doesn't hold all of the block that is referred to"))
        .when(H.get_int64(r["headers"], "Content-Length").isNull(), _error("merge", "the length of the record that is referred to can't be read"))
    )
    d = d.withColumn("_wrong", wrong).withColumn("_do", F.col("_wrong").isNull())
    # a header without its empty line gets one, if syntax errors may pass; the length doesn't count it
    ends = B.http_head_length("block") > 0
    open_ = F.octet_length("block").cast("int")
    if options.syntax == FAIL:
        d = d.withColumn("_wrong", F.coalesce("_wrong", F.when(~ends, _error("syntax", "the HTTP header has no empty line at its end")))).withColumn("_do", F.col("_wrong").isNull())
    own = F.when(ends, F.col("block")).otherwise(F.concat("block", F.lit(b"\r\n")))
    d = d.withColumn("_block", F.concat(own, B.payload(r["block"], r["payload_offset"]))).withColumn("_cut", F.octet_length(own).cast("int"))
    length = open_.cast("long") + H.get_int64(r["headers"], "Content-Length") - r["payload_offset"]
    cut = H.get(r["headers"], "WARC-Truncated")
    digest = H.get(r["headers"], "WARC-Block-Digest") if keep_block_digest else D.digest_field("_block", options.default_algorithm, options.default_encoding)
    gone = ["WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Profile"]
    changes = [("WARC-Type", r["record_type"]), ("WARC-Truncated", cut), ("Content-Length", length.cast("string")), ("WARC-Block-Digest", digest)]
    # a field without a value of its own goes
    d = d.withColumn("_h", F.when(F.col("_do"), H.set_many(H.delete("headers", *gone), changes, keep_missing=False)).otherwise(F.col("headers")))
    new = {"headers": F.col("_h"), "block": F.col("_block"), "record_type": r["record_type"], "record_type_code": H.type_code(r["record_type"]), "block_kind": r["block_kind"], "content_length": length, "block_size": F.octet_length("_block").cast("long"), "payload_offset": F.col("_cut"), "block_digest": digest}
    if "http" in cols:
        new["http"] = B.http_struct("_block", F.col("_cut"), F.lit(False)).cast(revisits.schema["http"].dataType)
    d = d.withColumns({k: F.when(F.col("_do"), v).otherwise(F.col(k)) for k, v in new.items() if k in cols})
    if "error" in cols:
        d = d.withColumn("error", F.coalesce(F.col("error"), F.col("_wrong")))
    return d.select(*cols)


def dangling(revisits: DataFrame, records: DataFrame) -> DataFrame:
    """Revisits whose target is not among the records."""
    target = records.select(H.get_id("headers", "WARC-Record-ID").alias("_target"))
    return revisits.join(target, H.get_id("headers", "WARC-Refers-To") == F.col("_target"), "left_anti")


def referenced(records: DataFrame, revisits: DataFrame) -> DataFrame:
    """Records that some revisit refers to."""
    wanted = revisits.select(H.get_id("headers", "WARC-Refers-To").alias("_wanted")).distinct()
    return records.join(wanted, H.get_id("headers", "WARC-Record-ID") == F.col("_wanted"), "left_semi")


def deduplicate(records: DataFrame, options: WarcOptions | None = None, *, profile: str = PROFILE_IDENTICAL_1_1, order: tuple[str, ...] = ("warc_date_raw", "record_id")) -> DataFrame:
    """Records with every later capture of a payload turned into a revisit of the first by `order`.

    The digest is that of the WARC-Payload-Digest field; records without one stay.
    """
    d = records.withColumn("_pd", H.get("headers", "WARC-Payload-Digest"))
    first = d.where(can_be_first()).groupBy("_pd").agg(F.min(F.struct(*order, create_revisit_ref(profile).alias("r"))).alias("_f")).select("_pd", F.col("_f.r").alias("_ref"))
    return refer_to_first(d, first, options).select(*records.columns)


def can_be_first() -> Column:
    """Whether a record with its digest in `_pd` can be what later captures refer to."""
    return F.col("_pd").isNotNull() & (F.col("record_type_code") != B.REVISIT)


def refer_to_first(records: DataFrame, first: DataFrame, options: WarcOptions | None = None) -> DataFrame:
    """Records with a digest in `_pd` as revisits of what first (`_pd`, `_ref`) has for it; the first ones themselves stay."""
    d = records.join(first.select(F.col("_pd").alias("_p"), "_ref"), F.col("_pd") == F.col("_p"), "left")
    own = H.get_id("headers", "WARC-Record-ID")
    d = d.withColumn("_ref", F.when((F.col("record_type_code") != B.REVISIT) & (own != F.col("_ref.target_record_id")), F.col("_ref")))
    return to_revisit(d, "_ref", options)
