"""Canonical records to normalised ones, their attributes and their blocking keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.functions import text as t


def normalized(records: DataFrame) -> DataFrame:
    phones = F.transform("phones", t.phone)
    out = records.select(
        "record_id", "source", F.col("ingested_at").try_cast("timestamp_ntz").alias("ingested_at"),
        F.coalesce("name", F.lit("")).alias("display_name"), t.name_tokens(F.col("name")).alias("name_tokens"),
        t.birth_date(F.col("dob")).alias("dob"), F.array_distinct(F.filter(phones, lambda p: p.isNotNull())).alias("phones"),
        t.email(F.col("email")).alias("email"), t.address(t.blank_to_null(F.col("address"))).alias("address"),
        t.pincode(t.blank_to_null(F.col("address")), F.col("pincode")).alias("pincode"), t.hashed_id(F.col("gov_id")).alias("id_hash"),
        t.blank_to_null(F.col("device_id")).alias("device_id"),
        F.size(F.filter(F.col("phones"), lambda p: (F.coalesce(p, F.lit("")) != "") & t.phone(p).isNull())).alias("_bad"),
        F.col("email").alias("_email"), F.col("dob").alias("_dob"), *[c for c in ("arrival",) if c in records.columns],
    )
    wrong = lambda raw, clean: (F.coalesce(raw, F.lit("")) != "") & clean.isNull()
    flags = F.concat(
        F.array_repeat(F.lit("invalid_phone"), F.col("_bad")),
        F.array_compact(F.array(
            F.when(wrong(F.col("_email"), F.col("email")), "invalid_email"),
            F.when(wrong(F.col("_dob"), F.col("dob")), "invalid_dob"),
            F.when(F.size("name_tokens") == 0, "missing_name"),
        )),
    )
    return out.withColumn("quality_flags", flags).drop("_bad", "_email", "_dob")


def attributes(records: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(record_id, kind, value) without repetition, of all kinds or of some; nkey holds sounds of tokens longer than one."""
    def pairs(kind: str, values) -> F.Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    keys = F.filter(F.transform(F.filter("name_tokens", lambda x: F.length(x) > 1), t.sound_key), lambda k: k != "")
    values = {
        "phone": F.col("phones"), "email": F.array("email"), "device": F.array("device_id"), "address": F.array("address"), "id": F.array("id_hash"), "nkey": keys,
    }
    every = F.concat(*[pairs(kind, v) for kind, v in values.items() if kinds is None or kind in kinds])
    return (
        records.select("record_id", F.explode(F.array_distinct(every)).alias("a"))
        .select("record_id", "a.kind", "a.value").where("value is not null")
    )


def blocking_keys(records: DataFrame) -> DataFrame:
    """(record_id, ingested_at, key): identifiers, and sounds of names with an initial or a birth date; ``arrival`` too if it is there."""
    toks = F.transform("name_tokens", lambda x, i: F.struct(x.alias("t"), i.alias("i"), t.sound_key(x).alias("k")))
    full = F.filter("_toks", lambda x: F.length(x["t"]) >= 2)
    initials = F.flatten(F.transform(full, lambda a: F.transform(
        F.filter("_toks", lambda b: b["i"] != a["i"]),
        lambda b: F.concat(F.lit("nm:"), a["k"], F.lit("|"), F.substring(b["t"], 1, 1)),
    )))
    dated = F.transform(full, lambda a: F.concat(F.lit("nd:"), a["k"], F.lit("|"), F.date_format("dob", "yyyy-MM-dd")))
    one = lambda tag, c: F.array(F.concat(F.lit(tag), F.col(c)))
    every = F.concat(
        F.transform("phones", lambda p: F.concat(F.lit("ph:"), p)), one("em:", "email"), one("id:", "id_hash"), one("dv:", "device_id"),
        initials, dated,
    )
    return records.withColumn("_toks", toks).select(
        "record_id", "ingested_at", *[c for c in ("arrival",) if c in records.columns], F.explode(F.array_distinct(F.array_compact(every))).alias("key")
    )
