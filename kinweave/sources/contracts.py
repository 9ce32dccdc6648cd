"""Source contracts: validation, drift notes and the mapping into one canonical shape."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kinweave.functions.text import once


@dataclass(frozen=True)
class Contract:
    source: str
    id_field: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    fields: dict[str, str]
    phones: tuple[str, ...] = field(default=())


# Names of sources and fields, and the texts of errors below.
CONTRACTS = [
    Contract(
        "bank_kyc", "kyc_ref", ("kyc_ref", "full_name", "dob", "pan_number"), ("address_line", "pincode", "mobile"),
        {"name": "full_name", "dob": "dob", "address": "address_line", "pincode": "pincode", "gov_id": "pan_number"}, ("mobile",),
    ),
    Contract(
        "telecom", "connection_id", ("connection_id", "msisdn", "subscriber_name"), ("activation_date", "circle", "date_of_birth"),
        {"name": "subscriber_name", "dob": "date_of_birth"}, ("msisdn",),
    ),
    Contract(
        "ecommerce", "customer_id", ("customer_id", "display_name", "email"), ("phone", "shipping_address", "device_id"),
        {"name": "display_name", "email": "email", "address": "shipping_address", "device_id": "device_id"}, ("phone",),
    ),
]
CANONICAL = ["name", "dob", "address", "pincode", "gov_id", "email", "device_id"]
ENVELOPE = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("ingested_at", T.StringType()),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
])


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of a JSON Lines folder or file, with the raw line and what was wrong with it.

    ``arrival`` is the order of the lines, of several files in that of their names: the file,
    the start of the block it was read in, and the place in it. A file is read in blocks, and
    by many tasks, without a count of the lines before.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("raw"),
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
        ).alias("arrival"),
    )
    return parse(lines)


#: An object of a few texts without escapes, as most payloads are; it has no value that is no text.
_ALL_TEXTS = r'^\s*+\{\s*+(?:"[^"\\]*+"\s*+:\s*+"[^"\\]*+"\s*+(?:,\s*+(?=")|(?=\}))){0,40}\}\s*+$'


def parse(lines: DataFrame) -> DataFrame:
    """(raw, source, ingested_at, payload, broken) from a column ``raw`` of JSON text.

    A line that is no JSON object is broken. A payload that is no object is null.
    ``not_text`` lists the fields of the payload that a contract knows and whose value is no
    JSON text; an optional one of them is taken as the text it is written as.
    """
    known = sorted({f for c in CONTRACTS for f in c.required + c.optional})
    kind = lambda tree, f: F.schema_of_variant(F.try_variant_get(tree, f"$.{f}", "variant"))
    kinds = lambda tree: F.array(*[F.struct(F.lit(f).alias("field"), kind(tree, f).alias("kind")) for f in known])
    other = F.filter(once(F.try_parse_json(F.col("_e.payload")), kinds), lambda x: x["kind"] != "STRING")["field"]
    other = F.when(F.col("_e.payload").rlike(_ALL_TEXTS), F.array().cast("array<string>")).otherwise(other)
    at = F.try_variant_get(F.try_parse_json("raw"), "$.ingested_at", "variant")
    # no time at all: false, zero, an empty list or object, as is an empty text or null
    blank = F.col("_e.ingested_at").isin("false", "[]", "{}") | (F.col("_e.ingested_at").try_cast("double") == 0)
    nothing = F.coalesce(blank, F.lit(False)) & (F.schema_of_variant(at) != "STRING")  # the line is parsed again only for such values
    body = F.from_json("raw", T.StructType([T.StructField("source", T.StringType()), T.StructField("ingested_at", T.StringType()), T.StructField("payload", T.StringType())]))
    is_object = F.get_json_object("raw", "$").rlike("^\\s*\\{")
    return lines.withColumn("_e", body).select(
        *lines.columns, F.col("_e.source").alias("source"),
        F.when(~F.coalesce(nothing, F.lit(False)), F.col("_e.ingested_at")).alias("ingested_at"),
        F.when(F.col("_e.payload").rlike("^\\s*\\{"), F.from_json("_e.payload", "map<string,string>")).alias("payload"),
        F.when(F.col("_e.payload").rlike("^\\s*\\{"), other).alias("not_text"),
        (~F.coalesce(is_object, F.lit(False))).alias("broken"),
    )


def _listed(names: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def _by_source(make) -> Column:
    out = F.lit(None)
    for c in reversed(CONTRACTS):
        out = F.when(F.col("source") == c.source, make(c)).otherwise(out)
    return out


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)]).cast("array<string>")


def missing_fields() -> Column:
    return _by_source(lambda c: F.array_except(_names(c.required), F.map_keys("payload")))


def unexpected_fields() -> Column:
    return _by_source(lambda c: F.array_sort(F.array_except(F.map_keys("payload"), _names(c.required + c.optional))))


def _empty(value: Column) -> Column:
    """Whether a text has nothing but white space, of Unicode too, or is null."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "(?U)[\\s\\x1c-\\x1f]+", "") == ""


def contract_error(not_text: Column | None = None) -> Column:
    """The first broken rule as text, or null; ``not_text`` lists fields whose value is no text."""
    other = F.coalesce(not_text, F.array().cast("array<string>")) if not_text is not None else F.array().cast("array<string>")
    missing, extra = missing_fields(), unexpected_fields()
    drift = F.when(F.size(extra) > 0, F.concat(F.lit("; unexpected field(s) "), _listed(extra), F.lit(" - possible schema drift"))).otherwise(F.lit(""))
    blank = _by_source(lambda c: F.get(F.filter(_names(c.required), lambda f: _empty(F.try_element_at("payload", f)) | F.array_contains(other, f)), F.lit(0)))
    return F.coalesce(
        F.when(~F.coalesce(F.col("source").isin([c.source for c in CONTRACTS]), F.lit(False)),
               F.concat(F.lit("unknown source: "), F.coalesce(F.concat(F.lit("'"), "source", F.lit("'")), F.lit("None")))),
        F.when(F.coalesce("ingested_at", F.lit("")) == "", F.lit("missing ingested_at")),
        F.when(F.col("payload").isNull(), F.lit("payload must be an object")),
        F.when(F.size(missing) > 0, F.concat("source", F.lit(": missing required field(s) "), _listed(missing), drift)),
        F.when(blank.isNotNull(), F.concat("source", F.lit(": field '"), blank, F.lit("' must be a non-empty string"))),
    )


def time_error() -> Column:
    """What is wrong with a time that no clock shows; such a record would be in no view at any time."""
    unread = F.col("ingested_at").try_cast("timestamp_ntz").isNull()
    return F.when(unread, F.concat(F.lit("ingested_at is no time: '"), "ingested_at", F.lit("'")))


def validated(envelopes: DataFrame) -> DataFrame:
    return envelopes.withColumn("error", contract_error(F.col("not_text") if "not_text" in envelopes.columns else None))


def canonical(valid: DataFrame) -> DataFrame:
    """Canonical records of the envelopes without an error."""
    at = lambda name: F.try_element_at("payload", F.lit(name))
    cols = [
        _by_source(lambda c, k=k: at(c.fields[k]) if k in c.fields else F.lit(None)).cast("string").alias(k) for k in CANONICAL
    ]
    phones = _by_source(lambda c: F.filter(F.array(*[at(p) for p in c.phones]), lambda p: F.coalesce(p, F.lit("")) != ""))
    return valid.where("error is null").select(
        _by_source(lambda c: at(c.id_field)).alias("record_id"), "source", "ingested_at", *cols,
        phones.alias("phones"), unexpected_fields().alias("unexpected_fields"), *[c for c in ("arrival",) if c in valid.columns],
    )
