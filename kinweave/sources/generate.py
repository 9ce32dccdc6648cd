"""Synthetic people, families and fraud rings, and their messy records in three sources.

Every draw is a hash of the seed, a name for the draw and the keys of the row, so rows do not
depend on partitioning and any number of people can be made in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinweave.sources.bridge import FIRST, LAST, STREETS

#: How letters after the first of a name may be spelled in another way; a name has a spelling
#: for each that changes it.
RESPELLED = [("v", "w"), ("t", "th"), ("d", "dh"), ("i", "ee"), ("a", "aa"), ("u", "oo"), ("k", "kh"), ("j", "z")]
SPAN_DAYS, BURST_DAYS = 180, 14
FAMILY_SHARE, MEAN_FAMILY = 0.35, 3.35
_UNIT = 1 << 30


#: Telecom circles, as areas of service are called.
CIRCLES = ["north", "south", "east", "west", "central"]


class _Draws:
    def __init__(self, seed: int) -> None:
        self.seed = seed

    def share(self, name: str, *keys: str) -> Column:
        """Uniform in [0, 1)."""
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(name), *keys), F.lit(_UNIT)) / float(_UNIT)

    def upto(self, n: int, name: str, *keys: str) -> Column:
        """Uniform in 0 .. n - 1."""
        return F.floor(self.share(name, *keys) * n).cast("int")

    def one_of(self, options: list, name: str, *keys: str) -> Column:
        return F.get(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), self.upto(len(options), name, *keys))

    def weighted(self, options: list[tuple[Column, float]], name: str, *keys: str) -> Column:
        """One of the options, each with its probability; the last takes what is left."""
        drawn, upto, out = self.share(name, *keys), 0.0, None
        for value, weight in options[:-1]:
            upto += weight
            out = F.when(drawn < upto, value) if out is None else out.when(drawn < upto, value)
        return out.otherwise(options[-1][0])


def _people(spark: SparkSession, persons: int, rings: int, d: _Draws) -> DataFrame:
    """One row for each person; ``number`` is unique, ``unit`` that of the first of a family or ring."""
    families = round(FAMILY_SHARE * persons / MEAN_FAMILY)
    singles = max(0, persons - round(families * MEAN_FAMILY))

    def made(kind: str, n: int, first: int, width: int, size: Column) -> DataFrame:
        rows = spark.range(n).select((F.lit(first) + F.col("id") * width).alias("unit"), F.lit(kind).alias("kind"))
        rows = rows.withColumn("size", size).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
        return rows.withColumn("number", F.col("unit") + F.col("k"))

    size = F.lit(1) + (d.share("spouse", "unit") < 0.85).cast("int") + d.upto(4, "children", "unit")
    out = made("family", families, 0, 8, size).union(made("single", singles, 8 * families, 1, F.lit(1)))
    return out.union(made("ring", rings, 8 * families + singles, 16, F.lit(4) + d.upto(6, "ring size", "unit")))


def _minted(d: _Draws) -> dict[str, Column]:
    """What a person has; unique by construction up to 4 * 10**9 people."""
    ring, family, n = F.col("kind") == "ring", F.col("kind") == "family", F.col("number")
    own_phone = F.when(family & (d.share("shared phone", "unit") < 0.5), F.col("unit")).when(ring, F.col("unit") + F.col("k") % 2).otherwise(n)
    devices = F.lit(1) + d.upto(2, "ring devices", "unit")
    own_device = F.when(family & (d.share("shared device", "unit") < 0.3), F.col("unit")).when(ring, F.col("unit") + F.col("k") % devices).otherwise(n)
    house = F.when(family | (ring & (d.share("ring address", "number") < 0.7)), F.col("unit")).otherwise(n)
    letters = [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.floor(n / (10_000 * 26**i)) % 26 + 1).cast("int"), F.lit(1)) for i in range(5)]
    begin = F.when(ring, d.upto(SPAN_DAYS - BURST_DAYS, "ring start", "unit") + d.share("burst", "number") * (BURST_DAYS - 4))
    return {
        "first": d.one_of(FIRST.split(","), "first", "number"),
        "last": F.when(family, d.one_of(LAST.split(","), "family name", "unit")).otherwise(d.one_of(LAST.split(","), "last", "number")),
        "mobile": F.concat((F.floor(own_phone / 10**9) % 4 + 6).cast("string"), F.lpad(((own_phone * 387_420_489 + 123_456_789) % 10**9).cast("string"), 9, "0")),
        "device": F.concat(F.lit("dev_"), F.lower(F.lpad(F.hex(own_device * 2_654_435_761 % (1 << 48)), 12, "0"))),
        "house": house,
        "pan": F.concat(*letters, F.lpad((n % 10_000).cast("string"), 4, "0"), d.one_of(list("ABCDEFGH"), "check", "number")),
        "born": F.date_add(F.lit("1955-01-01").cast("date"), d.upto(18_000, "born", "number")),
        "base_day": F.coalesce(begin, d.share("base", "number") * (SPAN_DAYS - 45)),
    }


def _records(people: DataFrame, d: _Draws) -> DataFrame:
    """A row for each record: source, and ``nth`` among the person's records of the source."""
    ring = F.col("kind") == "ring"
    some = lambda name, p, q: d.share(name, "number") < F.when(ring, q).otherwise(p)
    bank, telecom, shop = some("bank", 0.7, 0.1), some("telecom", 0.8, 0.6), some("shop", 0.75, 1.0)
    source = lambda name, nth: F.struct(F.lit(name).alias("source"), F.lit(nth).alias("nth"))
    listed = F.array_compact(F.array(
        F.when(bank, source("bank_kyc", 0)), F.when(bank & some("again", 0.1, 0.0), source("bank_kyc", 1)),
        F.when(telecom, source("telecom", 0)), F.when(shop | (~bank & ~telecom), source("ecommerce", 0)),
        F.when(shop & some("second account", 0.12, 0.0), source("ecommerce", 1)),
    ))
    return people.withColumn("r", F.explode(listed)).select("*", "r.source", "r.nth").drop("r")


def _spelled(rows: DataFrame, d: _Draws) -> DataFrame:
    """Adds the first name as ``spelled``: mostly as it is, else another spelling, and now and then a typing error."""
    keys = ("number", "source", "nth")
    rest = F.substring("first", 2, 40)
    tries = F.array(*[F.concat(F.substring("first", 1, 1), F.replace(rest, F.lit(old), F.lit(new))) for old, new in RESPELLED])
    others = F.filter(tries, lambda x: x != F.col("first"))
    other = F.get(others, F.floor(d.share("spelling", *keys) * F.size(others)).cast("int"))
    rows = rows.withColumn("word", F.when(d.share("canonical", *keys) < 0.6, F.col("first")).otherwise(F.coalesce(other, "first")))
    rows = rows.withColumn("at", F.lit(2) + F.floor(d.share("place", *keys) * (F.char_length("word") - 2)).cast("int"))
    word, at = F.col("word"), F.col("at")
    letter, rest = F.substring(word, at, F.lit(1)), F.substring(word, at + 1, F.lit(40))
    head = F.substring(word, F.lit(1), at - 1)
    swapped = F.concat(head, F.substring(word, at + 1, F.lit(1)), letter, F.substring(word, at + 2, F.lit(40)))
    wrong = d.one_of([swapped, F.concat(head, rest), F.concat(head, letter, letter, rest)], "error", *keys)
    return rows.withColumn("spelled", F.when(d.share("typo", *keys) < 0.04, wrong).otherwise(word))


def _written(d: _Draws) -> dict[str, Column]:
    """Fields as a source writes them."""
    keys = ("number", "source", "nth")
    first, last = F.initcap("spelled"), F.initcap("last")
    full = F.concat(first, F.lit(" "), last)
    initial = F.concat(F.substring("first", 1, 1), F.lit(". "), last)
    formal = d.weighted([(full, 0.55), (F.upper(full), 0.25), (F.concat(last, F.lit(" "), first), 0.2)], "style", *keys)
    telecom = d.weighted([(F.upper(full), 0.4), (initial, 0.2), (F.concat(F.upper(last), F.lit(" "), F.upper(first)), 0.1), (full, 0.3)], "style", *keys)
    shop = d.weighted([
        (F.concat("spelled", F.lit("."), "last"), 0.3), (F.concat("spelled", F.lit("_"), "last", (F.col("number") % 90).cast("string")), 0.3),
        (F.lower(full), 0.1), (full, 0.3),
    ], "style", *keys)
    m = F.col("mobile")
    halves = (F.substring(m, 1, 5), F.substring(m, 6, 5))
    phone = d.one_of([
        m, F.concat(F.lit("+91"), m), F.concat(F.lit("0"), m), F.concat(F.lit("+91 "), halves[0], F.lit(" "), halves[1]),
        F.concat(halves[0], F.lit("-"), halves[1]), F.concat(F.lit("91-"), m),
    ], "phone", *keys)
    born = F.when(
        (d.share("swap", *keys) < 0.03) & (F.dayofmonth("born") <= 12), F.make_date(F.year("born"), F.dayofmonth("born"), F.month("born"))
    ).otherwise(F.col("born"))
    dob = d.one_of([F.date_format(born, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd MMM yyyy")], "dob", *keys)
    pin = F.concat(F.lit("56"), F.lpad((F.col("house") % 10_000).cast("string"), 4, "0"))
    street = F.initcap(d.one_of(STREETS.split(","), "street", "house"))
    road = d.one_of(["Rd", "Road"], "road", *keys)
    place = F.concat(d.one_of(["No. ", "#", ""], "number", *keys), (F.col("house") % 997 + 1).cast("string"), F.lit(", "), street, F.lit(" "), road)
    email = F.concat("first", F.lit("."), "last", F.col("number").cast("string"), d.one_of(["@mail.example", "@post.example"], "domain", "number"))
    after = d.share("delay", *keys) * F.when(F.col("kind") == "ring", 4).otherwise(45)
    seconds = F.floor(F.least(F.col("base_day") + after, F.lit(SPAN_DAYS - 0.001)) * 86_400).cast("long")
    code = F.when(F.col("source") == "bank_kyc", "BK-").when(F.col("source") == "telecom", "TC-").otherwise("EC-")
    return {
        "record_id": F.concat(code, F.lpad((2 * F.col("number") + F.col("nth")).cast("string"), 9, "0")),
        "name": F.when(F.col("source") == "bank_kyc", formal).when(F.col("source") == "telecom", telecom).otherwise(shop),
        "phone": F.when((F.col("source") == "telecom") & (d.share("junk", *keys) < 0.02), "9999999999").otherwise(phone),
        "dob": dob, "pin": pin, "place": place,
        "email": F.when(d.share("upper", *keys) < 0.1, F.upper(email)).otherwise(email),
        "ingested_at": F.date_format(F.timestamp_add("SECOND", seconds, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"),
    }


def generate(spark: SparkSession, persons: int, rings: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(source, ingested_at, payload) envelopes, and (record_id, person_id, family_id, ring_id) with empty text for none.

    ``persons`` is met on average, as families differ in size; members of rings come on top.
    """
    d = _Draws(seed)
    rows = _records(_people(spark, persons, rings, d).withColumns(_minted(d)), d)
    rows = _spelled(rows, d).withColumns(_written(d))
    keys = ("number", "source", "nth")
    likely = lambda name, p, value: F.when(d.share(f"has {name}", *keys) < p, value)

    def fields(**named) -> Column:
        both = [x for field, c in named.items() for x in (F.lit(field), F.col(c) if isinstance(c, str) else c)]
        return F.map_filter(F.create_map(*both), lambda _, v: v.isNotNull())

    payload = (
        F.when(F.col("source") == "bank_kyc", fields(kyc_ref="record_id", full_name="name", dob="dob", pan_number="pan", address_line="place", pincode="pin", mobile=likely("mobile", 0.9, F.col("phone"))))
        .when(F.col("source") == "telecom", fields(connection_id="record_id", msisdn="phone", subscriber_name="name", date_of_birth=likely("dob", 0.4, F.col("dob")),
                                                         activation_date=F.substring("ingested_at", 1, 10), circle=d.one_of(CIRCLES, "circle", "number")))
        .otherwise(fields(customer_id="record_id", display_name="name", email="email", phone=likely("mobile", 0.9, F.col("phone")),
                          shipping_address=F.concat("place", F.lit(" "), "pin"), device_id="device"))
    )
    named = lambda kind, letter: F.when(F.col("kind") == kind, F.concat(F.lit(letter), F.col("unit").cast("string"))).otherwise("")
    truth = rows.select("record_id", F.concat(F.lit("P"), F.col("number").cast("string")).alias("person_id"), named("family", "F").alias("family_id"), named("ring", "R").alias("ring_id"))
    return rows.select("source", "ingested_at", payload.alias("payload")), truth


def write_jsonl(envelopes: DataFrame, path: str, ordered: bool = False) -> None:
    """One JSON object a line, as ``contracts.read_jsonl`` and the stream read them; by arrival if ``ordered``."""
    rows = envelopes.orderBy("ingested_at") if ordered else envelopes
    rows.select(F.to_json(F.struct("source", "ingested_at", "payload")).alias("value")).write.mode("overwrite").text(path)


def summary(envelopes: DataFrame, truth: DataFrame) -> dict:
    """How many people, families and records were made, and records of each source."""
    people = truth.agg(
        F.count_distinct("person_id").alias("people"), F.count_distinct(F.when(F.col("ring_id") != "", F.col("person_id"))).alias("ring_people"),
        F.count_distinct(F.when(F.col("ring_id") != "", F.col("ring_id"))).alias("rings"),
        F.count_distinct(F.when(F.col("family_id") != "", F.col("family_id"))).alias("families"), F.count("*").alias("records"),
    ).first()
    by = {r.source: r["count"] for r in envelopes.groupBy("source").count().collect()}
    return {**people.asDict(), "by_source": by}
