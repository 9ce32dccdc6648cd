"""Identity envelopes made from the star-schema tables by arithmetic that SQL engines share.

A customer is a person with a bank record; some orders give telecom records and events give
shop records of the same people. One SQL text serves both this engine and an oracle: only the
name of the string type differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FIRST = "aarti,bhaskar,chitra,dinesh,ekta,faisal,girish,hema,ishita,jatin,kamala,lokesh,madhavi,nitin,omkar,pallavi,rajiv,sarita,tarun,uma,vimala,wasim,yamini,zubin"
LAST = "apte,bhandari,chatterjee,dixit,gokhale,hegde,jain,kamat,lele,mehta,nambiar,oberoi,pandey,qureshi,rastogi,sethi,thakur,upadhyay,vaidya,wagle"
STREETS = "temple,station,lake,market,garden,school,river,hill,church,park"

_PERSON = """
    SELECT c_custkey AS k,
           split_part('{first}', ',', CAST(c_custkey % 24 AS INT) + 1) AS fn,
           split_part('{last}', ',', CAST(floor(c_custkey / 24.0) AS INT) % 20 + 1) AS ln,
           concat('9', lpad(concat('', (c_custkey * 7919 + 12345) % 1000000000), 9, '0')) AS mobile,
           concat('', 1960 + CAST(c_custkey % 40 AS INT), '-', lpad(concat('', 1 + CAST(c_custkey % 12 AS INT)), 2, '0'),
                  '-', lpad(concat('', 1 + CAST(c_custkey % 28 AS INT)), 2, '0')) AS dob,
           concat('No. ', CAST(floor(c_custkey / 3.0) AS INT), ', ', split_part('{streets}', ',', CAST(floor(c_custkey / 3.0) AS INT) % 10 + 1),
                  ' Rd, 56', lpad(concat('', CAST(floor(c_custkey / 3.0) AS INT) % 10000), 4, '0')) AS addr,
           concat('dev_', CAST(floor(c_custkey / CASE WHEN c_nationkey = 7 THEN 5.0 ELSE 1.0 END) AS INT), '_', CASE WHEN c_nationkey = 7 THEN 1 ELSE 0 END) AS dev,
           c_nationkey
    FROM customer
"""
_FLAT = """
    SELECT 'bank_kyc' AS source, concat('BK-', lpad(concat('', k), 7, '0')) AS record_id, k AS person_id,
           '2024-01-01T00:00:00' AS ingested_at, concat(fn, ' ', ln) AS name, mobile AS phone, dob,
           concat('ABCDE', lpad(concat('', k % 10000), 4, '0'), 'F') AS gov_id, addr AS address, CAST(NULL AS {S}) AS email, CAST(NULL AS {S}) AS device_id
    FROM person WHERE k % 10 < 7
    UNION ALL
    SELECT 'telecom', concat('TC-', lpad(concat('', k), 7, '0')), k,
           concat('2024-02-', lpad(concat('', 1 + CAST(k % 28 AS INT)), 2, '0'), 'T08:00:00'),
           CASE WHEN k % 3 = 0 THEN concat(ln, ' ', fn) WHEN k % 3 = 1 THEN upper(concat(substring(fn, 1, 1), '. ', ln)) ELSE concat(fn, '.', ln) END,
           CASE WHEN k % 50 = 49 THEN '9999999999' WHEN k % 2 = 0 THEN concat('+91 ', mobile) ELSE concat('0', mobile) END,
           CASE WHEN k % 4 = 0 THEN concat(substring(dob, 9, 2), '/', substring(dob, 6, 2), '/', substring(dob, 1, 4)) END,
           CAST(NULL AS {S}), CAST(NULL AS {S}), CAST(NULL AS {S}), CAST(NULL AS {S})
    FROM person WHERE k % 10 < 8
    UNION ALL
    SELECT 'ecommerce', concat('EC-', lpad(concat('', k), 7, '0')), k,
           concat('2024-03-', lpad(concat('', 1 + CAST(k % 28 AS INT)), 2, '0'), 'T20:30:00'),
           concat(fn, '_', ln, k % 100), CASE WHEN k % 5 > 0 THEN mobile END, CAST(NULL AS {S}), CAST(NULL AS {S}),
           CASE WHEN k % 2 = 0 THEN addr END, concat(upper(fn), '.', ln, k, '@mail.example'), dev
    FROM person WHERE k % 10 > 2
"""


def flat_sql(string_type: str) -> str:
    """A query with one row per envelope; ``customer`` must be a table."""
    person = _PERSON.format(first=FIRST, last=LAST, streets=STREETS)
    return f"WITH person AS ({person}), flat AS ({_FLAT.format(S=string_type)})"


def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    # a record takes far more work than a customer's bytes tell, and a file may be one task
    customers = customers.repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey")
    sql = flat_sql("STRING").replace("FROM customer", "FROM {customer}")
    return spark.sql(f"{sql} SELECT * FROM flat", customer=customers)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, ingested_at, payload) in each source's own field names."""
    def fields(**names: str) -> F.Column:
        both = [x for field, column in names.items() for x in (F.lit(field), F.col(column))]
        return F.map_filter(F.create_map(*both), lambda _, v: v.isNotNull())

    payload = (
        F.when(F.col("source") == "bank_kyc", fields(kyc_ref="record_id", full_name="name", dob="dob", pan_number="gov_id", address_line="address", mobile="phone"))
        .when(F.col("source") == "telecom", fields(connection_id="record_id", msisdn="phone", subscriber_name="name", date_of_birth="dob"))
        .otherwise(fields(customer_id="record_id", display_name="name", email="email", phone="phone", shipping_address="address", device_id="device_id"))
    )
    return flat_records(spark, sf_dir).select("source", "ingested_at", payload.alias("payload"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, person_id, family_id, ring_id), empty text for none."""
    rows = flat_records(spark, sf_dir).select("record_id", "person_id")
    people = spark.read.parquet(f"{sf_dir}/customer.parquet")
    ring = F.when(F.col("c_nationkey") == 7, F.concat(F.lit("R"), F.floor(F.col("c_custkey") / 5).cast("string"))).otherwise(F.lit(""))
    # two columns of short values are small in files, whatever they take in memory
    return rows.join(people.hint("merge"), F.col("person_id") == F.col("c_custkey")).select(
        "record_id", F.col("person_id").cast("string").alias("person_id"),
        F.concat(F.lit("F"), F.floor(F.col("person_id") / 3).cast("string")).alias("family_id"), ring.alias("ring_id"),
    )
