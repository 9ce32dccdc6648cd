"""Queries by operator, over the star-schema tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.config import SETTINGS
from kinweave.functions import similarity, text as t
from kinweave.functions.numbers import fixed_sql, half_even_sql
from kinweave.operators.components import connected_components
from kinweave.operators.normalize import attributes, blocking_keys, normalized
from kinweave.plans import analysis, evaluate, index, read, resolve as res, rings
from kinweave.sources import bridge, contracts, generate, tables
from kinweave.streaming import resolver
from kinweave.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- SQL for the oracle -------------------------------------------------------------------

def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _sound(x: str) -> str:
    out = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    for short, full in t.TOKEN_ALIASES.items():
        out = f"regexp_replace({out}, '^{short}$', '{full}')"
    for old, new in t.SOUND_RULES:
        out = f"replace({out}, '{old}', '{new}')"
    out = f"list_transform([{out}], lambda z: left(z, 1) || regexp_replace(substr(z, 2), '[aeiouy]', '', 'g'))[1]"
    for c in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{c}+', '{c}', 'g')"
    return out


_DIGITS = "regexp_replace(phone, '\\D', '', 'g')"
_LOCAL = (
    f"CASE WHEN length({_DIGITS}) = 12 AND starts_with({_DIGITS}, '91') THEN substr({_DIGITS}, 3) "
    f"WHEN length({_DIGITS}) = 11 AND starts_with({_DIGITS}, '0') THEN substr({_DIGITS}, 2) ELSE {_DIGITS} END"
)
_AW = "list_filter(string_split(regexp_replace(lower(address), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_PIN = f"list_filter({_AW}, lambda w: regexp_full_match(w, '[0-9]{{6}}'))[1]"
_LONG = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.ABBREVIATIONS.items()) + " ELSE w END"
NORM = f"""{bridge.flat_sql("VARCHAR")},
norm AS (
    SELECT source, record_id, person_id, CAST(ingested_at AS TIMESTAMP) AS ingested_at, name AS display_name, phone AS raw_phone, email AS raw_email,
        list_filter(string_split(regexp_replace(lower(name), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ({_quoted(t.HONORIFICS)})) AS toks,
        CASE WHEN regexp_full_match({_LOCAL}, '[6-9][0-9]{{9}}') AND ({_LOCAL}) NOT IN ({_quoted(t.JUNK_PHONES)})
             AND len(list_distinct(string_split({_LOCAL}, ''))) > 2 THEN '+91' || ({_LOCAL}) END AS phone,
        CASE WHEN regexp_full_match(lower(trim(email)), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN lower(trim(email)) END AS email,
        CAST(coalesce(try_strptime(dob, '%Y-%m-%d'), try_strptime(dob, '%d/%m/%Y')) AS DATE) AS dob,
        {_PIN} AS pincode,
        nullif(array_to_string(list_transform(list_filter({_AW}, lambda w: w <> coalesce({_PIN}, '') AND w NOT IN ({_quoted(t.ADDRESS_NOISE)})), lambda w: {_LONG}), ' '), '') AS address,
        left(sha256('{SETTINGS.salt}' || upper(regexp_replace(gov_id, '\\s', '', 'g'))), 24) AS id_hash, device_id
    FROM flat
), tok AS (
    SELECT record_id, ingested_at, dob, i, toks[i] AS tk, {_sound('toks[i]')} AS sk FROM norm, unnest(range(1, len(toks) + 1)) AS u(i)
), keys AS (
    SELECT DISTINCT record_id, ingested_at, k FROM (
        SELECT record_id, ingested_at, 'ph:' || phone AS k FROM norm UNION ALL SELECT record_id, ingested_at, 'em:' || email FROM norm
        UNION ALL SELECT record_id, ingested_at, 'id:' || id_hash FROM norm UNION ALL SELECT record_id, ingested_at, 'dv:' || device_id FROM norm
        UNION ALL SELECT a.record_id, a.ingested_at, 'nm:' || a.sk || '|' || left(b.tk, 1) FROM tok a JOIN tok b ON a.record_id = b.record_id AND a.i <> b.i WHERE length(a.tk) >= 2
        UNION ALL SELECT record_id, ingested_at, 'nd:' || sk || '|' || strftime(dob, '%Y-%m-%d') FROM tok WHERE length(tk) >= 2
    ) WHERE k IS NOT NULL
), attrs AS (
    SELECT DISTINCT record_id, kind, value FROM (
        SELECT record_id, 'phone' AS kind, phone AS value FROM norm UNION ALL SELECT record_id, 'email', email FROM norm UNION ALL SELECT record_id, 'device', device_id FROM norm
        UNION ALL SELECT record_id, 'address', address FROM norm UNION ALL SELECT record_id, 'id', id_hash FROM norm UNION ALL SELECT record_id, 'nkey', sk FROM tok WHERE length(tk) > 1 AND sk <> ''
    ) WHERE value IS NOT NULL
)"""

PAIRS = f"""{NORM.replace('WITH person', 'WITH RECURSIVE person', 1)},
ranked AS (SELECT k, record_id, row_number() OVER (PARTITION BY k ORDER BY ingested_at, record_id) - 1 AS rank FROM keys QUALIFY rank <= {SETTINGS.block_cap}),
pairs AS (SELECT DISTINCT a.record_id AS newer, b.record_id AS older FROM ranked a JOIN ranked b ON a.k = b.k AND b.rank < a.rank)"""
#: Jaro of the token pairs tp(a, b), a letter of a at a time; a letter of b that is taken becomes a dot.
_JARO = """steps AS (
    SELECT a, b, 1 AS i, b AS free, '' AS got, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS reach FROM tp
    UNION ALL
    SELECT a, b, i + 1, CASE WHEN hit > 0 THEN left(free, lo + hit - 1) || '.' || substr(free, lo + hit + 1) ELSE free END, CASE WHEN hit > 0 THEN got || c ELSE got END, reach
    FROM (SELECT *, instr(substr(free, lo + 1, i + reach - lo), c) AS hit FROM (SELECT *, greatest(i - 1 - reach, 0) AS lo, substr(a, i, 1) AS c FROM steps WHERE i <= length(a)))
), met AS (
    SELECT a, b, got, length(got) AS m, list_transform(list_filter(range(1, length(b) + 1), lambda k: substr(free, k, 1) = '.'), lambda k: substr(b, k, 1)) AS other
    FROM steps WHERE i > length(a)
), jaro AS (
    SELECT a, b, len(list_filter(range(1, 5), lambda k: k <= length(a) AND k <= length(b) AND left(a, k) = left(b, k))) AS prefix,
        CASE WHEN a = b THEN 1.0::DOUBLE WHEN m = 0 THEN 0.0::DOUBLE
             ELSE (m / length(a) + m / length(b) + (m - len(list_filter(range(1, m + 1), lambda k: substr(got, k, 1) <> other[k])) / 2) / m) / 3 END AS jaro FROM met
), sims AS (SELECT a, b, jaro, jaro + prefix * 0.1::DOUBLE * (1 - jaro) AS jaro_winkler FROM jaro)"""
#: Name similarity of named(few, many): tokens of the shorter name choose partners, initials last.
_NAMES = f"""named AS (
    SELECT DISTINCT newer, older, CASE WHEN len(a.toks) <= len(b.toks) THEN a.toks ELSE b.toks END AS few, CASE WHEN len(a.toks) <= len(b.toks) THEN b.toks ELSE a.toks END AS many
    FROM pairs JOIN norm a ON a.record_id = newer JOIN norm b ON b.record_id = older
), names AS (SELECT DISTINCT few, many FROM named),
tp AS (SELECT DISTINCT a, b FROM (SELECT unnest(few) AS a, many FROM names), unnest(many) AS u(b)), {_JARO},
sounds AS (SELECT DISTINCT tk, sk FROM tok),
near AS (
    SELECT a, b, CASE WHEN least(length(a), length(b)) = 1 THEN CASE WHEN left(a, 1) = left(b, 1) THEN 0.9 ELSE 0.0 END
        ELSE greatest(jaro_winkler, CASE WHEN length(p.sk) > 1 AND p.sk = q.sk THEN 0.95 ELSE 0.0 END) END::DOUBLE AS sim
    FROM sims JOIN sounds p ON p.tk = a JOIN sounds q ON q.tk = b
), picks AS (
    SELECT few, many, list_concat(list_filter(few, lambda x: length(x) > 1), list_filter(few, lambda x: length(x) = 1)) AS todo, many AS free, []::DOUBLE[] AS picked FROM names
    UNION ALL
    SELECT few, many, todo[2:], CASE WHEN best.sim > 0 THEN list_concat(free[1 : -best.back - 1], free[1 - best.back :]) ELSE free END, list_append(picked, best.sim)
    FROM (SELECT few, many, todo, free, picked, max({{'sim': sim, 'back': -nth}}) AS best FROM picks, unnest(range(1, len(free) + 1)) AS u(nth) JOIN near ON a = todo[1] AND b = free[nth] WHERE len(todo) > 0 GROUP BY ALL)
), alike AS (
    SELECT few, many, CASE WHEN len(few) = 0 THEN 0.0 WHEN list_min(picked) < 0.75 THEN least(list_avg(picked), 0.6) ELSE list_avg(picked) END::DOUBLE AS name_sim FROM picks WHERE len(todo) = 0
)"""


_BOTH = "list_distinct(list_concat(string_split(a.address, ' '), string_split(b.address, ' ')))"
_SIM, _ADDR = fixed_sql("name_sim", 2), fixed_sql("overlap", 2)
_EVIDENCE = [
    ("name_sim >= 0.92", 3.0, f"'names agree strongly (' || {_SIM} || ')'"), ("name_sim >= 0.85 AND name_sim < 0.92", 2.0, f"'names agree (' || {_SIM} || ')'"),
    (f"name_sim >= {SETTINGS.name_floor} AND name_sim < 0.85", 1.0, f"'names roughly agree (' || {_SIM} || ')'"),
    (f"name_sim < 0.7 AND name_sim < {SETTINGS.name_floor}", -3.0, f"'names disagree (' || {_SIM} || ')'"),
    ("ai = bi", 5.0, "'same government ID'"), ("ai <> bi", -6.0, "'different government IDs'"), ("email", 4.0, "'same email'"), ("phone", 2.5, "'shared phone'"),
    ("ad = bd", 2.5, "'same date of birth'"), ("crossed", 1.5, "'date of birth matches with day/month swapped'"), ("ad <> bd AND NOT crossed", -4.0, "'different dates of birth'"),
    ("overlap >= 0.6", 1.0, f"'similar address (' || {_ADDR} || ')'"), ("pin", 0.5, "'same pincode'"), ("device", 1.0, "'shared device'"),
]
SCORED = f"""{PAIRS}, {_NAMES}, both_sides AS (
    SELECT newer, older, name_sim, a.ingested_at AS linked_at, a.id_hash AS ai, b.id_hash AS bi, a.email = b.email AS email, a.phone = b.phone AS phone, a.dob AS ad, b.dob AS bd,
        a.dob <> b.dob AND year(a.dob) = year(b.dob) AND month(a.dob) = day(b.dob) AND day(a.dob) = month(b.dob) AS crossed, a.pincode = b.pincode AS pin, a.device_id = b.device_id AS device,
        CASE WHEN a.address IS NULL OR b.address IS NULL THEN 0.0 ELSE len(list_intersect(list_distinct(string_split(a.address, ' ')), list_distinct(string_split(b.address, ' ')))) * 1.0 / len({_BOTH}) END::DOUBLE AS overlap
    FROM named JOIN alike USING (few, many) JOIN norm a ON a.record_id = newer JOIN norm b ON b.record_id = older
), added AS (
    SELECT newer, older, linked_at, {half_even_sql("name_sim", 3)} AS name_similarity, ({" + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in _EVIDENCE)})::DOUBLE AS score,
        list_filter([{", ".join(f"CASE WHEN {c} THEN {why} || ' ({p:+.1f})' END" for c, p, why in _EVIDENCE)}], lambda x: x IS NOT NULL) AS reasons FROM both_sides
), points AS (SELECT *, score >= {SETTINGS.match_threshold} AND name_similarity >= {SETTINGS.name_floor} AS is_match FROM added)"""
#: Links replayed in each component a record at a time; ``holders`` tells the founder's place for each place so far.
RESOLVED = f"""{SCORED},
edges AS (SELECT older AS u, newer AS v FROM points WHERE is_match UNION SELECT newer, older FROM points WHERE is_match),
reach AS (SELECT u AS i, u AS r FROM edges UNION SELECT e.v, w.r FROM reach w JOIN edges e ON e.u = w.i),
parts AS (SELECT i AS record_id, min(r) AS c FROM reach GROUP BY i),
placed AS (SELECT record_id, ingested_at AS moment, coalesce(c, record_id) AS c, row_number() OVER (PARTITION BY coalesce(c, record_id) ORDER BY ingested_at, record_id) AS place FROM norm LEFT JOIN parts USING (record_id)),
linked AS (SELECT newer AS record_id, list(place) AS older FROM points JOIN placed ON record_id = older WHERE is_match GROUP BY newer),
listed AS (SELECT c, list({{'record_id': record_id, 'moment': moment, 'older': coalesce(older, [])}} ORDER BY place) AS items FROM placed LEFT JOIN linked USING (record_id) GROUP BY c),
play AS (
    SELECT c, items, 0::BIGINT AS i, []::BIGINT[] AS holders, []::BIGINT[] AS before, []::BIGINT[] AS touched, 0::BIGINT AS keeper FROM listed
    UNION ALL
    SELECT c, items, i + 1, list_append(list_transform(holders, lambda h: CASE WHEN list_contains(met, h) THEN chosen ELSE h END), chosen), holders, met, chosen
    FROM (SELECT *, coalesce(list_sort(list_transform(met, lambda f: {{'n': -len(list_filter(holders, lambda h: h = f)), 'f': f}}))[1].f, i + 1) AS chosen
        FROM (SELECT *, list_distinct(list_transform(items[i + 1].older, lambda o: holders[o])) AS met FROM play WHERE i < len(items)))
), played AS (SELECT c, i, items, items[i].record_id AS record_id, items[i].moment AS moment, len(items[i].older) AS n_older, before, touched, keeper FROM play WHERE i > 0),
titles AS (SELECT c, i AS f, moment AS created_at, printf('PID%07d', row_number() OVER (ORDER BY moment, record_id)) AS identity_id FROM played WHERE len(touched) = 0),
moves AS (
    SELECT record_id, moment, record_id AS trig, c, keeper AS f, CASE len(touched) WHEN 0 THEN 'no matching records' WHEN 1 THEN 'matched ' || n_older || ' record(s)'
        ELSE 'bridged ' || len(touched) || ' identities via ' || n_older || ' matching record(s)' END AS reason FROM played
    UNION ALL
    SELECT items[m].record_id, moment, p.record_id, p.c, keeper, 'merged from ' || identity_id FROM played p, unnest(range(1, i)) AS t(m) JOIN titles ON titles.c = p.c AND titles.f = before[m]
    WHERE list_contains(touched, before[m]) AND before[m] <> keeper
), clamped AS (SELECT *, max(moment) OVER (PARTITION BY record_id ORDER BY moment, trig ROWS UNBOUNDED PRECEDING) AS valid_from FROM moves),
assignments AS (SELECT record_id, identity_id, valid_from, lead(valid_from) OVER (PARTITION BY record_id ORDER BY moment, trig) AS valid_to, reason FROM clamped JOIN titles USING (c, f)),
ends AS (SELECT p.c, gone AS f, n.identity_id AS merged_into, moment AS merged_at FROM played p, unnest(touched) AS t(gone) JOIN titles n ON n.c = p.c AND n.f = keeper WHERE gone <> keeper),
identities AS (SELECT identity_id, created_at, merged_into, merged_at FROM titles LEFT JOIN ends USING (c, f))"""

#: Components and rings of identities ident(record_id, i) that share attributes.
_GRAPH = f"""ia AS (SELECT DISTINCT i, kind, value FROM attrs JOIN ident USING (record_id) WHERE kind IN ('phone', 'device', 'address')),
hubs AS (SELECT kind, value, min(i) AS u FROM ia GROUP BY kind, value HAVING count(*) > 1 AND count(*) <= {SETTINGS.hub_limit}),
spokes AS (SELECT DISTINCT u, i AS v FROM ia JOIN hubs USING (kind, value) WHERE i <> u),
both_ways AS (SELECT u, v FROM spokes UNION SELECT v, u FROM spokes),
walk AS (SELECT u AS i, u AS r FROM both_ways UNION SELECT b.v, w.r FROM walk w JOIN both_ways b ON b.u = w.i),
comp AS (SELECT i, min(r) AS c FROM walk GROUP BY i)"""
_PERSONS = f"{NORM.replace('WITH person', 'WITH RECURSIVE person', 1)}, ident AS (SELECT record_id, printf('PID%07d', person_id) AS i FROM norm), {_GRAPH}"
_DAYS, _KYC, _SHARE = (half_even_sql(x, 0) + "::BIGINT" for x in ("span", "kyc * 100", "share * 100"))
_RULES = [
    ("span <= 21", 2, f"n || ' identities first seen within ' || {_DAYS} || ' days (burst)'"), ("kyc < 0.3", 2, f"'only ' || {_KYC} || '% have bank KYC'"),
    ("d >= 4", 2, "d || ' identities share one device'"), ("p >= 4", 1, "p || ' identities share one phone'"),
    ("share >= 0.6 AND kyc >= 0.5", -2, f"{_SHARE} || '% share one home address and most passed KYC (family pattern)'"),
    ("span > 60", -1, f"'identities appeared over ' || {_DAYS} || ' days (organic growth)'"),
]
_REPORT = f"""prof AS (SELECT i, min(ingested_at) AS seen, max((source = 'bank_kyc')::INT) AS kyc FROM norm JOIN ident USING (record_id) GROUP BY i),
shared AS (SELECT c, kind, value, count(*) AS n FROM comp JOIN ia USING (i) GROUP BY ALL),
most AS (SELECT c, coalesce(max(n) FILTER (kind = 'device'), 0) AS d, coalesce(max(n) FILTER (kind = 'phone'), 0) AS p, coalesce(max(n) FILTER (kind = 'address'), 0) AS a FROM shared GROUP BY c),
g AS (SELECT c, count(*) AS n, date_diff('microsecond', min(seen), max(seen)) / 8.64e10::DOUBLE AS span, avg(kyc) AS kyc, string_agg(i, ',' ORDER BY i) AS identity_ids FROM comp JOIN prof USING (i)
    GROUP BY c HAVING count(*) >= {SETTINGS.min_ring}),
r AS (SELECT *, a / n AS share FROM g JOIN most USING (c)),
risky AS (SELECT *, ({" + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in _RULES)})::DOUBLE AS risk,
    list_filter([{", ".join(f"CASE WHEN {c} THEN {why} END" for c, _, why in _RULES)}], lambda x: x IS NOT NULL) AS reasons FROM r),
report AS (SELECT *, row_number() OVER (ORDER BY -risk, -n, c) AS component_id, CASE WHEN risk >= 4 THEN 'SUSPICIOUS_RING' WHEN risk <= 0 THEN 'LIKELY_FAMILY' ELSE 'REVIEW' END AS label FROM risky)"""
_RINGS = f"""{_REPORT} SELECT component_id, risk AS risk_score, label, identity_ids, array_to_string(reasons, '; ') AS reasons, n::INT AS size, {half_even_sql("span", 1)} AS first_seen_span_days,
    {half_even_sql("kyc", 2)} AS kyc_fraction, d::INT AS max_identities_per_device, p::INT AS max_identities_per_phone, {half_even_sql("share", 2)} AS address_share FROM report"""
#: Family and ring of each record, empty for none.
_TRUTH = """truth AS (SELECT record_id, person_id AS p, 'F' || floor(person_id / 3.0)::BIGINT AS fam, CASE WHEN c_nationkey = 7 THEN 'R' || floor(c_custkey / 5.0)::BIGINT ELSE '' END AS ring
    FROM norm JOIN customer ON c_custkey = person_id)"""
#: Metrics of m(i, record_id).
_ACCURACY = f"""{_TRUTH}, marked AS (SELECT * FROM m JOIN truth USING (record_id)),
cells AS (SELECT i, p, count(*) AS n FROM marked GROUP BY ALL), found AS (SELECT i, sum(n) AS n FROM cells GROUP BY i), people AS (SELECT p, sum(n) AS n, count(*) AS ids FROM cells GROUP BY p),
x AS (SELECT (SELECT sum(n) FROM cells) AS records, (SELECT sum(n * (n - 1) / 2) FROM cells) AS tp, (SELECT sum(n * (n - 1) / 2) FROM found) AS pp, (SELECT sum(n * (n - 1) / 2) FROM people) AS ap),
y AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 1.0 END::DOUBLE AS pre, CASE WHEN ap > 0 THEN tp / ap ELSE 1.0 END::DOUBLE AS rec FROM x),
mixed AS (SELECT i, CASE WHEN count(DISTINCT fam) = 1 THEN 'family' WHEN count(DISTINCT ring) = 1 AND max(ring) <> '' THEN 'ring' ELSE 'unrelated' END AS kind FROM marked GROUP BY i HAVING count(DISTINCT p) > 1)
SELECT records::BIGINT AS records, (SELECT count(*) FROM people) AS true_people, (SELECT count(*) FROM found) AS predicted_identities,
    {half_even_sql("pre", 4)} AS precision, {half_even_sql("rec", 4)} AS recall, {half_even_sql("CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END", 4)} AS f1,
    (SELECT count(*) FROM mixed) AS over_merged_identities, (SELECT count(*) FROM mixed WHERE kind = 'family') AS merged_same_family,
    (SELECT count(*) FROM mixed WHERE kind = 'ring') AS merged_same_ring, (SELECT count(*) FROM mixed WHERE kind = 'unrelated') AS merged_unrelated,
    (SELECT count(*) FROM people WHERE ids > 1) AS people_split_across_identities FROM y"""


# --- shared frames ------------------------------------------------------------------------

def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes as a table: a filter by what is in them would go below the shuffle of customers, and make a payload anew for each rule."""
    return Workspace(spark, "sent", shuffled=True).table(bridge.envelopes(spark, sf_dir), "envelopes")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.canonical(contracts.validated(sent(spark, sf_dir)))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(canonical(spark, sf_dir))


_resolved: dict[tuple, res.Resolution] = {}


def resolution(spark: SparkSession, sf_dir: str) -> res.Resolution:
    """The resolved tables of a folder, made once a session unless its table changes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/customer.parquet")
    state = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf_dir, state.getModificationTime(), state.getLen())
    if key not in _resolved:
        _resolved[key] = res.resolve(canonical(spark, sf_dir))
    return _resolved[key]


def by_person(spark: SparkSession, sf_dir: str) -> res.Resolution:
    """Tables in which the person is the identity, so that SQL can tell the answers too."""
    work = Workspace(spark, "people", shuffled=True)
    recs = work.table(records(spark, sf_dir), "records")
    people = bridge.flat_records(spark, sf_dir).select("record_id", F.format_string("PID%07d", "person_id").alias("identity_id"))
    assignments = work.table(recs.select("record_id", F.col("ingested_at").alias("valid_from")).join(people, "record_id").select(
        "record_id", "identity_id", "valid_from", F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit("truth").alias("reason")
    ), "assignments")
    identities = assignments.groupBy("identity_id").agg(F.min("valid_from").alias("created_at")).select(
        "*", F.lit(None).cast("string").alias("merged_into"), F.lit(None).cast("timestamp_ntz").alias("merged_at")
    )
    none = spark.createDataFrame([], "record_a string, record_b string, score double, reasons array<string>, created_at timestamp_ntz")
    return res.Resolution(recs, none, assignments, identities, none)


# --- sources, contracts -------------------------------------------------------------------

@query(f"{bridge.flat_sql('VARCHAR')} SELECT source, ingested_at, record_id, name, phone FROM flat")
def s1_envelopes(spark, sf_dir):
    at = lambda *names: F.coalesce(*[F.try_element_at("payload", F.lit(n)) for n in names])
    return bridge.envelopes(spark, sf_dir).select(
        "source", "ingested_at", at("kyc_ref", "connection_id", "customer_id").alias("record_id"),
        at("full_name", "subscriber_name", "display_name").alias("name"), at("mobile", "msisdn", "phone").alias("phone"),
    )


@query(f"{bridge.flat_sql('VARCHAR')} SELECT record_id, source, ingested_at, name, phone, email FROM flat")
def s1_json_lines(spark, sf_dir):
    """Envelopes written as JSON Lines and read as a source sends them."""
    folder = Workspace(spark, "s1").folder("lines")
    generate.write_jsonl(bridge.envelopes(spark, sf_dir), folder)
    rows = contracts.canonical(contracts.validated(contracts.read_jsonl(spark, folder)))
    return rows.select("record_id", "source", "ingested_at", "name", F.get("phones", F.lit(0)).alias("phone"), "email")


@query(f"{NORM}, {_TRUTH} SELECT record_id, p::VARCHAR AS person_id, fam AS family_id, ring AS ring_id FROM truth")
def s4_truth_csv(spark, sf_dir):
    folder = Workspace(spark, "s4").folder("truth")
    tables.write_truth(bridge.truth(spark, sf_dir), folder)
    return tables.read_truth(spark, folder)


@query(f"{bridge.flat_sql('VARCHAR')} SELECT 'raw.' || source AS topic, record_id AS key FROM flat")
def k9_messages(spark, sf_dir):
    lines = bridge.envelopes(spark, sf_dir).select(F.to_json(F.struct("source", "ingested_at", "payload")).alias("raw"))
    return tables.messages(lines).select("topic", F.col("key").cast("string").alias("key"))


@query()
def s8_generated_envelopes(spark, sf_dir):
    """As many people as there are customers, and a ring for every 200."""
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    return generate.generate(spark, n, n // 200)[0].withColumn("payload", F.to_json("payload"))


@query(f"""{bridge.flat_sql('VARCHAR')}
SELECT record_id, CASE WHEN person_id % 97 = 0 THEN 'unknown source: ''crm'''
    WHEN person_id % 89 = 0 THEN 'missing ingested_at'
    WHEN person_id % 83 = 0 AND source = 'telecom' THEN 'telecom: missing required field(s) [''msisdn'']; unexpected field(s) [''mobile_number''] - possible schema drift'
    WHEN person_id % 79 = 0 AND source = 'telecom' THEN 'telecom: field ''subscriber_name'' must be a non-empty string' END AS error
FROM flat""")
def p1_contract_errors(spark, sf_dir):
    at = lambda *names: F.coalesce(*[F.try_element_at("payload", F.lit(n)) for n in names])
    rows = bridge.envelopes(spark, sf_dir).withColumn("record_id", at("kyc_ref", "connection_id", "customer_id"))
    k = F.substring("record_id", 4, 20).cast("long")
    telecom = F.col("source") == "telecom"
    renamed = F.map_concat(F.map_filter("payload", lambda n, _: n != "msisdn"), F.create_map(F.lit("mobile_number"), F.lit("1")))
    blank = F.transform_values("payload", lambda n, v: F.when(n == "subscriber_name", F.lit("  ")).otherwise(v))
    changed = rows.withColumn("payload", F.when(telecom & (k % 83 == 0), renamed).when(telecom & (k % 79 == 0), blank).otherwise(F.col("payload")))
    changed = changed.withColumn("source", F.when(k % 97 == 0, "crm").otherwise(F.col("source"))).withColumn("ingested_at", F.when(k % 89 == 0, "").otherwise(F.col("ingested_at")))
    return contracts.validated(changed).select("record_id", "error")


@query(f"{bridge.flat_sql('VARCHAR')} SELECT record_id, source, name, dob, address, gov_id, email, device_id, phone AS phones FROM flat")
def p4_canonical(spark, sf_dir):
    return canonical(spark, sf_dir).select(
        "record_id", "source", "name", "dob", "address", "gov_id", "email", "device_id", F.get("phones", F.lit(0)).alias("phones")
    )


# --- scalar functions ---------------------------------------------------------------------

def _scalar(name: str, column: Callable[[], F.Column], sql: str) -> None:
    def run(spark, sf_dir):
        return records(spark, sf_dir).select("record_id", column().alias("value"))

    QUERIES[name] = run
    ORACLES[name] = f"{NORM} SELECT record_id, {sql} AS value FROM norm"


_scalar("f1_name_tokens", lambda: F.array_join("name_tokens", " "), "array_to_string(toks, ' ')")
_scalar("f2_phone", lambda: F.get("phones", F.lit(0)), "phone")
_scalar("f3_email", lambda: F.col("email"), "email")
_scalar("f4_birth_date", lambda: F.date_format("dob", "yyyy-MM-dd"), "strftime(dob, '%Y-%m-%d')")
_scalar("f5_address", lambda: F.concat_ws("/", "address", "pincode"), "concat_ws('/', address, pincode)")
_scalar("f6_hashed_id", lambda: F.col("id_hash"), "id_hash")
_scalar("f8_masked_phone", lambda: t.masked_phone(F.get("phones", F.lit(0))), "left(phone, 3) || repeat('*', (length(phone) - 7)::BIGINT) || right(phone, 4)")
_scalar("f9_masked_email", lambda: t.masked_email(F.col("email")),
        "left(split_part(email, '@', 1), 2) || repeat('*', greatest(length(split_part(email, '@', 1)) - 2, 1)::BIGINT) || '@' || split_part(email, '@', 2)")
_scalar("f12_spoken_name", lambda: t.spoken_name(F.col("display_name")), "trim(regexp_replace(regexp_replace(display_name, '[._]+', ' ', 'g'), '\\s+', ' ', 'g'))")
_scalar("f13_title_case", lambda: t.title_case(F.col("display_name")),
        "array_to_string(list_transform(regexp_extract_all(display_name, '[A-Za-z]+|[^A-Za-z]+'), lambda p: upper(left(p, 1)) || lower(substr(p, 2))), '')")
_scalar("m9_quality_flags", lambda: F.array_join("quality_flags", ","),
        "concat_ws(',', CASE WHEN raw_phone IS NOT NULL AND phone IS NULL THEN 'invalid_phone' END, CASE WHEN raw_email IS NOT NULL AND email IS NULL THEN 'invalid_email' END, CASE WHEN len(toks) = 0 THEN 'missing_name' END)")


@query(f"{NORM} SELECT DISTINCT tk AS token, sk AS sound FROM tok")
def f7_sound_key(spark, sf_dir):
    return records(spark, sf_dir).select(F.explode("name_tokens").alias("token")).distinct().select("token", t.sound_key(F.col("token")).alias("sound"))


@query(f"{NORM} SELECT record_id, kind, value FROM attrs")
def k2_attributes(spark, sf_dir):
    return attributes(records(spark, sf_dir))


# --- blocking and scoring -----------------------------------------------------------------

def _candidates(recs, *columns):
    work = Workspace(recs.sparkSession, "pairs", shuffled=True)
    return res.candidate_pairs(work.table(recs, "records"), SETTINGS.block_cap, work, *columns)


@query(f"{NORM} SELECT record_id, k AS key FROM keys")
def m8_blocking_keys(spark, sf_dir):
    return blocking_keys(records(spark, sf_dir)).select("record_id", "key")


@query(f"{NORM} SELECT k AS key, record_id, row_number() OVER (PARTITION BY k ORDER BY ingested_at, record_id) - 1 AS rank FROM keys QUALIFY rank <= {SETTINGS.block_cap}")
def w1_block_rank(spark, sf_dir):
    ranked = res.ranked_keys(blocking_keys(records(spark, sf_dir)), SETTINGS.block_cap)
    return ranked.select("key", "record_id", F.col("rank").cast("long").alias("rank"))


@query(f"""{NORM}, ranked AS (SELECT k, record_id, row_number() OVER (PARTITION BY k ORDER BY ingested_at, record_id) - 1 AS rank FROM keys QUALIFY rank <= {SETTINGS.block_cap})
SELECT DISTINCT a.record_id AS newer, b.record_id AS older FROM ranked a JOIN ranked b ON a.k = b.k AND b.rank < a.rank""")
def j1_candidate_pairs(spark, sf_dir):
    return _candidates(records(spark, sf_dir))


_JOINED = "array_to_string(reasons, '; ')"


@query(f"{SCORED} SELECT newer, older, score, name_similarity, {_JOINED} AS reasons, is_match, linked_at FROM points")
def m7_scored_pairs(spark, sf_dir):
    pairs = _candidates(records(spark, sf_dir), *res.said())
    return res.scored(pairs).withColumn("reasons", F.array_join("reasons", "; "))


@query(f"""{PAIRS}, tp AS (SELECT DISTINCT x.tk AS a, y.tk AS b FROM pairs JOIN tok x ON x.record_id = newer JOIN tok y ON y.record_id = older), {_JARO}
SELECT a, b, round(jaro, 9) AS jaro, round(jaro_winkler, 9) AS jaro_winkler FROM sims""")
def m1_jaro_winkler(spark, sf_dir):
    """Tokens of names that blocking brings together; a name of a block meets those that came before its last record."""
    work = Workspace(spark, "tokens")
    recs = work.table(records(spark, sf_dir), "records")
    rows = res.blocks(res.ranked_keys(blocking_keys(recs), SETTINGS.block_cap), recs, "name_tokens")
    names = work.table(rows.groupBy("key", "name_tokens").agg(F.min("rank").alias("first"), F.max("rank").alias("last")), "names")
    a = names.select("key", "last", F.array_distinct("name_tokens").alias("x"))
    b = names.select("key", "first", F.array_distinct("name_tokens").alias("y"))
    met = a.join(b, "key").where("first < last").select("x", "y").distinct()
    met = met.select(F.explode("x").alias("a"), "y").select("a", F.explode("y").alias("b")).distinct()
    return met.select(
        "a", "b", F.round(similarity.jaro_udf("a", "b"), 9).alias("jaro"), F.round(similarity.jaro_winkler_udf("a", "b"), 9).alias("jaro_winkler")
    )


@query(f"""{PAIRS}
SELECT newer, older, round(CASE WHEN a.address IS NULL OR b.address IS NULL THEN 0.0 ELSE len(list_intersect(list_distinct(string_split(a.address, ' ')), list_distinct(string_split(b.address, ' ')))) * 1.0
    / len(list_distinct(list_concat(string_split(a.address, ' '), string_split(b.address, ' ')))) END, 6) AS overlap,
    CASE WHEN a.dob = b.dob THEN 'same' WHEN year(a.dob) = year(b.dob) AND month(a.dob) = day(b.dob) AND day(a.dob) = month(b.dob) THEN 'swapped'
         WHEN a.dob IS NOT NULL AND b.dob IS NOT NULL THEN 'different' END AS relation
FROM pairs JOIN norm a ON a.record_id = newer JOIN norm b ON b.record_id = older""")
def m5_m6_pair_features(spark, sf_dir):
    pairs = _candidates(records(spark, sf_dir), t.word_set(F.col("address")).alias("words"), "dob")
    return pairs.select(
        "newer", "older", F.round(t.set_overlap(F.col("a_words"), F.col("b_words")), 6).alias("overlap"), t.date_relation(F.col("a_dob"), F.col("b_dob")).alias("relation")
    )


# --- resolved tables ----------------------------------------------------------------------

@query(f"{RESOLVED} SELECT record_id, identity_id, valid_from, valid_to, reason FROM assignments")
def g2_assignments(spark, sf_dir):
    return resolution(spark, sf_dir).assignments


@query(f"{RESOLVED} SELECT identity_id, created_at, merged_into, merged_at FROM identities")
def g2_identities(spark, sf_dir):
    return resolution(spark, sf_dir).identities


@query(f"{RESOLVED} SELECT record_id, identity_id, valid_from, valid_to, reason FROM assignments")
def r4_streamed_assignments(spark, sf_dir):
    """The same records in three micro-batches, a source each, which is their order of arrival."""
    lake = resolver.Lake(spark, Workspace(spark, "r4").folder("lake"))
    sent = bridge.envelopes(spark, sf_dir)
    for batch, source in enumerate(("bank_kyc", "telecom", "ecommerce")):
        lines = sent.where(F.col("source") == source).select(F.to_json(F.struct("source", "ingested_at", "payload")).alias("raw"))
        resolver.resolve_batch(lake, batch, lines)
    return resolver.state(spark, lake.path).assignments


@query(f"{RESOLVED} SELECT CASE len(touched) WHEN 0 THEN 'new' WHEN 1 THEN 'joined' ELSE 'merged' END AS action, count(*) AS n FROM played GROUP BY 1 UNION ALL SELECT 'duplicate', count(*) FROM norm WHERE source = 'telecom'")
def a20_actions(spark, sf_dir):
    """Outcomes if every telecom record is delivered twice."""
    once = canonical(spark, sf_dir)
    every = res.all_outcomes(once.union(once.where("source = 'telecom'")), resolution(spark, sf_dir))
    return every.groupBy("action").agg(F.count("*").alias("n"))


@query(f"""{RESOLVED} SELECT record_id, identity_id, CASE len(touched) WHEN 0 THEN 'new' WHEN 1 THEN 'joined' ELSE 'merged' END AS action, n_older::INT AS matched_records,
CASE WHEN len(touched) > 1 THEN len(touched) ELSE 0 END::INT AS merged_identities FROM played JOIN titles ON titles.c = played.c AND titles.f = keeper""")
def g2_outcomes(spark, sf_dir):
    return resolution(spark, sf_dir).outcomes


@query(f"{RESOLVED} SELECT older AS record_a, newer AS record_b, score, name_similarity, {_JOINED} AS reasons, linked_at AS created_at FROM points WHERE is_match")
def k6_links(spark, sf_dir):
    return resolution(spark, sf_dir).links.withColumn("reasons", F.array_join("reasons", "; "))


@query(f"{RESOLVED}, m AS (SELECT identity_id AS i, record_id FROM assignments WHERE valid_to IS NULL), {_ACCURACY}")
def a12_resolved_accuracy(spark, sf_dir):
    return evaluate.pairwise_metrics(resolution(spark, sf_dir).assignments.where("valid_to is null"), bridge.truth(spark, sf_dir))


@query(f"""{RESOLVED}, spoken AS (
    SELECT identity_id, record_id, source, ingested_at, toks, trim(regexp_replace(regexp_replace(display_name, '[._]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name
    FROM assignments JOIN norm USING (record_id) WHERE valid_to IS NULL
), times AS (SELECT *, count(*) OVER (PARTITION BY identity_id, lower(name)) AS n FROM spoken),
best AS (SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY n DESC, len(toks) DESC, length(name) DESC, ingested_at, record_id) AS k FROM times)
SELECT identity_id, array_to_string(list_transform(regexp_extract_all(max(name) FILTER (k = 1), '[A-Za-z]+|[^A-Za-z]+'), lambda p: upper(left(p, 1)) || lower(substr(p, 2))), '') AS display_name,
    count(*) AS record_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(ingested_at) AS first_seen,
    CASE WHEN merged_into IS NULL THEN 'active' ELSE 'merged' END AS status, merged_into
FROM best JOIN identities USING (identity_id) GROUP BY identity_id, merged_into""")
def q13_identity_summaries(spark, sf_dir):
    return read.summaries(resolution(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


def _flat_report(report):
    f = lambda n: F.col(f"features.{n}").alias(n)
    return report.select(
        "component_id", "risk_score", "label", F.array_join("identity_ids", ",").alias("identity_ids"), F.array_join("reasons", "; ").alias("reasons"),
        *[f(n) for n in ("size", "first_seen_span_days", "kyc_fraction", "max_identities_per_device", "max_identities_per_phone", "address_share")],
    )


@query(f"{RESOLVED}, ident AS (SELECT record_id, identity_id AS i FROM assignments WHERE valid_to IS NULL), {_GRAPH}, {_RINGS}")
def m15_resolved_rings(spark, sf_dir):
    return _flat_report(rings.ring_report(resolution(spark, sf_dir)))


# --- history ------------------------------------------------------------------------------

_MOVES = "SELECT user_id AS record_id, event_id AS trig, ts + INTERVAL 1 HOUR * (event_id % 7 - 3) AS moment, event_type AS identity_id FROM events"


def _moves(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    shifted = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 7 - 3).cast("int"))
    return res.history(e.select(
        F.col("user_id").alias("record_id"), F.col("event_id").alias("trigger"), shifted.alias("at"),
        F.col("event_id").alias("trigger_at"), F.col("event_type").alias("identity_id"),
    )).select("record_id", F.col("trigger").alias("trig"), "identity_id", "valid_from", "valid_to")


_HISTORY = f"""WITH m AS ({_MOVES}), c AS (SELECT *, max(moment) OVER (PARTITION BY record_id ORDER BY trig ROWS UNBOUNDED PRECEDING) AS valid_from FROM m),
h AS (SELECT record_id, trig, identity_id, valid_from, lead(valid_from) OVER (PARTITION BY record_id ORDER BY trig) AS valid_to FROM c)"""


@query(f"{_HISTORY} SELECT * FROM h")
def k4_history(spark, sf_dir):
    return _moves(spark, sf_dir)


@query(f"{_HISTORY} SELECT record_id, identity_id FROM h WHERE valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 00:00:00')")
def p6_as_of(spark, sf_dir):
    return _moves(spark, sf_dir).where(read.valid_at("2024-01-15T00:00:00")).select("record_id", "identity_id")


@query(f"{_HISTORY} SELECT record_id, identity_id FROM h WHERE valid_to IS NULL")
def p18_current(spark, sf_dir):
    return _moves(spark, sf_dir).where(read.valid_at(None)).select("record_id", "identity_id")


# --- graph --------------------------------------------------------------------------------

@query(f"{_PERSONS} SELECT i AS node, c AS component FROM comp")
def g1_components(spark, sf_dir):
    edges = rings.star_edges(rings.identity_attributes(by_person(spark, sf_dir)), SETTINGS.hub_limit)
    return connected_components(edges, Workspace(spark, "g1"))


@query(f"{_PERSONS}, {_RINGS}")
def m15_ring_report(spark, sf_dir):
    return _flat_report(rings.ring_report(by_person(spark, sf_dir)))


@query(f"{_PERSONS}, {_REPORT} SELECT component_id, label, risk AS risk_score, array_to_string(reasons, '; ') AS reasons FROM report WHERE label = 'SUSPICIOUS_RING' ORDER BY component_id LIMIT 3")
def t8_top_suspicious(spark, sf_dir):
    top = analysis.top_suspicious(rings.ring_report(by_person(spark, sf_dir)))
    return top.drop("features").withColumn("reasons", F.array_join("reasons", "; "))


@query(f"""{_PERSONS}, big AS (SELECT c FROM comp GROUP BY c HAVING count(*) >= {SETTINGS.min_ring}), own AS (
    SELECT c, i, kind, value, count(*) OVER w <= {SETTINGS.hub_limit} OR i = min(i) OVER w AS heads FROM comp JOIN ia USING (i) WHERE c IN (SELECT c FROM big) WINDOW w AS (PARTITION BY c, kind, value))
SELECT a.i AS a, b.i AS b, string_agg(DISTINCT a.kind, ',' ORDER BY a.kind) AS kinds
FROM own a JOIN own b ON a.c = b.c AND a.kind = b.kind AND a.value = b.value AND a.i < b.i WHERE a.heads GROUP BY ALL""")
def j11_component_edges(spark, sf_dir):
    r = by_person(spark, sf_dir)
    return rings.shared_edges(rings.ring_report(r), rings.identity_attributes(r)).select("a", "b", F.array_join("kinds", ",").alias("kinds"))


@query(f"""{_PERSONS}, {_REPORT}, {_TRUTH},
votes AS (SELECT i, ring <> '' AS is_ring, CASE WHEN ring <> '' THEN ring ELSE fam END AS grp, count(*) AS n FROM ident JOIN truth USING (record_id) GROUP BY ALL),
modes AS (SELECT i, is_ring, grp FROM votes QUALIFY row_number() OVER (PARTITION BY i ORDER BY n DESC, is_ring DESC, grp) = 1),
seconds AS (SELECT component_id, label, report.n AS size, is_ring, grp, count(*) AS n FROM report JOIN comp USING (c) JOIN modes USING (i) GROUP BY ALL),
top AS (SELECT * FROM seconds QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY n DESC, is_ring DESC, grp) = 1),
sums AS (SELECT (SELECT count(DISTINCT ring) FROM truth WHERE ring <> '') AS planted_rings, count(DISTINCT grp) FILTER (is_ring AND label = 'SUSPICIOUS_RING' AND n * 2 >= size) AS rings_flagged,
    count(*) FILTER (NOT is_ring AND grp <> '') AS family_groups_analyzed, count(*) FILTER (NOT is_ring AND grp <> '' AND label = 'SUSPICIOUS_RING') AS families_falsely_flagged FROM top)
SELECT *, CASE WHEN planted_rings > 0 THEN {half_even_sql("rings_flagged / planted_rings", 3)} END AS ring_recall FROM sums""")
def a19_ring_evaluation(spark, sf_dir):
    r = by_person(spark, sf_dir)
    return rings.evaluate_rings(rings.ring_report(r), r.assignments, bridge.truth(spark, sf_dir))


# --- evaluation ---------------------------------------------------------------------------

@query(f"{NORM}, m AS (SELECT coalesce(phone, record_id) AS i, record_id FROM norm), {_ACCURACY}")
def a12_pairwise_metrics(spark, sf_dir):
    now = records(spark, sf_dir).select("record_id", F.coalesce(F.get("phones", F.lit(0)), F.col("record_id")).alias("identity_id"))
    return evaluate.pairwise_metrics(now, bridge.truth(spark, sf_dir))


@query(f"""{NORM}, {_TRUTH}, m AS (SELECT coalesce(address, record_id) AS i, p, fam, ring FROM norm JOIN truth USING (record_id))
SELECT i AS identity_id, count(DISTINCT p) AS people, CASE WHEN count(DISTINCT fam) = 1 THEN 'same family' WHEN count(DISTINCT ring) = 1 AND max(ring) <> '' THEN 'same fraud ring' ELSE 'unrelated people' END AS kind
FROM m GROUP BY i HAVING count(DISTINCT p) > 1""")
def a15_over_merged(spark, sf_dir):
    now = records(spark, sf_dir).select("record_id", F.coalesce("address", "record_id").alias("identity_id"))
    return evaluate.over_merged(now.join(bridge.truth(spark, sf_dir), "record_id"))


# --- reading ------------------------------------------------------------------------------

@query(f"""{NORM} SELECT (SELECT count(*) FROM norm) AS records, (SELECT max(ingested_at) FROM norm) AS latest_ingest, (SELECT count(DISTINCT person_id) FROM norm) AS active_identities, 0::BIGINT AS merged_identities, 0::BIGINT AS links""")
def q2_stats(spark, sf_dir):
    return read.stats(by_person(spark, sf_dir)).drop("by_source")


@query(f"{NORM} SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM norm), 4) AS share FROM norm GROUP BY source")
def a25_source_shares(spark, sf_dir):
    return read.source_shares(records(spark, sf_dir))


@query(f"{NORM} SELECT record_id, source, ingested_at, display_name AS name_as_written, printf('PID%07d', person_id) AS identity_id FROM norm ORDER BY ingested_at DESC, record_id DESC LIMIT 100")
def q4_activity(spark, sf_dir):
    return read.activity(by_person(spark, sf_dir), 1000)[0].drop("assigned_because")


@query(f"{NORM} SELECT record_id, display_name AS name_as_written, left(phone, 3) || repeat('*', (length(phone) - 7)::BIGINT) || right(phone, 4) AS phones, id_hash IS NOT NULL AS has_government_id FROM norm WHERE person_id = 20 AND ingested_at <= TIMESTAMP '2024-03-05 00:00:00'")
def q5_identity_records(spark, sf_dir):
    rows = read.records_of(by_person(spark, sf_dir), "PID0000020", "2024-03-05T00:00:00")
    return read.public_records(rows).select("record_id", "name_as_written", F.get("phones", F.lit(0)).alias("phones"), "has_government_id")


@query(f"{NORM} SELECT DISTINCT printf('PID%07d', person_id) AS identity_id FROM norm WHERE phone = '+919000170725' ORDER BY 1")
def q9_search_phone(spark, sf_dir):
    return read.smart_search(by_person(spark, sf_dir), "090001 70725").select("identity_id")


@query(f"""{NORM}, hit AS (SELECT record_id FROM attrs WHERE kind = 'nkey' AND value IN ({_sound("'chitra'")}, {_sound("'mehta'")}) GROUP BY record_id HAVING count(DISTINCT value) = 2)
SELECT DISTINCT printf('PID%07d', person_id) AS identity_id FROM norm WHERE record_id IN (SELECT record_id FROM hit) ORDER BY 1 LIMIT 50""")
def a5_search_all_sounds(spark, sf_dir):
    return read.smart_search(by_person(spark, sf_dir), "Chithra  Mehtha").select("identity_id")


@query(f"{NORM} SELECT printf('PID%07d', person_id) AS identity_id, count(*) AS record_count, min(ingested_at) AS first_seen, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM norm GROUP BY person_id")
def a7_profiles(spark, sf_dir):
    return rings.profiles(by_person(spark, sf_dir)).select("identity_id", F.col("records").alias("record_count"), "first_seen", F.array_join("sources", ",").alias("sources"))


@query("""WITH r AS (SELECT 'run' AS run_id, user_id % 20 AS component_id, event_type AS decision, event_id AS reviewed_at FROM events)
SELECT run_id, component_id, decision, reviewed_at FROM r QUALIFY row_number() OVER (PARTITION BY run_id, component_id ORDER BY reviewed_at DESC) = 1""")
def w8_latest_reviews(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return read.latest_reviews(e.select(F.lit("run").alias("run_id"), (F.col("user_id") % 20).alias("component_id"), F.col("event_type").alias("decision"), F.col("event_id").alias("reviewed_at")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def w3_global_numbers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    return res.numbered(rows, ["o_orderdate", "o_orderkey"], Workspace(spark, "w3"), "orders").select("o_orderkey", "number")


# --- questions to the index ---------------------------------------------------------------

_indexed: dict[tuple, tuple] = {}
#: The identity asked about: the first that took another in, one day after it was created.
_WHO = f"""{RESOLVED}, who AS (SELECT coalesce((SELECT min(merged_into) FROM identities), 'PID0000001') AS i),
about AS (SELECT i, date_trunc('second', created_at) + INTERVAL 1 DAY AS t, created_at, merged_into, merged_at FROM who JOIN identities ON identity_id = i)"""
_RESOLVED_IDENT = f"{RESOLVED}, ident AS (SELECT record_id, identity_id AS i FROM assignments WHERE valid_to IS NULL), {_GRAPH}, {_REPORT}"


def indexed(spark: SparkSession, sf_dir: str) -> tuple[index.Index, str, str]:
    """An index of the resolved tables, an identity to ask about, and a time."""
    r = resolution(spark, sf_dir)
    key = (spark.sparkContext.applicationId, id(r))
    if key not in _indexed:
        kept = index.Index(spark, Workspace(spark, "index").folder("tables"))
        kept.save(r)
        who = r.identities.agg(F.coalesce(F.min("merged_into"), F.lit("PID0000001"))).first()[0]
        day = F.date_format(F.date_trunc("second", "created_at") + F.make_dt_interval(F.lit(1)), "yyyy-MM-dd'T'HH:mm:ss")
        _indexed[key] = kept, who, r.identities.where(F.col("identity_id") == who).select(day).first()[0]
    return _indexed[key]


@query(f"""{_WHO}, mine AS (SELECT record_id FROM assignments, about WHERE identity_id = i AND valid_from <= t AND (valid_to IS NULL OR valid_to > t))
SELECT i AS identity_id, strftime(t, '%Y-%m-%dT%H:%M:%S') AS as_of, CASE WHEN merged_at <= t THEN 'merged' ELSE 'active' END AS status, CASE WHEN merged_at <= t THEN merged_into END AS merged_into,
    count(record_id) AS record_count, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources, coalesce(string_agg(DISTINCT display_name, ',' ORDER BY display_name), '') AS names_seen
FROM about LEFT JOIN (SELECT record_id, source, display_name FROM mine JOIN norm USING (record_id)) ON true GROUP BY ALL""")
def q5_identity_view(spark, sf_dir):
    kept, who, at = indexed(spark, sf_dir)
    seen = kept.identity_view(who, at).drop("records", "created_at")
    return seen.withColumns({c: F.array_join(c, ",") for c in ("sources", "names_seen")})


@query(f"{_WHO} SELECT record_id, valid_from AS joined_at, valid_to AS left_at, reason FROM assignments JOIN who ON i = identity_id")
def q6_history_view(spark, sf_dir):
    kept, who, _ = indexed(spark, sf_dir)
    return kept.history_view(who)


@query(f"""{_WHO}, mine AS (SELECT record_id FROM assignments JOIN who ON i = identity_id WHERE valid_to IS NULL)
SELECT older AS record_a, newer AS record_b, score, {_JOINED} AS evidence, linked_at FROM points
WHERE is_match AND older IN (SELECT record_id FROM mine) AND newer IN (SELECT record_id FROM mine)""")
def q7_explain_view(spark, sf_dir):
    kept, who, _ = indexed(spark, sf_dir)
    return kept.explain_view(who).withColumn("evidence", F.array_join("evidence", "; "))


@query(f"""{_WHO}, one AS (SELECT min(record_id) AS record_id FROM assignments JOIN who ON i = identity_id WHERE valid_to IS NULL)
SELECT record_id, 'now' AS as_of, identity_id FROM assignments JOIN one USING (record_id) WHERE valid_to IS NULL""")
def q8_record_view(spark, sf_dir):
    kept, who, _ = indexed(spark, sf_dir)
    one = kept.identity(who).assignments.where((F.col("identity_id") == who) & read.valid_at(None)).agg(F.min("record_id")).first()[0]
    return kept.record_view(one)


@query(f"""{RESOLVED}, hit AS (SELECT record_id FROM attrs WHERE kind = 'nkey' AND value IN ({_sound("'chitra'")}, {_sound("'mehta'")}) GROUP BY record_id HAVING count(DISTINCT value) = 2),
found AS (SELECT DISTINCT identity_id FROM assignments WHERE valid_to IS NULL AND record_id IN (SELECT record_id FROM hit))
SELECT identity_id, (SELECT count(*) > 50 FROM found) AS truncated, count(*) AS record_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM (SELECT identity_id FROM found ORDER BY identity_id LIMIT 50) JOIN assignments USING (identity_id) JOIN norm USING (record_id) WHERE valid_to IS NULL GROUP BY identity_id""")
def q9_search_resolved(spark, sf_dir):
    found = indexed(spark, sf_dir)[0].smart_search("Chithra  Mehtha")
    return found.select("identity_id", "truncated", "record_count", F.array_join("sources", ",").alias("sources"))


def _reviewed(spark, sf_dir) -> index.Index:
    """All groups of a run confirmed, then every second one reviewed again."""
    kept = index.Index(spark, Workspace(spark, "reviews").folder("tables"))
    r = resolution(spark, sf_dir)
    kept.save(r)
    kept.save_report(rings.ring_report(r), "run")
    every = kept.report().select("run_id", "component_id", F.lit("confirmed_fraud").alias("decision"), F.lit(" first ").alias("note"), F.lit("2024-02-01").alias("reviewed_at"))
    kept.save_reviews(every)
    kept.save_reviews(every.where("component_id % 2 = 0").withColumn("decision", F.lit("false_alarm")).withColumn("note", F.lit(None).cast("string")))
    return kept


@query(f"""{_RESOLVED_IDENT} SELECT component_id, label, CASE WHEN component_id % 2 = 0 THEN 'false_alarm' ELSE 'confirmed_fraud' END AS decision,
CASE WHEN component_id % 2 = 0 THEN '' ELSE 'first' END AS note FROM report""")
def k8_reviews(spark, sf_dir):
    return _reviewed(spark, sf_dir).rings_view().select("component_id", "label", "decision", "note")


@query(f"""{_RESOLVED_IDENT}, labels AS (SELECT label, count(*) AS n FROM report GROUP BY label), decided AS (SELECT CASE WHEN component_id % 2 = 0 THEN 'false_alarm' ELSE 'confirmed_fraud' END AS d, count(*) AS n FROM report GROUP BY 1)
SELECT (SELECT count(*) FROM report WHERE label = 'SUSPICIOUS_RING') AS suspicious_total, 0::BIGINT AS suspicious_open,
    coalesce((SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM labels), '') AS label_counts, coalesce((SELECT string_agg(d || '=' || n, ',' ORDER BY d) FROM decided), '') AS decisions""")
def q3_overview(spark, sf_dir):
    told = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    seen = _reviewed(spark, sf_dir).overview()
    return seen.select("suspicious_total", "suspicious_open", told("label_counts").alias("label_counts"), told("decisions").alias("decisions"))


@query(f"""{_RESOLVED_IDENT}, one AS (SELECT * FROM report WHERE component_id = 1), own AS (
    SELECT ia.*, count(*) OVER w <= {SETTINGS.hub_limit} OR ia.i = min(ia.i) OVER w AS heads FROM one JOIN comp USING (c) JOIN ia ON ia.i = comp.i WINDOW w AS (PARTITION BY kind, value)),
ties AS (SELECT a.i AS a, b.i AS b, string_agg(DISTINCT a.kind, '+' ORDER BY a.kind) AS kinds FROM own a JOIN own b ON a.kind = b.kind AND a.value = b.value AND a.i < b.i WHERE a.heads GROUP BY ALL)
SELECT component_id, label, risk AS risk_score, identity_ids AS nodes, (SELECT string_agg(a || ' ' || b || ' ' || kinds, ',' ORDER BY a, b) FROM ties) AS edges,
    'confirmed_fraud' AS decision FROM one""")
def q11_ring_detail(spark, sf_dir):
    kept = _reviewed(spark, sf_dir)
    edge = lambda e: F.concat_ws(" ", e["a"], e["b"], F.array_join(e["kinds"], "+"))
    return kept.ring_detail("run", 1).select(
        "component_id", "label", "risk_score", F.array_join("nodes.identity_id", ",").alias("nodes"), F.array_join(F.transform("edges", edge), ",").alias("edges"),
        F.col("review.decision").alias("decision"),
    )
