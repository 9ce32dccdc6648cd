"""Single functions: cleaning, sounds, similarity."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import similarity as s, text as t


def one(spark, column, *values):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_phone_formats_collapse(spark):
    forms = ["9845012345", "+91 98450 12345", "098450-12345", "91-9845012345", "(98450) 12345"]
    assert set(one(spark, t.phone, *forms)) == {"+919845012345"}


def test_implausible_phones(spark):
    assert one(spark, t.phone, "9999999999", "9876543210", "12345", "5845012345", "9898989898", None, "") == [None] * 7


def test_birth_dates(spark):
    got = one(spark, lambda x: t.birth_date(x).cast("string"), "1990-03-07", "07/03/1990", "7-3-1990", " 7  mar 1990", "07 March 1990", "7.3.1990")
    assert set(got) == {"1990-03-07"}
    assert one(spark, t.birth_date, "1890-01-01", "2999-01-01", "31/02/1990", "soon", None) == [None] * 5


def test_address(spark):
    raw = "No. 12, 3rd Crs, MG Rd, Jaya Ngr 560041"
    assert one(spark, t.address, raw, None, "560041") == ["12 3rd cross mg road jaya nagar", None, None]
    assert one(spark, t.address_pin, raw, "x") == ["560041", None]


def test_email_and_names(spark):
    assert one(spark, t.email, " A.B@Mail.Example ", "a@b", "a b@c.d", None) == ["a.b@mail.example", None, None, None]
    assert one(spark, t.name_tokens, "Dr. R. Karthik_99", "", None) == [["r", "karthik"], [], []]


def test_hashes_agree_and_hide(spark):
    a, b, c = one(spark, t.hashed_id, "abcde 1234f", "ABCDE1234F", None)
    assert a == b and len(a) == 24 and c is None


@pytest.mark.parametrize("names", [["lakshmi", "laxmi"], ["mohammed", "muhammad", "mohd", "md"], ["karthik", "kartik"], ["suresh", "sureesh"]])
def test_sounds(spark, names):
    keys = one(spark, t.sound_key, *names)
    assert len(set(keys)) == 1 and keys == [s.key_of(n) for n in names]


def test_title_case_follows_every_other_character(spark):
    assert one(spark, t.title_case, "nikhil_iyer o'brien abc7def") == ["Nikhil_Iyer O'Brien Abc7Def"]


def test_masks(spark):
    assert one(spark, t.masked_phone, "+919845012345") == ["+91******2345"]
    assert one(spark, t.masked_email, "anand@mail.example", "a@b.c") == ["an***@mail.example", "a*@b.c"]


def test_jaro_winkler():
    assert s.jaro_winkler("martha", "marhta") == pytest.approx(0.961, abs=1e-3)
    assert s.jaro("", "") == 1 and s.jaro("", "a") == 0 and s.jaro("ab", "cd") == 0
    assert s.jaro("abcdef", "acbdef") == pytest.approx((1 + 1 + 5 / 6) / 3)


def test_name_similarity_bands():
    assert s.name_similarity(["r", "karthik"], ["karthik", "ramesh"]) == pytest.approx(0.95)
    assert s.name_similarity(["ramesh", "sharma"], ["rahul", "sharma"]) <= 0.6
    assert s.name_similarity([], ["a"]) == 0
    assert s.token_similarity("r", "r") == 0.9


def test_registered_in_sql(spark):
    t.register(spark)
    assert spark.sql("SELECT round(kw_jaro_winkler('martha', 'marhta'), 3)").first()[0] == 0.961


def test_package_is_shipped_once(spark, monkeypatch):
    from kinweave import shipping

    monkeypatch.delenv("PYTHONPATH", raising=False)
    monkeypatch.setattr(shipping, "_done", set())
    run = shipping.shipped(lambda session, _: session.createDataFrame([("martha", "marhta")], "a string, b string").select(s.jaro_udf("a", "b")))
    assert run(spark, "").first()[0] == pytest.approx(0.944, abs=1e-3)
    assert run(spark, "").count() == 1 and len(shipping._done) == 1
