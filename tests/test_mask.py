from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from veladura.functions.rules import RULES
from veladura.operators.detect import detect, with_hits
from veladura.operators.mask import MaskConfig, censor, mask_table, mask_text, partial_mask

RECORD = "Cliente: Ana RFC: ABCD850101XY1 correo ana.perez@mail.com tel 5512345678 🐍 ip 10.0.0.1 No. 12"


def masked(spark, text, **config):
    return mask_text(spark.createDataFrame([(text,)], "t string"), "t", MaskConfig(**{"salt": "s3cret", **config})).first()["t"]


@pytest.mark.parametrize(
    "value, kind, percent, expected",
    [
        ("a@b.co", "email", 30, "*@b.co"), ("ab@b.co", "email", 30, "**@b.co"), ("abc@b.co", "email", 30, "a*c@b.co"),
        ("1", "nss", 30, "1"), ("12", "nss", 30, "*2"), ("1234567890", "telefono", 30, "1*******90"),
        ("1234567890", "telefono", 100, "1234567890"), ("1234567890", "telefono", 0, "*********0"), ("1234567890", "telefono", 40, "12******90"),
    ],
)
def test_partial(spark, value, kind, percent, expected):
    df = spark.createDataFrame([(value, kind)], "v string, k string")
    assert df.select(partial_mask(F.col("v"), F.col("k"), "*", percent)).first()[0] == expected


def test_modes(spark):
    assert masked(spark, RECORD, mode="full") == (
        "Cliente: Ana RFC: [RFC] correo [EMAIL] tel [TELEFONO] 🐍 ip [IP_ADDRESS] [NUMERO_EXTERIOR]"
    )
    digest = hashlib.sha256(b"10.0.0.1").hexdigest()[:8]
    assert f"ip HASH_{digest} " in masked(spark, RECORD, mode="hash")
    assert masked(spark, RECORD, mode="full", modes={"rfc": "partial", "telefono": "hash"}).startswith("Cliente: Ana RFC: A**********Y1 correo [EMAIL] tel HASH_")


def test_fake_values_are_valid_and_stable(spark):
    df = spark.createDataFrame([(1, RECORD), (2, RECORD + " otra vez")], "id int, t string")
    fake = mask_text(df, "t", MaskConfig(mode="fake", salt="s3cret"))
    kinds = {}
    for r in detect(fake, "t", ["id"]).collect():
        kinds.setdefault(r["id"], []).append((r["type"], r["value"]))
    assert kinds[1] == kinds[2]
    assert {k for k, _ in kinds[1]} >= {"rfc", "email", "ip_address"}
    text = fake.where("id = 1").first()["t"]
    assert "[FAKE_numero_exterior]" in text and "ABCD850101XY1" not in text


def test_preserve_keeps_the_layout_of_both_rfc_lengths(spark):
    for value in ("ABC850101XY1", "ABCD850101XY1"):
        out = masked(spark, f"rfc {value}", mode="preserve").split(" ")[1]
        letters = len(value) - 9
        assert len(out) == len(value) and not any(c.isdigit() for c in out[:letters]) and out[letters : letters + 6].isdigit()
    curp = masked(spark, "curp GODE561231HDFRRN09", mode="preserve").split(" ")[1]
    assert curp[:4].isalpha() and curp[4:10].isdigit() and curp[10:16].isalpha() and curp[16:].isdigit()


def test_full_and_hash_leave_no_hit(spark):
    df = spark.createDataFrame([(RECORD,)], "t string")
    assert with_hits(mask_text(df, "t", MaskConfig(mode="full")), "t").first()["hits"] == []


def test_excluded_context_and_columns(spark):
    assert masked(spark, "Folio 06500", mode="full", excluded=["folio"]) == "Folio 06500"
    df = spark.createDataFrame([("Ana 06500", "a@b.co", 3)], "nombre string, email string, n int")
    out = mask_table(df, MaskConfig(mode="full", excluded=["NOMBRE"]))
    assert out.columns == ["nombre", "email", "n"] and out.first() == ("Ana 06500", "[EMAIL]", 3)


def test_levels(spark):
    df = spark.createDataFrame([(RECORD,)], "t string")
    low, medium, high = (censor(df, "t", level).first()["t"] for level in ("bajo", "medio", "alto"))
    assert "ABCD850101XY1" in low and "10.0.0.1" in low and "5512345678" not in low
    assert "ABCD850101XY1" not in medium and "10.0.0.1" not in medium and "No. 12" in medium
    assert "No. 12" not in high


def test_null_stays_null_and_unknown_modes_are_refused(spark):
    assert masked(spark, None) is None
    with pytest.raises(ValueError):
        MaskConfig(mode="otro")
    assert len(RULES) == 14


def test_masking_is_one_stage_without_python(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    plan = mask_table(df, MaskConfig(mode="fake", salt="s3cret"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_filters_reach_the_scan_below_masking(spark, tmp_path):
    spark.createDataFrame([(i, f"mail a{i}@example.com") for i in range(20)], "id bigint, t string").write.parquet(f"{tmp_path}/t")
    plan = mask_table(spark.read.parquet(f"{tmp_path}/t"), MaskConfig(mode="full")).where("id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,5)" in plan and plan.count("__pieces") <= 2 * plan.count("Project")
    assert mask_table(spark.read.parquet(f"{tmp_path}/t"), MaskConfig(mode="full")).where("id = 5").first()["t"] == "mail [EMAIL]"


def test_fake_modes_need_a_salt():
    with pytest.raises(ValueError):
        MaskConfig(mode="fake")
    with pytest.raises(ValueError):
        MaskConfig(modes={"rfc": "preserve"})


def test_fake_mails_do_not_collide(spark):
    ids = spark.range(100_000).selectExpr("concat('user', id, '@example.com') AS t")
    assert mask_text(ids, "t", MaskConfig(mode="fake", salt="s3cret")).distinct().count() == 100_000
