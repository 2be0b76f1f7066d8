"""Normalisation against the standard library, on whole test texts."""

import unicodedata

from pyspark.sql import functions as F

from hemicycle.functions import text


def plain(s):
    return unicodedata.normalize("NFKD", s.lower()).encode("ascii", "ignore").decode().strip()


def test_party_names(spark, sf):
    odd = ["Evolución Política", "  ÑUÑOA ", "½ ﬁn №5 … ™", "日本 é", "Straße Łódź", "İstanbul", "\tx\n", "", "𝐀𝐁", "㎏ ㈱ ⅷ"]
    rows = spark.createDataFrame([(s,) for s in odd], "s string")
    for r in rows.select("s", text.normalize_party_name(F.col("s")).alias("p")).collect():
        assert r.p == plain(r.s), r.s
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", text.normalize_party_name(F.col("text")).alias("p"))
    for r in docs.collect():
        assert r.p == plain(r.text)


def test_codes(spark):
    rows = spark.createDataFrame([("1101",), ("01101",), ("1101.0",), ("13101",)], "c string")
    assert [r[0] for r in rows.select(text.normalize_cut(F.col("c"))).collect()] == ["01101", "01101", "01101", "13101"]


def test_small_helpers(spark):
    row = spark.range(1).select(
        text.parse_district_id(F.lit("DISTRITO 07 (b)")).alias("d"), text.parse_district_id(F.lit("none")).alias("none"),
        text.independent_to_party(F.lit(" Independiente  Liberal de Chile")).alias("party"),
        text.normalize_commune_name(F.lit(None).cast("string")).alias("empty"),
        text.resolve_commune_alias(F.lit("Marchigüe")).alias("alias"),
        text.candidate_full_name(F.lit(" Ana  María"), F.lit("Soto "), F.lit(None).cast("string")).alias("name"),
    ).first()
    assert tuple(row) == (7, None, "partido liberal de chile", "", "MARCHIHUE", "Ana María Soto")
