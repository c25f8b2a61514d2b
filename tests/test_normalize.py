import datetime

import pytest
from pyspark.sql import functions as F

from claimgraph.functions import dates
from claimgraph.functions import normalize as N

QUANTITIES = [
    ("52,417.09", "Rs Million", 52417.09 * 1e6),
    ("(2,718.4)", None, -2718.4),
    ("7", "\u20b9 Cr", 7e7),
    ("4.5", "Lakh", 4.5e5),
    ("9", "Lac", 9e5),
    ("2", "Bn", 2e9),
    ("611cr", None, 611e7),
    ("12 million", "Cr", 12e6),
    ("8.25", "per cent", 8.25),
    ("8.257", "per cent", 8.25),
    ("52,417.093", "Rs Million", 52417.09 * 1e6),
    ("Rs. 7.50", None, None),
    ("Rs 7.50", None, 7.5),
    ("June 30, 2021", None, 302021.0),
    ("(2,718.4) Cr", None, 2718.4e7),
    ("(-6)", None, -6.0),
    ("3.1.4", None, None),
    ("nothing here", None, None),
    ("", None, None),
    (None, None, None),
]


def test_quantities(spark):
    rows = spark.createDataFrame([(r, u) for r, u, _ in QUANTITIES], "raw string, unit string").select(N.quantity(F.col("raw"), F.col("unit"))).collect()
    for (raw, _, want), got in zip(QUANTITIES, rows):
        assert got[0] == (None if want is None else pytest.approx(want, rel=1e-12)), raw


def test_fiscal_years(spark):
    wanted = {"FY24": 2024, "FY2024": 2024, "FY 2023-24": 2024, "2023-24": 2024, "1999-00": 2000, "2049-50": None, "2023-30": None, "Q4 FY24": None, "": None}
    got = spark.createDataFrame([(k,) for k in wanted], "x string").select("x", N.fiscal_year_end(F.col("x"))).collect()
    assert {r[0]: r[1] for r in got} == wanted


def test_identifiers_and_names(spark):
    row = spark.sql("SELECT '  u10203mh1998plc004455 ' AS a, 'ref 0042' AS b, 'Kestrel Harbour Limited' AS c, 'Co-op Store' AS d, 'length_of_the_pier' AS e")
    got = row.select(N.identifier(F.col("a")), N.identifier(F.col("b")), N.entity_name(F.col("c")), N.entity_name(F.col("d")), N.attribute_tokens(F.col("e"))).first()
    assert tuple(got) == ("10203MH1998PLC004455", "REF 0042", "kestrel harbour", "op store", ["length", "pier"])


def test_dates(spark):
    """Missing parts are those of the reference date, never of the day of the run."""
    wanted = {"3 May 2019": "2019-05-03", "31 June 2019": None, "2019-05-03": "2019-03-05", "2019-05-23": "2019-05-23", "closed on 4th of July, 2015.": "2015-07-04", "2018": "2018-02-10", "3 May 9999": None, "no day": None, "": None, "May": "2011-05-10"}
    df = spark.createDataFrame([(k,) for k in wanted], "x string").coalesce(1)
    got = df.select("x", dates.point_in_time(F.col("x"), datetime.date(2011, 2, 10))).collect()
    assert {r[0]: r[1] for r in got} == wanted


def test_identifiers_of_large_keys_equal_the_sql(spark, tmp_path):
    """Keys of over five digits make no company number, and keep their letter."""
    import duckdb

    from claimgraph.queries import oracle_sql, queries

    keys = [0, 7, 99_999, 100_000, 142_857, 142_858, 900_001, 400_000_000]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: r.identifier for r in queries()["normalize_identifier"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == dict(con.sql(oracle_sql()["normalize_identifier"]).fetchall()) and got[100_000] == "U100000HR2011PLC700000"
