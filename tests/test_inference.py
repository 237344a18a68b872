"""CSV with inferred types."""

import decimal

from perkframe import sources
from perkframe.sources.inference import BAD


def read(spark, tmp_path, text, **options):
    path = tmp_path / "x.csv"
    path.write_text(text)
    return sources.read_csv_inferred(spark, str(path), **options)


def test_types_hold_every_cell(spark, tmp_path):
    text = ("i,big,huge,x,flag,day,time,mixed,none,s\n"
            "1,3000000000,123456789012345678901,1.5,true,2024-01-31,2024-01-31 10:00:00,1,,a\n"
            "-2, 7 ,5,2,FALSE,2024-02-29,2024-01-31,1.5,,007x\n"
            ",,,1e3,,,,2024-01-01,,\n")
    df = read(spark, tmp_path, text)
    assert dict(df.dtypes) == {"i": "bigint", "big": "bigint", "huge": "decimal(38,0)", "x": "double",
                               "flag": "boolean", "day": "date", "time": "timestamp_ntz", "mixed": "string",
                               "none": "string", "s": "string", BAD: "string"}
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, -2, None] and [r["x"] for r in rows] == [1.5, 2.0, 1000.0]
    assert rows[0]["huge"] == decimal.Decimal("123456789012345678901") and rows[1]["flag"] is False
    assert rows[1]["s"] == "007x" and rows[2]["mixed"] == "2024-01-01" and not any(r[BAD] for r in rows)


def test_one_late_cell_decides_the_type(spark, tmp_path):
    path = tmp_path / "many"
    spark.range(20_000).selectExpr("id", "IF(id = 19999, 'x', CAST(id AS STRING)) AS late",
                                   "IF(id = 0, '0.5', CAST(id AS STRING)) AS first").repartition(6) \
        .write.option("header", True).csv(str(path))
    df = sources.read_csv_inferred(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "late": "string", "first": "double", BAD: "string"}
    assert df.count() == 20_000 and df.agg({"id": "sum"}).first()[0] == 19999 * 10_000


def test_quoted_newlines_and_bad_records(spark, tmp_path):
    text = ('id,text,n\n1,"two\nlines, ""quoted""",5\n2,short\n3,too,many,cells\n4,"[\'a\', \'b\']",6\n')
    df = read(spark, tmp_path, text)
    assert dict(df.dtypes)["id"] == "bigint" and dict(df.dtypes)["n"] == "bigint"
    rows = df.collect()
    good = [r for r in rows if r[BAD] is None]
    assert [(r["id"], r["text"], r["n"]) for r in good] == [(1, 'two\nlines, "quoted"', 5), (4, "['a', 'b']", 6)]
    bad = [r for r in rows if r[BAD] is not None]
    assert [r[BAD].strip() for r in bad] == ["2,short", "3,too,many,cells"]
    assert all(r["id"] is None and r["text"] is None and r["n"] is None for r in bad)
    assert df.filter(f"{BAD} IS NOT NULL").count() == 2  # also when only that column is asked for


def test_no_rows_and_split_files(spark, tmp_path):
    df = read(spark, tmp_path, "a,b\n")
    assert df.count() == 0 and dict(df.dtypes) == {"a": "string", "b": "string", BAD: "string"}
    df = read(spark, tmp_path, "a,b c\n1,x\n2,y\n", multi_line=False)
    assert dict(df.dtypes) == {"a": "bigint", "b c": "string", BAD: "string"} and df.count() == 2
