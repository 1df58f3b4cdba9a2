import json

import pytest
from pyspark.errors import AnalysisException  # noqa: F401
from pyspark.sql import functions as F

from queries import write_arrays
from reviewmill.operators import validation as V
from reviewmill.plans import importing as I
from reviewmill.schemas import REVIEWS
from reviewmill.sources import corpora, tables
from reviewmill.sources.reviews import files_not_utf8, read_reviews

NOT_OBJECT = "value: Input should be a valid dictionary or instance of RawReviewRow"


def validated(spark, paths, fmt):
    rows = V.validate_rows(read_reviews(spark, paths, fmt)).orderBy("path", "row_number").collect()
    return [(r.row_number, r.error, r.text) for r in rows]


def test_csv(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text(
        "rating,text,external_id,occurred_at,attributes\n"
        "2,lid does not close,kettle-7,2025-03-01 08:00,\n"
        "1,,kettle-8,2025-03-02,{}\n"
        "12,spout drips,kettle-9,2025-03-03,{}\n"
        "\n"
        ',"steam\nand ""foam""",,2025-03-04,"{""cups"":6}"\n'
        "3,no handle,kettle-10\n"
        "3,two handles,kettle-11,2025-03-05,{},left over\n"
        "3,cracked,kettle-12,2025-03-06,{cups\n"
    )
    b.write_text("occurred_at,text\r\n2026-01-01,hello\r\n", newline="")
    assert validated(spark, [str(a), str(b)], "csv") == [
        (2, None, "lid does not close"),
        (3, "text: Value error, text must not be blank", None),
        (4, "rating: Value error, rating must be between 1 and 5", "spout drips"),
        (5, None, 'steam\nand "foam"'),
        (6, "occurred_at: Input should be a valid datetime", "no handle"),
        (7, None, "two handles"),
        (8, "attributes: Value error, Expecting property name enclosed in double quotes: line 1 column 2 (char 1)", "cracked"),
        (2, None, "hello"),
    ]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    lines = [
        '{"occurred_at": "2025-03-01 08:00:30", "text": "dents"}', "kettle", "", '{"text": "", "occurred_at": "x"}',
        "[1]", '{"text":"t","occurred_at":1700000000} x', '{"text":"t","occurred_at":1,"rating":5.0,"external_id":5}',
        '{"text":"t","occurred_at":1,"rating":true}', '{"text":"a","text":"b","occurred_at":1}', '{"occurred_at":1}',
        '{"text":"a]","occurred_at":1}],[{"b":2}',
    ]
    path.write_text("\n".join(lines) + "\n")
    assert validated(spark, str(path), "jsonl") == [
        (1, None, "dents"), (2, "invalid json: Expecting value", None),
        (4, "text: Value error, text must not be blank", None), (5, NOT_OBJECT, None),
        (6, "invalid json: Extra data", None), (7, "external_id: Input should be a valid string", "t"),
        (8, None, "t"), (9, None, "b"), (10, "text: Field required", None), (11, "invalid json: Extra data", None),
    ]


def test_json_array(spark, tmp_path):
    contents = ['[{"occurred_at": "2025-03-01", "text": "dents"}, 3, null]', '{"cups": 6}', "[1,", "[]"]
    for name, content in zip("abcd", contents, strict=True):
        (tmp_path / f"{name}.json").write_text(content)
    assert validated(spark, [str(tmp_path / f"{n}.json") for n in "abcd"], "json") == [
        (1, None, "dents"), (2, NOT_OBJECT, None), (3, NOT_OBJECT, None),
        (1, "json payload must be an array of review objects", None), (1, "invalid json: Expecting value", None),
    ]


def test_csv_with_long_quoted_text_and_a_missing_cell(spark, tmp_path):
    path, long = tmp_path / "a.csv", 'w "" ' * 8000
    path.write_text(f'text,occurred_at,rating\n"{long}",2025-03-01\n"{long}",2025-03-01,4,5\n')
    want = long.replace('""', '"').strip()
    assert validated(spark, str(path), "csv") == [(2, None, want), (3, None, want)]


@pytest.mark.parametrize("header", ["text,text,occurred_at", "Text,text,occurred_at", "text,TEXT,text,occurred_at"])
def test_csv_with_repeated_headers(spark, tmp_path, header):
    path = tmp_path / "a.csv"
    cells = ["first", *["middle"] * (header.count(",") - 2), "last"]
    path.write_text("\ufeff" + header + "\n" + ",".join([*cells, "2025-03-01"]) + "\n")
    assert validated(spark, str(path), "csv") == [(2, None, "last")]


def test_separators_alone_are_blank(spark):
    cases = ["\x1c", " \x1f\t", "\u2003", "a\x1c", ""]
    df = spark.createDataFrame([(("string", c),) for c in cases], "c struct<kind:string,value:string>")
    value, problem = V.validate_text(F.col("c"))
    got = df.select(value.alias("v"), problem.alias("p"), V.blank_to_null(F.col("c.value")).alias("b")).collect()
    assert [r.p for r in got] == [V.BLANK_TEXT] * 3 + [None, V.BLANK_TEXT]
    assert [r.b is None for r in got] == [True, True, True, False, True]


def test_row_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 1500)):
        lines = [json.dumps({"text": f"{name}{i}", "occurred_at": 1}) if i % 7 else "" for i in range(1, n + 1)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = V.validate_rows(read_reviews(spark, str(tmp_path / "*.jsonl"), "jsonl"))
        assert rows.rdd.getNumPartitions() > 10
        wrong = rows.where(F.col("row_number") != F.substring("text", 2, 9).cast("long")).count()
        assert (rows.count(), wrong) == (4000 - 571 + 1500 - 214, 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_occurred_at(spark, session_zone):
    day = 1786492800
    cases = {
        "2026-08-12": day, "2026-08-12 00:01": day + 60, "2026-08-12T00:00:02Z": day + 2, "2026-08-12_03:00+03:00": day,
        "2026-08-12t03:00:00.5+0300": day + 0.5, "1700000000": 1700000000, "1700000000000": 1700000000, "-1.5": -1.5,
        "12/08/2026": "invalid character in year", "": "input is too short", "2026-13-01": "month value is outside expected range of 1-12",
        "2026-02-30": "day value is outside expected range", "2026-08-12T25:00": "unexpected extra characters at the end of the input",
        "99999999999999999": "dates after 9999 are not supported as unix timestamps",
    }
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        value, problem = V.parse_occurred_at(F.col("c"))
        df = spark.createDataFrame([(k, ("string", k)) for k in cases], "k string, c struct<kind:string,value:string>")
        for row in df.select("k", (F.unix_micros(value) / 1e6).alias("v"), problem.alias("p")).collect():
            want = cases[row.k]
            if isinstance(want, str):
                assert row.p == "Input should be a valid datetime or date, " + want, row.k
            else:
                assert (row.v, row.p) == (want, None), row.k
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rating(spark):
    cases = [("string", "5", 5), ("string", " 4 ", 4), ("string", "5.0", 5), ("number", "5", 5), ("boolean", "true", 1),
             ("string", " ", None), ("null", None, None), ("absent", None, None), ("string", "4.5", V.NOT_AN_INTEGER_TEXT),
             ("number", "4.5", V.NOT_A_WHOLE_NUMBER), ("string", "x", V.NOT_AN_INTEGER_TEXT), ("string", "9", V.RATING_BOUNDS),
             ("boolean", "false", V.RATING_BOUNDS), ("array", "[1]", V.NOT_AN_INTEGER)]
    value, problem = V.parse_rating(F.col("c"))
    df = spark.createDataFrame([(i, c[:2]) for i, c in enumerate(cases)], "i int, c struct<kind:string,value:string>")
    for row in df.select("i", value.alias("v"), problem.alias("p")).collect():
        want = cases[row.i][2]
        assert (row.v, row.p) == ((None, want) if isinstance(want, str) else (want, None)), cases[row.i]


def test_import_and_append(spark, tmp_path):
    good, bad = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"
    good.parent.mkdir()
    records = [("Great &amp; good", "e1"), ("great &amp; GOOD", "e2"), ("Another one", "e1"), ("<p></p>", "e4"), ("Third", None), (" ", None)]
    good.write_text("\n".join(json.dumps({"text": t, "occurred_at": 1, "external_id": e}) for t, e in records))
    bad.write_bytes(b'{"text": "caf\xe9", "occurred_at": 1}\n')
    owner = dict(organization_id=F.lit("o"), product_id=F.lit("p"), source_id=F.lit("s"), ingested_at=F.timestamp_seconds(F.lit(5)))
    path = str(tmp_path / "in" / "*.jsonl")
    assert files_not_utf8(spark, path).count() == 1
    result = I.import_reviews(spark, path, "jsonl", **owner)
    outcomes = {r.row_number: r.outcome for r in result.classified.collect()}
    assert outcomes == {1: "imported", 2: "duplicate", 3: "duplicate", 4: "rejected", 5: "imported", 6: "rejected"}
    assert [tuple(r)[1:] for r in result.summary.collect()] == [(6, 2, 2, 2)]
    assert {r.row_number: r.reason for r in result.errors.collect()} == {4: I.TOO_SHORT, 6: "text: Value error, text must not be blank"}
    assert [r.path.endswith("b.jsonl") for r in result.failed_files.collect()] == [True]
    store = str(tmp_path / "reviews")
    tables.append_reviews(result.reviews, store)
    stored = tables.read_table(spark, store, REVIEWS)
    again = I.import_reviews(spark, path, "jsonl", stored=stored, **owner)
    # The third text lost only its external id in the first run, and that is stored now.
    assert [tuple(r)[1:] for r in again.summary.collect()] == [(6, 0, 4, 2)]
    assert {r.id for r in stored.collect()} == {r.id for r in result.reviews.collect()}


def test_sources_report_what_is_missing(spark, tmp_path):
    with pytest.raises(tables.MissingObject):
        tables.require_files(spark, [str(tmp_path / "none.csv")])
    with pytest.raises(ValueError):
        read_reviews(spark, "x", "xml")
    assert tables.landing_path("/l", "org", "csv").startswith("/l/imports/org/")
    path = tmp_path / "l.csv"
    path.write_text("text,label\ngood,positive\nodd,mixed\n")
    with pytest.raises(ValueError, match="mixed"):
        corpora.read_labelled(spark, str(path))
    assert corpora.read_corpus(spark, str(path)).count() == 2


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_snapshot(spark, path, "id bigint").count() == 0
    tables.write_snapshot(spark.range(3), path)
    old = tables.read_snapshot(spark, path, "id bigint")
    tables.write_snapshot(old.where("id > 0"), path)
    (tmp_path / "t" / "snapshot=99999999999999999999").mkdir()
    assert (old.count(), tables.read_snapshot(spark, path, "id bigint").count()) == (3, 2)


def test_csv_headers_that_span_lines(spark, tmp_path):
    """Two files whose headers share the first line only, one header of a single cell, one empty file."""
    (tmp_path / "a.csv").write_text('text,"no\nte"\nshort hose,x\n')
    (tmp_path / "b.csv").write_text('text,"no\nx",rating\nlong hose,y,4\n')
    (tmp_path / "c.csv").write_text("text\nonly a text\n")
    (tmp_path / "d.csv").write_text("")
    rows = {r.text.value: (r.row_number, r.rating.kind, r.rating.value) for r in read_reviews(spark, str(tmp_path), "csv").collect()}
    assert rows == {"short hose": (2, "absent", None), "long hose": (2, "string", "4"), "only a text": (2, "absent", None)}


def test_array_files_hold_many_records(spark, tmp_path):
    # a folder and a file per conversation before: 300 of each here
    records = spark.range(300).select(F.concat_ws("-", F.col("id"), F.lit(0)).alias("external_id"), F.lit("text").alias("text"))
    write_arrays(records, str(tmp_path / "a"), per_file=100)
    assert 1 <= len(list((tmp_path / "a").glob("file=*/*.txt"))) <= 3
    found = read_reviews(spark, str(tmp_path / "a"), "json").select("external_id.value", "parse_error").collect()
    assert sorted(r.value for r in found) == sorted(f"{i}-0" for i in range(300)) and not any(r.parse_error for r in found)
