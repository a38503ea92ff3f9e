import pytest
from pyspark.sql import types as T

from scorekit.sources import readers, sinks
from scorekit.sources.contracts import SCORING_COLUMNS, TRAINING_COLUMNS, double_schema, keyed_schema, string_schema
from scorekit.staging import cached, drop_path, materialize, new_path, shared_root


def lines(tmp_path, *rows):
    path = tmp_path / "in.csv"
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_contracts():
    assert len(TRAINING_COLUMNS) == len(set(TRAINING_COLUMNS)) == 123 and TRAINING_COLUMNS[-1] == "uid_flag"
    assert len(SCORING_COLUMNS) == len(set(SCORING_COLUMNS)) == 123 and SCORING_COLUMNS[-1] == "score"
    assert len(set(TRAINING_COLUMNS) & set(SCORING_COLUMNS)) == 122
    keyed = keyed_schema(SCORING_COLUMNS)
    assert [f.name for f in keyed.fields][:2] == ["ID", "uid_uid"] and len(keyed.fields) == 125
    assert {f.dataType for f in string_schema(TRAINING_COLUMNS).fields} == {T.StringType()}
    assert all(f.nullable for f in keyed.fields)


def test_bad_rows(spark, tmp_path):
    path = lines(tmp_path, "a,b", "1,2", "3", "4,5,6", "x,7")
    schema = double_schema(["a", "b"])
    padded = [tuple(r) for r in readers.read_typed(spark, path, schema, on_bad="null").collect()]
    assert padded == [(1.0, 2.0), (3.0, None), (4.0, 5.0), (None, 7.0)]
    dropped = readers.read_typed(spark, path, schema, on_bad="drop")
    assert [tuple(r) for r in dropped.collect()] == [(1.0, 2.0)]
    # The same rows count, whichever columns a query reads.
    assert dropped.count() == 1 and dropped.select("b").count() == 1
    failing = readers.read_typed(spark, path, schema, on_bad="fail")
    with pytest.raises(Exception):
        failing.select("b").collect()
    wrong_type = readers.read_typed(spark, lines(tmp_path, "a,b", "x,7"), schema, on_bad="fail")
    with pytest.raises(Exception, match="bad value"):
        wrong_type.select("b").collect()
    clean = readers.read_typed(spark, lines(tmp_path, "a,b", "1,", "2,3"), schema, on_bad="fail")
    assert [tuple(r) for r in clean.collect()] == [(1.0, None), (2.0, 3.0)]
    with pytest.raises(ValueError):
        readers.read_typed(spark, path, schema, on_bad="skip")


def test_quarantine(spark, tmp_path):
    schema = T.StructType.fromDDL("a double, `b c` int, d string")
    path = lines(tmp_path, "a,b c,d", "1,2,x", "3", "4,5,y,6", "x,7,z", "8,9.5,z", ",,", '1e3,2,"q,r"')
    out = readers.read_quarantined(spark, path, schema)
    assert (out.n_good, out.n_rejected) == (3, 4)
    assert sorted(map(str, map(tuple, out.good.collect()))) == sorted(map(str, [(1.0, 2, "x"), (None, None, None), (1000.0, 2, "q,r")]))
    bad = {r["line"]: r["reason"] for r in out.rejected.collect()}
    assert bad == {"3": "not 3 fields", "4,5,y,6": "not 3 fields", "x,7,z": "a is no double: x", "8,9.5,z": "b c is no int: 9.5"}
    assert {r["file"].rsplit("/", 1)[1] for r in out.rejected.collect()} == {"in.csv"}
    # Good and bad rows make up the file; what is good is what reading without the bad rows gives.
    assert out.good.count() + out.rejected.count() == 7
    assert out.good.exceptAll(readers.read_typed(spark, path, schema, on_bad="drop")).count() == 0
    empty = readers.read_quarantined(spark, lines(tmp_path, "a,b c,d"), schema)
    assert (empty.n_good, empty.n_rejected, empty.good.count(), empty.rejected.count()) == (0, 0, 0, 0)


def test_fields_are_converted_once_and_rows_judged_whole(spark, tmp_path):
    path = lines(tmp_path, "a,b", "1,2", "x,3")
    plan = readers.read_typed(spark, path, double_schema(["a", "b"]), on_bad="drop").select("b")._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(" not in plan and plan.count("Relation") == 1
    one = readers.read_quarantined(spark, path, double_schema(["a", "b"]))
    assert [tuple(r) for r in one.good.select("b").collect()] == [(2.0,)]


INFERRED = {
    "i": (["1", "-2", None], "int", (2, 2, 2, 2, 0, 0, 0)), "l": (["1", "3000000000", None], "bigint", (2, 1, 2, 2, 0, 0, 0)),
    "f": (["1", "2.5", "1e3"], "double", (3, 1, 1, 3, 0, 0, 0)), "d": (["2016-09-28", "2016-02-29", None], "date", (2, 0, 0, 0, 2, 2, 0)),
    "t": (["2016-09-28", "2016-09-28 10:00:00", None], "timestamp", (2, 0, 0, 0, 1, 2, 0)), "o": (["true", "FALSE", None], "boolean", (2, 0, 0, 0, 0, 0, 2)),
    "s": (["2016-02-30", "1", "x"], "string", (3, 1, 1, 1, 0, 0, 0)), "n": ([None, None, None], "string", (0, 0, 0, 0, 0, 0, 0)),
}


def test_inference_over_the_lattice(spark, tmp_path):
    rows = list(zip(*[v for v, _, _ in INFERRED.values()], strict=True))
    text = spark.createDataFrame(rows, string_schema(list(INFERRED)))
    got = {r[0]: (r[1], tuple(r)[2:]) for r in readers.inferred_types(text).collect()}
    assert got == {n: (t, counts) for n, (_, t, counts) in INFERRED.items()}
    path = lines(tmp_path, ",".join(INFERRED), *[",".join(c or "" for c in row) for row in rows])
    assert dict(readers.read_inferred(spark, path).dtypes) == {n: t for n, (_, t, _) in INFERRED.items()}


def test_inference_reads_the_file_once(spark, tmp_path):
    path = lines(tmp_path, "a,b", "1,x")
    df = readers.read_inferred(spark, path)
    (tmp_path / "in.csv").unlink()
    assert [tuple(r) for r in df.collect()] == [(1, "x")]


def test_header_must_match_by_name(spark, tmp_path):
    path = lines(tmp_path, "b,a", "1,2")
    with pytest.raises(Exception):
        readers.read_typed(spark, path, double_schema(["a", "b"])).collect()
    bare = readers.read_typed(spark, lines(tmp_path, "1,2"), double_schema(["a", "b"]), header=False)
    assert [tuple(r) for r in bare.collect()] == [(1.0, 2.0)]


def test_quotes_and_trailing_blanks(spark, tmp_path):
    path = lines(tmp_path, "a,b,c", '"x,y",,', "1,2,3")
    rows = readers.read_typed(spark, path, string_schema(["a", "b", "c"])).collect()
    assert [tuple(r) for r in rows] == [("x,y", None, None), ("1", "2", "3")]


def test_inference(spark, tmp_path):
    path = lines(tmp_path, "i,d,s,t", "1,1.5,a,2016-09-28 10:00:00", "2,2.5,b,2016-09-29 10:00:00")
    types = dict(readers.read_inferred(spark, path).dtypes)
    assert (types["i"], types["d"], types["s"]) == ("int", "double", "string") and types["t"].startswith("timestamp")


def test_contract_files(spark, tmp_path):
    values = [str(i) for i in range(123)]
    train = lines(tmp_path, ",".join(TRAINING_COLUMNS), ",".join(values))
    text = readers.read_training_text(spark, train).collect()[0]
    assert text["uid_grade"] == "0" and text["uid_flag"] == "122"
    score = lines(tmp_path, ",".join(SCORING_COLUMNS), ",".join(values))
    assert readers.read_scoring(spark, score).collect()[0]["score"] == 122.0
    assert readers.read_scoring_text(spark, score).collect()[0]["score"] == "122"
    keyed = lines(tmp_path, ",".join(["ID", "uid_uid", *SCORING_COLUMNS]), ",".join(["9", "u9", *values]))
    row = readers.read_scoring_keyed(spark, keyed).collect()[0]
    assert (row["ID"], row["uid_uid"], row["uid_grade"]) == (9.0, "u9", 0.0)


def test_drop_lines_containing(spark, tmp_path):
    path = lines(tmp_path, "uid_grade,uid_age", "1,2", "x uid_grade y", "3,4")
    kept = readers.drop_lines_containing(spark.read.text(path), "uid_grade").collect()
    assert [r["value"] for r in kept] == ["1,2", "3,4"]
    # The token is plain text, not a pattern.
    dots = lines(tmp_path, "a.c", "abc")
    assert [r["value"] for r in readers.drop_lines_containing(spark.read.text(dots), "a.c").collect()] == ["abc"]


def test_text_records(spark, tmp_path):
    people = readers.text_records(spark, lines(tmp_path, "Michael, 29", "Andy,30 "))
    assert people.dtypes == [("name", "string"), ("age", "int")]
    assert [tuple(r) for r in people.collect()] == [("Michael", 29), ("Andy", 30)]
    with pytest.raises(Exception):
        readers.text_records(spark, lines(tmp_path, "Justin, x")).collect()


def test_rows_and_names(spark):
    schema = T.StructType.fromDDL("a int, b double, c string")
    df = spark.createDataFrame([(["1", "2.5"],)], "cells array<string>")
    assert [tuple(r) for r in readers.bind_fields(df, "cells", schema).collect()] == [(1, 2.5, None)]
    pair = spark.createDataFrame([("1", "2")], "x string, y string")
    typed = readers.rows_to_frame(pair, T.StructType.fromDDL("a int, b double"))
    assert [tuple(r) for r in typed.collect()] == [(1, 2.0)]
    with pytest.raises(ValueError):
        readers.rows_to_frame(pair, schema)
    assert readers.rename_positional(pair, "p", "q").columns == ["p", "q"]


def test_sink_refuses_an_existing_path(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1.5, None)], "a double, b string")
    sinks.write_csv(df, path)
    assert readers.read_inferred(spark, path).columns == ["a", "b"]
    with pytest.raises(Exception):
        sinks.write_csv(df, path)
    sinks.write_csv(df, path, mode="overwrite")


def test_staged_table_survives_its_source(spark):
    assert spark.sparkContext.getCheckpointDir() is not None or shared_root(spark)
    df = materialize(spark.range(10).selectExpr("id", "id * 2 AS twice"))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    path = new_path(spark, "gone")
    spark.range(1).write.parquet(path)
    assert drop_path(spark, path) and not drop_path(spark, path)


def test_cache_ends_with_its_block(spark):
    df = spark.range(5)
    with pytest.raises(RuntimeError):
        with cached(df) as kept:
            assert kept.count() == 5 and kept.storageLevel.useMemory
            raise RuntimeError
    assert not df.storageLevel.useMemory
