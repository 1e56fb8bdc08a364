import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import dedup as dd, profile as pf
from riskloom.plans import corpus as plans
from riskloom.session import shared_folder
from riskloom.sources import messages as files, scams


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def test_positional_csv(spark, tmp_path):
    path = write(
        tmp_path, "a.csv",
        b'type,text\nspam,"quoted, comma"\nham\nspam,"two\nlines",x,y\nham,"say ""hi"""\nham,bad \xff byte\n\nspam,last\n',
    )
    rows = files.read_messages(spark, [path]).orderBy(*files.MESSAGE_ORDER).collect()
    assert [(r.type, r.text) for r in rows] == [
        ("type", "text"), ("spam", "quoted, comma"), ("spam", "two\nlines"), ("ham", 'say "hi"'),
        ("ham", "bad � byte"), ("spam", "last"),
    ]


def test_latin1_and_file_order(spark, tmp_path):
    first = write(tmp_path, "a.csv", "spam,caf\xe9 un\n".encode("latin-1"))
    second = write(tmp_path, "b.csv", "ham,deux\n".encode("latin-1"))
    rows = files.read_messages(spark, [second, first], "ISO-8859-1").orderBy(*files.MESSAGE_ORDER).collect()
    assert [(r.file_seq, r.text) for r in rows] == [(0, "deux"), (1, "caf\xe9 un")]


def test_merge_keeps_the_later_copy(spark, tmp_path):
    first = write(tmp_path, "a.csv", b"spam,the same long text\nham,another long text\nham,short\n")
    second = write(tmp_path, "b.csv", b"ham,  THE SAME LONG TEXT\nnews,a long text of no class\n")
    merged = files.read_messages(spark, [first, second])
    got = plans.build_corpus([merged], files.MESSAGE_ORDER).select("type", "text").collect()
    assert sorted(map(tuple, got)) == [("ham", "another long text"), ("ham", "the same long text")]
    with pytest.raises(ValueError):
        plans.build_corpus([merged.where("type = 'news'")], files.MESSAGE_ORDER)


def test_required_columns_in_any_order(spark, tmp_path):
    path = write(tmp_path, "a.csv", b"text,extra,type\nhello there,1,spam\n")
    assert files.read_labelled(spark, path).select("type", "text").head() == ("spam", "hello there")
    with pytest.raises(ValueError):
        files.read_labelled(spark, path, ["text", "label"])


def test_csv_round_trip(spark, frame):
    texts = ['a "quoted" one', "comma, here", "line\nbreak", "back\\slash", " blanks ", "ümläut", "'", '"', "\\\"", "tab\t"]
    path = shared_folder(spark, "round-trip")
    files.write_messages(frame([(t, "spam") for t in texts], "text string, type string"), path)
    assert sorted(r.text for r in files.read_labelled(spark, path).collect()) == sorted(texts)


def test_split_names(spark):
    with pytest.raises(ValueError):
        files.read_split(spark, "/nowhere", "validation")


def test_rejected_rows_are_those_that_conform_leaves_out(frame):
    rows = frame([(1, "sms", "a"), (2, None, "b"), (3, "sms", None), (4, None, None)],
                 "id long, source string, scam_text string")
    for table, missing in ((scams.SCAMS, {3: ["scam_text"], 4: ["scam_text"]}),
                           (scams.REALTIME_SCAMS, {2: ["source"], 3: ["scam_text"], 4: ["source", "scam_text"]})):
        assert {r.id: r.missing for r in scams.rejected(rows, table).collect()} == missing
        assert {r.id for r in scams.conform(rows, table).collect()} == {1, 2, 3, 4} - set(missing)


def test_conform(frame):
    now = F.lit(dt.datetime(2024, 5, 1))
    rows = frame([(1, "a", None, None, None), (2, None, "x", 0.4, None), (3, "c", "y", 0.3, dt.datetime(2020, 1, 1))],
                 "id int, scam_text string, scam_type string, confidence double, timestamp timestamp_ntz")
    got = {r.id: r for r in scams.conform(rows, scams.SCAMS, now).collect()}
    assert set(got) == {1, 3} and got[1].confidence == 1.0 and got[1].detected_at == dt.datetime(2024, 5, 1)
    assert got[3].confidence == 0.3 and got[3].detected_at == dt.datetime(2020, 1, 1)
    live = scams.conform(rows.withColumn("source", F.lit("sms")), scams.REALTIME_SCAMS)
    assert live.where("id = 1").head().confidence == 0.8
    assert scams.conform(rows.withColumn("source", F.lit(None)), scams.REALTIME_SCAMS).isEmpty()
    with pytest.raises(ValueError):
        scams.conform(rows, "other")


def test_ids_run_on(frame):
    fresh = frame([(f"text {i}",) for i in range(20)], "scam_text string")
    ids = [r.id for r in scams.assign_ids(fresh, ["scam_text"], frame([(7,)], "id bigint")).collect()]
    assert sorted(ids) == list(range(8, 28))
    empty = frame([], "id bigint")
    assert sorted(r.id for r in scams.assign_ids(fresh, ["scam_text"], empty).collect()) == list(range(1, 21))


def test_seed(spark, frame):
    schema = "source string, scam_text string, scam_type string, confidence double"
    assert scams.seed_if_empty(frame([], schema), scams.seed_rows(spark)).count() == 3
    assert scams.seed_if_empty(frame([("a", "b", "c", 0.1)], schema), scams.seed_rows(spark)).count() == 1


def test_type_filter_reaches_the_files(spark, sf, frame):
    path = shared_folder(spark, "scams")
    frame([(1, "a", "phishing"), (2, "b", "lottery")], "id int, scam_text string, scam_type string").write.parquet(path)
    found = scams.scams_of_type(scams.read_scams(spark, path), "phishing").select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and "EqualTo(scam_type,phishing)" in plan


def test_dedup_order_and_where(frame):
    rows = frame([("x", 0, 1, "a"), ("x", 1, 0, "b"), ("x", 0, 2, "c"), ("y", 0, 0, "d"), (None, 0, 5, "e")],
                 "text string, file_seq int, row_seq bigint, tag string")
    last = {r.text: r.tag for r in dd.dedup(rows, ["text"]).collect()}
    assert last == {"x": "b", "y": "d", None: "e"}
    first = {r.text: r.tag for r in dd.dedup(rows, ["text"], keep="first").collect()}
    assert first == {"x": "a", "y": "d", None: "e"}
    some = {r.text: r.tag for r in dd.dedup(rows, ["text"], where=F.col("tag").isin("a", "c", "z")).collect()}
    assert some == {"x": "c"}
    with pytest.raises(ValueError):
        dd.dedup(rows, ["text"], keep="any")


def test_hot_text_folds_before_the_shuffle(spark):
    rows = spark.range(0, 30_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"),
        F.lit(0).alias("file_seq"), F.col("id").alias("row_seq"),
    )
    out = dd.dedup(rows, ["text"])
    assert out.count() == 20_001 and out.where("text = 'hot'").head().row_seq == 29_997
    assert "partial_max_by" in out._jdf.queryExecution().executedPlan().toString()


def test_union_of_nothing(frame):
    with pytest.raises(ValueError):
        dd.union_sources([frame([], "a int"), frame([], "a int")])


def test_recent_since_is_a_date(frame):
    rows = frame(
        [("new", dt.datetime(2024, 1, 20, 9)), ("edge", dt.datetime(2024, 1, 16, 0)), ("old", dt.datetime(2024, 1, 15, 23)),
         ("new", dt.datetime(2024, 1, 3)), ("", dt.datetime(2024, 1, 20)), (None, dt.datetime(2024, 1, 20))],
        "text string, ts timestamp_ntz",
    )
    got = dd.recent_texts(rows, F.lit(dt.datetime(2024, 1, 31, 18)), 15).collect()
    assert [r.text for r in got] == ["new", "edge"]


def test_profile_record(frame):
    rows = frame([("spam", "abcd"), ("spam", "ab"), ("ham", "abc"), (None, None)], "type string, text string")
    got = pf.profile(rows).head()
    assert got.total_samples == 4 and got.label_distribution == {"spam": 2, "ham": 1}
    assert got.label_percentages == {"spam": 0.6667, "ham": 0.3333}
    assert tuple(got.text_length_stats) == (3.0, 4, 2)


def test_quartiles(frame):
    rows = frame([("a", "x" * n) for n in (1, 2, 3, 4, 100)] + [("b", "yy"), (None, "zzz")], "type string, text string")
    got = {r.type: r for r in pf.length_quartiles(rows).collect()}
    a = got["a"]
    assert (a.n, a.q1, a.median, a.q3, a.whisker_low, a.whisker_high, a.max_length) == (5, 2.0, 3.0, 4.0, 1, 4, 100)
    assert got["b"].median == 2.0 and got[None].n == 1


def test_empty_funnel(frame):
    empty = frame([], "msg_id bigint, type string, text string, lang string")
    assert [(r.total, r.spam, r.ham) for r in plans.funnel(empty, ["msg_id"]).collect()] == [(0, 0, 0)] * 5


def test_files_of_a_folder_are_in_order_of_their_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("spam,the same text here\n")
    (tmp_path / "b.csv").write_text("".join(f"ham,other text number {n}\n" for n in range(20_000)) + "ham,the same text here\n")
    for multi_line in (True, False):
        rows = files.read_messages(spark, [str(tmp_path)], multi_line=multi_line)
        assert dd.dedup(rows, ["text"], files.MESSAGE_ORDER).where("text = 'the same text here'").head().type == "ham"
        first = dd.dedup(rows, ["text"], files.MESSAGE_ORDER, keep="first")
        assert first.where("text = 'the same text here'").head().type == "spam"


def test_a_warehouse_on_a_local_disk_is_no_shared_folder():
    from types import SimpleNamespace

    from riskloom import session

    def shared(master, folder, default="file:///"):
        spark = SimpleNamespace(
            sparkContext=SimpleNamespace(master=master),
            _jsc=SimpleNamespace(hadoopConfiguration=lambda: SimpleNamespace(get=lambda name, other: default)))
        return session._shared(spark, folder)

    assert shared("local[4]", "file:/tmp/x") and shared("yarn", "hdfs://a/b") and shared("yarn", "/b", "hdfs://a")
    assert not shared("yarn", "file:/tmp/x") and not shared("spark://a:1", "/tmp/x")
