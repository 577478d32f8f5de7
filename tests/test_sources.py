"""CSV, pages and appended tables."""

import datetime

from pyspark.sql import functions as F

from followgraph import schemas
from followgraph.sources import delimited, documents, factors, pages, tables


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = str(tmp_path / "names.csv")
    with open(path, "w", newline="") as f:
        f.write('index,artist_name\r\n6,"say ""hi"", twice"\r\n7,"two\nlines"\r\n8,"ends with \\"\r\n9,\r\n')
    rows = delimited.read_delimited(spark, path, schemas.ROSTER_FILE, multi_line=True)
    got = {r["index"]: r.artist_name for r in delimited.sound_rows(rows).collect()}
    assert got == {6: 'say "hi", twice', 7: "two\nlines", 8: "ends with \\", 9: None}


def test_csv_written_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"\nc\\'), (2, None), (3, "é,;")], schemas.ROSTER_FILE)
    path = str(tmp_path / "out")
    delimited.write_delimited(rows, path)
    back = delimited.sound_rows(delimited.read_delimited(spark, path, schemas.ROSTER_FILE, multi_line=True))
    assert sorted(back.collect()) == sorted(rows.collect())


def test_factors_written_as_text(spark, tmp_path):
    path = str(tmp_path / "factors")
    items = spark.createDataFrame([(1, [0.5, 0.25])], schemas.ITEM_FACTORS)
    delimited.write_delimited(items, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.collect()[0].features == "[0.5,0.25]"


def test_factors_on_disk(spark, tmp_path):
    text = str(tmp_path / "items.csv")
    open(text, "w").write('"",id,features\n0,1,"[0.5, 0.0]"\n1,11,"[0.25, 1e-05]"\n')
    rows = factors.read_factor_text(spark, text)
    assert {r.id: r.features for r in rows.collect()} == {1: [0.5, 0.0], 11: [0.25, 1e-05]}
    stored = str(tmp_path / "factors")
    factors.export_factors(rows.withColumn("artist_alias", F.concat(F.lit("a"), "id")), stored)
    assert sorted(r.artist_alias for r in factors.read_factors(spark, stored).collect()) == ["a1", "a11"]


def test_columns_by_position(spark):
    rows = spark.createDataFrame([("e", "1", "2", "a", "x")], "_c0 STRING, _c1 STRING, _c2 STRING, _c3 STRING, _c4 STRING")
    got = delimited.by_position(rows, {3: "artist_alias", 4: "follower_alias"})
    assert got.columns == ["artist_alias", "follower_alias"] and got.head() == ("a", "x")


def test_untyped_read_names_columns_by_position(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    open(path, "w").write("h1,h2\n1,2\n")
    rows = delimited.read_untyped(spark, path)
    assert rows.columns == ["_c0", "_c1"]
    assert delimited.drop_repeated_headers(rows, "_c1", "h2").collect() == [("1", "2")]


def test_edges_of_error_rows_count_once(spark, tmp_path):
    path = str(tmp_path / "edges.csv")
    header = "exception,artist_num,artist_follower_num,artist_alias,follower_alias\r\n"
    with open(path, "w", newline="") as f:
        f.write(header + "no exception,1,1,a,x\r\nboom,1,1,a,x\r\nno exception,1,2,a,y\r\n" + header)
        f.write("no exception,2,1,b,x\r\nno exception,2,2,b,\r\n")
    got = {tuple(r) for r in delimited.read_edges(spark, path).collect()}
    assert got == {("a", "x"), ("a", "y"), ("b", "x")}


def test_short_profile_rows_are_quarantined(spark, tmp_path):
    path = str(tmp_path / "followers.csv")
    names = schemas.PROFILE.fieldNames()
    with open(path, "w", newline="") as f:
        f.write(",".join(names) + "\r\n")
        f.write("no exception,1,1,a,x,1,2,3,2016/01/01,4,Free,5,6,7,8,u:1,X\r\n")
        f.write("bad text,1,2,a,y\r\n")
        f.write('no exception,1,3,a,z,1,2,3,2016/01/01,4,Free,5,6,7,8,u:3,"Z\nZ"\r\n')
    good, bad = delimited.read_profiles(spark, path)
    assert sorted((r.follower_alias, r.username) for r in good.collect()) == [("x", "X"), ("z", "Z\nZ")]
    assert [(r.exception, r.follower_alias) for r in bad.collect()] == [("bad text", "y")]
    assert good.select("follower_alias").count() == 2  # a pruned read agrees


def test_artist_file_keeps_types_and_flag(spark, tmp_path):
    path = str(tmp_path / "meta.csv")
    with open(path, "w", newline="") as f:
        f.write(",".join(schemas.ARTIST.fieldNames()) + "\r\n")
        f.write("0,1,Name,alias,C,D,500,1,2016,2,Free,3,4,,0.0\r\n")
    row = delimited.read_artists(spark, path).collect()[0]
    assert (row.followers_count, row["count"], row.duplicate_flag) == (500, None, "0.0")


HTML = """<!-- <a title="c">commented</a> --><script>"<a title='s'>x</a>"</script>
<p data-x='<a title="q">quoted</a>'><a href="/1" title="One">First &amp; <b>bold</b></a>
<a href="/2">No title</a><A TITLE='Two'><b><i>Nested</i></b> tail</A><a title="Empty"></a><a title><img src="x">pic</a>
<a href="title=3">text</a><a title = "G > H">five > 4</a>
<span title="T &quot;1&quot;" itemprop="name">x</span><span title="T2">y</span><span itemprop=name title=T3>z</span>"""


def _pages(spark):
    return spark.createDataFrame([(1, HTML), (2, "<p>none</p>"), (3, None), (4, "<A title=x>last")], "page_id INT, html STRING")


def test_link_list_names(spark):
    rows = pages.link_list_names(_pages(spark)).orderBy("page_id", "element_pos").collect()
    got = [(r.page_id, r.value, r.error is not None) for r in rows]
    assert got == [
        (1, "First & ", False),
        (1, "Nested", False),
        (1, None, True),
        (1, None, True),
        (1, "five > 4", False),
        (4, "last", False),
    ]


def test_search_result_names(spark):
    rows = pages.search_result_names(_pages(spark)).orderBy("element_pos").collect()
    assert [r.value for r in rows] == ['T "1"', "T3"]


def test_failed_elements_in_rosters(spark):
    elements = pages.link_list_names(_pages(spark))
    kept = pages.as_roster(elements, "list", 1, keep_errors=True)
    assert pages.as_roster(elements, "list", 1).count() == 4
    assert kept.where(F.col("artist_name").startswith("Exception ")).count() == 2


def test_long_page_with_many_attributes(spark):
    html = "<div " + " ".join(f'a{i}="{i}>"' for i in range(20_000)) + "><a title='t'>" + "x" * 200_000 + "</a>"
    rows = pages.link_list_names(spark.createDataFrame([(1, html)], "page_id INT, html STRING")).collect()
    assert [len(r.value) for r in rows] == [200_000]


def test_harvest_log_is_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([(1000, 5000, "a", 1, 2)], "added INT, expected INT, alias STRING, artist_index INT, total_artists INT")
    tables.append_harvest_log(first, path)
    tables.append_harvest_log(first.withColumn("error", F.lit("boom")), path)
    rows = tables.read_harvest_log(spark, path).collect()
    assert sorted(str(r.error) for r in rows) == ["None", "boom"]
    assert all(abs((r.logged_at - datetime.datetime.now()).total_seconds()) < 86_400 for r in rows)


def test_artist_rows_are_appended_by_name(spark, tmp_path):
    path = str(tmp_path / "artists")
    wanted = [f for f in schemas.ARTIST.fieldNames() if f not in ("index", "id", "count", "duplicate_flag")]
    row = spark.createDataFrame([(1, 2)], "followers_count INT, track_count INT")
    for name in wanted:
        if name not in row.columns:
            row = row.withColumn(name, F.lit("5"))
    tables.append_artists(row, path)
    tables.append_artists(row, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.schema["playlist_count"].dataType.typeName() == "long"


def test_documents_in_json_lines(spark, tmp_path):
    path = str(tmp_path / "docs")
    one = spark.createDataFrame([("a", [("c1",)], 1)], "alias STRING, followers ARRAY<STRUCT<permalink: STRING>>, first_follower_num BIGINT")
    documents.write_documents(one, path, "json")
    back = documents.read_documents(spark, path, "json").collect()
    assert back[0].followers[0].permalink == "c1" and back[0].city is None
