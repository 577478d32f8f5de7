"""Queries of the way from raw files to training edges: CSV as it comes, pages, documents with broken elements, reports as they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from followgraph import schemas
from followgraph.catalog import _EDGES, _log, query
from followgraph.operators import activity, edges as E, selection
from followgraph.plans import stand_ins as S, training
from followgraph.session import new_path
from followgraph.sources import delimited, pages as P, tables, tolerant
from followgraph.streaming import harvest

# --- CSV files -----------------------------------------------------------------------------------


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def _write_lines(lines: DataFrame, header: list[str], path: str) -> None:
    """Text files in which the header comes again and again; ``lines`` has one column."""
    title = F.lit(",".join(header) + "\n")
    lines.toDF("line").select(F.concat(title, "line").alias("value")).repartition(4).write.text(path)


def _edge_files(spark: SparkSession, sf_dir: str) -> str:
    """Edge files: every edge, a tenth again with an error text in front, and some without a follower."""
    edges = S.id_edges(spark, sf_dir).withColumns({"artist": S.part_alias("artist_id"), "follower": S.customer_alias("follower_id")})
    place = F.concat_ws(",", F.col("artist_id").cast("string"), F.col("follower_id").cast("string"), "artist", "follower")
    plain = edges.select(F.concat(F.lit("no exception,"), place))
    again = edges.where("(artist_id + follower_id) % 10 = 0").select(F.concat(_quoted(F.lit('Exception: "city", missing')), F.lit(","), place))
    lost = edges.where("(artist_id + follower_id) % 25 = 0").select(F.concat(F.lit("no exception,1,1,"), F.col("artist"), F.lit(",")))
    path = new_path(spark, "edge-files")
    _write_lines(plain.union(again).union(lost), schemas.EDGE.fieldNames(), path)
    return path


def _artist_files(spark: SparkSession, sf_dir: str) -> str:
    """Artist files: names with quotes, commas and line breaks; flags in several spellings."""
    parts = S.table(spark, sf_dir, "part")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, F.lit(', "live"\nset')).otherwise(F.lit("")))
    flag = F.element_at(F.array(*map(F.lit, ("0", "0.0", "1", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    cells = [key, key, _quoted(name), S.part_alias("p_partkey"), F.lit("x"), F.lit("y"), F.col("p_size").cast("string"), F.lit("1,d,2,Free,3,4,5"), flag]
    path = new_path(spark, "artist-files")
    _write_lines(parts.select(F.concat_ws(",", *cells)), schemas.ARTIST.fieldNames(), path)
    return path


def _profile_files(spark: SparkSession, sf_dir: str) -> str:
    """Profile files: rows of customers, of which every ninth failed and is short."""
    customers = S.table(spark, sf_dir, "customer")
    key, alias = F.col("c_custkey").cast("string"), S.customer_alias("c_custkey")
    whole = F.concat_ws(",", F.lit("no exception"), key, key, F.lit("part-1"), alias, F.lit("1,2,3,d,4,Free,5,6,7"), F.col("c_nationkey").cast("string"), F.lit("u"), _quoted(F.concat(F.lit("a\n"), "c_name")))
    short = F.concat_ws(",", F.lit("Exception 404"), key, key, F.lit("part-1"), alias)
    path = new_path(spark, "profile-files")
    _write_lines(customers.select(F.when(F.col("c_custkey") % 9 == 0, short).otherwise(whole)), schemas.PROFILE.fieldNames(), path)
    return path


_FOLLOWER = "'Customer#' || lpad(CAST({} AS VARCHAR), 9, '0')"
_ALIASES = f"SELECT DISTINCT 'part-' || artist_id AS artist_alias, {_FOLLOWER.format('follower_id')} AS follower_alias FROM ({_EDGES})"


@query(_ALIASES)
def csv_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from files with repeated headers, repeated error rows and rows without a follower."""
    return delimited.read_edges(spark, _edge_files(spark, sf_dir))


@query("""
    SELECT 'part-' || p_partkey AS sc_alias, p_name || CASE WHEN p_partkey % 5 = 0 THEN ', "live"' || chr(10) || 'set' ELSE '' END AS artist_name,
           CAST(p_size AS BIGINT) AS followers_count, CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '0.0' WHEN 2 THEN '1' END AS duplicate_flag
    FROM part
""")
def csv_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All artists from files whose names hold quotes, commas and line breaks."""
    return delimited.read_artists(spark, _artist_files(spark, sf_dir)).select("sc_alias", "artist_name", "followers_count", "duplicate_flag")


@query(f"""
    SELECT {_FOLLOWER.format('c_custkey')} AS follower_alias, CAST(c_nationkey AS BIGINT) AS track_count, 'a' || chr(10) || c_name AS username
    FROM customer WHERE c_custkey % 9 <> 0
""")
def csv_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound profiles of files with short rows."""
    sound, _ = delimited.read_profiles(spark, _profile_files(spark, sf_dir))
    return sound.select("follower_alias", "track_count", "username")


@query(f"""
    SELECT 'Exception 404,' || c_custkey || ',' || c_custkey || ',part-1,' || {_FOLLOWER.format('c_custkey')} AS text, {_FOLLOWER.format('c_custkey')} AS follower_alias
    FROM customer WHERE c_custkey % 9 = 0
""")
def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short rows, as they stand in the files."""
    _, broken = delimited.read_profiles(spark, _profile_files(spark, sf_dir))
    return broken.select(F.col(delimited.CORRUPT).alias("text"), "follower_alias")


@query(f"""
    WITH a AS (SELECT 'part-' || p_partkey AS artist_alias, CAST(row_number() OVER (ORDER BY 'part-' || p_partkey) AS INT) AS artist_id
               FROM part WHERE p_partkey % 4 IN (0, 1)),
    f AS (SELECT {_FOLLOWER.format('c_custkey')} AS follower_alias, CAST(row_number() OVER (ORDER BY {_FOLLOWER.format('c_custkey')}) AS INT) AS follower_id
          FROM customer WHERE c_custkey % 9 <> 0)
    SELECT artist_id, follower_id, artist_alias, follower_alias, CAST(1 AS INT) AS count
    FROM ({_ALIASES}) JOIN a USING (artist_alias) JOIN f USING (follower_alias)
""")
def csv_training_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the three kinds of files to numbered training edges."""
    edges = delimited.read_edges(spark, _edge_files(spark, sf_dir))
    artists = training.eligible_artists(delimited.read_artists(spark, _artist_files(spark, sf_dir)))
    profiles, _ = delimited.read_profiles(spark, _profile_files(spark, sf_dir))
    return E.training_edges(edges, E.artist_ids(artists), E.follower_ids(profiles))


@query("""
    SELECT 'artist' AS kind, 'part-' || p_partkey AS alias, CAST(p_size AS VARCHAR) AS first, CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '0.0' WHEN 2 THEN '1' END AS last FROM part
""")
def csv_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files without a header: columns named by their position, header rows dropped by a predicate."""
    raw = spark.read.option("escape", '"').option("multiLine", True).csv(_artist_files(spark, sf_dir))
    named = delimited.by_position(raw, {2: "artist_name", 3: "alias", 6: "first", 14: "last"})
    return delimited.drop_repeated_headers(named, "artist_name", "artist_name").select(F.lit("artist").alias("kind"), "alias", "first", "last")


# --- pages ---------------------------------------------------------------------------------------

_NAMES = "SELECT p_partkey AS page_id, replace(replace(p_name, '&', '&amp;'), '<', '&lt;') AS shown, p_name AS name, p_size AS size FROM part"


def _roster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part: anchors and spans with and without the attributes that count, some without text."""
    shown = F.replace(F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    text = F.when(F.col("p_size") % 7 == 0, F.lit("<img src='x.png'>")).otherwise(shown)
    page = F.concat(
        F.lit("<ul><li><a href='/a' title='t'>"), text, F.lit("</a></li><li><a href='/b'>no title</a></li><!-- <a title='x'>y</a> -->"),
        F.lit('<li><A TITLE="second">'), F.col("p_size").cast("string"), F.lit("</A></li></ul>"),
        F.lit('<span itemprop="name" title="'), F.replace(shown, F.lit('"'), F.lit("&quot;")), F.lit('">x</span><span title="only">y</span>'),
        F.lit("<span itemprop='name'>z</span><script>'<span title=\"s\" itemprop=\"s\">'</script>"),
    )
    return S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), page.alias("html"))


@query(f"""
    SELECT page_id, CASE WHEN size % 7 <> 0 THEN name END AS value, CASE WHEN size % 7 = 0 THEN '{P.NO_CONTENT}' END AS error FROM ({_NAMES})
    UNION ALL SELECT page_id, CAST(size AS VARCHAR), NULL FROM ({_NAMES})
""")
def anchor_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every anchor with a title; an anchor that begins with an image has an error instead."""
    return P.link_list_names(_roster_pages(spark, sf_dir)).select("page_id", "value", "error")


@query(f"SELECT page_id, name AS value FROM ({_NAMES})")
def span_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of every span with a title and an itemprop."""
    return P.search_result_names(_roster_pages(spark, sf_dir)).select("page_id", "value")


# --- documents with broken elements --------------------------------------------------------------

_ELEMENTS = """
    SELECT 'order-' || l_orderkey AS alias, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS position, l_partkey AS p, l_orderkey AS o FROM lineitem
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of JSON for each order, with its lines as followers; some are broken in one way or another."""
    lines, p = S.table(spark, sf_dir, "lineitem"), F.col("l_partkey").cast("string")
    element = (
        F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit('"gone '), p, F.lit('"')))
        .when(F.col("l_partkey") % 11 == 1, F.lit('{"city":"x","permalink":null}'))
        .when(F.col("l_partkey") % 11 == 2, F.concat(F.lit('{"permalink":"part-'), p, F.lit('","track_count":"many"}')))
        .otherwise(F.concat(F.lit('{"permalink":"part-'), p, F.lit('","track_count":'), p, F.lit(',"unknown":[1,{"a":2}]}')))
    )
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", element.alias("e")))).alias("list"))
    body = F.concat(F.lit('{"alias":"order-'), F.col("l_orderkey").cast("string"), F.lit('","followers":['), F.array_join("list.e", ","), F.lit("]"))
    key = F.col("l_orderkey")
    tail = F.when(key % 29 == 0, F.lit("")).otherwise(F.lit("}"))
    text = F.when(key % 31 == 0, F.concat(F.lit('{"alias":"order-'), key.cast("string"), F.lit('","followers":7}'))).otherwise(F.concat(body, tail))
    return lists.select(text.alias("line"))


@query(f"""
    WITH e AS ({_ELEMENTS}),
    docs AS (SELECT DISTINCT alias, o FROM e)
    SELECT alias, CAST(position AS BIGINT) AS position, 'part-' || p AS permalink, p AS track_count, CAST(NULL AS VARCHAR) AS reason FROM e WHERE p % 11 > 2 AND o % 29 <> 0 AND o % 31 <> 0
    UNION ALL SELECT alias, position, CASE p % 11 WHEN 0 THEN '"gone ' || p || '"' WHEN 1 THEN '{{"city":"x","permalink":null}}' ELSE '{{"permalink":"part-' || p || '","track_count":"many"}}' END,
      NULL, CASE p % 11 WHEN 0 THEN '{tolerant.NO_OBJECT}' WHEN 1 THEN '{tolerant.NO_ALIAS}' ELSE 'track_count is no number' END FROM e WHERE p % 11 <= 2 AND o % 29 <> 0 AND o % 31 <> 0
    UNION ALL SELECT CASE WHEN o % 31 = 0 THEN alias END, NULL, NULL, NULL, CASE WHEN o % 31 = 0 THEN '{tolerant.NO_LIST}' ELSE '{tolerant.NO_JSON}' END FROM docs WHERE o % 29 = 0 OR o % 31 = 0
""")
def broken_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followers of documents with broken elements: the sound ones, and the quarantine with text and reason."""
    path = new_path(spark, "documents")
    _documents(spark, sf_dir).write.text(path)
    sound, broken = tolerant.followers_of(tolerant.read_lines(spark, path))
    rows = sound.select("alias", "position", "follower.permalink", "follower.track_count", F.lit(None).cast("string").alias("reason"))
    text = F.when(F.col("position").isNotNull(), F.col("text"))
    return rows.unionByName(broken.select("alias", "position", text.alias("permalink"), F.lit(None).cast("bigint").alias("track_count"), "reason"))


# --- reports, ranges, sketches -------------------------------------------------------------------


@query("""
    SELECT alias, reports, l.added AS added, CAST(5000 AS BIGINT) AS expected, l.added / 5000.0::DOUBLE AS ratio,
           l.error AS error, l.error IS NOT NULL AS failed
    FROM (SELECT CAST(user_id AS VARCHAR) AS alias, count(*) AS reports,
                 arg_max({'added': CAST(round(value * 100) AS BIGINT),
                          'error': CASE WHEN event_type = 'error' THEN props END}, ts) AS l
          FROM events GROUP BY user_id)
""")
def harvest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harvest report from a stream of three slices, with state per alias instead of the whole log."""
    path = new_path(spark, "harvest-log")
    log = _log(spark, sf_dir)
    for part in range(3):
        tables.append_harvest_log(log.where(F.pmod(F.xxhash64("alias", "added"), F.lit(3)) == part).coalesce(1), path)
    table = new_path(spark, "harvest-state")
    progress = harvest.follow_harvests(harvest.log_stream(spark, path, files_per_batch=1), "36500 days")
    harvest.write_progress(progress, table, new_path(spark, "harvest-checkpoint")).awaitTermination()
    return harvest.harvest_state(spark, table).drop("logged_at", "stalled")


_RANGE = "SELECT {0}, position FROM (SELECT {0}, row_number() OVER (ORDER BY {1}) - 1 AS position FROM {2}) WHERE position >= {3} AND position < {4}"


@query(_RANGE.format("l_orderkey, l_linenumber, l_shipdate", "l_shipdate DESC, l_orderkey, l_linenumber", "lineitem", 1000, 1700))
def selected_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 1000 to 1700 by falling date, by counting instead of numbering the whole table."""
    rows = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    order = [selection.Key("l_shipdate", False), selection.Key("l_orderkey"), selection.Key("l_linenumber")]
    return selection.select_range(rows, order, 1000, 1700)


@query("SELECT 'edges' AS what, true AS within UNION ALL SELECT 'followers', true UNION ALL SELECT 'artists', true UNION ALL SELECT 'density', true")
def approx_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether merged sketches of four overlapping batches are within two per cent of the exact report."""
    edges, path = S.id_edges(spark, sf_dir), new_path(spark, "sketches")
    for part in range(4):  # every edge is in two batches
        batch = edges.where(F.pmod(F.xxhash64("artist_id", "follower_id"), F.lit(4)).isin(part, (part + 1) % 4))
        activity.activity_sketches(batch, "artist_id", "follower_id").write.mode("append").parquet(path)
    about = activity.merged_activity(spark.read.parquet(path)).select(F.struct("*").alias("about"))
    exact = activity.activity_thresholds(edges, "artist_id", "follower_id", []).select(F.struct("*").alias("exact"))
    together = about.unionByName(exact, allowMissingColumns=True)  # one row each
    both = together.agg(*[F.first(c, ignorenulls=True).alias(c) for c in together.columns])
    near = lambda c: F.abs(F.col(f"about.{c}") - F.col(f"exact.{c}")) <= 0.02 * F.col(f"exact.{c}")
    rows = [F.struct(F.lit(c).alias("what"), near(c).alias("within")) for c in ("edges", "followers", "artists", "density")]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
