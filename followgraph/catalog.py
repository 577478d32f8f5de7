"""Every operator as a query on the test tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from followgraph import fixed
from followgraph.functions import links, names
from followgraph.operators import activity, edges as E, evaluation, lookup, model, nesting, numbering, overlap
from followgraph.operators import roster as R, similarity, tiles
from followgraph.plans import stand_ins as S, training, views
from followgraph.plans.roster_build import harvest_list as build_harvest_list
from followgraph.session import new_path, written
from followgraph.sources import delimited, documents as D, factors, pages as P, tables
from followgraph.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_EDGES = "SELECT DISTINCT l_partkey AS artist_id, o_custkey AS follower_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# --- rosters -----------------------------------------------------------------------------------


@query("""
    SELECT artist_name, CAST(min(source_rank) AS BIGINT) AS source_rank
    FROM (SELECT p_name AS artist_name, 1 AS source_rank FROM part
          UNION ALL SELECT s_name, 2 FROM supplier)
    GROUP BY artist_name
""")
def roster_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = S.table(spark, sf_dir, "part").select(F.col("p_name").alias("artist_name"), F.lit(1).alias("source_rank"))
    second = S.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("artist_name"), F.lit(2).alias("source_rank"))
    return R.clean_roster(first, second).withColumn("source_rank", F.col("source_rank").cast("bigint"))


@query("""
    SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS BIGINT) AS supplier FROM customer
    UNION ALL SELECT s_name, s_acctbal, NULL, s_suppkey FROM supplier
""")
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = S.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    second = S.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("supplier")
    )
    return R.union_rosters(first, second)


@query("SELECT p_partkey, p_name AS artist_name FROM part WHERE p_name NOT IN ('red widget', 'small ring')")
def roster_denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("artist_name"))
    return R.deny_names(rows, ["red widget", "small ring"])


@query("""
    SELECT c_custkey, plan, followers_count, followers_count < 500 AS small FROM (
        SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS followers_count,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Pro' WHEN 'MACHINERY' THEN 'Pro Plus' ELSE 'Free' END AS plan
        FROM customer)
    WHERE plan IN ('Pro', 'Pro Plus') OR followers_count >= 500
""")
def legitimacy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    rows = S.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(segment == "HOUSEHOLD", "Pro").when(segment == "MACHINERY", "Pro Plus").otherwise("Free").alias("plan"),
        F.floor("c_acctbal").cast("bigint").alias("followers_count"),
    )
    return R.legitimate(rows).withColumn("small", F.col("followers_count") < fixed.MIN_FOLLOWERS)


_FLAGS = """CASE c_nationkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '0.0' WHEN 3 THEN ' 0 '
            WHEN 4 THEN '' WHEN 5 THEN 'duplicate_flag' END"""


@query(f"""
    SELECT c_custkey, duplicate_flag FROM (SELECT c_custkey, {_FLAGS} AS duplicate_flag FROM customer)
    WHERE TRY_CAST(duplicate_flag AS DOUBLE) = 0
""")
def duplicate_flag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_FLAGS).alias("duplicate_flag"))
    return R.not_flagged(delimited.drop_repeated_headers(rows, "duplicate_flag", "duplicate_flag"))


@query(r"""
    WITH raw AS (SELECT p_partkey, p_name || ' (' || CAST(p_size % 13 AS VARCHAR)
                 || CASE p_size % 3 WHEN 0 THEN ')' WHEN 1 THEN 'x' ELSE '' END AS name FROM part)
    SELECT p_partkey, name, regexp_replace(regexp_replace(name, '^(.+) \([0-9].$', '\1', 's'),
                                           '^(.+) \([0-9][0-9].$', '\1', 's') AS cleaned FROM raw
""")
def name_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    ending = F.when(size % 3 == 0, ")").when(size % 3 == 1, "x").otherwise("")
    rows = S.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" ("), (size % 13).cast("string"), ending).alias("name")
    )
    return rows.withColumn("cleaned", names.strip_number_suffix(F.col("name")))


@query("""
    SELECT 'c' AS kind, c_custkey AS key, nullif(regexp_extract(c_name, '[0-9]+'), '') AS digits FROM customer
    UNION ALL SELECT 'p', p_partkey, nullif(regexp_extract(p_name, '[0-9]+'), '') FROM part
""")
def first_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = S.table(spark, sf_dir, "customer").select(
        F.lit("c").alias("kind"), F.col("c_custkey").alias("key"), names.first_digits(F.col("c_name")).alias("digits")
    )
    second = S.table(spark, sf_dir, "part").select(
        F.lit("p").alias("kind"), F.col("p_partkey").alias("key"), names.first_digits(F.col("p_name")).alias("digits")
    )
    return first.unionByName(second)


@query("""
    WITH parsed AS (
        SELECT page_id, url, CASE WHEN list_contains(string_split(url, '/'), 'https:') AND len(string_split(url, '/')) = 5
                                  THEN string_split(url, '/')[5] ELSE 'none' END AS alias FROM pages)
    SELECT page_id, alias, 'https://host/' || alias AS profile, 'https://host/' || alias || '/followers' AS followers,
           CASE WHEN contains(url, 'example.com') THEN split_part(url, 'example.com', 2) END AS cursor FROM parsed
""")
def alias_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, alias = F.col("url"), F.col("alias")
    return (
        S.table(spark, sf_dir, "pages")
        .select("page_id", "url", links.alias_from_url(url, host=None, parts=5, missing="none").alias("alias"))
        .select(
            "page_id",
            "alias",
            links.profile_url(alias, "https://host/").alias("profile"),
            links.followers_url(alias, "https://host/").alias("followers"),
            links.page_cursor(url, "example.com").alias("cursor"),
        )
    )


@query(rf"""
    SELECT p_partkey, regexp_replace(trim(p_name), '\s+', '+', 'g') || '{fixed.SEARCH_SUFFIX}' AS phrase FROM part
""")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return S.table(spark, sf_dir, "part").select("p_partkey", names.search_phrase(padded).alias("phrase"))


@query("""
    SELECT p_partkey, p_name AS artist_name, coalesce(o.sc_alias, 'part-' || p_partkey) AS sc_alias
    FROM part LEFT JOIN (SELECT p_name AS name, min(p_brand) AS sc_alias FROM part WHERE p_size = 50 GROUP BY 1) o
      ON p_name = o.name
""")
def alias_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.col("p_name").alias("artist_name"), S.part_alias("p_partkey").alias("sc_alias"))
    pairs = part.where("p_size = 50").select(F.col("p_name").alias("artist_name"), F.col("p_brand").alias("sc_alias"))
    return R.override_aliases(rows, pairs)


_UNESCAPED = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(f"""
    SELECT page_id, CAST(pos - 1 AS BIGINT) AS element_pos, {_UNESCAPED.format('raw')} AS value
    FROM (SELECT page_id, unnest(a) AS raw, generate_subscripts(a, 1) AS pos
          FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS a FROM pages))
""")
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.extract_elements(S.table(spark, sf_dir, "pages").select("page_id", "html"), "a", ["href"])
    return found.select("page_id", F.col("element_pos").cast("bigint").alias("element_pos"), "value")


@query(f"""
    SELECT page_id, CAST(pos - 1 AS BIGINT) AS element_pos, {_UNESCAPED.format('raw')} AS value
    FROM (SELECT page_id, unnest(a) AS raw, generate_subscripts(a, 1) AS pos
          FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS a FROM pages))
""")
def page_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.extract_elements(S.table(spark, sf_dir, "pages").select("page_id", "html"), "a", ["href"], "href")
    return found.select("page_id", F.col("element_pos").cast("bigint").alias("element_pos"), "value")


@query("""
    SELECT doc_id, lang, n_chars, position FROM (
        SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
    WHERE position >= 6 AND position < 618
""")
def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return numbering.row_range(rows, [F.col("doc_id").asc()], 6, 618)


@query("SELECT p_name AS sc_alias, count(DISTINCT p_partkey) AS count FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def duplicate_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "part").select(F.col("p_name").alias("sc_alias"), F.col("p_partkey").alias("artist_name"))
    return R.duplicate_aliases(rows)


_ALIASED = "SELECT p_partkey AS artist_name, p_name || '-' || p_brand || '-' || p_size AS sc_alias FROM part"
_DOUBLED = "SELECT sc_alias, count(DISTINCT artist_name) AS count FROM a GROUP BY 1 HAVING count(DISTINCT artist_name) > 1"


def _aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("artist_name"), F.concat_ws("-", "p_name", "p_brand", "p_size").alias("sc_alias")
    )


@query(f"WITH a AS ({_ALIASED}), d AS ({_DOUBLED}) SELECT artist_name, sc_alias, count FROM a LEFT JOIN d USING (sc_alias)")
def duplicate_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aliased(spark, sf_dir)
    return R.with_duplicate_count(rows, R.duplicate_aliases(rows))


@query(f"WITH a AS ({_ALIASED}), d AS ({_DOUBLED}) SELECT artist_name, sc_alias FROM a WHERE sc_alias IN (SELECT sc_alias FROM d)")
def rows_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aliased(spark, sf_dir)
    return R.rows_to_review(rows, R.duplicate_aliases(rows)).orderBy("sc_alias", "artist_name")


@query(f"WITH a AS ({_ALIASED}), d AS ({_DOUBLED}) SELECT artist_name, sc_alias FROM a WHERE sc_alias NOT IN (SELECT sc_alias FROM d)")
def non_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aliased(spark, sf_dir)
    return R.unique_rows(rows, R.duplicate_aliases(rows))


@query("""
    SELECT sc_alias, artist_name, source_rank FROM (
        SELECT p_name AS sc_alias, p_type || ' ' || p_partkey AS artist_name, CAST(p_size AS BIGINT) AS source_rank,
               row_number() OVER (PARTITION BY p_name ORDER BY levenshtein(lower(p_type || ' ' || p_partkey), lower(p_name)),
                                  p_size, p_type || ' ' || p_partkey) AS r FROM part) WHERE r = 1
""")
def duplicate_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("sc_alias"),
        F.concat_ws(" ", "p_type", "p_partkey").alias("artist_name"),
        F.col("p_name").alias("page_name"),
        F.col("p_size").cast("bigint").alias("source_rank"),
    )
    return R.resolve_duplicates(rows).drop("page_name")


@query("""
    WITH a AS (SELECT p_partkey AS artist_name, p_name || '-' || p_brand || '-' || p_size AS sc_alias,
                      CASE WHEN p_type = 'PROMO' THEN 'Pro' ELSE 'Free' END AS plan,
                      CAST(floor(p_retailprice) AS BIGINT) % 1000 AS followers_count FROM part),
         d AS (SELECT sc_alias FROM a GROUP BY 1 HAVING count(DISTINCT artist_name) > 1)
    SELECT artist_name, sc_alias, plan, followers_count FROM a
    WHERE (sc_alias NOT IN (SELECT sc_alias FROM d) OR artist_name IN (SELECT min(artist_name) FROM a GROUP BY sc_alias))
      AND (plan IN ('Pro', 'Pro Plus') OR followers_count >= 500)
""")
def harvest_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("artist_name"),
        F.concat_ws("-", "p_name", "p_brand", "p_size").alias("sc_alias"),
        F.when(F.col("p_type") == "PROMO", "Pro").otherwise("Free").alias("plan"),
        (F.floor("p_retailprice").cast("bigint") % 1000).alias("followers_count"),
    )
    duplicates = R.duplicate_aliases(rows)
    first = rows.groupBy("sc_alias").agg(F.min("artist_name").alias("first_name"))
    marked = (
        R.rows_to_review(rows, duplicates)
        .join(first, "sc_alias")
        .withColumn("review", F.when(F.col("artist_name") == F.col("first_name"), fixed.REVIEW_KEEP))
        .drop("first_name")
    )
    return build_harvest_list(rows, marked)


@query("SELECT DISTINCT c_mktsegment AS plan FROM customer")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("plan")).distinct()


@query("SELECT p_partkey AS alias, p_name AS name FROM part")
def artist_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("alias"), F.col("p_name").alias("name"))
    return lookup.artist_options(rows, "alias", "name")


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def utf8_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = F.concat(F.col("text").cast("binary"), F.lit(bytearray(b"\xff\xc3")))
    return S.table(spark, sf_dir, "documents").select("doc_id", F.md5(names.drop_invalid_utf8(damaged)).alias("hash"))


# --- files -------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS hash, lang, source, n_chars FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents")
    path = new_path(spark, "csv")
    delimited.write_delimited(rows, path)
    back = delimited.read_delimited(spark, path, rows.schema, multi_line=True)
    return delimited.sound_rows(back).select("doc_id", F.md5("text").alias("hash"), "lang", "source", "n_chars")


@query("SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding[1] AS DOUBLE) AS head, len(embedding) AS dims FROM embeddings")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    path = new_path(spark, "json")
    D.write_documents(rows, path, "json")
    back = D.read_documents(spark, path, "json", rows.schema)
    return back.select(
        "vec_id",
        F.col("label").cast("bigint").alias("label"),
        F.col("embedding")[0].alias("head"),
        F.size("embedding").cast("bigint").alias("dims"),
    )


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_error = F.col("event_type") == "error"
    return S.table(spark, sf_dir, "events").select(
        F.round(F.col("value") * 100).cast("bigint").alias("added"),
        F.lit(5000).cast("bigint").alias("expected"),
        F.col("user_id").cast("string").alias("alias"),
        F.lit(1).alias("artist_index"),
        F.lit(1).alias("total_artists"),
        F.col("ts").cast("timestamp").alias("logged_at"),
        F.when(is_error, F.col("props")).alias("error"),
    )


@query("""
    SELECT alias, reports, l.added AS added, CAST(5000 AS BIGINT) AS expected, l.added / 5000.0::DOUBLE AS ratio,
           l.error AS error, l.error IS NOT NULL AS failed
    FROM (SELECT CAST(user_id AS VARCHAR) AS alias, count(*) AS reports,
                 arg_max({'added': CAST(round(value * 100) AS BIGINT),
                          'error': CASE WHEN event_type = 'error' THEN props END}, ts) AS l
          FROM events GROUP BY user_id)
""")
def harvest_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "harvest-log")
    tables.append_harvest_log(_log(spark, sf_dir), path)
    return activity.harvest_completeness(tables.read_harvest_log(spark, path)).drop("logged_at")


@query("""
    SELECT artist_name, sc_alias, count(*) AS copies
    FROM (SELECT p_name AS artist_name, 'part-' || p_partkey AS sc_alias FROM part
          UNION ALL SELECT s_name, 'supplier-' || s_suppkey FROM supplier)
    GROUP BY 1, 2
""")
def appended_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "aliases")
    tables.append_aliases(S.artists(spark, sf_dir), path)
    second = S.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("artist_name"), F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("sc_alias")
    )
    tables.append_aliases(second, path)
    return spark.read.parquet(path).groupBy("artist_name", "sc_alias").agg(F.count("*").alias("copies"))


@query("SELECT event_type AS artist_alias, CAST(user_id AS VARCHAR) AS follower_alias FROM events GROUP BY 1, 2")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("artist_alias"), F.col("user_id").cast("string").alias("follower_alias")
    )
    source, stored, state = (new_path(spark, label) for label in ("pages", "stored", "ingest"))
    pages.repartition(6).write.parquet(source)
    stream = ingest.edge_stream(spark, source, files_per_batch=2)
    ingest.ingest_edges(stream, stored, state).awaitTermination()
    return ingest.stored_edges(spark, stored)


@query("SELECT event_type AS artist_alias, CAST(user_id AS VARCHAR) AS follower_alias FROM events GROUP BY 1, 2")
def ingest_two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams with checkpoints of their own into one table."""
    events = S.table(spark, sf_dir, "events")
    stored = new_path(spark, "stored")
    for part in (0, 1):
        source, state = new_path(spark, "pages"), new_path(spark, "ingest")
        events.where(F.col("event_id") % 2 == part).select(
            F.col("event_type").alias("artist_alias"), F.col("user_id").cast("string").alias("follower_alias")
        ).repartition(3).write.parquet(source)
        ingest.ingest_edges(ingest.edge_stream(spark, source), stored, state).awaitTermination()
    return ingest.stored_edges(spark, stored)


# --- documents ---------------------------------------------------------------------------------


@query("""
    SELECT conv_id, CAST(1 AS BIGINT) AS first_follower_num, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles,
           md5(string_agg(text, '|' ORDER BY turn)) AS hash FROM conversations GROUP BY conv_id
""")
def nest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = nesting.nest(S.table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["turn", "role", "text"])
    return nested.select(
        "conv_id",
        "first_follower_num",
        F.size("followers").cast("bigint").alias("n"),
        F.array_join("followers.role", ",").alias("roles"),
        F.md5(F.array_join("followers.text", "|")).alias("hash"),
    )


@query("""
    SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS artist_num,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS artist_follower_num, turn, role, md5(text) AS hash
    FROM conversations
""")
def flatten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "conversations")
    nested = nesting.nest(rows, "conv_id", ["turn"], ["turn", "role", "text"], chunk_rows=3)
    path = new_path(spark, "documents")
    D.write_documents(nested, path, "json")
    flat = nesting.flatten(D.read_documents(spark, path, "json", nested.schema), "conv_id")
    return flat.select(
        "conv_id",
        F.col("artist_num").cast("bigint").alias("artist_num"),
        "artist_follower_num",
        "turn",
        "role",
        F.md5("text").alias("hash"),
    )


@query(f"""
    WITH e AS ({_EDGES})
    SELECT 'no exception' AS exception, dense_rank() OVER (ORDER BY 'part-' || artist_id) AS artist_num,
           row_number() OVER (PARTITION BY artist_id ORDER BY c_name) AS artist_follower_num,
           'part-' || artist_id AS artist_alias, c_name AS follower_alias, c_mktsegment AS plan,
           CAST(c_nationkey AS BIGINT) AS track_count
    FROM e JOIN customer ON follower_id = c_custkey
""")
def artist_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every artist with at least one follower, flattened again to profile rows."""
    schema = {f.name: f.dataType for f in nesting.schemas.DOCUMENT.fields}
    meta = S.artists(spark, sf_dir).withColumnsRenamed({"artist_name": "artist", "sc_alias": "alias"})
    missing = [c for c in schema if c not in meta.columns and c not in ("followers", "first_follower_num", "date_time")]
    meta = meta.withColumns({c: F.lit(None).cast(schema[c]) for c in missing})
    followers = S.alias_edges(spark, sf_dir).join(S.profiles(spark, sf_dir), "follower_alias")
    followers = followers.withColumnsRenamed({"artist_alias": "alias", "follower_alias": "permalink"})
    struct = {f.name: f.dataType for f in nesting.schemas.FOLLOWER.fields}
    followers = followers.withColumns({c: F.lit(None).cast(t) for c, t in struct.items() if c not in followers.columns})
    documents = written(nesting.build_documents(meta, followers, chunk_rows=20), "documents")
    _, rows = nesting.flatten_documents(documents.where(F.size("followers") > 0))
    return rows.select(
        "exception",
        F.col("artist_num").cast("bigint").alias("artist_num"),
        "artist_follower_num",
        "artist_alias",
        "follower_alias",
        "plan",
        "track_count",
    )


@query("""
    SELECT vec_id, len(embedding) AS dims, CAST(embedding[1] AS DOUBLE) AS head,
           CAST(embedding[len(embedding)] AS DOUBLE) AS tail FROM embeddings
""")
def parse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = S.table(spark, sf_dir, "embeddings").select(
        F.lit(0).alias("index"),
        F.col("vec_id").cast("int").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
    )
    path = new_path(spark, "factors")
    delimited.write_delimited(text, path)
    parsed = factors.read_factor_text(spark, path)
    return parsed.select(
        F.col("id").cast("bigint").alias("vec_id"),
        F.size("features").cast("bigint").alias("dims"),
        F.col("features")[0].alias("head"),
        F.element_at("features", -1).alias("tail"),
    )


# --- edges and activity ------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY c_name NULLS FIRST) AS follower_id, c_name AS follower_alias FROM customer GROUP BY c_name")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = E.follower_ids(S.table(spark, sf_dir, "customer"), "c_name")
    return ids.withColumn("follower_id", F.col("follower_id").cast("bigint"))


@query(f"""
    WITH e AS ({_EDGES}),
         a AS (SELECT row_number() OVER (ORDER BY 'part-' || p_partkey) AS artist_id, 'part-' || p_partkey AS artist_alias,
                      p_partkey FROM part WHERE p_type <> 'PROMO'),
         f AS (SELECT row_number() OVER (ORDER BY c_name) AS follower_id, c_name AS follower_alias, c_custkey
               FROM customer WHERE c_acctbal >= 0)
    SELECT a.artist_id, f.follower_id, artist_alias, follower_alias, CAST(1 AS BIGINT) AS count
    FROM e JOIN a ON e.artist_id = p_partkey JOIN f ON e.follower_id = c_custkey
""")
def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists = R.deny_names(S.artists(spark, sf_dir), ["PROMO"], "plan")
    profiles = S.table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_name").alias("follower_alias"))
    found = E.training_edges(S.alias_edges(spark, sf_dir), E.artist_ids(artists), E.follower_ids(profiles))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("artist_id", "follower_id", "count")})


@query(f"""
    SELECT plan, count(*) AS edges, count(DISTINCT follower_id) AS followers
    FROM ({_EDGES}) JOIN (SELECT p_partkey, p_type AS plan FROM part) ON artist_id = p_partkey GROUP BY plan
""")
def sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ad-hoc SQL query over the registered views."""
    views.register_views(S.alias_edges(spark, sf_dir), S.artists(spark, sf_dir), S.profiles(spark, sf_dir))
    return spark.sql(f"""
        SELECT a.plan, count(*) AS edges, count(DISTINCT f.follower_id) AS followers
        FROM {views.EDGES} e
        JOIN {views.ARTIST_IDS} i ON e.artist_alias = i.artist_alias
        JOIN {views.FOLLOWER_IDS} f ON e.follower_alias = f.follower_alias
        JOIN {views.ARTISTS} a ON i.artist_alias = a.sc_alias
        GROUP BY a.plan
    """)


@query(f"""
    SELECT count(*) FILTER (WHERE p_partkey IS NULL) AS without_artist, count(*) FILTER (WHERE c_custkey IS NULL) AS without_profile
    FROM ({_EDGES}) LEFT JOIN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO') ON artist_id = p_partkey
    LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON follower_id = c_custkey
""")
def dropped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists = R.deny_names(S.artists(spark, sf_dir), ["PROMO"], "plan").select(F.col("sc_alias").alias("artist_alias"))
    profiles = S.table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_name").alias("follower_alias"))
    return E.dropped_edges(S.alias_edges(spark, sf_dir), artists, profiles)


@query("""
    SELECT o_custkey AS follower_alias, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS last_modified, o_orderpriority AS plan,
           o_orderkey AS track_count
    FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC,
                                           o_orderpriority DESC, o_orderkey DESC) = 1
""")
def follower_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of the profiles that a follower has, one per order."""
    rows = S.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("follower_alias"),
        F.to_date("o_orderdate").cast("string").alias("last_modified"),
        F.col("o_orderpriority").alias("plan"),
        F.col("o_orderkey").alias("track_count"),
    )
    return E.follower_profile(rows)


@query(f"SELECT follower_id, count(*) AS count FROM ({_EDGES}) GROUP BY follower_id")
def follower_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.follower_activity(S.id_edges(spark, sf_dir), "follower_id")


@query(f"""
    WITH e AS ({_EDGES}), f AS (SELECT follower_id, count(*) AS n FROM e GROUP BY 1),
         t AS (SELECT (SELECT count(*) FROM e) AS edges, count(*) AS followers,
                      (SELECT count(DISTINCT artist_id) FROM e) AS artists, count(*) FILTER (WHERE n > 10) AS over_10,
                      count(*) FILTER (WHERE n > 40) AS over_40, count(*) FILTER (WHERE n > 100) AS over_100 FROM f)
    SELECT *, edges / (CAST(followers AS DOUBLE) * artists) AS density FROM t
""")
def activity_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = S.id_edges(spark, sf_dir)
    return activity.activity_thresholds(edges, "artist_id", "follower_id", [10, 40, 100])


@query(f"""
    SELECT p_partkey AS artist_id, CAST(p_size AS BIGINT) AS followers_count, coalesce(n, 0) AS stored_followers,
           coalesce(n, 0) / nullif(p_size, 0)::DOUBLE AS completeness
    FROM part LEFT JOIN (SELECT artist_id, count(*) AS n FROM ({_EDGES}) GROUP BY 1) ON artist_id = p_partkey
""")
def artist_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists = S.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("artist_id"), F.col("p_size").cast("bigint").alias("followers_count")
    )
    return activity.artist_popularity(S.id_edges(spark, sf_dir), artists, "artist_id")


@query(f"""
    WITH e AS ({_EDGES})
    SELECT artist, count(*) AS partners, CAST(sum(common) AS BIGINT) AS common_sum, max(common) AS most
    FROM (SELECT a.artist_id AS artist, b.artist_id AS other, count(*) AS common
          FROM e a JOIN e b ON a.follower_id = b.follower_id AND a.artist_id < b.artist_id GROUP BY 1, 2)
    GROUP BY 1
""")
def follower_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of artists with followers in common, summed up for the artist with the smaller id."""
    edges = written(S.id_edges(spark, sf_dir), "edges")
    pairs = overlap.common_followers(edges)
    return pairs.groupBy("artist").agg(
        F.count("*").alias("partners"), F.sum("common").cast("bigint").alias("common_sum"), F.max("common").cast("bigint").alias("most")
    )


_OVERLAP_RANKS = f"""
    WITH e AS ({_EDGES}),
         c AS (SELECT a.artist_id AS artist, b.artist_id AS other, count(*) AS common
               FROM e a JOIN e b ON a.follower_id = b.follower_id AND a.artist_id <> b.artist_id GROUP BY 1, 2)
    SELECT artist, row_number() OVER (PARTITION BY artist ORDER BY common DESC, other) AS rank, other, common FROM c
    QUALIFY rank <= 10
"""


@query(_OVERLAP_RANKS)
def top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every artist the 10 others with the most followers in common."""
    edges = written(S.id_edges(spark, sf_dir), "edges")
    return overlap.top_overlap(edges, 10).withColumn("rank", F.col("rank").cast("bigint"))


# --- similarity and answers --------------------------------------------------------------------

_COSINES = """
    SELECT a.vec_id AS id, b.vec_id AS similar_id,
           round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS cosine
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
"""
_SIMILAR_RANKS = f"""
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, similar_id) AS rank, similar_id, cosine
    FROM ({_COSINES}) QUALIFY rank <= 30
"""


@query(f"SELECT id, rank, similar_id, round(cosine, 6) AS cosine FROM ({_SIMILAR_RANKS})")
def topn_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.top_similar(S.items(spark, sf_dir))
    return found.select("id", F.col("rank").cast("bigint").alias("rank"), "similar_id", F.round("cosine", 6).alias("cosine"))


@query("""
    SELECT CAST(pos - 1 AS BIGINT) AS factor, row_number() OVER (PARTITION BY pos ORDER BY weight DESC, id) AS rank, id
    FROM (SELECT vec_id AS id, unnest(embedding) AS weight, generate_subscripts(embedding, 1) AS pos FROM embeddings)
""")
def factor_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = similarity.factor_dominance(S.items(spark, sf_dir))
    return ranked.select(F.col("factor").cast("bigint").alias("factor"), "rank", "id")


@query("""
    SELECT vec_id AS id, len(embedding) AS dims, p_name AS artist_name, 'part-' || p_partkey AS sc_alias, p_type AS plan,
           CAST(p_size AS BIGINT) AS followers_count FROM embeddings JOIN part ON vec_id = p_partkey
""")
def artist_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = lookup.artist_info(S.items(spark, sf_dir), S.artists(spark, sf_dir))
    return info.withColumn("dims", F.size("features").cast("bigint")).drop("features")


_LOOKUP = f"""
    SELECT 'part-' || a.p_partkey AS alias, a.p_name AS artist_name, rank, 'part-' || b.p_partkey AS similar_alias,
           b.p_name AS similar_name, '{fixed.PROFILE_PREFIX}part-' || b.p_partkey AS similar_url
    FROM ({_SIMILAR_RANKS}) JOIN part a ON a.p_partkey = id JOIN part b ON b.p_partkey = similar_id
"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = training.answers(S.items(spark, sf_dir), S.artists(spark, sf_dir))
    return found.withColumn("rank", F.col("rank").cast("bigint")).drop("cosine")


@query(_LOOKUP)
def lookup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir)


@query(f"SELECT * FROM ({_LOOKUP}) WHERE alias = 'part-7'")
def lookup_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question to the stored answers of all artists."""
    path = new_path(spark, "lookup")
    lookup.write_lookup(_answers(spark, sf_dir), path)
    return lookup.recommend(spark, path, "part-7")


@query(f"""
    WITH s AS ({_SIMILAR_RANKS.replace('<= 30', '<= 10')}), o AS ({_OVERLAP_RANKS})
    SELECT s.id AS artist_id, count(o.other) AS hits, count(o.other) / 10.0::DOUBLE AS share
    FROM s LEFT JOIN o ON s.id = o.artist AND s.similar_id = o.other GROUP BY s.id
""")
def overlap_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = written(S.id_edges(spark, sf_dir), "edges")
    similar = similarity.top_similar(S.items(spark, sf_dir), 10).withColumnRenamed("id", "artist_id")
    return evaluation.overlap_share(similar, overlap.top_overlap(edges, 10), 10)


_PRODUCTS = """
    SELECT a.vec_id AS follower_id, b.vec_id AS artist_id,
           round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS prediction
    FROM embeddings a CROSS JOIN embeddings b
"""
_PRODUCT_RANKS = f"""
    SELECT follower_id, row_number() OVER (PARTITION BY follower_id ORDER BY prediction DESC, artist_id) AS rank, artist_id,
           prediction FROM ({_PRODUCTS}) QUALIFY rank <= 10
"""


def _best_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as factors of followers and of artists."""
    items = S.items(spark, sf_dir)
    return tiles.best_products(items, items, 10).select(
        F.col("row_id").alias("follower_id"),
        F.col("rank").cast("bigint").alias("rank"),
        F.col("column_id").alias("artist_id"),
        F.col("score").alias("prediction"),
    )


@query(f"SELECT follower_id, rank, artist_id, round(prediction, 6) AS prediction FROM ({_PRODUCT_RANKS})")
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best_products(spark, sf_dir).withColumn("prediction", F.round("prediction", 6))


@query(f"SELECT follower_id, rank, artist_id FROM ({_PRODUCT_RANKS})")
def top_small_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks from factors that are 1e8 times smaller."""
    items = S.items(spark, sf_dir).withColumn("features", F.transform("features", lambda x: x * 1e-8))
    return tiles.best_products(items, items, 10).select(
        F.col("row_id").alias("follower_id"), F.col("rank").cast("bigint").alias("rank"), F.col("column_id").alias("artist_id")
    )


@query(f"""
    SELECT count(*) AS pairs, round(sqrt(avg(power(prediction - CASE WHEN e.artist_id IS NULL THEN 0 ELSE 1 END, 2))), 9) AS rmse,
           round(avg(CASE WHEN e.artist_id IS NULL THEN 0.0::DOUBLE ELSE 1 END), 9) AS hit_rate
    FROM ({_PRODUCT_RANKS}) p LEFT JOIN ({_EDGES}) e ON p.follower_id = e.follower_id AND p.artist_id = e.artist_id
""")
def top_n_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.top_n_error(_best_products(spark, sf_dir), S.id_edges(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) for c in ("rmse", "hit_rate")})


# --- factors -----------------------------------------------------------------------------------


def _trained(spark: SparkSession, sf_dir: str, **settings: object) -> training.Training:
    return training.train(S.alias_edges(spark, sf_dir), S.artists(spark, sf_dir), S.profiles(spark, sf_dir), **settings)


@query(f"""
    SELECT count(DISTINCT artist_id) AS items, count(DISTINCT follower_id) AS users, CAST(5 AS BIGINT) AS rank,
           CAST(0 AS BIGINT) AS negatives, CAST(0 AS BIGINT) AS missing FROM ({_EDGES})
""")
def als_factor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = _trained(spark, sf_dir)
    item = F.col("kind") == "item"
    factors = trained.factors.select(F.lit("item").alias("kind"), "features").unionByName(
        trained.model.userFactors.select(F.lit("user").alias("kind"), "features")
    )
    return factors.agg(
        F.count_if(item).alias("items"),
        F.count_if(~item).alias("users"),
        F.max(F.size("features")).cast("bigint").alias("rank"),
        F.count_if(F.exists("features", lambda x: x < 0)).alias("negatives"),
        F.count_if(F.exists("features", lambda x: x.isNull() | F.isnan(x))).alias("missing"),
    )


@query()
def similar_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: edges, ids, factors, the 30 most similar artists of every artist with names and links."""
    trained = _trained(spark, sf_dir)
    return training.answers(trained.factors, S.artists(spark, sf_dir))


@query()
def als_two_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-factor variant with default training settings."""
    return _trained(spark, sf_dir, rank=2, maxIter=10, regParam=0.1).factors


@query()
def als_top_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every follower's 10 highest predictions."""
    trained = _trained(spark, sf_dir)
    found = written(model.recommend_artists(trained.model, 10), "top-artists")  # sorting reads its rows twice, and would compute them twice
    return found.orderBy(F.desc("prediction"), "follower_id", "artist_id")


@query()
def als_top_n_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of every follower's 10 highest predictions."""
    trained = _trained(spark, sf_dir)
    return evaluation.top_n_error(model.recommend_artists(trained.model, 10), trained.edges)


def _holdout(spark: SparkSession, sf_dir: str) -> tuple[model.ALSModel, DataFrame]:
    """Factors of four fifths of the edges, and the predictions for the rest."""
    train_part, test_part = model.split(_trained_edges(spark, sf_dir))
    fitted = model.fit(train_part)
    return fitted, model.predict(fitted, test_part)


@query()
def als_holdout_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for the held-out fifth of the edges, from factors of the rest."""
    return _holdout(spark, sf_dir)[1]


def _trained_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = E.artist_ids(S.artists(spark, sf_dir)), E.follower_ids(S.profiles(spark, sf_dir))
    return written(E.training_edges(S.alias_edges(spark, sf_dir), *ids), "edges")


_SPLIT = f"""
    SELECT *, ('0x' || substr(md5('1|part-' || artist_id || '|Customer#' || lpad(CAST(follower_id AS VARCHAR), 9, '0')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.8 AS training
    FROM ({_EDGES})
"""


@query(f"""
    WITH s AS ({_SPLIT})
    SELECT count(*) AS pairs, true AS falling, true AS finite, true AS products FROM s
    WHERE NOT training AND artist_id IN (SELECT artist_id FROM s WHERE training) AND follower_id IN (SELECT follower_id FROM s WHERE training)
""")
def als_holdout_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out edges with both ends in the training part get a prediction, the product of their factors; the order falls."""
    fitted, predictions = _holdout(spark, sf_dir)
    found = written(predictions.withColumn("at", F.monotonically_increasing_id()), "predictions")
    inside = found.select((F.col("at") + 1).alias("at"), F.col("prediction").alias("before"))
    rows = found.join(inside, "at", "left").withColumn("falls", F.coalesce(F.col("before") >= F.col("prediction"), F.lit(True)))
    # partitions follow each other: the first of one is not above the last of the one before
    ends = found.groupBy(F.shiftright("at", 33).alias("part")).agg(F.max("prediction").alias("first"), F.min("prediction").alias("last"))
    borders = ends.withColumn("before", F.lag("last").over(Window.orderBy("part")))  # one row a partition
    follows = borders.agg(F.every(F.coalesce(F.col("before") >= F.col("first"), F.lit(True))).alias("follows"))
    users = fitted.userFactors.select(F.col("id").alias("follower_id"), F.col("features").alias("u"))
    items = fitted.itemFactors.select(F.col("id").alias("artist_id"), F.col("features").alias("i"))
    terms = F.zip_with("u", "i", lambda a, b: a.cast("double") * b.cast("double"))
    product = F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)
    rows = rows.join(users, "follower_id").join(items, "artist_id")
    equal = F.abs(product - F.col("prediction")) <= 1e-5 * F.greatest(F.lit(1.0), F.abs("prediction"))
    totals = rows.agg(
        F.count("*").alias("pairs"),
        F.every("falls").alias("falling"),
        F.every(~F.isnan("prediction")).alias("finite"),
        F.every(equal).alias("products"),
    )
    together = totals.unionByName(follows, allowMissingColumns=True)  # one row each
    both = together.agg(*[F.first(c, ignorenulls=True).alias(c) for c in together.columns])
    return both.select("pairs", (F.col("falling") & F.col("follows")).alias("falling"), "finite", "products")


@query(f"SELECT DISTINCT 'part-' || artist_id AS artist_alias, CAST(2 AS INT) AS factors, true AS non_negative FROM ({_EDGES})")
def als_two_factors_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors for every artist with followers, none below zero."""
    return als_two_factors(spark, sf_dir).select(
        "artist_alias", F.size("features").alias("factors"), F.forall("features", lambda x: x >= 0).alias("non_negative")
    )


@query(f"""
    SELECT count(DISTINCT follower_id) AS followers, 10 * count(DISTINCT follower_id) AS rows, true AS ranked, true AS falling FROM ({_EDGES})
""")
def als_top_artists_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten predictions for each follower, ranked 1 to 10 and falling."""
    found = als_top_artists(spark, sf_dir).groupBy("follower_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "prediction"))).alias("list")
    )
    ranked = F.transform("list", lambda x: x["rank"].cast("int")) == F.sequence(F.lit(1), F.size("list"))
    scores = F.transform("list", lambda x: x["prediction"])
    return found.agg(
        F.count("*").alias("followers"),
        F.sum(F.size("list")).cast("bigint").alias("rows"),
        F.every(ranked).alias("ranked"),
        F.every(F.array_sort(scores) == F.reverse(scores)).alias("falling"),
    )


@query()
def als_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rmse of every rank x regParam, cross-validated on the training edges."""
    train_part, _ = model.split(_trained_edges(spark, sf_dir))
    results = model.grid_results(model.grid_search(train_part))
    return spark.createDataFrame(results, "rank INT, regParam DOUBLE, rmse DOUBLE, best BOOLEAN")


@query()
def als_overlap_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the 10 most similar artists that are among the 10 with the most common followers."""
    trained = _trained(spark, sf_dir)
    similar = similarity.top_similar(trained.factors, 10, bounded=None).withColumnRenamed("id", "artist_id")
    return evaluation.overlap_share(similar, overlap.top_overlap(trained.edges, 10), 10)
