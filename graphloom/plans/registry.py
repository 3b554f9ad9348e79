"""Named queries over the supplied tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import prose
from graphloom.operators import kernels as K
from graphloom.operators import notes
from graphloom.operators import ranking as R
from graphloom.plans import mapqueries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(mapqueries.QUERIES)
ORACLES: dict[str, str] = dict(mapqueries.ORACLES)


def _query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return add


@_query("q01_dedupe_by_rank", """SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1""")
def _(t):
    d = t("documents").withColumn("k", F.md5(F.lower(F.trim("text")).cast("binary")))
    return K.dedupe_by_rank(d, ["k"], [F.desc("n_chars"), F.desc("doc_id")]).select("doc_id", "n_chars")


_WHITE = r"[ \t\n\r\f\v]"
_RULE_LINE = r"[ \t\r\f\v]*(?:" + "|".join("\\" + m + "{3,}" for m in "=-`:'\"~^_*+#<>").replace("'", "''") + r")[ \t\r\f\v]*(?:\n|$)"


def _untitled_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '^(?:[ \\t\\r\\f\\v]*\\n|{_RULE_LINE}|[^\\n]*\\n{_RULE_LINE})*', '')"


def _sentence_sql(x: str) -> str:
    one = f"regexp_replace(regexp_replace({x}, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '{_WHITE}+', ' ', 'g')"
    head = f"regexp_extract({one}, '^((?:.*?[^A-Z])??[.!?])(?: |$)', 1)"
    return f"nullif(regexp_replace(CASE WHEN {head} != '' THEN {head} ELSE {one} END, '\\.+$', ''), '')"


_FIRST_SENTENCE = _sentence_sql(f"string_split({_untitled_sql('x')}, chr(10) || chr(10))[1]")


@_query("q02_first_sentence", f"SELECT doc_id, {_FIRST_SENTENCE} AS said FROM (SELECT doc_id, text AS x FROM documents)")
def _(t):
    return t("documents").select("doc_id", prose.first_sentence_of(F.col("text")).alias("said"))


@_query("q03_licence_markers", "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{m}')" for m in prose.LICENCE_MARKERS))
def _(t):
    return t("documents").filter(prose.licence(F.col("text"))).select("doc_id")


_IS_LICENCE = " OR ".join(f"contains(lower(said), '{m}')" for m in prose.LICENCE_MARKERS)


@_query("q04_purpose", f"""WITH p AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split({_untitled_sql('text')}, chr(10) || chr(10)) AS ps FROM documents)),
s AS (SELECT doc_id, i, {_FIRST_SENTENCE} AS said FROM p), n AS (SELECT *, {_IS_LICENCE} AS licence, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s WHERE said IS NOT NULL),
f AS (SELECT doc_id, min_by(said, k) AS said FROM n WHERE k <= 2 AND NOT licence GROUP BY 1)
SELECT doc_id, CASE WHEN regexp_matches(said, '\\p{{L}}') THEN said END AS purpose FROM documents LEFT JOIN f USING (doc_id)""")
def _(t):
    return t("documents").select("doc_id", prose.purpose_of(F.col("text")).alias("purpose"))


@_query("q05_fans", """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem), i AS (SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY 1), o AS (SELECT src AS node, count(*) AS fan_out FROM e GROUP BY 1)
SELECT node, coalesce(fan_in, 0)::BIGINT AS fan_in, coalesce(fan_out, 0)::BIGINT AS fan_out FROM i FULL JOIN o USING (node)""")
def _(t):
    return K.fans(K.distinct_edges(t("lineitem").withColumn("p", F.col("l_partkey") + 1000000), "l_suppkey", "p"))


@_query("q06_weighted_score", """WITH s AS (SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS fan_out, count(DISTINCT l_orderkey) AS fan_in, count(*) AS loc, count(*) FILTER (l_returnflag = 'R') - 0.5 * count(*) FILTER (l_discount > 0.08) AS branches, count(*) FILTER (l_linestatus = 'O') AS strings FROM lineitem GROUP BY 1),
m AS (SELECT min(fan_out) AS a, max(fan_out) AS b, min(loc) AS c, max(loc) AS d, min(branches) AS e, max(branches) AS f, min(fan_in) AS g, max(fan_in) AS h FROM s)
SELECT node, round((0.45 * coalesce((branches - e)::DOUBLE / nullif(f - e, 0), 0.0) + 0.25 * coalesce((loc - c)::DOUBLE / nullif(d - c, 0), 0.0) + 0.15 * coalesce((fan_in - g)::DOUBLE / nullif(h - g, 0), 0.0) + 0.15 * coalesce((fan_out - a)::DOUBLE / nullif(b - a, 0), 0.0))
  * CASE WHEN loc < 4 OR strings < 3 THEN 1.0 WHEN strings >= 0.5 * loc THEN 0.65 ELSE 0.8 END * CASE WHEN node % 10 = 0 THEN 0.6 ELSE 1.0 END, 6)::DOUBLE AS score FROM s, m""")
def _(t):
    name = F.when(F.col("node") % 10 == 0, "__init__").otherwise("run")
    s = t("lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.countDistinct("l_partkey").alias("fan_out"), F.countDistinct("l_orderkey").alias("fan_in"), F.count("*").alias("loc"), F.count_if(F.col("l_returnflag") == "R").alias("n_branches"), F.count_if(F.col("l_discount") > 0.08).alias("n_ternaries"), F.count_if(F.col("l_linestatus") == "O").alias("n_strings"))
    s = K.weighted_score(s.withColumns({"name": name, "effective_branches": R.effective_branches()}), R.WEIGHTS)
    return s.select("node", F.round(F.col("score") * R.presentation_factor() * R.constructor_factor(), 6).alias("score"))


@_query("q07_budgeted_prefix", """SELECT o_custkey, o_orderkey FROM (SELECT *, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 50000000""")
def _(t):
    d = t("orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return K.budgeted_prefix(d, ["o_custkey"], [F.col("o_orderkey")], "cents", 50000000).select("o_custkey", "o_orderkey")


@_query("q08_kth_cutoff", """WITH r AS (SELECT *, row_number() OVER (ORDER BY p_retailprice) AS n, count(*) OVER () AS c FROM part), k AS (SELECT p_retailprice AS cutoff FROM r WHERE n = greatest(c // 3, 1))
SELECT p_partkey, cutoff FROM part, k WHERE p_retailprice <= cutoff""")
def _(t):
    return t("part").join(F.broadcast(K.kth_smallest(t("part"), "p_retailprice")), F.col("p_retailprice") <= F.col("cutoff")).select("p_partkey", "cutoff")


@_query("q09_top_with_skip", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part), f AS (SELECT p_brand, min(place) AS f FROM r WHERE place > 2 AND p_size > 25 GROUP BY 1)
SELECT p_brand, p_partkey, place::INT AS place FROM r LEFT JOIN f USING (p_brand) WHERE place <= 2 OR place = f""")
def _(t):
    return K.top_with_skip(t("part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 2, F.col("p_size") > 25).select("p_brand", "p_partkey", "place")


_NEXT_ORDERS = """WITH RECURSIVE n AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders),
d AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS dst FROM orders), """


def _next_orders(t, by: Column) -> DataFrame:
    """From each order to the next of the same group."""
    w = Window.partitionBy(by).orderBy("o_orderkey")
    return t("orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).filter("dst IS NOT NULL")


@_query("q10_bounded_reach", _NEXT_ORDERS + """e AS (SELECT * FROM n WHERE dst IS NOT NULL UNION SELECT * FROM d WHERE dst IS NOT NULL),
r(source, node, hops) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders UNION SELECT source, dst, hops + 1 FROM r JOIN e ON node = src WHERE hops < 6)
SELECT source, node, min(hops)::INT AS hops FROM r GROUP BY 1, 2""")
def _(t):
    e = _next_orders(t, F.col("o_custkey")).union(_next_orders(t, F.to_date("o_orderdate"))).distinct()
    return K.bounded_reach(e, t("orders").select(F.col("o_orderkey").alias("node")), 6)


@_query("q11_least_hops", _NEXT_ORDERS + """r(node, hops) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderpriority < '3' UNION SELECT dst, hops + 1 FROM r JOIN n ON node = src WHERE dst IS NOT NULL)
SELECT node, min(hops)::INT AS hops FROM r GROUP BY 1""")
def _(t):
    return K.least_hops(_next_orders(t, F.col("o_custkey")), t("orders").filter("o_orderpriority < '3'").select(F.col("o_orderkey").alias("node")))


_ISLANDS = """WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM f)"""


_GAP = 3_600_000_000


def _island_rows(t) -> DataFrame:
    """Runs of a user's events with at most an hour between neighbours, joined from cells of an hour."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kinds = (F.collect_set("event_type"), F.size(F.array_distinct(F.flatten(F.collect_list("_kinds")))).cast("long"))
    return K.island_summaries(t("events"), ["user_id"], us, _GAP, _GAP, {"n": (F.count("*"), F.sum("_n")), "kinds": kinds})


@_query("q12_islands", _ISLANDS + " SELECT user_id, island, count(*) AS n, count(DISTINCT event_type) AS kinds FROM i GROUP BY 1, 2 HAVING count(*) >= 2")
def _(t):
    return _island_rows(t).select("user_id", "island", "n", "kinds").filter("n >= 2")


@_query("q12_distinct_islands", _ISLANDS + " SELECT user_id, island, count(*) AS n, count(DISTINCT event_type) AS kinds FROM i GROUP BY 1, 2 HAVING count(DISTINCT event_type) >= 3")
def _(t):
    return _island_rows(t).select("user_id", "island", "n", "kinds").filter("kinds >= 3")


@_query("q13_interval_join", _ISLANDS + """, s AS (SELECT user_id, min(epoch_us(ts)) - 600000000 AS b, max(epoch_us(ts)) + 600000000 AS e FROM i GROUP BY user_id, island)
SELECT event_id, min(b) AS b FROM events JOIN s USING (user_id) WHERE epoch_us(ts) BETWEEN b AND e GROUP BY 1""")
def _(t):
    s = _island_rows(t).select("user_id", (F.col("begin") - 600_000_000).alias("b"), (F.col("end") + 600_000_000).alias("e"))
    points = t("events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return K.first_interval(points, s, ["user_id"], "us", "b", "e").select("event_id", "b")


_PATH = "regexp_extract(url, '^[^:]*://([^?#]*)', 1)"


@_query("q14_longest_prefix", f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), x AS (SELECT DISTINCT string_split(path, '/')[1] AS prefix FROM p UNION SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] FROM p WHERE path LIKE '%/en/%')
SELECT page_id, max_by(prefix, length(prefix)) AS prefix FROM p JOIN x ON path = prefix OR starts_with(path, prefix || '/') GROUP BY 1""")
def _(t):
    p = t("pages").select("page_id", F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1).alias("path"))
    one = p.select(F.substring_index("path", "/", 1).alias("prefix"))
    two = p.filter(F.col("path").contains("/en/")).select(F.substring_index("path", "/", 2).alias("prefix"))
    return K.longest_prefix(p, "path", one.union(two)).select("page_id", "prefix")


@_query("q15_shortest_unique_suffix", f"""WITH v AS (SELECT DISTINCT {_PATH} AS path FROM pages), s AS (SELECT path, n, array_to_string(list_slice(string_split(path, '/'), len(string_split(path, '/')) - n + 1, len(string_split(path, '/'))), '/') AS suffix FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM v)),
a AS (SELECT suffix, n, max(path) AS path FROM s GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT path, min_by(suffix, n) AS suffix FROM a GROUP BY 1)
SELECT path, coalesce(suffix, path) AS suffix FROM v LEFT JOIN b USING (path)""")
def _(t):
    return K.shortest_unique_suffix(t("pages").select(F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1).alias("path")), "path")


def _greedy_sql(rounds: int) -> str:
    parts = ["l0 AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem)"]
    for r in range(rounds):
        parts += [f"p{r} AS (SELECT {r} AS place, k, count(*) AS gain FROM l{r} GROUP BY k ORDER BY gain DESC, k LIMIT 1)", f"l{r + 1} AS (SELECT * FROM l{r} WHERE i NOT IN (SELECT i FROM l{r} WHERE k IN (SELECT k FROM p{r})))"]
    return "WITH " + ", ".join(parts) + " SELECT place, k AS l_suppkey, gain FROM (" + " UNION ALL ".join(f"SELECT * FROM p{r}" for r in range(rounds)) + ")"


@_query("q16_greedy_cover", _greedy_sql(4))
def _(t):
    return K.greedy_cover(t("lineitem"), "l_suppkey", "l_partkey", 4)


@_query("q17_subset", """SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size <= 45))""")
def _(t):
    d = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return K.subset_of(d, "l_suppkey", "p_brand", t("part").filter("p_size <= 45"))


@_query("q18_tally_top", """WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, word) AS k FROM w)
SELECT CASE WHEN k <= 3 THEN word ELSE 'more' END AS word, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def _(t):
    w = t("part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = w.orderBy(F.desc("n"), "word").limit(3).select("word", F.lit(True).alias("top"))
    return w.join(F.broadcast(top), "word", "left").groupBy(F.when(F.col("top"), F.col("word")).otherwise("more").alias("word")).agg(F.sum("n").alias("n"))


_REASON = f"""CASE WHEN length(kept) = 0 THEN 'empty' WHEN length(kept) > 90 THEN 'too long' WHEN len(regexp_extract_all(kept, '[^ \\t\\n\\r\\f\\v]+')) < 3 OR length(kept) < 25 THEN 'too short'
WHEN turn % 2 = 0 AND regexp_matches(lower(kept), '{notes.LOOP_WORDS}') THEN 'invented a loop' WHEN conv_id % 2 = 0 AND regexp_matches(lower(kept), '{notes.BRANCH_WORDS}') THEN 'invented a branch' ELSE 'kept' END"""
_KEPT = "CASE WHEN length(text) <= 90 THEN text ELSE coalesce(list_aggregate([array_to_string(list_slice(cs, 1, n), ', ') for n in range(1, len(cs) + 1) if length(array_to_string(list_slice(cs, 1, n), ', ')) <= 90], 'last'), '') END"


@_query("q19_reasons", f"WITH c AS (SELECT *, string_split(text, ', ') AS cs FROM conversations), k AS (SELECT *, {_KEPT} AS kept FROM c) SELECT {_REASON} AS reason, count(*) AS n FROM k GROUP BY 1")
def _(t):
    why = notes.rejection(F.col("text"), F.col("turn") % 2, F.col("conv_id") % 2)
    return t("conversations").groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@_query("q20_semi_anti", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def _(t):
    """Both halves in one left join with the distinct keys."""
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("has")).distinct()
    return t("customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.col("has").isNotNull().alias("has_orders"))


@_query("q21_profile", "SELECT lang, count(*) AS n, median(n_chars) AS mid, round(100.0 * sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) / count(*), 6)::DOUBLE AS long_percent FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.median("n_chars").alias("mid"), F.round(F.sum(F.when(F.col("n_chars") > 2000, 1).otherwise(0)) * 100.0 / F.count("*"), 6).cast("double").alias("long_percent"))


@_query("q22_priority_union", """WITH u AS (SELECT n_name AS name, 0 AS tier FROM nation UNION ALL SELECT r_name, 1 FROM region UNION ALL SELECT s_name, 2 FROM supplier) SELECT name, min(tier)::INT AS tier FROM u GROUP BY 1 ORDER BY tier, name LIMIT 10""")
def _(t):
    tiers = [t("nation").select(F.col("n_name").alias("name"), F.lit(0).alias("tier")), t("region").select("r_name", F.lit(1)), t("supplier").select("s_name", F.lit(2))]
    return tiers[0].union(tiers[1]).union(tiers[2]).groupBy("name").agg(F.min("tier").alias("tier")).orderBy("tier", "name").limit(10)


@_query("q23_cascade", """SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'label' WHEN b.item_id IS NOT NULL THEN 'benchmark' ELSE 'none' END AS found, coalesce(l.quality::BIGINT, b.item_id) AS value FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def _(t):
    d = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").join(t("benchmark").select(F.col("item_id").alias("doc_id"), "item_id"), "doc_id", "left")
    return d.select("doc_id", F.when(F.col("quality").isNotNull(), "label").when(F.col("item_id").isNotNull(), "benchmark").otherwise("none").alias("found"), F.coalesce(F.col("quality").cast("long"), "item_id").alias("value"))


@_query("q24_content_key", "SELECT doc_id, substr(sha256('m:' || doc_id || ':' || text), 1, 24) AS key FROM documents")
def _(t):
    return t("documents").select("doc_id", F.substring(F.sha2(F.concat(F.lit("m:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("text")), 256), 1, 24).alias("key"))


@_query("q25_levels", "WITH RECURSIVE r(node, level) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey // 3 = p_partkey OR p_partkey // 3 NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT p_partkey, level + 1 FROM part JOIN r ON node = p_partkey // 3 AND node != p_partkey) SELECT node, level FROM r")
def _(t):
    p = t("part").select(F.col("p_partkey").alias("node"))
    return K.topological_levels(p, p.select("node", F.expr("node div 3").alias("need")))


@_query("q26_last_two", "SELECT page_id, array_to_string(list_slice(string_split(regexp_extract(url, '^[^:]*://([^/?#]*)', 1), '.'), -2, -1), '.') AS tail FROM pages")
def _(t):
    return t("pages").select("page_id", F.substring_index(F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1), ".", -2).alias("tail"))


@_query("q27_word_overlap", "SELECT p_partkey, round(len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), list_distinct(string_split(lower(p_type), ' '))))::DOUBLE / len(list_distinct(string_split(lower(p_name), ' '))), 6) AS ratio FROM part")
def _(t):
    a, b = F.array_distinct(F.split(F.lower("p_name"), " ")), F.array_distinct(F.split(F.lower("p_type"), " "))
    return t("part").select("p_partkey", F.round(F.size(F.array_intersect(a, b)) / F.size(a), 6).alias("ratio"))
