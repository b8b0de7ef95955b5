"""The registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import asof, graph, intervals, lines, resolve, rollup, search
from lodestar.plans import code_oracles, commands, fixture, reports, views
from lodestar.session import materialise
from lodestar.sources.code import CodeIndex

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return _SQL | code_oracles.oracle_sql()


_SCORE = """CASE WHEN lower({n}) = '{q}' THEN 1.0 WHEN starts_with(lower({n}), '{q}') THEN 0.95 + 0.05 * {l} / strlen({n})
 WHEN contains(lower({n}), '{q}') THEN 0.85 + 0.05 * {l} / strlen({n}) ELSE 1.0 - levenshtein(lower({n}), '{q}') / greatest(strlen({n}), {l})::DOUBLE END"""


@register(f"""SELECT p_partkey, p_name, round(s, 6) AS score FROM (SELECT p_partkey, p_name, {_SCORE.format(n="p_name", q="small", l=5)} AS s FROM part) WHERE s >= 0.7""")
def find_ranked(spark, sf_dir):
    found = search.ranked(table(spark, sf_dir, "part"), "p_name", ["small"], 0.7)
    return found.select("p_partkey", "p_name", F.round("score", 6).alias("score"))


@register(f"""WITH h AS (SELECT p_partkey, p_name, {_SCORE.format(n="p_name", q="small ring", l=10)} AS s FROM part)
 SELECT p_partkey, p_name, round(s, 6) AS score FROM h WHERE s >= 0.6 AND (s = 1.0 OR (SELECT max(s) FROM h) < 1.0)""")
def find_exact_suppresses(spark, sf_dir):
    found = search.exact_suppresses(search.ranked(table(spark, sf_dir, "part"), "p_name", ["small ring"], 0.6))
    return found.select("p_partkey", "p_name", F.round("score", 6).alias("score"))


@register(f"""SELECT p_partkey, round(coalesce(a, b, c), 6) AS score, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'sig' ELSE 'path' END AS match_kind
 FROM (SELECT p_partkey, CASE WHEN x >= 0.85 THEN x END AS a, CASE WHEN y >= 0.85 THEN y END AS b, CASE WHEN z >= 0.85 THEN z END AS c FROM
 (SELECT p_partkey, {_SCORE.format(n="p_name", q="small", l=5)} AS x, {_SCORE.format(n="p_type", q="small", l=5)} AS y, {_SCORE.format(n="p_brand", q="small", l=5)} AS z FROM part))
 WHERE coalesce(a, b, c) IS NOT NULL""")
def find_match_signature(spark, sf_dir):
    found = search.ranked_tiers(table(spark, sf_dir, "part"), ["p_partkey"], [("name", "p_name"), ("sig", "p_type"), ("path", "p_brand")], ["small"])
    return found.select("p_partkey", F.round("score", 6).alias("score"), "match_kind")


@register("""SELECT name, round(s, 6) AS similarity FROM (SELECT DISTINCT p_name AS name, CASE WHEN contains(lower(p_name), 'smal rings') THEN 1.0
 ELSE 1.0 - levenshtein(lower(p_name), 'smal rings') / greatest(strlen(p_name), 10)::DOUBLE END AS s FROM part) WHERE s >= 0.5 AND s < 0.85 ORDER BY s DESC, name LIMIT 5""")
def did_you_mean(spark, sf_dir):
    return search.did_you_mean(table(spark, sf_dir, "part"), "p_name", "smal rings", 0.85).select("name", F.round("similarity", 6).alias("similarity"))


_LINES = "(SELECT doc_id, generate_subscripts(l, 1)::INT AS line, unnest(l) AS text FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents))"
_GREP = "(?i)\\bthe\\b.*\\btion"


@register(f"SELECT doc_id, line, text FROM {_LINES} WHERE regexp_matches(text, '{_GREP}')")
def grep_lines(spark, sf_dir):
    return lines.grep(lines.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text"), _GREP, ascii_words=True)


@register(f"SELECT doc_id, count(*) AS n_lines FROM {_LINES} WHERE contains(text, 'eau') GROUP BY doc_id ORDER BY n_lines DESC, doc_id")
def grep_by_file(spark, sf_dir):
    hits = lines.grep(lines.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text"), "eau", fixed=True)
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_lines")).orderBy(F.desc("n_lines"), "doc_id")


@register(f"SELECT h.doc_id, h.line, c.line AS at, c.text FROM {_LINES} h JOIN {_LINES} c ON h.doc_id = c.doc_id AND c.line BETWEEN h.line - 1 AND h.line + 2 WHERE contains(h.text, 'nicht')")
def grep_context(spark, sf_dir):
    return lines.with_context(table(spark, sf_dir, "documents"), "doc_id", "text", lambda x: F.contains(x, F.lit("nicht")), 1, 2)


@register(f"SELECT doc_id, line FROM {_LINES} WHERE regexp_matches(text, 'token') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def grep_excluding(spark, sf_dir):
    hits = lines.grep(lines.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text"), "token", ascii_words=True).select("doc_id", "line")
    return rollup.minus(hits, table(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"])


@register("""SELECT doc_id, 2 AS first_line, least(5, len(l))::INT AS last_line, array_to_string(l[2:5], chr(10)) AS text
 FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents) WHERE len(l) >= 2""")
def slice_lines(spark, sf_dir):
    return lines.slice_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 2, 5)


_PERIODS = """(SELECT 'y' || y AS name, y * 372 AS s, y * 372 + 371 AS e FROM range(1992, 1999) t(y) UNION ALL
 SELECT 'q' || y || '-' || q, y * 372 + q * 93, y * 372 + q * 93 + 92 FROM range(1992, 1999) t(y), range(0, 4) u(q) UNION ALL
 SELECT 'm' || y || '-' || m, y * 372 + m * 31, y * 372 + m * 31 + 30 FROM range(1992, 1999) t(y), range(0, 12, 5) u(m))"""


def _periods(spark: SparkSession) -> DataFrame:
    years = spark.range(1992, 1999).select(F.col("id").alias("y"))
    parts = [years.select(F.concat(F.lit("y"), "y").alias("name"), (F.col("y") * 372).alias("s"), (F.col("y") * 372 + 371).alias("e"))]
    for letter, size, every in (("q", 93, range(4)), ("m", 31, range(0, 12, 5))):
        for k in every:
            parts.append(years.select(F.concat(F.lit(letter), "y", F.lit(f"-{k}")).alias("name"), (F.col("y") * 372 + k * size).alias("s"), (F.col("y") * 372 + k * size + size - 1).alias("e")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("year", F.expr("s div 372"))


_DAY = "(year({d}) * 372 + (month({d}) - 1) * 31 + day({d}) - 1)"


def _order_days(spark, sf_dir):
    day = F.expr(_DAY.format(d="o_orderdate")).cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), F.year("o_orderdate").cast("bigint").alias("year"))


@register(f"""SELECT o_orderkey, arg_max(name, (s, -(e - s))) AS period FROM (SELECT o_orderkey, {_DAY.format(d="o_orderdate")} AS d FROM orders) JOIN {_PERIODS} ON d BETWEEN s AND e GROUP BY o_orderkey""")
def innermost_interval(spark, sf_dir):
    found = intervals.innermost(_order_days(spark, sf_dir), _periods(spark), ["year"], ["o_orderkey"], "day", "s", "e", ["e"])
    return found.where(F.col("span_name").isNotNull()).select("o_orderkey", F.col("span_name").alias("period"))


@register(f"""WITH j AS (SELECT o_orderkey, name, e - s AS w FROM (SELECT o_orderkey, {_DAY.format(d="o_orderdate")} AS d FROM orders) JOIN {_PERIODS} ON d BETWEEN s AND e)
 SELECT o_orderkey, min(name) AS period FROM j a WHERE w = (SELECT min(w) FROM j b WHERE a.o_orderkey = b.o_orderkey) GROUP BY o_orderkey HAVING count(*) = 1""")
def narrowest_unique(spark, sf_dir):
    found = intervals.narrowest_unique(_order_days(spark, sf_dir), _periods(spark), ["year"], ["o_orderkey"], "day", "s", "e")
    return found.select("o_orderkey", F.col("span_name").alias("period"))


@register("""SELECT o_orderkey FROM orders WHERE (year(o_orderdate) * 372 + (month(o_orderdate) - 1) * 31 + day(o_orderdate) - 1) + 3 >= 1995 * 372 + 60
 AND (year(o_orderdate) * 372 + (month(o_orderdate) - 1) * 31 + day(o_orderdate) - 1) <= 1995 * 372 + 90""")
def changed_overlap(spark, sf_dir):
    spans = _order_days(spark, sf_dir).withColumn("until", F.col("day") + 3)
    ranges = spark.createDataFrame([(1995 * 372 + 60, 1995 * 372 + 70), (1995 * 372 + 68, 1995 * 372 + 90)], "range_start long, range_end long")
    return intervals.overlapping(spans, ranges, "day", "until", "range_start", "range_end").select("o_orderkey")


@register("SELECT page_id, s AS suffix FROM pages, (VALUES ('.html'), ('/'), ('#top')) t(s) WHERE ends_with(url, s)")
def path_suffix_join(spark, sf_dir):
    suffixes = spark.createDataFrame([(".html",), ("/",), ("#top",)], "suffix string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.join(F.broadcast(suffixes), F.endswith("url", F.col("suffix"))).select("page_id", "suffix")  # three rows


@register("""SELECT l_orderkey, l_partkey, 'callers' AS section FROM lineitem WHERE l_returnflag = 'R' UNION ALL
 SELECT l_orderkey, l_partkey, 'refs' FROM lineitem a WHERE l_shipdate < TIMESTAMP '1995-06-01' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey)""")
def usages_minus_callers(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate")
    keys = ["l_orderkey", "l_partkey"]
    return rollup.usages(items.where("l_returnflag = 'R'").select(*keys), items.where("l_shipdate < timestamp'1995-06-01'").select(*keys), keys)


@register("""SELECT p_partkey, n_live::BIGINT AS n_live, n_test::BIGINT AS n_test FROM (SELECT p_partkey, coalesce(count_if(l_returnflag <> 'R'), 0) AS n_live, coalesce(count_if(l_returnflag = 'R'), 0) AS n_test
 FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01') ON p_partkey = l_partkey GROUP BY p_partkey) WHERE n_live = 0""")
def dead_parts(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp'1995-03-01'").select("l_partkey", "l_returnflag")
    return rollup.unreferenced(table(spark, sf_dir, "part").select("p_partkey"), refs, "p_partkey", "l_partkey", F.col("l_returnflag") == "R")


@register("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size < 10 THEN 'framework' WHEN p_type LIKE '%BRASS%' OR p_type LIKE '%brass%' THEN 're_exported' WHEN p_retailprice > 1500 THEN 'cfg_test'
 WHEN p_brand LIKE '%3%' THEN 'runtime_entry' END AS reason FROM part) WHERE reason IS NOT NULL GROUP BY reason""")
def skip_reason_cascade(spark, sf_dir):
    cases = [
        ("framework", F.col("p_size") < 10),
        ("re_exported", F.col("p_type").like("%BRASS%") | F.col("p_type").like("%brass%")),
        ("cfg_test", F.col("p_retailprice") > 1500),
        ("runtime_entry", F.col("p_brand").like("%3%")),
    ]
    return table(spark, sf_dir, "part").select(rollup.first_reason(cases).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@register("""SELECT event_id, (SELECT arg_max(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND (b.ts, b.event_id) < (a.ts, a.event_id)) AS producer
 FROM events a WHERE event_type = 'purchase'""")
def asof_producer(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase')")
    found = asof.latest_before(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "producer")
    return found.where("event_type = 'purchase'").select("event_id", "producer")


@register("""SELECT user_id, event_id AS producer, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts, b.event_id) > (a.ts, a.event_id)) AS n_later
 FROM events a WHERE event_type = 'signup'""")
def later_consumers(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase')")
    return asof.later_consumers(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase", "event_id")


@register("""SELECT event_id, event_type, 'function' AS kind FROM events UNION ALL
 SELECT event_id, t, 'function_via_alias' FROM events JOIN (VALUES ('click', 'press'), ('view', 'show'), ('view', 'display')) a(s, t) ON event_type = s""")
def alias_expand(spark, sf_dir):
    aliases = spark.createDataFrame([("click", "press"), ("view", "show"), ("view", "display")], "alias string, target string")
    sites = table(spark, sf_dir, "events").select("event_id", "event_type", F.lit("function").alias("kind"))
    return rollup.alias_expand(sites, aliases, "event_type", "kind")


def _accounts(spark, sf_dir):
    sites = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    return sites, table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")


_RULES = {"near": "abs(c_acctbal - s_acctbal) < 100", "same_sign": "s_acctbal < 0 AND c_acctbal < 0", "rich": "s_acctbal > 8000"}


@register(f"""WITH j AS (SELECT c_custkey, s_suppkey, {", ".join(f"coalesce({c}, false) AS {k}" for k, c in _RULES.items())} FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey),
 g AS (SELECT c_custkey, {", ".join(f"CASE WHEN count_if({k}) = 1 THEN max(CASE WHEN {k} THEN s_suppkey END) END AS {k}" for k in _RULES)} FROM j GROUP BY c_custkey)
 SELECT c_custkey, coalesce(near, same_sign, rich) AS target, CASE WHEN near IS NOT NULL THEN 'near' WHEN same_sign IS NOT NULL THEN 'same_sign' WHEN rich IS NOT NULL THEN 'rich' ELSE 'unresolved' END AS rule FROM g""")
def resolve_cascade(spark, sf_dir):
    sites, targets = _accounts(spark, sf_dir)
    negative, rich = (F.col("c_acctbal") < 0, F.col("s_acctbal") < 0), (F.lit(True), F.col("s_acctbal") > 8000)
    rules = [("near", resolve.Near("c_acctbal", "s_acctbal", 100)), ("same_sign", negative), ("rich", rich)]
    return resolve.paired_cascade(sites, ["c_custkey"], targets, "s_suppkey", ["nation"], rules)


_LOOSE = """WITH j AS (SELECT c_custkey, s_suppkey, coalesce(abs(c_acctbal - s_acctbal) < 500, false) AS strict FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey),
 k AS (SELECT *, max(strict::INT) OVER (PARTITION BY c_custkey) AS any_strict FROM j), r AS (SELECT c_custkey, s_suppkey, CASE WHEN any_strict = 1 THEN 'strict' ELSE 'fell_back' END AS mode FROM k WHERE strict OR any_strict = 0)"""

_STRICT = resolve.Near("c_acctbal", "s_acctbal", 500)


@register(_LOOSE + " SELECT * FROM r")
def strict_vs_loose(spark, sf_dir):
    sites, targets = _accounts(spark, sf_dir)
    return resolve.near_or_all(sites, ["c_custkey"], targets, ["nation"], _STRICT).select("c_custkey", "s_suppkey", "mode")


@register(_LOOSE + " SELECT mode, count(*) AS n, (count(*) * 100 // (SELECT count(*) FROM (SELECT DISTINCT c_custkey, mode FROM r)))::BIGINT AS percent FROM (SELECT DISTINCT c_custkey, mode FROM r) GROUP BY mode")
def resolution_stats(spark, sf_dir):
    sites, targets = _accounts(spark, sf_dir)  # a site has one mode, whatever its pairs
    return resolve.mode_shares(resolve.near_modes(sites, ["c_custkey"], targets, ["nation"], _STRICT).select("c_custkey", "mode").distinct(), "mode")


@register("""SELECT src, dst, min(ts) AS ts FROM (SELECT event_type AS src, lead(event_type) OVER w AS dst, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dst IS NOT NULL GROUP BY src, dst""")
def first_edge_per_pair(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sites = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), "ts").where("dst IS NOT NULL")
    return resolve.first_edge(sites, "src", "dst", ["ts"])


@register("""SELECT source, count_if(lang = 'en') AS n_en, count_if(lang = 'de') AS n_de, count_if(lang = 'fr') AS n_fr, count_if(lang = 'es') AS n_es FROM documents GROUP BY source""")
def kind_pivot(spark, sf_dir):
    return rollup.kind_counts(table(spark, sf_dir, "documents").select("source", "lang"), "source", "lang", ["en", "de", "fr", "es"])


@register(f"SELECT lang, count(DISTINCT doc_id) AS files, count_if(trim(text) <> '') AS code_lines FROM (SELECT lang, l.* FROM {_LINES} l JOIN documents d ON d.doc_id = l.doc_id) GROUP BY lang")
def language_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.size(F.filter(text.lines(F.col("text")), lambda x: F.trim(x) != "")).alias("n"))
    return docs.groupBy("lang").agg(F.count("*").alias("files"), F.sum("n").cast("bigint").alias("code_lines"))


_TABLES = "region nation customer supplier part orders lineitem events".split()


@register(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def project_counts(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("""SELECT prefix, count(*) AS files FROM (SELECT unnest([array_to_string(p[1:k], '/') for k in range(1, len(p))]) AS prefix FROM (SELECT string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS p FROM pages)) GROUP BY prefix""")
def url_tree_rollup(spark, sf_dir):
    parts = F.split(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/")
    d = table(spark, sf_dir, "pages").select(parts.alias("p")).where(F.size("p") > 1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))
    return d.select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("files"))


@register("""SELECT prefix, n FROM (SELECT array_to_string(p[1:list_position(p, 'de')], '/') AS prefix, count(*) AS n FROM (SELECT string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS p FROM pages)
 WHERE list_contains(p, 'de') GROUP BY 1) ORDER BY n DESC, prefix LIMIT 3""")
def prefix_suggestions(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select(F.split(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/").alias("p")).where(F.array_contains("p", "de"))
    prefix = F.array_join(F.slice("p", F.lit(1), F.array_position("p", F.lit("de")).cast("int")), "/")
    return d.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(3)


@register("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k <= 2""")
def topn_per_group(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rollup.top_per_group(items, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 2)


@register("""SELECT k, section FROM (SELECT s_suppkey AS k, 0 AS section FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_acctbal > 5000) ORDER BY section, k LIMIT 120""")
def budget_cap(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return rollup.budget_cap([a, b], ["k"], 120).select("k", "section")


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a customers' nation and another one that supplies it."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li, s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = c.join(o, c["c_custkey"] == o["o_custkey"]).join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


def _node(spark: SparkSession, *keys: int) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "node int")


_PATHS = """, p(node, path, done) AS (SELECT 0, [0], false UNION ALL SELECT dst, list_append(path, dst), dst IN ({targets}) FROM p JOIN edges ON node = src WHERE NOT done AND NOT list_contains(path, dst) AND len(path) < 6)
 SELECT array_to_string(path, '>') AS path, len(path)::INT AS length FROM p WHERE done"""


_PAIRS = """WITH RECURSIVE edges AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst
 FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)"""
_FLAGGED = (0, 2, 4, 5, 8, 11, 13, 16, 19, 21, 24)


def whole_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(nation_pairs(spark, sf_dir), "nation-pairs")


@register(_PAIRS + ", b(node, dist) AS (SELECT 0, 0 UNION SELECT dst, dist + 1 FROM b JOIN edges ON node = src WHERE dist < 25) SELECT node::INT AS node, min(dist)::INT AS dist FROM b GROUP BY node")
def bfs_distance(spark, sf_dir):
    return graph.bfs(whole_graph(spark, sf_dir), _node(spark, 0))


@register(_PAIRS + ", b(node, dist) AS (SELECT 3, 0 UNION SELECT dst, dist + 1 FROM b JOIN edges ON node = src WHERE dist < 2) SELECT node::INT AS node, min(dist)::INT AS dist FROM b WHERE dist > 0 GROUP BY node")
def neighborhood_k2(spark, sf_dir):
    return graph.neighbourhood(whole_graph(spark, sf_dir), _node(spark, 3), 2)


@register(_PAIRS + ", b(node, root) AS (SELECT unnest([1, 7, 20]), unnest([1, 7, 20]) UNION SELECT dst, root FROM b JOIN edges ON node = src) SELECT node::INT AS node, count(DISTINCT root) AS n_tests FROM b GROUP BY node")
def reach_sets(spark, sf_dir):
    return graph.reachable_tests(whole_graph(spark, sf_dir), _node(spark, 1, 7, 20))


@register(_PAIRS + """ SELECT node::INT AS node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, CASE WHEN sum(i) > 0 AND sum(o) > 0 THEN 'transit' WHEN sum(o) > 0 THEN 'entry' ELSE 'endpoint' END AS role
 FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node""")
def degree_roles(spark, sf_dir):
    return rollup.degree_roles(whole_graph(spark, sf_dir), "src", "dst")


@register(_PAIRS + _PATHS.format(targets="3"))
def bounded_paths(spark, sf_dir):
    found, _ = graph.paths(whole_graph(spark, sf_dir), _node(spark, 0), _node(spark, 3), max_nodes=6, limit=None, max_expansions=None)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length")


@register(_PAIRS + _PATHS.format(targets="3, 11, 17"))
def paths_to_module(spark, sf_dir):
    found, _ = graph.paths(whole_graph(spark, sf_dir), _node(spark, 0), _node(spark, 3, 11, 17), max_nodes=6, limit=None, max_expansions=None)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length")


def _fixpoint_sql() -> str:
    """Each step adds a nation at least, so as many steps as there are others are enough."""
    steps = ["f0 AS (SELECT unnest([" + ", ".join(map(str, _FLAGGED)) + "]) AS node)"]
    for k in range(1, 26 - len(_FLAGGED)):
        steps.append(f"f{k} AS MATERIALIZED (SELECT node FROM f{k - 1} UNION SELECT src FROM edges GROUP BY src HAVING bool_and(dst IN (SELECT node FROM f{k - 1})))")
    return f"{_PAIRS}, {', '.join(steps)} SELECT n_nationkey AS node, n_nationkey IN (SELECT node FROM f{25 - len(_FLAGGED)}) AS flagged FROM nation"


@register(_fixpoint_sql())
def fixpoint_sink(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.fixpoint(whole_graph(spark, sf_dir), _node(spark, *_FLAGGED), nodes)


_LITERALS = {"customer": ("c_nationkey", "c_mktsegment"), "orders": ("year(o_orderdate)", "o_orderpriority")}
_DECLARED = " UNION ALL ".join(f"SELECT '{t}' || ({k}) AS owner, 'kind' AS name, {v} AS literal FROM {t}" for t, (k, v) in _LITERALS.items())


@register(f"""WITH d AS (SELECT DISTINCT * FROM ({_DECLARED})), g AS (SELECT owner, name, string_agg(literal, '|' ORDER BY literal) AS vocabulary, count(*) AS n FROM d GROUP BY owner, name)
 SELECT lower(name) AS name, vocabulary, count(*) AS n_declarations FROM g WHERE n BETWEEN 2 AND 16 GROUP BY ALL HAVING count(*) >= 2""")
def shared_vocabulary(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(t), F.expr(k)).alias("owner"), F.lit("kind").alias("name"), F.col(v).alias("literal")) for t, (k, v) in _LITERALS.items()]
    return rollup.shared_vocabulary(parts[0].unionByName(parts[1]), "owner", "name", "literal")


@register("""SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS n_distinct, count(*) AS n_observed, count_if(o_totalprice > 100000) AS n_compared FROM orders GROUP BY o_orderstatus""")
def literal_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_orderpriority").alias("n_distinct"), F.count("*").alias("n_observed"), F.count_if(F.col("o_totalprice") > 100000).alias("n_compared"))


@register("""SELECT page_id, CASE WHEN regexp_matches(p, '^[1-5][0-9][0-9]($|\\s+\\S)') THEN 'status' WHEN regexp_matches(p, '^/(bin|etc|tmp|usr|var)(/|$)') THEN 'filesystem'
 WHEN regexp_matches(p, '^/[^/]') AND strlen(p) <= 256 AND NOT regexp_matches(p, '\\s') THEN 'endpoint' END AS shape,
 url <> '' AND strlen(url) <= 64 AND NOT regexp_matches(url, '\\s') AND regexp_matches(url, '[A-Za-z0-9]') AS is_token FROM (SELECT *, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS p FROM pages)""")
def literal_shape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.literal_shape(F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1)).alias("shape"), text.enum_token(F.col("url")).alias("is_token"))


_COLUMNS = "doc_id url page_id n_chars embedding vec_id item_path client_ip peer_ip_addr ip bind_addr app_version home_uri socket id text".split()


@register(f"""SELECT name, CASE WHEN e = 'path' THEN 'PathBuf' WHEN name = 'ip' OR name LIKE '%ip_addr' THEN 'IpAddr' WHEN name = 'bind_addr' THEN 'SocketAddr' WHEN e = 'url' THEN 'Url' WHEN e = 'uuid' THEN 'Uuid' WHEN e = 'uri' THEN 'Uri'
 WHEN e = 'version' THEN 'Version' ELSE array_to_string([upper(x[1]) || x[2:] for x in string_split(name, '_')], '') END AS suggestion,
 CASE WHEN e IN ('url', 'uuid') THEN 0.82 WHEN name IN ('ip', 'bind_addr') OR name LIKE '%ip_addr' THEN 0.80 WHEN e = 'uri' THEN 0.78 WHEN e IN ('path', 'version') THEN 0.74 ELSE 0.72 END::DOUBLE AS confidence
 FROM (SELECT name, string_split(name, '_')[-1] AS e FROM (SELECT unnest({_COLUMNS}) AS name)) WHERE e IN ('url', 'uuid', 'uri', 'path', 'version') OR name IN ('ip', 'bind_addr') OR name LIKE '%ip_addr' OR name LIKE '%\\_id' ESCAPE '\\'""")
def semantic_columns(spark, sf_dir):
    names = spark.createDataFrame([(c,) for c in _COLUMNS], "name string")
    suggestion, confidence = text.semantic_name(F.col("name"))
    return names.select("name", suggestion.alias("suggestion"), confidence.alias("confidence")).where("suggestion IS NOT NULL")


def _families(column: str) -> str:
    parts = []
    for family, words in text.BOUNDARIES.items():
        hits = " + ".join(f"contains(lower({column}), '{w}')::INT" for w in words)
        parts.append(f"SELECT page_id, '{family}' AS family, ({hits})::BIGINT AS n FROM pages")
    return " UNION ALL ".join(parts)


@register(f"SELECT page_id, family, n AS hits, round(least(0.95, 0.45 + 0.1 * n), 6)::DOUBLE AS confidence FROM ({_families('html')}) WHERE n > 0")
def boundary_keywords(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower("html").alias("low"))
    found = [F.struct(F.lit(f).alias("family"), text.boundary_hits(F.col("low"), f).alias("hits")) for f in text.BOUNDARIES]
    d = pages.select("page_id", F.explode(F.array(*found)).alias("b")).select("page_id", "b.family", "b.hits").where(F.size("hits") > 0)
    return d.select("page_id", "family", F.size("hits").cast("bigint").alias("hits"), F.round(text.boundary_confidence(F.col("hits")), 6).alias("confidence"))


@register("""SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[^\\p{L}\\p{N}_]+')) AS token FROM conversations) WHERE token <> '' GROUP BY token""")
def identifier_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@register("""SELECT page_id, regexp_extract(u, '([^:.]*)$', 1) AS base, CASE WHEN regexp_matches(regexp_extract(u, '([A-Za-z0-9_]+)(?:::|\\.)[^:.]*$', 1), '^[A-Z]') THEN regexp_extract(u, '([A-Za-z0-9_]+)(?:::|\\.)[^:.]*$', 1) END AS qualifier
 FROM (SELECT page_id, replace(replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '::'), 'example', 'Example') AS u FROM pages)""")
def qualifier_split(spark, sf_dir):
    callee = F.replace(F.replace(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit("."), F.lit("::")), F.lit("example"), F.lit("Example"))
    d = table(spark, sf_dir, "pages").select("page_id", callee.alias("u"))
    return d.select("page_id", text.callee_base(F.col("u")).alias("base"), text.type_qualifier(F.col("u")).alias("qualifier"))


@register("""SELECT l_partkey, count_if(ran) AS n_executed, count(*) AS n_regions, CASE WHEN count_if(ran) > 0 THEN 'observed' ELSE 'not_observed' END AS state
 FROM (SELECT l_partkey, l_suppkey, bool_or(l_returnflag = 'R') AS ran FROM lineitem GROUP BY l_partkey, l_suppkey) GROUP BY l_partkey""")
def region_coverage(spark, sf_dir):
    return rollup.region_states(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), "l_partkey", ["l_suppkey"], F.col("l_returnflag") == "R")


def _fixture(spark: SparkSession) -> CodeIndex:
    return CodeIndex.from_strings(spark, fixture.FILES)


def _code(name: str, query: Callable[[CodeIndex], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(_fixture(spark))

    run.__name__ = f"code_{name}"
    register()(run)


_code("inventory", commands.inventory)
_code("tree", commands.tree)
_code("find", lambda c: commands.find(c, "save"))
_code("definition", lambda c: commands.definition(c, "Event"))
_code("callers", lambda c: commands.callers(c, "save", depth=2))
_code("refs", lambda c: commands.refs(c, "Event"))
_code("usages", lambda c: commands.usages(c, "parse"))
_code("members", lambda c: commands.members(c, "Event"))
_code("impls", lambda c: commands.impls(c, "Store"))
_code("grep", lambda c: commands.grep(c, "event"))
_code("call_graph", lambda c: commands.call_graph(c, "pipe", include_callers=True))
_code("call_graph_dot", lambda c: commands.dot(commands.call_graph(c, "pipe")))
_code("paths", lambda c: commands.paths_between(c, "app", "open")[0])
_code("dead", commands.dead_code)
_code("lifecycle", lambda c: commands.lifecycle(c, "Event"))
_code("value_flow", commands.value_flow)
_code("boundaries", commands.boundaries)
_code("stringly", lambda c: commands.stringly(c, least=0.7))
_code("coverage", commands.test_coverage)
_code("blind_spots", commands.blind_spots)
_code("coverage_dot", lambda c: reports.coverage_dot(commands.test_coverage(c), commands.resolved_edges(c)))
_code("slice", lambda c: reports.source_slice(c, "src/lib.rs", 3, 9))
_code("summary", reports.project_summary)
_code("find_short", lambda c: views.find_with_fallbacks(c, "pa").withColumn("score", F.col("score").cast("double")))
_code("find_relaxed", lambda c: views.find_with_fallbacks(c, "pasre"))
_code("refs_by_function", lambda c: views.refs_by_function(commands.refs(c, "Event")))
_code("member_sites", lambda c: views.member_sites(c, "Event"))
_code("caller_sites", lambda c: views.caller_sites(c, "parse"))
_code("symbols", lambda c: views.search_symbols(c, "e", public_only=True))
_code("stringly_counts", lambda c: views.stringly_counts(commands.stringly(c, least=0.7)))
_code("modules", lambda c: c.files.select("file_path", views.display_module(F.col("file_path")).alias("module")))
_code("unresolved", views.unresolved_names)
_code("external", views.external_calls)
