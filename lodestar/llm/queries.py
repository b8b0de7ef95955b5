"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, decontam, langid, ngram_join, ngram_lm, pseudonyms, quality_gam, quality_rules, secrets, url_filter
from lodestar.llm.sampling import held_out


#: A real run brings a secret key of its own.
PSEUDONYM_KEY = "example key: replace in production"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_WORDS = r"[x for x in string_split_regex({}, '[\x20\x09-\x0D]+') if x <> '']"


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def _op1_sql() -> str:
    classes = [f"len(regexp_extract_all(t, '[{c.replace(chr(39), chr(39) * 2)}]'))" for c in quality_rules.CLASSES.values()]
    words = ", ".join(f"'{w}'" for w in quality_rules.COMMON)
    part = "CASE WHEN {a} > 0 THEN {a} * log2(2.0 * {a} / ({a} + {b})) ELSE 0.0 END"
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, {_WORDS.format("t")} AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM d),
 b AS (SELECT doc_id, lang, w, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(t) AS n_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, [{", ".join(classes)}] AS c FROM w),
 g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM b))),
 r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE k > 1) GROUP BY doc_id),
 h AS (SELECT doc_id, lang, n_words, 'c' AS kind, unnest(list_concat(c, [n_chars - word_chars, word_chars - list_sum(c)])) AS n, unnest(range({len(classes) + 2}))::VARCHAR AS cell FROM b
  UNION ALL SELECT b.doc_id, b.lang, b.n_words, 'w', coalesce(f.n, 0), v.v FROM b CROSS JOIN (SELECT unnest([{words}]) AS v) v LEFT JOIN (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM b) GROUP BY ALL) f ON f.doc_id = b.doc_id AND f.x = v.v
  UNION ALL SELECT doc_id, lang, n_words, 'w', len([x for x in w if NOT list_contains([{words}], x)]), ' other' FROM b),
 p AS (SELECT doc_id, kind, cell, n / nullif(sum(n) OVER (PARTITION BY doc_id, kind), 0) AS p FROM h),
 q AS (SELECT lang, kind, cell, sum(n) / sum(sum(n)) OVER (PARTITION BY lang, kind) AS q FROM h WHERE lang IN (SELECT lang FROM b GROUP BY lang HAVING sum(n_words) >= {quality_rules.LEAST_REFERENCE_WORDS}) GROUP BY lang, kind, cell),
 j AS (SELECT doc_id, lang, kind, CASE WHEN count(p) > 0 THEN sqrt(greatest(0.0, 0.5 * sum({part.format(a="p", b="q")} + {part.format(a="q", b="p")}))) END AS x FROM p JOIN q USING (kind, cell) GROUP BY ALL),
 n AS (SELECT doc_id, lang, max(CASE WHEN kind = 'w' THEN x END) AS wd, max(CASE WHEN kind = 'c' THEN x END) AS cd FROM j GROUP BY doc_id, lang),
 m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY wd NULLS FIRST, cd NULLS FIRST, lang) = 1),
 o AS (SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, m.lang, cd, wd FROM b LEFT JOIN r USING (doc_id) LEFT JOIN m ON m.doc_id = b.doc_id)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEATED_PERCENT} * n_words) AND NOT coalesce(n_words >= {quality_rules.GUARD_CHAR_WORDS} AND cd > {quality_rules.MOST_CHAR}, false)
  AND NOT coalesce(n_words >= {quality_rules.GUARD_WORD_WORDS} AND wd > {quality_rules.MOST_WORD}, false) AS kept, lang AS nearest_language, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM o"""


def op2_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(table(spark, sf_dir, "documents"))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 e AS (SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
 r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = d.doc_id"""


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Rules (action, host, path), and listed URLs, which a real run reads from tables.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LISTED_URLS = (
    *(f"http://{name}.example.{top}/" for name in ("casino-win", "cheap-pills", "free-bets") for top in ("com", "net", "org")),
    "https://Warez.example.org:443/files/%7Eall/",
    "http://user@mirror.example.com./a/../pirated/./",
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(h, p, a, True) for a, h, p in URL_RULES], "host string, path string, action string, is_rule boolean")
    listed = url_filter.listed_urls(spark.createDataFrame([(u,) for u in LISTED_URLS], "url string"))
    return url_filter.verdicts(table(spark, sf_dir, "pages"), rules.unionByName(listed))


def listed_entries() -> list[tuple[str, str]]:
    """Canonical host and path of each of ``LISTED_URLS``."""
    parts = [u.split("://", 1)[1].partition("/") for u in LISTED_URLS]
    return [(url_filter.canonical_host(h), url_filter.canonical_path(f"/{p}")) for h, _, p in parts]


_FITS = "({x}host = {h} OR ends_with({x}host, '.' || {h})) AND starts_with({x}path, {p})"


def _op4_sql() -> str:
    letters = ", ".join(f"'{c}'" for c in url_filter.UNRESERVED)
    plain = "rtrim(regexp_replace(url_decode(regexp_replace(host, '^.*@', '')), ':[0-9]*$', ''), '.')"
    step = "CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END"
    return f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 e AS (SELECT *, lower({plain}) AS c_host,
  list_reduce(list_prepend(path, [{letters}]), lambda a, c: regexp_replace(a, '%' || hex(c), c, 'gi')) AS open FROM p),
 g AS (SELECT *, string_split(open, '/')[2:] AS s FROM e),
 c AS (SELECT *, CASE WHEN len(s) = 0 THEN '/' ELSE coalesce(nullif(list_reduce(list_prepend('', s), lambda a, x: {step}) || CASE WHEN s[-1] IN ('.', '..') THEN '/' ELSE '' END, ''), '/') END AS c_path FROM g),
 r(a, h, f) AS (VALUES {", ".join(map(str, URL_RULES))}),
 l(h, f) AS (VALUES {", ".join(map(str, listed_entries()))}),
 d AS (SELECT page_id, host, path,
  (SELECT arg_max(h || f, length(h || f)) FROM r WHERE {_FITS.format(h="h", p="f", x="")}) AS rule,
  (SELECT arg_max(a, length(h || f)) FROM r WHERE {_FITS.format(h="h", p="f", x="")}) AS act,
  (SELECT arg_max(h || f, length(h || f)) FROM l WHERE {_FITS.format(h="h", p="f", x="c_")}) AS listed FROM c)
 SELECT page_id, host, path, rule, listed, coalesce(act, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM d"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]

    def text(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def of(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *(of(k) for k in base), F.sha2(text(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))


def _op5_sql() -> str:
    fold = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    word = "|".join(fold(w) for w in ("password", "passwd", "secret", "token", "api")).replace("[Aa][Pp][Ii]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
    head = f"(?:{word})[\"'']?\\x20*[:=]\\x20*[\"'']?"
    kinds = [("assign", head + "[A-Za-z0-9+/_.=-]+")] + [(r.kind, r.pattern.replace("([A-Z]+ )*", "(?:[A-Z]+ )*")) for r in secrets.RULES[1:]]
    parts = []
    for k, (kind, pattern) in enumerate(kinds):
        size = f"length(regexp_extract(m, '^{head}(.*)$', 1))" if kind == "assign" else "length(m)"
        rows = f"SELECT doc_id, unnest(range(len(m))) AS i, unnest(s[1 : len(m)]) AS s, unnest(m) AS m FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS s, regexp_extract_all(t, '{pattern}') AS m FROM d)"
        ends = f"SELECT doc_id, m, sum(length(s) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM ({rows})"
        parts.append(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, e - length(m) AS b, e FROM ({ends}) WHERE {size} >= {secrets.RULES[k].least}")
    text = "coalesce(string_agg({c}kind || ':' || b || ':' || e, ',' ORDER BY b, k){f}, '')"
    counts = ", ".join(f"coalesce(count_if(kind = '{r.kind}'), 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ({" UNION ALL ".join(parts)})
 SELECT d.doc_id, {counts}, sha256({text.format(c="", f=f" FILTER (WHERE k < {len(secrets.BASE)})")}) AS base_sha256, {text.format(c="", f="")} AS spans FROM d LEFT JOIN x ON x.doc_id = d.doc_id GROUP BY d.doc_id"""


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_gam.train(docs, labels.where(~held_out("doc_id")))
    found = quality_gam.score(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False, keep_decoded=False, digests=True)


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op9_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_lm.backoff_scores(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


OP9_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
 t AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
 c1 AS (SELECT a, count(*) AS n FROM t GROUP BY a), c2 AS (SELECT b, a, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, a), c3 AS (SELECT c, b, a, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY c, b, a),
 s AS (SELECT t.doc_id, CASE WHEN c3.n >= {ngram_lm.MIN_COUNT} THEN ln(c3.n / h2.n) WHEN c2.n >= {ngram_lm.MIN_COUNT} THEN ln(c2.n / h1.n) + ln({ngram_lm.BACKOFF}) * (least(i - 1, 2) - 1)
  ELSE ln(c1.n / (SELECT sum(n) FROM c1)) + ln({ngram_lm.BACKOFF}) * least(i - 1, 2) END AS x FROM t JOIN c1 ON c1.a = t.a LEFT JOIN c2 ON c2.b = t.b AND c2.a = t.a LEFT JOIN c3 ON c3.c = t.c AND c3.b = t.b AND c3.a = t.a
  LEFT JOIN c1 h1 ON h1.a = t.b LEFT JOIN c2 h2 ON h2.b = t.c AND h2.a = t.b)
 SELECT w.doc_id, len(w)::BIGINT AS n_words, round(coalesce(sum(x), 0), 6) AS log_score, round(sum(x) / nullif(len(w), 0), 6) AS mean_log_score FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id, w.w"""


def op10_langid_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out("doc_id")))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_divergence, op2_partenum_join, op3_template_decontamination, op4_url_filter, op5_secret_scan, op6_quality_gam, op7_bpe_tree, op8_feistel_pseudonyms, op9_backoff_scores, op10_langid_embeddings)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_divergence": _op1_sql(), "op2_partenum_join": OP2_SQL, "op4_url_filter": _op4_sql(), "op5_secret_scan": _op5_sql(), "op9_backoff_scores": OP9_SQL}
