"""Verdicts against a plain matcher."""

import random
import re

from lodestar.llm import url_filter as U
from lodestar.llm.queries import LISTED_URLS, URL_RULES, op4_url_filter, oracle_sql

FIXED = [None, "", "no scheme", "http://NET", "http://a.net/", "https://x.Example.NET/en/1?q#f", "https://example.net/en", "ftp://example.com/de/x", "http://a.example.com/de", "http://fr.org/fr/?x", "://org/fr/", "http://casino-win.example.com/", "http://m.casino-win.example.org/fr/9", "http:///net/", "a://b://net/", "http://net?/", "http://xnet/", "http://.net/", "http://net./", "http://a..net//x/"]
FIXED += ["http://casino-win.example.com:80/x", "http://user:pw@casino-win.example.com", "http://CASINO-WIN.example.com.", "http://c%61sino-win.example.com/", "http://warez.example.org/files/~all/1", "http://warez.example.org/files/%7eall/", "http://warez.example.org/x/%2E%2e/files/%7Eall/y", "http://warez.example.org/files/~allx", "http://mirror.example.com/pirated", "http://m.mirror.example.com:8080/./pirated/..", "http://mirror.example.com/q/../pirated/", "http://mirror.example.com/%2Fpirated/", "http://a@b@free-bets.example.org/"]
LONG = ["http://casino-win.example.com/" + "a/" * 30_000, "http://" + "a." * 30_000 + "org/fr/" + "b/" * 3000, "http://mirror.example.com/" + "a/../" * 12_000 + "pirated/"]


def plain_canonical(host, path):
    decode = lambda s: re.sub(r"%([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), s)
    host = re.sub(r":\d*$", "", decode(host.split("@")[-1]))
    while host.endswith("."):
        host = host[:-1]
    path = re.sub(r"%([0-9a-fA-F]{2})", lambda m: c if re.match(r"[A-Za-z0-9._~-]", c := chr(int(m[1], 16))) else m[0].upper(), path)
    while path != (shorter := re.sub(r"/\.(?=/|$)", "/", path).replace("//", "/") if "/./" in path or path.endswith("/.") else path):
        path = shorter
    while m := re.search(r"/(?!\.\.(?:/|$))[^/]*/\.\.(/|$)|^/\.\.(/|$)", path):
        path = path[: m.start()] + "/" + path[m.end() :]
    return host.lower(), path or "/"


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = m[1].translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}), m[2]
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    rules = sorted(((len(h + p), h + p, a) for a, h, p in URL_RULES if fits(h, p)), reverse=True)
    c_host, c_path = plain_canonical(host, path)
    entries = [plain_canonical(*re.match(r"\w+://([^/]*)(.*)", u.lower()).groups()) for u in LISTED_URLS]
    listed = sorted(((len(h + p), h + p) for h, p in entries if (c_host == h or c_host.endswith("." + h)) and c_path.startswith(p)), reverse=True)
    verdict = rules[0][2] if rules else "block" if listed else "allow"
    return host, path, rules[0][1] if rules else None, listed[0][1] if listed else None, verdict


def test_verdicts_equal_a_plain_matcher(spark, tmp_path):
    rng = random.Random(8)
    hosts = ["net", "example", "com", "org", "casino-win", "www", "de", ""]
    urls = FIXED + ["http://" + ".".join(rng.choice(hosts) for _ in range(rng.randint(1, 4))) + "".join("/" + rng.choice(["en", "de", "fr", "", "x"]) for _ in range(rng.randint(0, 3))) + rng.choice(["", "?a=/en/", "#/de/"]) for _ in range(600)]
    urls += ["http://" + rng.choice(["", "u@", "a:b@"]) + rng.choice(["casino-win", "warez", "m.mirror", "x"]) + ".example." + rng.choice(["com", "org"]) + rng.choice(["", ".", ":80", ".:443"]) + "".join("/" + rng.choice(["files", "~all", "%7Eall", "..", ".", "pirated", "%70irated", "x"]) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/", "?q"]) for _ in range(400)]
    rows = [(k, u, "x") for k, u in enumerate(urls)] * 2
    spark.createDataFrame(rows, "page_id long, url string, host string").write.parquet(str(tmp_path / "pages.parquet"))
    got = op4_url_filter(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.listed, r.verdict) == plain(urls[r.page_id]), urls[r.page_id]


def test_verdicts_equal_their_sql(spark, tmp_path):
    import duckdb

    rows = [(k, u) for k, u in enumerate(FIXED)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "listed", "verdict"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()['op4_url_filter']}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in op4_url_filter(spark, str(tmp_path)).select(*columns).orderBy("page_id").collect()] == want


def test_long_urls(spark, tmp_path):
    spark.createDataFrame(list(enumerate(LONG)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.listed, r.verdict) for r in op4_url_filter(spark, str(tmp_path)).collect()}
    assert got == {0: (None, "casino-win.example.com/", "block"), 1: ("org/fr/", None, "allow"), 2: (None, "mirror.example.com/pirated/", "block")}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    entries = spark.createDataFrame([], "host string, path string, action string, is_rule boolean")
    assert [r.verdict for r in U.verdicts(pages, entries).collect()] == ["allow"]
    assert U.verdicts(pages.limit(0), entries).collect() == []
