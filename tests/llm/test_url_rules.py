import random
import re

from sparkwarden.llm import url_rules as U

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("com", "/fr/a", "block"), ("com", "/fr/ab", "allow"), ("a.com", "", "allow"), ("A.com", "/x", "block"), ("a.com", "/x", "allow"), ("", "/", "block"),
         ("b.a.com", "/é", "block"), ("b.a.com", "/", "allow"), (None, "/", "block"), ("c", None, "block"), ("c", "/", None), ("..", "/", "block")]


def plain(url, rules=RULES):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(r[0]), len(r[1]), r[2], r[0] + r[1]) for r in rules if None not in r
           and (host == (h := r[0].lower()) or host.endswith("." + h)) and path.startswith(r[1])]
    best = max(fit, key=lambda x: x[:3]) if fit else None
    return host, path, best and best[3].lower() if best and best[3].startswith("A.") else best and best[3], best[2] if best else "allow"


def urls():
    r = random.Random(3)
    hosts = ["example.org", "www.Example.ORG", "x.com", "a.com", "b.a.com", "c.b.a.com", "myexample.org", "org", "com", "", "c", "a.com.", "..", "a..", "x" * 3000 + ".com",
             ".".join("abcdefgh") * 400 + ".org", "a.com:80", "u@a.com"]
    paths = ["", "/", "/es/1", "/en/15", "/en/2", "/fr/", "/fr/a", "/fr/abc", "/fr/b", "/de/x", "/x", "/xy", "/é", "/éa", "/" + "y" * 9000, "/a b\n"]
    out = [f"{s}://{h}{p}{t}" for h in hosts for p in paths for s, t in [(r.choice(["http", "https", "x"]), r.choice(["", "?q=/es/", "#/fr/", "?a://b.org/"]))]]
    return [*out, None, "", "no scheme", "://", "a://b://example.org/es/", out[0], out[0]] + ["http://x.com/fr/hot"] * 500


def test_rows_equal_brute_force(spark):
    rows = [(i if i % 5 else None, u) for i, u in enumerate(urls())]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string").selectExpr("*", "1 as labels")
    got = U.judge(spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "2 as host", "3 as stack", "4 as row"), rules)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((i, *plain(u)) for i, u in rows), key=str)


def test_empty(spark):
    rules = spark.createDataFrame(RULES[:5], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id bigint, url string")
    assert U.judge(pages.where("false"), rules).count() == 0
    assert [tuple(r) for r in U.judge(pages, rules.where("false"), "block").collect()] == [(1, "a.org", "/x", None, "block")]
