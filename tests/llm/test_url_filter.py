import duckdb
import pytest

from llm_helpers import rows
from snaptable.llm import url_filter as u


def judge(spark, urls, **how):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    return {r.page_id: r for r in u.url_filter(pages, **how).collect()}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.COM/en/71?x#y", "a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("http://other.com/en/71", "other.com", "/en/71", "com/en/", "block"),
        ("http://com/en/", "com", "/en/", "com/en/", "block"),
        ("http://xcom/en/1", "xcom", "/en/1", None, "allow"),
        ("ftp://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        ("https://x.example.net/de/8x", "x.example.net", "/de/8x", "example.net/de/8", "block"),
        ("https://x.org/ES/1", "x.org", "/ES/1", None, "allow"),
        ("https://x.org?/es/1", "x.org", "", None, "allow"),
        ("https://x.org#a/b", "x.org", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("/es/1", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_hosts_paths_and_rules(spark, url, host, path, rule, verdict):
    r = judge(spark, [url])[0]
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_labels_of_one_branch_say_little_about_another(spark):
    bad = [f"http://bad.com/en/{i}" for i in range(20)] + ["http://bad.com/fr/1"]
    good = [f"http://good.net/de/{i}0" for i in range(20)] + ["http://good.net/fr/1"]
    found = judge(spark, bad + good)
    assert found[20].rule is None and found[20].verdict == "allow" and found[20].purity < 0.7
    assert found[0].purity > 0.95 and found[41].verdict == "allow"


def test_a_branch_without_labels_follows_many_siblings_that_agree(spark):
    """Four labelled sections of a host are blocked, a fifth has no label; elsewhere the sections differ."""
    rules = [("block", f"h.io/{c}/") for c in "abcd"] + [("block", f"i.io/{c}/") for c in "ab"] + [("allow", f"i.io/{c}/") for c in "cd"]
    urls = [f"http://{h}.io/{c}/p{i}" for h in "hi" for c in "abcde" for i in range(5)]
    found = judge(spark, urls, rules=tuple(rules))
    verdicts = {(r.host, r.path[1]): r.verdict for r in found.values()}
    assert verdicts["h.io", "e"] == "block" and verdicts["i.io", "e"] == "allow"


def test_siblings_alike_merge_and_others_do_not(spark):
    """A page with one label takes its purity from siblings like it, not from those unlike it."""
    rules = (("block", "h.io/x/bad"), ("allow", "h.io/x/good"))
    urls = [f"http://h.io/x/bad-{k}" for k in "abc" for _ in range(40)] + [f"http://h.io/x/good-{k}" for k in "abc" for _ in range(40)] + ["http://h.io/x/bad-z", "http://h.io/x/good-z"]
    found = judge(spark, urls, rules=rules)
    by = {r.template: r.purity for r in found.values()}
    assert by["/x/bad-z"] == by["/x/bad-a"] > 0.98 and by["/x/good-z"] == by["/x/good-a"] < 0.02


def test_wildcards_at_any_depth(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    urls = [f"http://h.io/1/b/c/d/e/f/{x}{y}q/g/{y}{x}.html" for x in letters[:6] for y in letters[:6]]
    found = judge(spark, [*urls, "http://h.io/" + "/".join(letters * 20)])
    assert {found[i].template for i in range(36)} == {"/{n}/b/c/d/e/f/*/g/*"} and found[36].template.endswith("/y/z")


def test_many_different_children_are_one_wildcard(spark):
    urls = [f"http://h.io/user/{chr(97 + i % 26)}{chr(97 + i // 26)}x/home" for i in range(60)] + ["http://h.io/about/team/", "http://h.io/7/8/9/10", "http://h.io/user/aax"]
    found = judge(spark, urls)
    assert found[0].template == "/user/*/home" and found[60].template == "/about/team" and found[61].template == "/{n}/{n}/{n}/{n}" and found[62].template == "/user/aax"


def test_the_sql_agrees(spark, odd, none):
    urls = [f"http{'s' * (i % 2)}://{h}.example.{t}/{p}/{i % 97}{'/' * (i % 3)}" for i in range(900) for h, t, p in [
        (("a", "b", "c")[i % 3], ("com", "net", "org")[i % 7 % 3], ("en", "de", "es", "fr", f"w{i % 41}")[i % 5])]]
    urls += [f"http://{h}.{t}/{k}/{d}/{i}" for i, (h, t) in enumerate([("u", "com"), ("v", "org"), ("w", "net")] * 40) for k in ("en", "es", "de", "fr") for d in (f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}", "9", "8/x")]
    urls += [f"http://hot.io/t/{'abcdefgh'[i % 8]}{'abcdefgh'[i // 8 % 8]}q" for i in range(64)] + [None, "x", urls[0]]
    pages = spark.createDataFrame([(i, x, 1, "z") for i, x in enumerate(urls)] + [(None, "http://n.org/es/1", 1, "z")], "page_id bigint, url string, n int, host string")
    c = duckdb.connect()
    c.register("pages", pages.select("page_id", "url").toPandas().convert_dtypes())
    names = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    wanted = c.sql(u.ORACLE).select(", ".join(names)).fetchall()
    assert rows(u.url_filter(pages).select(*names)) == sorted(wanted, key=repr)
    assert u.url_filter(pages.limit(0)).count() == 0
