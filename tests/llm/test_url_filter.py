import numpy as np
import pytest

from fairground.llm import url_filter as U
from fairground.llm.queries import RULES

URLS = [
    (1, "http://WWW.Bad.example.ORG/x?y#z"), (2, "https://example.net/en/page"), (3, "https://sub.example.net/en/"), (4, "https://example.net/en"), (5, "ftp://other.net/a"), (6, "https://example.com/de/1"),
    (7, "http://a.org/fr/x"), (8, "http://a.org/frx"), (9, None), (10, ""), (11, "no scheme"), (12, "http://"), (13, "http://net"), (14, "x://y://z/p"), (15, "http://bad.example.org"), (15, "http://bad.example.org"), (16, "http://notbad.example.org/"),
    (17, "http://h#frag/p"), (18, "http://h?q=/a://b"), (19, "http://h/" + "p" * 50_000), (20, "http://été.example.com/É?x"), (None, "http://net/"), (21, "http://fakenet/"), (22, "http://a\nb/c\nd"),
]


def brute(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
        path = rest[at:].split("?")[0].split("#")[0]
    rule = None
    for r in RULES:
        h, p = U.parse_rule(r)
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (rule is None or len(r) > len(rule)):
            rule = r
    parts = host.split(".")
    hit = any(".".join(parts[i:]) in listed for i in range(len(parts)))
    return host, path, rule, RULES[rule] if rule else "block" if hit else "allow"


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in URLS], "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.example.org",), ("BAD.example.org",), (None,), ("été.example.com",), ("unseen.example",)], "key string")
    got = U.judge_urls(pages, listed, RULES).select("row.page_id", "row.host", "row.url", "host", "path", "rule", "verdict").toDF("page_id", "old", "url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(URLS) and all(r.old == "x" for r in got)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, {"bad.example.org", "été.example.com"})


def test_the_empty_key_is_never_asked_for(spark):
    # As many hosts are listed as not, so the first filter's rate is a half and it lets many an unknown key pass.
    odd = [(1, None), (2, "http://a.x./p"), (3, "http://"), (4, "no scheme")]
    for i in range(5):
        pages = spark.createDataFrame(odd + [(5, f"http://bad{i}-{k}/") for k in range(60)] + [(6, f"http://good{k}/") for k in range(40)], "page_id long, url string")
        got = U.judge_urls(pages, spark.createDataFrame([(f"bad{i}-{k}",) for k in range(60)], "key string"), {}).select("row.page_id", "verdict").distinct().collect()
        assert sorted(map(tuple, got)) == [(n, "block" if n == 5 else "allow") for n in range(1, 7)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    listed = spark.createDataFrame([], "key string")
    assert U.judge_urls(none, listed, RULES).count() == 0
    pages = spark.createDataFrame([(1, "http://h/x")], "page_id long, url string")
    assert [r.verdict for r in U.judge_urls(pages, listed, {}).collect()] == ["allow"]


def test_cascade_is_exact_over_its_universe(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 62), 1 << 62, (20_000, 2))
    df = spark.createDataFrame([(int(a), int(b), i < 3000) for i, (a, b) in enumerate(keys)], "h1 long, h2 long, listed boolean")
    c = U.build_cascade(df)
    assert len(c.levels) > 2
    assert (c.holds(keys[:, 0].copy(), keys[:, 1].copy()) == (np.arange(20_000) < 3000)).all()
    assert c.size() < 3000 * 2 * 8
    with pytest.raises(ValueError):
        U.build_cascade(df, max_bytes=100)


def test_a_list_too_long_for_a_cascade_is_joined(spark):
    pages = spark.createDataFrame([(i, u) for i, u in URLS], "page_id long, url string")
    listed = spark.createDataFrame([("bad.example.org",), (None,), ("",), ("été.example.com",)], "key string")
    columns = ("row.page_id", "row.url", "host", "path", "rule", "verdict")
    plain, joined = (sorted(map(tuple, U.judge_urls(pages, listed, RULES, max_bytes=n).select(*columns).collect()), key=str) for n in (U.MAX_BYTES, 1))
    assert plain == joined and len(joined) == len(URLS)
