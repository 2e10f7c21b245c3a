"""URL rules against a plain loop, mapped and in shards."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import url_filter as U
from terrane.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, path[:end]


def judged(url, rules):
    host, path = parts(url)
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def urls():
    rng = random.Random(9)
    hosts = ["example.com", "WWW.Example.COM", "a.b.net", "example.net", "net", "x.org", "org", "notcom", "com", "", "ÄB.com", "example.com:80", "u@example.net"]
    paths = ["/en/7", "/en/71?q=/en/", "/en", "/de/8/x", "/de/#a", "?/en/", "#/en/", "/es/", "", "/ES/", "//en/", "/de/é😀"]
    return [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme/en/", "://", "a://b://c/en/", "x://com/en/\nz"]


@pytest.mark.parametrize("most", [U.MAX_INDEX_BYTES, 0])
def test_matches_a_plain_loop(spark, most):
    rows = list(enumerate(urls()))
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = U.apply_rules(pages.repartition(3), U.rule_frame(spark, URL_RULES), max_index_bytes=most).collect()
    assert len(got) == len(rows) + 3
    want = {k: judged(u, URL_RULES) for k, u in rows}
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[r["page_id"]], r["url"]


def test_cases(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = U.rule_frame(spark, [("block", "a.com", "/x")]).limit(0)
    assert U.apply_rules(pages, none).first()["verdict"] == "allow"
    twice = U.rule_frame(spark, [("allow", "A.com", "/x"), ("block", "a.com", "/x"), ("block", None, "/"), ("other", "com", "/")])
    assert U.apply_rules(pages, twice).first()["verdict"] == "block"
    assert U.apply_rules(pages.limit(0), twice).count() == 0


def test_collisions_are_confirmed_by_strings(tmp_path):
    index = U.DigestIndex.build(np.array([5, 5, 9]), ["one", "two", "three"], np.array([1, 0, 1]))
    index.save(f"{tmp_path}/i.bin")
    mapped = U.DigestIndex.load(f"{tmp_path}/i.bin")
    found = mapped.find(np.array([5, 5, 5, 9, 1]), ["two", "one", "other", "three", "one"])
    assert [mapped.block[i] if i >= 0 else None for i in found] == [0, 1, None, 1, None]
