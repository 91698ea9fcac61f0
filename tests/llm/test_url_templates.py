import re

from lodestream.llm.url_templates import RULES, url_templates


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_and_parts(spark):
    urls = [
        None, "", "nothing", "http://", "HTTP://Www.Example.ORG/es/1?x=/en/", "http://example.org", "http://example.org/", "https://a.example.org/en/12.html#x", "ftp://notexample.org/es/2",
        "http://x.com/fr/1", "http://com/de/", "http://x.com/deep/fr/", "https://a.net/http://b.org/es/", "http://É.org/ü", "http://h.net?q=http://x.org/", "http://y.org/en/1\nz",
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_templates(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or "allow")


def test_learned_templates(spark):
    rules = (("block", "bad.net", "/spam/"), ("allow", "bad.net", "/news/"))
    urls = [f"http://bad.net/spam/{i}.html" for i in range(60)] + [f"http://bad.net/news/item-{i}" for i in range(60)]
    urls += [f"http://bad.net/junk/{i}.html" for i in range(20)] + [f"http://w.net/{c}{c}{c}" for c in "abcdefghijkl"]
    urls += [f"http://only.spam.bad.net/spam/{i}" for i in range(50)] + ["http://only.spam.bad.net/other/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    out = {r.page_id: r for r in url_templates(df, rules=rules).collect()}
    got = {urls[i]: r for i, r in out.items()}
    assert len(out) == len(urls)
    assert got["http://w.net/aaa"].template == "/*" and got["http://w.net/aaa"].verdict == "allow"
    assert got["http://bad.net/junk/1.html"].template == "/junk/*.html" and got["http://bad.net/junk/1.html"].verdict == "allow"
    assert got["http://only.spam.bad.net/other/1"].verdict == "block"  # all labels of its host are blocked
    assert all(r.verdict == "block" for u, r in got.items() if "/spam/" in u)


def test_empty_table(spark):
    assert url_templates(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_similar_branches_are_merged_and_rejected(spark):
    rules = (("block", "x.net", "/ads/"), ("block", "x.net", "/promo/"), ("allow", "x.net", "/blog/"), ("block", "x.net", "/blend/a1"))
    spam = lambda b, n, extra: [f"http://x.net/{b}/click/{i}" for i in range(n)] + [f"http://x.net/{b}/{extra}" for _ in range(2)]
    urls = spam("ads", 40, "about") + spam("promo", 40, "terms")  # alike, though not over the same templates
    urls += [f"http://x.net/blog/post/{i}" for i in range(400)]
    urls += [f"http://x.net/blend/a1/click/{i}" for i in range(6)] + [f"http://x.net/blend/a2/click/{i}" for i in range(6)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    out = {urls[r.page_id]: r for r in url_templates(df, rules=rules).collect()}
    a, b = out["http://x.net/ads/click/1"], out["http://x.net/promo/click/1"]
    assert a.purity == b.purity < 0.25  # one template of the merged branch
    assert out["http://x.net/blog/post/1"].purity > 0.9
    assert out["http://x.net/blend/a2/click/1"].verdict == "allow"  # half way between its branch and its host


def test_deep_paths_keep_their_segments(spark):
    df = spark.createDataFrame([(1, "http://h.net/a/b/c/d/e/f/g"), (2, "http://h.net/a/b/c/d/e/f/h"), (3, "http://h.net/" + "/".join("s" for _ in range(40)))], "page_id long, url string")
    got = {r.page_id: r.template for r in url_templates(df).collect()}
    assert got[1] == "/a/b/c/d/e/f/g" and got[2] == "/a/b/c/d/e/f/h" and got[3].endswith("/**")


def slow_verdicts(urls, rules):
    """(template, purity, verdict) of every url by loops."""
    import math
    from collections import Counter, defaultdict

    rows = []
    for u in urls:
        host, path = brute(u)[:2]
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        shape = re.sub(r"[0-9]+", "*", re.sub(r"(?:(?<=^)|(?<=[/._-]))(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?=$|[/._-])", "*", path))
        rows.append((host, shape, max(fits)[1] if fits else None))
    n, good, bad = Counter(), Counter(), Counter()
    for h, s, v in rows:
        n[h, s] += 1
        good[h, s] += v == "allow"
        bad[h, s] += v == "block"
    prefix = dict.fromkeys(n, "")
    for level in range(1, max(s.count("/") for _, s in n) + 1):
        child = Counter()
        for h, s in n:
            if s.count("/") >= level:
                child[h, prefix[h, s], s.split("/")[level]] += n[h, s]
        kinds, total = Counter((h, p) for h, p, _ in child), Counter()
        for (h, p, _), k in child.items():
            total[h, p] += k
        wild = {x for x in kinds if kinds[x] >= 10 and kinds[x] >= 0.3 * total[x]}
        prefix = {(h, s): p if s.count("/") < level else p + "/" + ("*" if (h, p) in wild else s.split("/")[level]) for (h, s), p in prefix.items()}
    place = {(h, s): (h, p.split("/")[1] if p else "", p[len(p.split("/")[1] if p else "") + 1 :]) for (h, s), p in prefix.items()}
    rests = defaultdict(lambda: [0, 0, 0])
    for x, at in place.items():
        for i, c in enumerate((n, good, bad)):
            rests[at][i] += c[x]
    branches = defaultdict(dict)
    for (h, b, r), v in rests.items():
        branches[h, b][r] = v
    pools, sizes = defaultdict(Counter), Counter()
    key = {}
    for (h, b), of in branches.items():
        known = sum(v[1] + v[2] for v in of.values()) >= 5
        key[h, b] = (h, max((v[0], r) for r, v in of.items())[1], known)
        for r, v in of.items():
            pools[key[h, b]][r] += v[0]
            sizes[key[h, b]] += v[0]
    alike, sums = {}, {}
    for (h, b), of in branches.items():
        k, all_ = key[h, b], sum(v[0] for v in of.values())
        pq = [(v[0] / all_, pools[k][r] / sizes[k]) for r, v in of.items()]
        alike[h, b] = 0.5 * (sum(abs(p - q) for p, q in pq) + 1 - sum(q for _, q in pq)) <= 0.3 + 1 / math.sqrt(all_)
        sums[h, b] = (sum(v[1] for v in of.values()), sum(v[2] for v in of.values()))
    kind = {}
    for x in branches:
        if not alike[x]:
            kind[x] = ("alone", x[1])
            continue
        pool = [sums[y] for y in branches if key[y] == key[x] and alike[y]]
        rate = (sum(g for g, _ in pool) + 1) / (sum(g + b for g, b in pool) + 2)
        g, labels = sums[x][0], sum(sums[x])
        error = (g / labels - rate) / math.sqrt(rate * (1 - rate) / labels) if labels else 0
        kind[x] = ("pool", key[x][1], "few" if not key[x][2] else "above" if error > 3 else "below" if error < -3 else "like")
    smooth = lambda g, b, up: (g + 10 * up) / (g + b + 10)
    totals = sum(good.values()), sum(bad.values())
    prior = (totals[0] + 1) / (sum(totals) + 1)
    groups = {"host": defaultdict(lambda: [0, 0]), "kind": defaultdict(lambda: [0, 0]), "rest": defaultdict(lambda: [0, 0])}
    names = lambda h, b, r: (("host", h), ("kind", (h, kind[h, b])), ("rest", (h, kind[h, b], r)))
    for (h, b, r), (_, g, x) in rests.items():
        for level, name in names(h, b, r):
            groups[level][name][0] += g
            groups[level][name][1] += x
    out = []
    for h, s, v in rows:
        p = prior
        for level, name in names(*place[h, s]):
            p = smooth(*groups[level][name], p)
        out.append((prefix[h, s], round(p, 9), v or ("block" if p < 0.25 else "allow")))
    return out


def test_verdicts_equal_brute_force(spark):
    import random

    r = random.Random(12)
    rules = (("block", "a.net", "/p1/"), ("block", "a.net", "/p2/x"), ("allow", "a.net", "/p3/"), ("allow", "b.net", "/"), ("block", "b.net", "/q/1"), ("block", "c.net", "/s/"))
    urls = [None, "x", "http://a.net", "http://c.net/s/only"]
    for _ in range(900):
        host = r.choice(["a.net", "a.net", "b.net", "c.net", "w.c.net"])
        branch = r.choice(["p1", "p2", "p3", "p4", "q", "s", "t"])
        leaf = r.choice([str(r.randrange(99)), "x" + str(r.randrange(9)), "deadbeef" + str(r.randrange(10, 99)), "".join(r.choice("ghjk") for _ in range(4)), "about"])
        urls.append(f"http://{host}/{branch}/" + r.choice(["", "", "d/", "e/f/"]) + leaf + r.choice(["", ".html", "?q=1"]))
    out = {x.page_id: x for x in url_templates(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4), rules=rules).collect()}
    want = slow_verdicts(urls, rules)
    for i, (template, purity, verdict) in enumerate(want):
        assert (out[i].template, out[i].verdict) == (template, verdict) and abs(out[i].purity - purity) < 1e-8, urls[i]
    assert {x.verdict for x in out.values() if x.rule is None} == {"allow", "block"}  # templates are rejected
