"""Mixing and url rules against brute force."""

import math
from collections import defaultdict

from fanchart.llm import links, mixing
from tests.llm import edge

LABELS = "doc_id long, quality int, toxic int"


def water(sizes, weights, cap=3.0):
    """Targets by repeated resharing."""
    total, target, fixed = float(sum(sizes)), [0.0] * len(sizes), set()
    while True:
        left = total - sum(target[i] for i in fixed)
        w = sum(x for i, x in enumerate(weights) if i not in fixed)
        for i, x in enumerate(weights):
            if i not in fixed:
                target[i] = left * x / w if w else 0.0
        over = [i for i in range(len(sizes)) if i not in fixed and target[i] > cap * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = cap * sizes[i]
            fixed.add(i)


def corpus(n=900):
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else [None, "a", "b", "tiny", "é", "Z", "empty"][i % 7] if i % 11 else "b"
        size = 0 if source == "empty" else 5 if source == "tiny" and i > 100 else (i * 7919) % 180 + 1
        rows.append((i, "" if i % 97 == 0 else " ".join(["w"] * size), "en", source, 0))
    return [r for r in rows if r[3] != "tiny" or r[0] < 60]


def test_mix_meets_its_targets(spark):
    rows = corpus() + edge.ROWS
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 900, 3)] + [(0, 0, 0), (None, 1, 0), (4, None, 1)], LABELS)
    run = lambda ranges: mixing.mix(mixing.sized_with_weight(edge.docs(spark, rows), labels), range_rows=ranges).collect()
    out = run(20)
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    sizes = [sum(r.size for r in by[s]) for s in order]
    want = water(sizes, [(1, 2, 3)[i % 3] for i in range(len(order))])
    for s, size, target in zip(order, sizes, want):
        assert {r.source_size for r in by[s]} == {size}
        assert all(math.isclose(r.target, target, rel_tol=1e-9, abs_tol=1e-9) for r in by[s])
        assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0 for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= max(r.size for r in by[s])
        # complete epochs come before parts
        assert len({r.copies for r in by[s] if r.size}) <= 2 and (not size or {r.copies for r in by[s] if r.size} <= {target // size, target // size + 1})
    key = lambda rows: sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in rows)
    assert key(out) == key(run(20)) == key(run(100_000))


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, "one two three four", "en", "only" if i < 3000 else "other", 0) for i in range(6000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3000)], LABELS)
    out = mixing.mix(mixing.sized_with_weight(edge.docs(spark, rows), labels)).collect()
    taken = [sum(1 for r in out if r.source == "only" and r.taken and r.doc_id % 2 == y) for y in (0, 1)]
    assert taken[1] > 1.5 * taken[0]


def test_rows_without_an_id_spread_over_the_ranges(spark):
    rows = [(None, "one two three", "en", "a" if i < 4000 else "b", 0) for i in range(5000)]
    sized = mixing.sized_with_weight(edge.docs(spark, rows), spark.createDataFrame([], LABELS))
    assert sized.select("__name").distinct().count() == len(rows)
    out = mixing.mix(sized, range_rows=50).collect()
    for s in "ab":
        of = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 3


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], LABELS)
    assert mixing.mix(mixing.sized_with_weight(edge.docs(spark, []), none)).collect() == []
    out = mixing.mix(mixing.sized_with_weight(edge.docs(spark, [(1, None, None, "a", None), (2, "", None, None, None)]), none)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in out) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


PAGES = "page_id long, url string, html string"
URLS = [
    ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("https://x.example.com/de/7", "x.example.com", "/de/7", "example.com/de/", "block"), ("ftp://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"),
    ("http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"), ("http://net", "net", "", None, "allow"), ("http://net/", "net", "/", "net/", "block"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://?q", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("://h/p", "h", "/p", None, "allow"),
]


def test_rules_and_urls(spark):
    df = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(URLS)], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in links.judge(df).collect()}
    assert {i: got[i][:3] for i in got} == {i: u[1:4] for i, u in enumerate(URLS)}
    assert all(got[i][3] == u[4] for i, u in enumerate(URLS) if u[3])
    assert links.judge(spark.createDataFrame([], PAGES)).collect() == []


def brute_ranks(pages):
    """Trust and distrust by plain iteration."""
    edges, seeds, hosts = defaultdict(float), {"trust": defaultdict(float), "distrust": defaultdict(float)}, set()
    for host, far, action in pages:
        hosts.add(host)
        if action:
            seeds["trust" if action == "allow" else "distrust"][host] += 1
        for dst in far:
            if dst != host:
                edges[host, dst] += 1
    for h in hosts:
        up = h[h.find(".") + 1 :]
        if up != h and up in hosts:
            edges[h, up] += 1
    out = {}
    for kind in seeds:
        e = edges if kind == "trust" else {(b, a): n for (a, b), n in edges.items()}
        total = defaultdict(float)
        for (a, _), n in e.items():
            total[a] += n
        rank = dict(seeds[kind])
        for _ in range(links.ITERATIONS):
            new = defaultdict(float, {h: s * (1 - links.DAMPING) for h, s in seeds[kind].items()})
            for (a, b), n in e.items():
                new[b] += rank.get(a, 0) * n / total[a] * links.DAMPING
            rank = new
        out[kind] = rank
    return out


def test_trust_and_distrust_spread_over_links(spark):
    pages, rows = [], []
    for i in range(400):
        host = f"h{i % 13}.site{i % 5}." + ["org", "com", "info"][i % 3] if i % 3 else "hot.info"
        host = host if i % 4 else ["example.com", "site1.com", "spam.net"][i % 3]
        far = [f"h{(i * 7) % 13}.site{(i + 1) % 5}.com", "spam.net" if i % 9 == 0 else "www.w.org", host]
        path = ["/fr/", "/de/", "/en/"][i % 7 % 3]
        html = "".join(f"<a class=x HREF = '{p}{h.upper()}/q'>t</a>" for h, p in zip(far, ("http://", "//", "https://"))) + '<a href="/local"><a href=mailto:x@y.z>'
        rows.append((i, f"http://{host}{path}{i}", html if i % 10 else None))
        fits = [(len(h) + len(p), a) for a, h, p in links.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        pages.append((host, far if i % 10 else [], max(fits)[1] if fits else None))
    want = brute_ranks(pages)
    for r in links.judge(spark.createDataFrame(rows, PAGES)).collect():
        trust, distrust = want["trust"].get(r.host, 0.0), want["distrust"].get(r.host, 0.0)
        assert math.isclose(r.trust, trust, abs_tol=1e-9) and math.isclose(r.distrust, distrust, abs_tol=1e-9)
        action = pages[r.page_id][2]
        assert r.verdict == (action or ("block" if distrust - trust > links.THRESHOLD else "allow"))
    assert {r.verdict for r in links.judge(spark.createDataFrame(rows, PAGES)).where("rule IS NULL").collect()} == {"allow", "block"}


def test_verdicts_reach_far_hosts_and_do_not_depend_on_the_number_of_pages(spark):
    link = lambda host: f'<a href="http://{host}/">'
    # d0 links to a blocked host, d1 to d0, and so on; mixed.info has an allowed and a blocked neighbour
    graph = [("spam.net", "/", "")] + [(f"d{i}.info", "/", link(f"d{i - 1}.info" if i else "spam.net")) for i in range(12)]
    graph += [("good.org", "/fr/", link("mixed.info")), ("mixed.info", "/", link("spam.net")), ("e.info", "/", link("bad.net"))] + [("bad.net", "/", "")] * 3

    def run(times):
        rows = [(i, f"http://{h}{p}", html) for i, (h, p, html) in enumerate(graph * times)]
        return {r.host: r for r in links.judge(spark.createDataFrame(rows, PAGES)).collect()}

    one, ten = run(1), run(10)
    assert {h: r.verdict for h, r in one.items()} == {h: r.verdict for h, r in ten.items()}
    assert {r.verdict for r in one.values() if not r.rule} == {"allow", "block"}
    # half of spam.net's distrust goes to d0, and 0.85 of a host's to the next
    for i in range(12):
        assert math.isclose(one[f"d{i}.info"].distrust, 0.15 * 0.5 * 0.85 ** (i + 1), rel_tol=1e-9)
