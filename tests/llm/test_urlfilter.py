import pytest

from loomgraph.llm import urlfilter

URLS = [
    (1, "http://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/"),
    (2, "https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/"),
    (3, "https://example.com/en", "example.com", "/en", "com/"),
    (4, "https://x.net/es/?a", "x.net", "/es/", "net/es/"),
    (5, "https://planet/es/1", "planet", "/es/1", None),
    (6, "https://x.com?y=/en/", "x.com", "", None),
    (7, None, "", "", None),
    (8, "no scheme/com/", "", "", None),
    (9, "http://Ä.net:80/fr/é\nz#t", "Ä.net:80", "/fr/é\nz", None),
    (10, "http://u@x.net#/fr/", "u@x.net", "", None),
    (11, "://net/fr/x", "net", "/fr/x", "net/fr/"),
    (12, "", "", "", None),
]
PAGES = "page_id long, url string, html string"
LABELS = "doc_id long, quality int, toxic int"


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "x", 1) for i, u, *_ in URLS], "page_id long, url string, html string, host string, n int")
    got = {r["page_id"]: r for r in urlfilter.judged(df, spark.createDataFrame([], LABELS)).collect()}
    assert len(got) == len(URLS)
    for i, _, host, path, rule in URLS:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == ("block" if rule in ("example.com/en/", "net/es/", "net/fr/") else "allow")


def test_levels(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.org",), ("org",), ("u@x.y.net:8080",), ("",), ("x.co.info",)], "host string")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in urlfilter.with_levels(df).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.org": ("b.org", "org"), "org": ("org", "org"), "u@x.y.net:8080": ("y.net", "net"), "": ("", ""), "x.co.info": ("co.info", "info")}


def test_levels_by_a_table(spark, tmp_path):
    (tmp_path / "suffixes.dat").write_text("// public suffixes\ncom\nuk\nco.uk // second level\n*.ck\n!www.ck\ngithub.example\n\n")
    table = urlfilter.read_suffix_table(spark, str(tmp_path / "suffixes.dat"))
    assert table.count() == 6
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.uk": ("b.uk", "uk"), "x.y.foo.ck": ("y.foo.ck", "foo.ck"), "a.www.ck": ("www.ck", "ck"), "p.q.github.example:80": ("q.github.example", "github.example"), "odd": ("odd", "odd"), "a.odd": ("a.odd", "odd"), "": ("", "")}
    got = {r["host"]: (r["domain"], r["suffix"]) for r in urlfilter.with_levels(spark.createDataFrame([(h,) for h in hosts], "host string"), table).collect()}
    assert got == hosts


def outcomes():
    rows, labels, page = [], [], 0
    for host, bad, n in [("good.a.org", 0, 40), ("bad.a.org", 38, 40), ("new.a.org", 0, 0), ("one.b.org", 1, 1), ("evil1.c.info", 20, 20), ("evil2.c.info", 2, 2), ("fine.d.info", 1, 60)]:
        for i in range(max(n, 1)):
            rows.append((page, f"http://{host}/{i}", ""))
            if i < n:
                labels.append((page, 0 if i < bad else 1, 0))
            page += 1
    return rows, labels


def brute(rows, labels):
    """The documented formulas in plain Python."""
    bad = {d: max(1 - q, t) for d, q, t in labels}
    hosts = {}
    for p, u, _ in rows:
        h = u.split("/")[2]
        n, y = hosts.get(h, (0, 0))
        hosts[h] = (n + (p in bad), y + bad.get(p, 0))

    def up(groups, key):
        out = {}
        for g, (n, y) in groups.items():
            a, b = out.get(key(g), (0, 0))
            out[key(g)] = (a + n, b + y)
        return out

    def strength(groups, m):
        s = sum((y - n * m[g]) ** 2 / (m[g] * (1 - m[g])) for g, (n, y) in groups.items())
        n, q = sum(n for n, _ in groups.values()), sum(n * n for n, _ in groups.values())
        return 1 / min(0.5, max(0.001, (s - n) / (q - n))) - 1

    domains = up(hosts, lambda h: ".".join(h.split(".")[-2:]))
    tops = up(domains, lambda d: d.split(".")[-1])
    n, y = map(sum, zip(*tops.values(), strict=True))
    m = dict.fromkeys(tops, (y + 1) / (n + 2))
    for level, parent in ((tops, None), (domains, lambda d: d.split(".")[-1]), (hosts, lambda h: ".".join(h.split(".")[-2:]))):
        m = m if parent is None else {g: mean[parent(g)] for g in level}
        k = strength(level, m)
        mean = {g: (y + k * m[g]) / (n + k) for g, (n, y) in level.items()}
    out = {}
    for h, (n, y) in hosts.items():
        a, b = y + k * m[h], n - y + k * (1 - m[h])
        out[h] = (a / (a + b), (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)
    return out


def test_reputation_against_formulas(spark):
    rows, labels = outcomes()
    got = {r["host"]: r for r in urlfilter.judged(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels + [(None, 0, 1), (10**6, 0, 0)], LABELS)).collect()}
    want = brute(rows, labels)
    for h, (mean, sd) in want.items():
        assert got[h]["bad_rate"] == pytest.approx(mean) and got[h]["bad_bound"] == pytest.approx(mean - 1.645 * sd)
    verdicts = {h: r["verdict"] for h, r in got.items()}
    assert verdicts["bad.a.org"] == verdicts["evil1.c.info"] == "block"
    assert verdicts["good.a.org"] == verdicts["new.a.org"] == verdicts["one.b.org"] == verdicts["fine.d.info"] == "allow"


def test_empty(spark):
    assert urlfilter.judged(spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS)).count() == 0
    one = urlfilter.judged(spark.createDataFrame([(1, "http://a.org/", "x"), (1, "http://a.org/", "x")], PAGES), spark.createDataFrame([(1, None, None), (1, 0, None)], LABELS)).collect()
    assert len(one) == 2


def test_addresses_are_domains_of_their_own(spark):
    hosts = ["10.0.3.4", "8.8.3.4", "user@10.0.3.4:8080", "[::1]:80", "[2001:db8::2]", "1.2.3.example.com", "1.2.3"]
    got = {r["host"]: (r["domain"], r["suffix"]) for r in urlfilter.with_levels(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert got == {"10.0.3.4": ("10.0.3.4",) * 2, "8.8.3.4": ("8.8.3.4",) * 2, "user@10.0.3.4:8080": ("10.0.3.4",) * 2, "[::1]:80": ("[::1]",) * 2, "[2001:db8::2]": ("[2001:db8::2]",) * 2, "1.2.3.example.com": ("example.com", "com"), "1.2.3": ("2.3", "3")}
