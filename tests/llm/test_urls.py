import duckdb
import pytest

from plebis.llm import urls


def brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for _, rule in urls.RULES:
        name, _, after = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + after) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


GIVEN = [
    None, "", "no url", "http://", "http://X.Example.ORG/en/1", "http://example.org/en/12?x=/", "http://example.org/en/2", "https://a.example.org/es/", "http://badexample.org/es/1",
    "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "http://x.org", "http://x.org?u=http://y.com/de/", "http://x.net/a#b", "ftp://u@h.com:80/fr/é", "http://É.org/ÀB",
    "a://b://c/d", "http://x.net/\nline",
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(GIVEN)), "page_id long, url string")
    got = {r["row"]["page_id"]: r for r in urls.judge(pages).collect()}
    assert len(got) == len(GIVEN)
    for k, url in enumerate(GIVEN):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == brute(url)
        if got[k]["rule"]:
            assert got[k]["verdict"] == {r: v for v, r in urls.RULES}[got[k]["rule"]]


def test_reputation_blocks_bad_hosts(spark):
    rows = [("bad.com", 1)] * 40 + [("good.com", 0)] * 40 + [("bad.com", None), ("good.com", None), ("new.com", None), ("few.com", 1)]
    got = {r["host"]: r["lower"] for r in urls.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.com"] > 0.5 > got["new.com"] and got["good.com"] < 0.2 and got["few.com"] < got["bad.com"]


def test_all_rows_and_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    expected = sorted(map(str, con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.OP5_SQL})").fetchall()))
    got = urls.op5_url_filter(spark, data).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == expected


@pytest.mark.parametrize("rows", [[], [(1, "http://a.com/x"), (1, "http://a.com/x")]])
def test_empty_and_repeated(spark, rows):
    pages = spark.createDataFrame([(*r, "h", "l") for r in rows], "page_id long, url string, host string, lower string")
    assert urls.judge(pages).count() == len(rows)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_bounds_decide_as_in_sql(spark, tmp_path, monkeypatch, broadcast):
    """Hosts that are mostly blocked by rule lose their other pages too."""
    monkeypatch.setattr(urls, "BROADCAST_HOSTS", broadcast)
    given = [f"http://bad.com/de/{k}" for k in range(60)] + ["http://bad.com/x"] * 3 + [f"http://good.com/fr/{k}" for k in range(60)] + ["http://good.com/x", "http://new.net/", None]
    given += [f"http://h{k}.com/{'de' if k % 3 == 0 else 'fr'}/{k}" for k in range(90)] + [f"http://h{k}.com/p" for k in range(90)]
    spark.createDataFrame(list(enumerate(given)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in urls.op5_url_filter(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(con.execute(f"SELECT page_id, host, path, rule, verdict, lower FROM ({urls.OP5_SQL})").fetchall())
    verdicts = {r[1]: r[4] for r in got if r[3] is None}
    assert verdicts["bad.com"] == "block" and verdicts["good.com"] == verdicts["new.net"] == verdicts[""] == "allow"
