import hashlib
import random

from terrasieve.llm import warc as W
from terrasieve.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, file string"


def fixture():
    r = random.Random(8)
    long = ["<p>" + "é\r\n\r\nWARC/1.1\r\n" * 90 + str(k) for k in range(3)]
    rows = [(i, f"http://{r.choice(['a', 'www.b', 'c.b'])}.example.com/{r.randrange(40)}?q={i % 3}#f", r.choice([*long, "x" * 999, "x" * 1000, f"own {i}", "", None]), "z") for i in range(150)]
    return rows + [(None, "http://a.example.com/n", long[0], "z"), (200, None, "no url", "z"), (201, "not a url [", "q", "z"), (202, "http://x y/\n", "w" * 300_000, "z"), (149, rows[149][1], rows[149][2], "z")]


def brute(rows):
    best = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        ref = best.get(h) if i is not None and len(raw) >= 1000 and best.get(h) != i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = fixture()
    got = W.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_lookup_by_binary_search(spark):
    rows = fixture()
    to = scratch_path(spark, "warc-test")
    files = W.write(spark.createDataFrame(rows, SCHEMA), f"{to}/a")
    index = W.build_index(spark, files, f"{to}/i", block_lines=4)
    asked = [rows[5][1], rows[77][1], "http://a.example.com/n", "http://nowhere.example.org/"]
    urls = spark.createDataFrame([(u,) for u in asked], "url string")
    keys = {W.surt(u) for u in asked}
    want = sorted(((i, u) for i, u, _, _ in rows if W.surt(u) in keys), key=str)
    for segment in (1, 3, 4096):
        found = W.lookup(spark, index, urls, segment_blocks=segment)
        assert sorted(((r.page_id, r.url) for r in W.read(found).collect()), key=str) == want


def test_keys():
    assert W.surt("https://www.Blog.Example.com:8080/a?b=1#top") == "com,example,blog:8080)/a?b=1"
    assert W.surt("http://x.org") == "org,x)/" and W.surt(None) == ")/"


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_ids(spark):
    base = 9007199254740993
    rows = [(base, "http://a.b/1", "y" * 2000, "z"), (base + 2, "http://a.b/2", "y" * 2000, "z"), (base + 4, "http://a.b/3", "y" * 2000, "z"), (None, "http://a.b/4", "y" * 2000, "z"), (5, "http://a.b/5", "own", "z")]
    got = W.round_trip(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {r.refers_to for r in got} == {None, base + 4}
