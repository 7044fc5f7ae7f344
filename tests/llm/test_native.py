"""Sharding, mixing, URL filter and secret scan against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from procsim.llm import mixing, secrets, sharding, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, base string, rows long"
LONG = "word " * 30_000
ROWS = [
    (1, "one two three", "en", "b", 13, 9, "x", 1), (2, "", "en", "a", 0, 9, "x", 1), (3, None, None, None, None, None, None, None),
    (None, "no id here", "en", "a", 10, 9, "x", 1), (4, LONG, "en", "b", len(LONG), 9, "x", 1), (5, "über\tçé\n", "de", "c", 8, 9, "x", 1),
    *[(6, "again and again", "en", "b", 15, 9, "x", 1)] * 5, *[(i, f"text {i} " * (i % 7), "en", "abc"[i % 3], 1, 9, "x", 1) for i in range(7, 60)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5)


def test_sharding(docs):
    got = [r.asDict() for r in sharding.shard_by_bytes(docs, 4).collect()]
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [(r["doc_id"] is not None, r["doc_id"], r["size"]) for r in order] == sorted((r["doc_id"] is not None, r["doc_id"], r["size"]) for r in got)
    for s in range(4):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= largest


def test_sharding_of_nothing(spark, docs):
    assert sharding.shard_by_bytes(docs.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs, 0)


def water(sizes, weights, most):
    goal, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        level = left / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > most * sizes[s]]
        if not over:
            return goal | {s: level * weights[s] for s in free}
        for s in over:
            goal[s] = most * sizes[s]
            left -= goal[s]
            free.remove(s)
    return goal


def test_mixing(docs):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((r[0], r[3], size(r[1])) for r in ROWS)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = water(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, 3)
    for source in order:
        own = [r for r in rows if r["source"] == source]
        assert [r["target"] for r in own] == pytest.approx([goal[source]] * len(own))
        rate = goal[source] / sizes[source] if sizes[source] else 0
        assert {r["copies"] - int(rate) for r in own} <= ({0, 1} if rate % 1 else {0})
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in rows)
    again = Counter((r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(2)).collect())
    assert again == Counter((r["doc_id"], r["copies"]) for r in rows)


def test_draws_come_as_often_as_the_fraction(spark):
    """Documents of one size are drawn independently: their number is binomial."""
    import hashlib

    rows = spark.range(20_000).selectExpr("id as doc_id", "'w w' as text", "if(id % 4 = 0, 'a', 'b') as source")
    got = mixing.mix(rows).collect()
    for source, n in (("a", 5000), ("b", 15_000)):
        own = [r for r in got if r["source"] == source]
        rate = own[0]["target"] / own[0]["source_size"]
        part = rate - int(rate)
        extra = sum(r["copies"] - int(rate) for r in own)
        assert abs(extra - n * part) <= 5 * (n * part * (1 - part)) ** 0.5
        for r in own[:200]:
            mark = hashlib.md5(f"42:{r['doc_id']}:{source}:2:0".encode()).hexdigest()[:8]
            assert r["copies"] == int(rate) + (int(mark, 16) / 2**32 < part)


def test_a_million_copies_of_a_row(spark):
    """A hot row is dealt out over tasks, each copy with its own draw, place and slot."""
    rows = spark.range(1_000_000).selectExpr("7L as doc_id", "'one two' as text", "'hot' as source")
    rows = rows.unionByName(spark.createDataFrame([(8, "x y z", "cold"), (9, None, None)], "doc_id long, text string, source string"))
    mixed = mixing.mix(rows)
    assert mixed.count() == 1_000_002
    hot = mixed.filter("source = 'hot'").agg(F.sum("taken"), F.first("target")).first()
    assert abs(hot[0] - hot[1]) <= 10_000
    shards = sharding.shard_by_bytes(rows, 16).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert len(shards) == 16 and all(r["n"] == r["slots"] == r["last"] + 1 for r in shards) and sum(r["n"] for r in shards) == 1_000_002


def test_mixed_documents(docs):
    odd = docs.withColumns({"_row": F.lit(1), "_times": F.lit(2), "row": F.lit("x"), "copies": F.lit(0), "target": F.lit(9)})
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.filter("copies <> 0 or _times <> 2").count() == 0
    single = docs.dropDuplicates(["doc_id", "source", "text"])
    assert mixing.mixed_documents(single).count() == sum(r["copies"] for r in mixing.mix(single).collect())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


URLS = [None, "", "nothing", "http://A.Example.ORG", "https://x.org/es/1?q", "http://example.org/es/7", "http://a.example.org/en/1", "http://com/de/2#f", "http://b.com/fr/3", "ftp://h.net:80/a/b/c/d/e/f", "http://h.net/9", "x://http://y.org/"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "", 0) for i, u in enumerate(URLS)] + [(3, URLS[3], "", 0)], "page_id long, url string, html string, bad long")
    labels = spark.createDataFrame([], "doc_id long, bad int")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    got = url_filter.filter_urls(pages, labels).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        url = URLS[r["page_id"]] or ""
        rest = url.partition("://")[2]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == ((max(fits)[2], max(fits)[1]) if fits else (None, "allow"))
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


def test_template_tree(spark):
    """A branch of bad labels is rejected, one like its siblings merges with them."""
    pages = [(i, f"http://h.net/{'junk' if i % 3 == 0 else 'news' if i % 3 == 1 else 'blog'}/{i}.html") for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 300, 2)] + [(4, None), (None, 1), (6, 1)]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad int"))
    assert {(r["template"], r["verdict"]) for r in got.select("template", "verdict").distinct().collect()} == {("/junk/{n}.html", "block"), ("/*-/{n}.html", "allow")}


def test_deep_templates(spark):
    """Branches are told apart however deep they are, and a long path by itself keeps its segments."""
    pages = [(i, f"http://h.net/en/blog/may/x/y/{'casino' if i % 2 else 'health'}/{i}.html") for i in range(200)]
    pages += [(1000, "http://h.net/en/blog/may/x/y/" + "z/" * 60), (1001, "http://k.net/" + "/".join("abcdefgh"))]
    labels = [(i, i % 2) for i in range(200)]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, bad int"))
    rows = {r["page_id"]: r for r in got.collect()}
    assert len(rows) == 202
    assert {(rows[i]["template"], rows[i]["verdict"]) for i in range(200)} == {
        ("/en/blog/may/x/y/casino/{n}.html", "block"), ("/en/blog/may/x/y/health/{n}.html", "allow")
    }
    assert rows[1000]["template"] == "/en/blog/may/x/y/*" + "/z" * 59
    assert rows[1001]["template"] == "/a/b/c/d/e/f/g/h"


TEXTS = [
    "password=abcdefghijkl and token: short", "SeCrEt\" : 'aaaa/bbbb+cccc", "password=secret : abcdefghijklmnop", "AKIAABCDEFGHIJKLMN AKIA123", "éé deadbeefdeadbeef0 ff",
    "api_key==abcdefabcdefabcdef0123", None, "", "x" * 100_000, "plain words, nothing else 12345678901234567890123", "Zx9kQ2mW7vB4nL8pR1tY6uJ3 is odd", "id 123e4567-e89b-12d3-a456-426614174000 ok", "DEADBEEF0123456789AB and",
    "AKIAABCDEFGHIJKLMN" * 50,
]
BASE = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]


def base_spans(text):
    found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m))
    return [f"{secrets.BASE_KINDS[k]}:{a}:{b}" for a, k, b in found]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None)], "doc_id long, text string, base string")
    return rows, secrets.digest(secrets.scan_secrets(rows)).collect()


def test_base_spans(scanned):
    assert len(scanned[1]) == len(TEXTS) + 1
    for r in scanned[1]:
        base = base_spans(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])
        assert [r[f"n_{k}"] for k in secrets.BASE_KINDS] == [sum(x.startswith(k) for x in base) for k in secrets.BASE_KINDS]


def test_entropy_adds_and_allows(scanned):
    spans = {r["doc_id"]: r["spans"] for r in scanned[1]}
    assert spans[10] == "entropy_base64:0:24" and spans[9] == "hex:26:49" and spans[11] == "" and spans[12] == "entropy_hex:0:20"


def test_window_entropy_by_brute_force(spark):
    import math
    import random

    draw = random.Random(3)
    runs = ["".join(draw.choice("abcdefgh01234567") for _ in range(draw.randint(20, 60))) for _ in range(40)]
    for width, least in ((20, 3.3), (8, 2.75)):
        found = spark.createDataFrame([(r,) for r in runs], "s string").select("s", secrets.entropy_span(F.col("s"), width, least).alias("w"))
        for r in found.collect():
            bits = [-sum(c / width * math.log2(c / width) for c in Counter(r["s"][i : i + width]).values()) for i in range(len(r["s"]) - width + 1)]
            hits = [i for i, b in enumerate(bits) if b >= least - 1e-9]
            assert (r["w"]["from"], r["w"]["to"]) == ((hits[0], hits[-1] + width) if hits else (-1, 0))


def test_redaction(spark):
    rows = [(1, "é password=abcdefghijkl end AKIAABCDEFGHIJKLMN", 46), (2, "clean", 5), (3, None, None)]
    got = {r["doc_id"]: r for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got[1]["text"] == "é [SECRET] end [SECRET]" and got[1]["n_chars"] == 23
    assert got[2]["text"] == "clean" and got[3]["text"] is None


def test_redaction_keeps_all_columns(spark):
    """Columns may be named like those that the operator uses inside."""
    names = ["_id", "row", "spans", "clean", "base", "hex", "whole", "blocks", "doc_id"]
    rows = spark.createDataFrame([("x AKIAABCDEFGHIJKLMN", *range(9)), (None, *range(9)), ("", *[None] * 9)], "text string, " + ", ".join(f"{c} int" for c in names))
    got = secrets.redact(rows)
    assert got.columns == rows.columns
    assert {tuple(r) for r in got.collect()} == {("x [SECRET]", *range(9)), (None, *range(9)), ("", *[None] * 9)}
    assert secrets.redact(rows.limit(0)).count() == 0


def test_thousands_of_matches_in_a_text(spark):
    import math
    import random

    draw = random.Random(5)
    words = [f"AKIA{''.join(draw.choice('ABCDEFGH0123456') for _ in range(16))} {''.join(draw.choice('abcdwxyzEFGHKLMN0123456789') for _ in range(30))}" for _ in range(3000)]
    row = secrets.digest(secrets.scan_secrets(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"))).first()
    assert row["n_access"] == 3000 and row["base_sha256"] == hashlib.sha256(",".join(base_spans(" ".join(words))).encode()).hexdigest()
    expected = 0
    for run in (w.split(" ")[1] for w in words):
        bits = [-sum(c / 20 * math.log2(c / 20) for c in Counter(run[i : i + 20]).values()) for i in range(11)]
        expected += max(bits) >= 3.8 - 1e-9 and not run.isalpha()
    assert row["spans"].count("access") == 3000 and row["spans"].count("entropy_base64") == expected > 1000


TOKEN = "Zx9kQ2mW7vB4nL8pR1tY6uJ3sD5fG0hKqXcVbNmE"
GLUED = {
    f"id 1234567890123456789-{TOKEN} end": [TOKEN],
    f"AKIAABCDEFGHIJKLMN-{TOKEN}": [TOKEN],
    f"see /2024/01/15/{TOKEN}": [TOKEN],
    f"{TOKEN}_2024-01-15_{TOKEN[::-1]}": [TOKEN, TOKEN[::-1]],
    "x DEADBEEF0123456789abcdef0123 y": ["DEADBEEF"],
}
CLEAN = ["/2024/01/15/a-title-of-many-plain-words-42", "2024-01-15/123e4567-e89b-12d3-a456-426614174000", "/static/app/main/0123456789abcdef0123-plain-words-after-it"]


def test_secrets_beside_base_spans_and_dates(spark):
    """What base patterns and dates leave of a run is a candidate of its own."""
    texts = [*GLUED, *CLEAN]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(rows).collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()}
    for i, text in enumerate(texts):
        assert all(s["start"] < s["end"] for s in found[i])
        for token in GLUED.get(text, []):
            at = text.index(token)
            covered = {k for s in found[i] for k in range(s["start"], s["end"])}
            assert set(range(at, at + len(token))) <= covered and token not in clean[i]
        if text in CLEAN:
            assert not [s for s in found[i] if s["kind"].startswith("entropy")]
