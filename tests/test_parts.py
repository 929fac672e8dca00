"""Tables in parts, the hash registry, long block lists and pages of deep markup."""

import pathlib
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from millrace.operators import funnel, lake, parts

SCHEMA = "id long, k string, a string, b long, updated_at string"


def rows(frame, *columns):
    return sorted(map(tuple, (frame.select(*columns) if columns else frame).collect()), key=str)


def table(spark, n=400):
    return spark.createDataFrame([(i, f"k{i % 7}", f"a{i}", i, "old") for i in range(n)], SCHEMA)


@pytest.mark.parametrize("broadcast", [parts.BROADCAST, 0])
@pytest.mark.parametrize("insert", [True, False])
def test_upsert_parts(spark, tmp_path, broadcast, insert):
    path, base = str(tmp_path / "t"), table(spark)
    parts.write_parts(base, path, ["id"], 16)
    before = {f: f.read_bytes() for f in pathlib.Path(path).glob("part=*/*.parquet")}
    source = spark.createDataFrame([(3, None), (5, "new5"), (1000, "new1000"), (None, "nokey")], "id int, a string")
    touched = parts.upsert_parts(spark, path, base.schema, source, ["id"], ["a"], parts=16, updated_at="now", insert=insert, broadcast=broadcast)
    got = parts.read_parts(spark, path, base.schema).select(base.columns)
    if insert:
        want = lake.upsert(base, source, ["id"], ["a"], "now")
        want = want.withColumn("updated_at", F.when(F.col("b").isNotNull(), F.col("updated_at")))
        got = got.withColumn("updated_at", F.when(F.col("b").isNotNull(), F.col("updated_at")))
    else:
        want = lake.update_only(base, source, ["id"], ["a"], "now")
    assert rows(got) == rows(want)
    assert 0 < len(touched) <= 4
    for f, content in before.items():  # files of other parts stay as they were; those of touched parts are replaced
        inside = int(f.parent.name.split("=")[1]) in touched
        assert f.exists() != inside and (inside or f.read_bytes() == content)


def test_upsert_parts_shuffles_no_target(spark, tmp_path):
    path, base = str(tmp_path / "t"), table(spark)
    parts.write_parts(base, path, ["id"], 8)
    source = spark.createDataFrame([(3, "x")], "id long, a string")
    existing = parts.read_parts(spark, path, base.schema, [1, 2])
    plan = parts.merged(existing, source, ["id"], ["a"], None, True, True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "PartitionFilters: [part" in plan


def test_upsert_parts_odd(spark, tmp_path):
    path, base = str(tmp_path / "t"), table(spark, 20)
    parts.write_parts(base, path, ["id"], 4)
    none = spark.createDataFrame([], "id long, a string")
    assert parts.upsert_parts(spark, path, base.schema, none, ["id"], ["a"], parts=4) == []
    with pytest.raises(ValueError):
        parts.upsert_parts(spark, path, base.schema, spark.createDataFrame([(1, "x"), (1, "y")], "id long, a string"), ["id"], ["a"], parts=4)
    with pytest.raises(ValueError):
        parts.write_parts(base.withColumn("part", F.lit(1)), path, ["id"])
    assert rows(parts.read_parts(spark, path, base.schema).select(base.columns)) == rows(base)
    two = spark.createDataFrame([(1, "k1", "both"), (1, "k9", "none")], "id long, k string, a string")
    other = str(tmp_path / "two")
    parts.write_parts(base, other, ["id", "k"], 4)
    parts.upsert_parts(spark, other, base.schema, two, ["id", "k"], ["a"], parts=4)
    assert rows(parts.read_parts(spark, other, base.schema).select(base.columns)) == rows(lake.upsert(base, two, ["id", "k"], ["a"]))


def hashes(spark, of):
    return spark.createDataFrame([(None if i is None else f"h{i}",) for i in of], "content_hash string")


def test_registry(spark, tmp_path):
    path, n = str(tmp_path / "r"), dict(parts=8, blocks=2)
    assert parts.registered(spark, path, hashes(spark, [1])).count() == 0
    parts.register(hashes(spark, [*range(500), 3, None]), path, 0, **n)
    parts.register(hashes(spark, range(400, 900)), path, 1, **n)
    asked = hashes(spark, [None, 5, 5, *range(450, 1400)])
    assert rows(parts.registered(spark, path, asked, **n)) == rows(hashes(spark, [5, *range(450, 900)]))
    assert rows(parts.registered(spark, path, asked, before=1, **n)) == rows(hashes(spark, [5, *range(450, 500)]))
    likely = parts.candidates(spark, path, asked, **n).count()
    assert 451 <= likely <= 451 + 25  # of 500 hashes that nobody registered, few pass the filters
    parts.register(hashes(spark, range(400, 900)), path, 1, **n)  # a batch that is run again
    assert spark.read.parquet(f"{path}/hashes").count() == 1000


def test_registry_reads_only_likely_parts(spark, tmp_path):
    path, n = str(tmp_path / "r"), dict(parts=16, blocks=2)
    parts.register(hashes(spark, range(2000)), path, 0, **n)
    asked = hashes(spark, [7, *range(5000, 5040)])
    named = {r.part for r in parts.candidates(spark, path, asked, **n).select("part").distinct().collect()}
    assert 1 <= len(named) <= 4
    for f in pathlib.Path(path).glob("hashes/part=*/*/*.parquet"):  # files of other parts can't be read any more
        if int(f.parent.parent.name.split("=")[1]) not in named:
            f.write_bytes(b"no parquet")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    assert rows(parts.registered(spark, path, asked, **n)) == [("h7",)]


def test_contained_and_blocklist(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("ab.") for _ in range(draw.randrange(0, 9)))
    domains, listed = [word() for _ in range(300)] + [None, "한국.kr"], [word() for _ in range(12)] + [None, "국", "abc.한국.kr"]
    listed = [x for x in listed if x is None or len(x) > 2 or x == "국"]
    outer, inner = spark.createDataFrame([(x,) for x in domains], "o string"), spark.createDataFrame([(x,) for x in listed], "i string")
    want = sorted({(i, o) for i in listed for o in domains if i is not None and o is not None and i in o})
    assert sorted(map(tuple, funnel.contained(inner, outer).collect())) == want and want
    made = spark.createDataFrame(list(enumerate(domains)), "id long, domain string")
    hit = {i for i, d in enumerate(domains) if d is not None and any(x is not None and (x in d or d in x) for x in listed)}
    for blocked, ids in ((True, hit), (False, set(range(len(domains))) - hit)):
        got = funnel.domain_blocklist(made, inner.toDF("listed"), blocked)
        assert {r.id for r in got.collect()} == ids and got.columns == ["id", "domain"]
    plan = funnel.domain_blocklist(made, inner.toDF("listed"), True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert funnel.domain_blocklist(made, inner.limit(0).toDF("listed"), True).count() == 0
    assert funnel.domain_blocklist(made, spark.createDataFrame([("",)], "listed string"), True).count() == len(domains) - 1


class Tree(HTMLParser):
    """A page as a tree, the plain way: each element gets every piece of text while it is open."""

    def __init__(self):
        super().__init__()
        self.up, self.all = [], []

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [x[:2] for x in self.up], [])
        self.all.append(node)
        if tag not in funnel._Page.VOID:
            self.up.append(node)

    def handle_endtag(self, tag):
        at = max((i for i, x in enumerate(self.up) if x[0] == tag), default=None)
        self.up = self.up if at is None else self.up[:at]

    def handle_data(self, data):
        for node in self.up:
            node[3].append(data)


def test_pages_against_trees(spark):
    draw = random.Random(3)
    bits = ["<div>", "</div>", "<div id='newsct_article'>", "<h2 id=title_area>", "</h2>", "<span>", "</span>", "<title>T", "</title>", "<p>", "</p>", "<div id=summary_info>", "<h4 class='x h_sub sub_tit7'>", "</h4>", "<em>", "</em>",
            "<a>", "</a>", "<div class='description b'>", "<img alt=K>", "<br>", " one ", "two", "&lt;", "</b>"]
    pages = ["".join(draw.choice(bits) for _ in range(draw.randrange(0, 60))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(pages)), "id long, html string").select("id", funnel.html_title("html").alias("title"), funnel.html_article_body("html").alias("body"), funnel.html_stock_facts("html").alias("f"))
    for row in got.collect():
        tree = Tree()
        tree.feed(pages[row.id])
        tree.close()
        classes = lambda a: set((a.get("class") or "").split())
        first = lambda test: next((n[3] for n in tree.all if test(n)), [])
        span = "".join(first(lambda n: n[0] == "span" and any(t == "h2" and a.get("id") == "title_area" for t, a in n[2]))).strip()
        assert row.title == (span or "".join(first(lambda n: n[0] == "title")).strip() or None)
        assert row.body == ("\n".join(x.strip() for x in first(lambda n: n[0] == "div" and n[1].get("id") == "newsct_article") if x.strip()) or None)
        image = lambda n: n[0] == "img" and any("description" in classes(a) for _, a in n[2])
        assert row.f.market == next((n[1].get("alt") for n in tree.all if image(n)), None)
        link = lambda n: n[0] == "a" and any(t == "em" for t, _ in n[2]) and any(t == "h4" and {"h_sub", "sub_tit7"} <= classes(a) for t, a in n[2])
        assert row.f.industry == ("".join(first(link)).strip() or None)
        paragraphs = [n[3] for n in tree.all if n[0] == "p" and any(a.get("id") == "summary_info" for _, a in n[2])]
        assert row.f.summary == ("\n".join("".join(x).strip() for x in paragraphs) or None)


def test_deep_pages_are_linear():
    wanted = {"body": (funnel._is("div", "newsct_article"), ())}

    def seconds(n):
        page = "<div id='newsct_article'>" + "<b><i>x" * n + "</u></i>" * n + "<img>" * n
        began = time.perf_counter()
        assert len(funnel._parse(page, wanted).first("body")) == n
        return time.perf_counter() - began

    seconds(1_000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.02)  # ten times the page; a square would be a hundred


def test_title_keeps_references_that_were_cut(spark):
    """A title that ends in the middle of a reference is read as its SQL reads it: only whole references are decoded."""
    pages = ["<title>a&amp;&lt;b&gt; &quot;c&#39;&amp</title>", "<title>x&&&amp;&amp;&am</title>", '<meta property="og:title" content="Q&amp;A &lt"><title>t</title>']
    got = spark.createDataFrame(list(enumerate(pages)), "id long, html string").select("id", funnel.html_title("html").alias("title"))
    assert [r.title for r in got.orderBy("id").collect()] == ["a&<b> \"c'&amp", "x&&&&&am", "Q&A &lt"]
