"""The text funnel (2.B, 2.C): duplicates, refinement, mentions, enrichment and the last filter."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as t

# Endings that may follow a name, and particles that may follow those.
SUFFIXES = ("그룹", "팀", "연구소", "노조", "본부", "직원")
PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "와", "과", "로", "으로", "에", "에서", "에게", "까지", "부터", "만", "도")
SUFFIX = f"(?:{'|'.join(SUFFIXES)})?"
PARTICLE = f"(?:{'|'.join(PARTICLES)})?"


#: Letters of a key of the substring index, and the rows that one key's inner side is copied to against hot keys.
GRAM, SALTS = 4, 8


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): every pair of the distinct, non-null strings of both frames' one column where outer holds inner.

    Each inner string is looked for by one key: itself where it is shorter than a gram, else that of its grams that the
    fewest outer strings hold. Pairs with equal keys are compared in full. Keys are spread over salts, so a key that most
    outer strings hold meets its few inner strings in several tasks. Only the numbers 0 to GRAM come to the driver.
    """
    inner, outer = inner.toDF("inner").na.drop().distinct(), outer.toDF("outer").na.drop().distinct()
    size = F.least(F.char_length("inner"), F.lit(GRAM))
    sizes = sorted(r.n for r in inner.select(size.alias("n")).distinct().collect())

    def grams(text: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.char_length(text) - n + 1)
        return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    all_ = F.concat(F.array().cast("array<string>"), *[F.array(F.lit("")) if n == 0 else grams(F.col("outer"), n) for n in sizes])
    index = outer.select("outer", F.explode(all_).alias("key"))
    held = index.filter(F.char_length("key") == GRAM).groupBy("key").agg(F.count("*").alias("n"))
    short = inner.filter(size < GRAM).select("inner", F.col("inner").alias("key"))
    asked = inner.filter(size == GRAM).select("inner", F.explode(grams(F.col("inner"), GRAM)).alias("key")).join(held, "key", "left")
    rare = asked.groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))["key"].alias("key"))
    keys = short.unionByName(rare).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = index.withColumn("salt", F.pmod(F.xxhash64("outer"), F.lit(SALTS)).cast("int")).join(keys, ["key", "salt"])
    return pairs.filter(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def domain_blocklist(rows: DataFrame, domains: DataFrame, blocked: bool) -> DataFrame:
    """B2: rows whose ``domain`` holds a listed one or is part of one, or the others, for lists of any length.

    Distinct domains are compared, not rows, by equal grams instead of all with all. An empty domain is part of every
    listed one, an empty listed one blocks every domain; a null domain is not blocked and a null listed one blocks none.
    """
    said, listed = rows.select("domain"), domains.select("listed")
    found = contained(listed, said).select(F.col("outer").alias("domain")).unionByName(contained(said, listed).select(F.col("inner").alias("domain"))).distinct()
    return rows.join(found, "domain", "left_semi" if blocked else "left_anti").select(rows.columns)


def exact_domain_block(rows: DataFrame, domains: list[str]) -> DataFrame:
    """Rows of other domains."""
    return rows.filter(~F.col("domain").isin(domains))


class _Page(HTMLParser):
    """One pass over a page: the wanted elements with their place in one list of text pieces, and meta values.

    ``wanted`` names a test (tag, attributes) of an element and the marks that must be open around it; ``marks`` names
    the tests of those. Marks are counted and open elements found by their tag, so the work is linear in the page.
    """

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, wanted, marks=None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.marks = wanted, marks or {}
        self.open, self.by_tag, self.around = [], {}, dict.fromkeys(self.marks, 0)
        self.pieces, self.found, self.meta = [], {k: [] for k in wanted}, {}

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "meta":
            self.meta.setdefault(attrs.get("property") or attrs.get("name"), attrs.get("content"))
        hits = []
        for name, (test, needed) in self.wanted.items():
            if all(self.around[m] for m in needed) and test(tag, attrs):
                hits.append([attrs, len(self.pieces), len(self.pieces) if tag in self.VOID else None])
                self.found[name].append(hits[-1])
        if tag not in self.VOID:
            marks = [m for m, test in self.marks.items() if test(tag, attrs)]
            for m in marks:
                self.around[m] += 1
            self.by_tag.setdefault(tag, []).append(len(self.open))
            self.open.append((tag, marks, hits))

    def handle_endtag(self, tag):
        places = self.by_tag.get(tag)
        if not places:
            return
        for _ in range(len(self.open) - places[-1]):
            closed, marks, hits = self.open.pop()
            self.by_tag[closed].pop()
            for m in marks:
                self.around[m] -= 1
            for hit in hits:
                hit[2] = len(self.pieces)

    def handle_data(self, data):
        self.pieces.append(data)

    def inside(self, hit) -> list[str]:
        """The pieces of text inside a found element; one that was never closed reaches to the end."""
        return self.pieces[hit[1] : hit[2]]

    def first(self, name: str) -> list[str]:
        return self.inside(self.found[name][0]) if self.found[name] else []


def _parse(html: str, wanted: dict, marks: dict | None = None) -> _Page:
    page = _Page(wanted, marks)
    page.feed(html)
    page.close()
    return page


def _is(tag: str | None, id_: str | None = None, classes: str = ""):
    """Whether an element has the tag, the id and all the classes."""
    return lambda t_, a: (tag is None or t_ == tag) and (id_ is None or a.get("id") == id_) and set(classes.split()) <= set((a.get("class") or "").split())


#: An & that begins no reference with a semicolon at its end, such as one in a title that was cut.
PLAIN_AND = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


@F.pandas_udf(T.StringType())
def html_title(html: pd.Series) -> pd.Series:
    """The first title of a page that isn't blank: og:title, twitter:title, the heading's span, <title>; else null.

    References without a semicolon stay as they are.
    """
    wanted, marks = {"title": (_is("title"), ()), "span": (_is("span"), ("area",))}, {"area": _is("h2", "title_area")}

    def one(page):
        if page is None:
            return None
        p = _parse(PLAIN_AND.sub("&amp;", page), wanted, marks)
        text = lambda k: "".join(p.first(k)).strip()
        options = ((p.meta.get("og:title") or "").strip(), (p.meta.get("twitter:title") or "").strip(), text("span"), text("title"))
        return next((o for o in options if o), None)

    return html.map(one)


@F.pandas_udf(T.StringType())
def html_article_body(html: pd.Series) -> pd.Series:
    """The article's text, its parts on lines of their own; null where there is none."""
    wanted = {"body": (_is("div", "newsct_article"), ())}

    def one(page):
        if page is None:
            return None
        return "\n".join(x for x in (p.strip() for p in _parse(page, wanted).first("body")) if x) or None

    return html.map(one)


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("market", "industry", "summary")]))
def html_stock_facts(html: pd.Series) -> pd.DataFrame:
    """Market, industry and summary of a stock's page. Paragraphs inside each other give their text once each."""
    marks = {"description": _is(None, classes="description"), "em": _is("em"), "heading": _is("h4", classes="h_sub sub_tit7"), "info": _is(None, "summary_info")}
    wanted = {"market": (_is("img"), ("description",)), "industry": (_is("a"), ("em", "heading")), "summary": (_is("p"), ("info",))}

    def one(page):
        p = _parse(page or "", wanted, marks)
        market = next((attrs.get("alt") for attrs, _, _ in p.found["market"]), None)
        industry = "".join(p.first("industry")).strip() or None
        summary = "\n".join("".join(p.inside(x)).strip() for x in p.found["summary"]) or None
        return market, industry, summary

    return pd.DataFrame([one(p) for p in html], columns=["market", "industry", "summary"])


def title_backfill(articles: DataFrame, titles: DataFrame, as_of: str, days_back: int, limit: int, offset: int = 0) -> DataFrame:
    """Candidates with cut titles and what becomes of them: (news_id, old_title, new_title, outcome)."""
    cut = F.col("title").like("%...") | F.col("title").like("%…")
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days_back))
    rows = articles.filter(cut & ~F.col("crawl_status").eqNullSafe("url_filtered") & (F.col("api_request_date") >= since))
    rows = rows.orderBy(F.desc("api_request_date"), F.desc("news_id")).offset(offset).limit(limit)
    new = t.normalize_title(F.col("new_title"))
    outcome = F.when(new == "", "failed").when(new == t.normalize_title(F.col("title")), "unchanged").otherwise("updated")
    return rows.join(titles, "news_id", "left").select("news_id", F.col("title").alias("old_title"), new.alias("new_title"), outcome.alias("outcome"))


def dedup_in_batch(rows: DataFrame) -> DataFrame:
    """Adds ``is_first``: the first row of each content hash by (created_at, news_id)."""
    hashed = rows.withColumn("content_hash", t.content_hash(F.col("text")))
    return hashed.withColumn("is_first", F.row_number().over(W.partitionBy("content_hash").orderBy("created_at", "news_id")) == 1)


def dedup_across_runs(rows: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of new hashes, registry with them)."""
    new = rows.join(registry, "content_hash", "left_anti")
    return new, registry.select("content_hash").unionByName(new.select("content_hash").distinct())


def refine(rows: DataFrame, registry: DataFrame, refined: Column, sports: Column, least: int = 10) -> DataFrame:
    """Every row with its ``status`` and ``reason``, the first that holds.

    Empty texts, duplicates in the batch, duplicates of earlier runs, sport or short texts,
    texts too short to encode; the others pass. ``refined`` and ``sports`` are columns of rows.
    """
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    named = rows.withColumns({"refined_text": refined, "content_hash": t.content_hash(F.col("text")), "is_empty": empty, "is_sports": sports})
    first = F.row_number().over(W.partitionBy("is_empty", "content_hash").orderBy("created_at", "news_id"))
    known = named.withColumn("nth", first).join(registry.select("content_hash").distinct().withColumn("known", F.lit(True)), "content_hash", "left")
    cases = (
        (F.col("is_empty"), "filtered_out", "empty_text"), (F.col("nth") > 1, "skipped", "duplicate_in_batch"), (F.col("known").isNotNull(), "skipped", "duplicate_processed"),
        (F.col("is_sports") | t.is_short(F.col("refined_text")), "filtered_out", "sports_or_too_short"), (F.char_length("refined_text") < least, "skipped", "not_selected_for_refinement"),
    )
    status = reason = F
    for condition, s, r in cases:
        status, reason = status.when(condition, s), reason.when(condition, r)
    return known.select("news_id", "refined_text", "content_hash", status.otherwise("passed").alias("status"), reason.otherwise(F.lit(None)).alias("reason"))


def refine_full_refresh(rows: DataFrame, refined: Column, sports: Column) -> DataFrame:
    """(news_id, outcome): kept, or a reason; a row may be trash for two reasons."""
    first = F.row_number().over(W.partitionBy("text").orderBy("news_id"))
    named = rows.withColumn("nth", F.when(F.col("text").isNull(), 2).otherwise(first))
    unique = named.filter("nth = 1").withColumns({"is_sports": sports, "is_short": t.is_short(refined)})
    as_ = lambda frame, name: frame.select("news_id", F.lit(name).alias("outcome"))
    return as_(unique.filter("NOT is_sports AND NOT is_short"), "kept").unionByName(as_(named.filter("nth > 1"), "duplicate_or_nan")).unionByName(as_(unique.filter("is_sports"), "sports_news")).unionByName(as_(unique.filter("is_short"), "short_text"))


def stock_name_map(stocks: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, stock_id): small letters of names and aliases; an alias goes before a name, then the largest id."""
    both = stocks.select(F.lower("stock_name").alias("name"), "stock_id", F.lit(0).alias("rank")).unionByName(aliases.select(F.lower("alias_name").alias("name"), "stock_id", F.lit(1).alias("rank")))
    return both.groupBy("name").agg(F.max(F.struct("rank", "stock_id"))["stock_id"].alias("stock_id"))


def mention_pattern(names: list[str]) -> str:
    """The pattern of B24 for a bounded list of names, longest first."""
    quoted = (rf"\b(?:\Q{n}\E){SUFFIX}(?={PARTICLE}\b)" for n in sorted(names, key=lambda n: (-len(n), n)))
    return "(?iU)" + "|".join(quoted)


def _pieces(text: Column) -> Column:
    """The text in small letters, cut into runs of word characters and the runs between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+|\W+"), F.lit(0))


def _readings(p: Column, size: int, led: bool) -> Column:
    """All (start, last, name, suffixed) that ``size`` neighbours of the pieces may be read as, with and without
    suffix and particle; ``led`` if the first of them is no word. ``last`` is the last piece that a match touches."""
    word = F.when(F.get(p, F.lit(0)).rlike(r"(?U)^\w"), 1).otherwise(2)
    first, stop = word + int(led), F.size(p) - size + 1 - int(led == bool(size % 2))
    places = F.when(first <= stop, F.sequence(first, stop, F.lit(2))).otherwise(F.array().cast("array<int>"))
    joined = lambda i: F.array_join(F.slice(p, i, F.lit(size)), "")
    reading = lambda i, last, name, suffixed: F.struct(i.alias("start"), last.alias("last"), name.alias("name"), suffixed.alias("suffixed"))
    if led == bool(size % 2):  # no word at the end: a word follows, which may be a suffix
        suffixed = lambda i: F.get(p, i + size - 1).rlike(f"^(?:{'|'.join(SUFFIXES)}){PARTICLE}$")
        return F.transform(places, lambda i: reading(i, i + size - 1 + suffixed(i).cast("int"), joined(i), suffixed(i)))
    ends = F.array(*[F.struct(F.lit(s + e).alias("text"), F.lit(s != "").alias("suffixed")) for s in ("", *SUFFIXES) for e in ("", *PARTICLES)])

    def at(i: Column) -> Column:
        run = F.get(p, i + size - 2)
        fits = F.filter(ends, lambda e: run.endswith(e["text"]) & (F.char_length(run) > F.char_length(e["text"])))
        cut = lambda e: F.substring(joined(i), F.lit(1), F.char_length(joined(i)) - F.char_length(e["text"]))
        plain = F.array(reading(i, i + size - 1, joined(i), F.lit(False)))
        return F.when(run.rlike("[가-힣]$"), F.transform(fits, lambda e: reading(i, i + size - 1, cut(e), e["suffixed"]))).otherwise(plain)

    return F.flatten(F.transform(places, at))


def find_stock_mentions(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(news_id, stock_id): names that a text mentions, for any number of names (B23's, each once).

    From left to right the longest name at the start of a word is taken, in any case, if nothing but a suffix, a particle
    or both follow it in its word; the next one begins behind it. A match with a suffix takes its place but counts only
    if it is a name itself. Runs of words are joined with the names by equality; matches that overlap are settled in
    chains of a text. Null and empty texts mention nothing; names without a letter or digit are never found; texts of
    one news_id count together, also of a null one. Only the distinct numbers of runs in names come to the driver.
    """
    known = names.select(F.lower("name").alias("name"), "stock_id").filter(r"name RLIKE '(?U)\\w'")
    shapes = known.select(F.size(_pieces(F.col("name"))).alias("size"), (~F.col("name").rlike(r"(?U)^\w")).alias("led")).distinct().collect()
    if not shapes:
        return rows.join(known, F.lit(False)).select("news_id", "stock_id")
    read = F.transform(F.array(_pieces(F.col("text"))), lambda p: F.concat(*[_readings(p, x["size"], x["led"]) for x in sorted(shapes)]))
    text = ["news_id", "text_key"]
    found = rows.select("news_id", F.xxhash64("text").alias("text_key"), F.explode(F.flatten(read)).alias("m")).select(*text, "m.*").join(known, "name")
    longest = found.groupBy(*text, "start").agg(F.max(F.struct(F.char_length("name").alias("n"), "last", "suffixed", "stock_id")).alias("m")).select(*text, "start", "m.*")
    order = W.partitionBy(*text).orderBy("start")
    before = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    chained = longest.withColumn("free", (F.col("start") > F.coalesce(before, F.lit(0))).cast("int")).withColumn("chain", F.sum("free").over(order))
    none = F.struct(F.lit(0).alias("last"), F.array().cast(f"array<{known.schema['stock_id'].dataType.simpleString()}>").alias("ids"))

    def take(done: Column, m: Column) -> Column:
        ids = F.when(m["suffixed"], done["ids"]).otherwise(F.concat(done["ids"], F.array(m["stock_id"])))
        return F.when(m["start"] > done["last"], F.struct(m["last"].alias("last"), ids.alias("ids"))).otherwise(done)

    links = chained.groupBy(*text, "chain").agg(F.array_sort(F.collect_list(F.struct("start", "last", "suffixed", "stock_id"))).alias("ms"))
    return links.select("news_id", F.explode(F.aggregate("ms", none, take)["ids"]).alias("stock_id")).distinct()


def validate_stock_names(reported: DataFrame, names: DataFrame) -> DataFrame:
    """(news_id, pos, stock_id) of reported names, each stock at its first place."""
    rows = reported.select("news_id", F.posexplode("related_stocks").alias("pos", "n")).withColumn("name", F.lower(F.trim("n")))
    return rows.join(names, "name").groupBy("news_id", "stock_id").agg(F.min("pos").alias("pos"))


ANSWER = "summary: string, sentiment: string, keywords: array<string>, related_stocks: array<string>"


def parse_enrichment(answers: DataFrame) -> DataFrame:
    """Adds summary, sentiment, keywords and related_stocks from raw JSON: an object, the first of a list, or nested."""
    body = F.when(F.ltrim("raw").startswith("["), F.get_json_object("raw", "$[0]")).otherwise(F.col("raw"))
    nested = ", ".join(f"{name}: struct<{ANSWER}>" for name in ("analysis", "result", "data"))
    rows = answers.withColumn("a", F.from_json(body, f"struct<{ANSWER}, {nested}>"))
    said = lambda s: (F.coalesce(F.col(f"{s}.summary"), F.lit("")) != "") | (F.coalesce(F.col(f"{s}.sentiment"), F.lit("")) != "")
    pick = lambda c: F.when(said("a"), F.col(f"a.{c}")).when(said("a.analysis"), F.col(f"a.analysis.{c}")).when(said("a.result"), F.col(f"a.result.{c}")).when(said("a.data"), F.col(f"a.data.{c}")).otherwise(F.col(f"a.{c}"))
    clean = lambda c: F.trim(F.coalesce(pick(c), F.lit("")))
    sentiment = clean("sentiment")
    return rows.select(*answers.columns, clean("summary").alias("summary"), F.when(sentiment.isin(*t.SENTIMENTS), sentiment).otherwise("").alias("sentiment"), pick("keywords").alias("keywords"), pick("related_stocks").alias("related_stocks"))


def enrichment_outcome(parsed: DataFrame, articles: DataFrame) -> DataFrame:
    """The first valid answer of each article, else a fallback with its failure. ``parsed`` has news_id, attempt, raw and B26's columns."""
    valid = (F.col("summary") != "") & (F.col("sentiment") != "")
    best = parsed.filter(F.col("raw").isNotNull()).groupBy("news_id").agg(F.max(F.struct(valid.alias("ok"), F.when(valid, -F.col("attempt")).otherwise(F.col("attempt")).alias("o"), "summary", "sentiment")).alias("b"))
    joined = articles.join(best, "news_id", "left")
    text = F.trim(F.coalesce("text", F.lit("")))
    fallback = F.when(text != "", F.substring(text, 1, 220)).otherwise("요약 생성 실패")
    ok, had = F.coalesce(F.col("b.ok"), F.lit(False)), F.col("b").isNotNull()
    return joined.select(
        "news_id", F.when(ok, F.col("b.summary")).otherwise(fallback).alias("summary"), F.when(ok, F.col("b.sentiment")).otherwise("중립").alias("sentiment"),
        F.when(~ok, F.when(had, "failed_permanent").otherwise("failed_retryable")).alias("status"),
        F.when(~ok, F.when(had, "invalid_analysis_format").otherwise("gemini_api_no_response")).alias("reason"),
    )


def explode_enrichment(parsed: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stocks, keywords and analysis of parsed answers."""
    keywords = parsed.select("news_id", F.explode("keywords").alias("keyword")).filter("keyword IS NOT NULL").distinct()
    return validate_stock_names(parsed, names), keywords, parsed.select("news_id", "summary", "sentiment")


def post_filter(refined: DataFrame, stocks: DataFrame, include, exclude, least: int = 3, most: int = 0) -> DataFrame:
    """Ids of articles that stay: mapped to a stock, or with enough wanted and few unwanted terms. Without wanted terms all stay."""
    if not include:
        return refined.select("news_id")
    mapped = refined.join(stocks.select("news_id").distinct(), "news_id", "left_semi").select("news_id")
    rest = refined.join(stocks.select("news_id").distinct(), "news_id", "left_anti")
    return mapped.unionByName(rest.filter((t.count_term_matches(F.col("text"), include) >= least) & (t.count_term_matches(F.col("text"), exclude) <= most)).select("news_id"))


def registry_update(day: DataFrame, registry: DataFrame) -> DataFrame:
    """(keyword, vector): the registry with the day's keywords that it lacks."""
    return registry.unionByName(day.dropDuplicates(["keyword"]).join(registry, "keyword", "left_anti").select(registry.columns))


def target_news(rows: DataFrame) -> DataFrame:
    """Rows that may be worked on."""
    return rows.filter(F.col("filter_status").isin("pending", "failed_retryable", "processing"))


def status_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by status."""
    return rows.groupBy(*keys, "filter_status").count()
