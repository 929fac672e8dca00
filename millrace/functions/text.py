"""Column functions on texts, urls and labels (2.B). Null texts give what each function says."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What cleaning removes, in order; white space and dots as in Unicode text.
REMOVED = (
    r"\(.*?\)|\[.*?\]|\{.*?\}|<.*?>",
    r"\S*@\S*",
    r"http\S+|www\S+",
    r"\S*=\S*",
    r"[가-힣]{2,4}\s?(기자|특파원)",
    r"(연합뉴스|뉴스1|뉴시스|조선일보|중앙일보|동아일보|한겨레|한국일보|서울경제|매일경제|머니투데이|한국경제|경향신문|헤럴드경제|아시아경제|이데일리|데일리안|세계일보|국민일보|뉴스핌|파이낸셜뉴스)",
    r"(무단전재\s*및\s*재배포\s*금지|저작권자[^.,\n]+|Copyright\s*ⓒ[^.,\n]+|끝\)|끝$)",
    r"(사진\s*=\s*[^.,\n]+|관련기사|주요뉴스|이 시각 뉴스)[^.\n]*",
    r"※.*|▶.*|★.*",
)
#: Fixed value: characters that cleaned texts keep.
KEPT = r"[^A-Za-z0-9가-힇.,\"'\:\·\!\?\-\%\~\&]"
# Words of sport news; letters among them are compared in small letters, so KBO never is found.
SPORTS = ("야구", "농구", "축구", "골프", "e스포츠", "KBO")
SPORT_CONTEXT = ("경기", "시즌", "우승", "패배", "리그", "순위", "스코어")
# Lengths from which texts get more keywords, and how many.
KEYWORD_COUNTS = ((700, 3), (2300, 4), (4500, 5), (None, 6))
# What tells a failure that no retry mends.
PERMANENT = ("invalid input syntax", "undefined column", "does not exist", "enum", "schema")
# Parts of a reason and the labels they get; the first that occurs counts.
CURSOR_REASONS = (
    ("format", "invalid_format"), ("missing", "missing_fields"), ("type", "invalid_types"), ("version", "unsupported_version"), ("limit", "limit_mismatch"),
    ("request_id", "request_id_mismatch"), ("session", "session_not_found"), ("force_refresh", "force_refresh_with_cursor"),
)
SENTIMENTS = ("긍정", "중립", "부정")
JAVA = "(?Ud)"


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """All named and numbered entities of HTML."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def url_domain(url: Column) -> Column:
    """B1: host and port without any "www."; 'unknown' for null or empty urls, empty where there is no host."""
    host = F.replace(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1), F.lit("www."), F.lit(""))
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("unknown")).otherwise(host)


def normalize_title(title: Column) -> Column:
    """White space as single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " "))


def is_truncated(title: Column) -> Column:
    """Ends in dots; null is not."""
    clean = normalize_title(title)
    return clean.endswith("...") | clean.endswith("…")


def clean_text(text: Column) -> Column:
    """Unescaped, without captions, bylines, addresses and odd characters; null is empty."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.contains(text, F.lit("&")), unescape_html(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)
    for pattern in REMOVED:
        # A token is looked at once, from where it starts or the match before it ended, and only
        # where the sign occurs: else long unbroken texts would be tried from every character.
        if pattern.startswith(r"\S*"):
            once = F.regexp_replace(text, JAVA + r"(?:\G|(?<!\S))" + pattern, "")
            text = F.when(F.contains(text, F.lit(pattern[3])), once).otherwise(text)
        else:
            text = F.regexp_replace(text, JAVA + pattern, "")
    text = F.regexp_replace(text, KEPT, " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def keep_script_sentences(text: Column, script: str = "[가-힣]") -> Column:
    """The sentences, between full stops, in which a character of the script occurs."""
    parts = F.transform(F.split(text, r"\."), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    kept = F.filter(parts, lambda s: (s != "") & s.rlike(script))
    return F.concat(F.array_join(kept, ". "), F.when(F.size(kept) > 0, ".").otherwise(""))


def is_sports(text: Column, sports=SPORTS, context=SPORT_CONTEXT, least: int = 3) -> Column:
    """One of the sports and at least so many of the context words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda w: F.contains(low, F.lit(w))
    any_of = F.lit(False)
    for w in sports:
        any_of = any_of | has(w)
    return any_of & (sum((has(w).cast("int") for w in context), F.lit(0)) >= least)


def is_short(text: Column, most: int = 20) -> Column:
    """At most so many characters."""
    return F.char_length(text) <= most


def content_hash(text: Column) -> Column:
    """md5 without blanks and line breaks; '' for null."""
    return F.when(text.isNull(), "").otherwise(F.md5(F.translate(text, " \n\r\t", "")))


def failure(message: Column) -> Column:
    """(status, reason) of an error message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    permanent = F.lit(False)
    for mark in PERMANENT:
        permanent = permanent | F.contains(low, F.lit(mark))
    reason = F.when(F.coalesce(message, F.lit("")) == "", F.lit("refinement_error")).otherwise(F.substring(message, 1, 100))
    return F.struct(F.when(permanent, F.lit("failed_permanent")).otherwise(F.lit("failed_retryable")).alias("status"), reason.alias("reason"))


def chunk_text(most: int = 3000):
    """A pandas UDF that cuts texts after the last full stop in the first ``most`` characters, or hard after one more."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pd.Series) -> pd.Series:
        def cut(text):
            if text is None or len(text) <= most:
                return None if text is None else [text]
            out, at = [], 0
            while at < len(text):
                if len(text) - at <= most:
                    out.append(text[at:])
                    break
                stop = text.rfind(".", at, at + most)
                stop = at + most if stop < 0 else stop
                out.append(text[at : stop + 1])
                at = stop + 1
                text = text.rstrip() if len(out) == 1 else text
                while at < len(text) and text[at].isspace():
                    at += 1
            return out

        return texts.map(cut)

    return chunks


def target_keyword_count(text: Column) -> Column:
    """How many keywords a text gets."""
    n = F.char_length(text)
    out = None
    for below, count in KEYWORD_COUNTS[:-1]:
        out = (F if out is None else out).when(n < below, count)
    return out.otherwise(KEYWORD_COUNTS[-1][1])


def verify_keywords(keywords: Column, text: Column, most: Column) -> Column:
    """The sorted distinct keywords that the text has, white space aside, the first ``most``."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    whole = bare(text)
    return F.slice(F.sort_array(F.array_distinct(F.filter(keywords, lambda k: F.contains(whole, bare(k))))), F.lit(1), most)


def count_term_matches(text: Column, terms) -> Column:
    """How many of the distinct terms occur; 0 for a null or blank text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    wanted = sorted({t.strip().lower() for t in terms if t and t.strip()})
    return sum((F.contains(low, F.lit(t)).cast("int") for t in wanted), F.lit(0))


def embedding_input(text: Column, most: int = 3000) -> Column:
    """What an encoder is given; null for texts under 10 characters."""
    return F.when(F.char_length(text) >= 10, F.substring(text, 1, most))


def parse_vector(text: Column) -> Column:
    """B33: "[0.1,0.2]" as numbers; blanks are skipped, null and empty ones are []."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\[|\]\s*$", "")
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("double"))


def to_kst(ts: Column) -> Column:
    """Korean time of a time in UTC."""
    return F.from_utc_timestamp(ts, "Asia/Seoul")


def window_label(start: Column, end: Column) -> Column:
    """The name of a processing window."""
    return F.concat(F.date_format(start, "yyyyMMddHHmm"), F.lit("_"), F.date_format(end, "yyyyMMddHHmm"))


def context_hash(json: Column) -> Column:
    """16 digits of the sha256 of canonical JSON."""
    return F.substring(F.sha2(json, 256), 1, 16)


def clean_label(value: Column) -> Column:
    """At most 64 characters of a label's alphabet; 'none' for nothing."""
    raw = F.substring(F.when(F.coalesce(value, F.lit("")) == "", F.lit("none")).otherwise(value), 1, 64)
    clean = F.btrim(F.regexp_replace(raw, r"[^a-zA-Z0-9_.:-]+", "_"), F.lit("_"))
    return F.when(clean == "", F.lit("none")).otherwise(clean)


def cursor_reason(reason: Column) -> Column:
    """The label of a cursor error."""
    low, out = F.lower(reason), None
    for part, label in CURSOR_REASONS:
        out = (F if out is None else out).when(F.contains(low, F.lit(part)), label)
    return out.otherwise("invalid_cursor")


def stable_bucket(experiment: Column, user: Column, modulo: int) -> Column:
    """the first 16 digits of a sha256 as a number, modulo."""
    digits = F.substring(F.sha2(F.concat_ws(":", experiment, user.cast("string")), 256), 1, 16)
    return (F.conv(digits, 16, 10).cast("decimal(20,0)") % modulo).cast("int")


def public_path(path: Column) -> Column:
    """The code of an arm; other names in capitals."""
    known = {"onboarding": "A1", "behavior": "A2", "breaking": "B", "popular": "C", "latest": "LATEST", "random": "RANDOM"}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.lower(path)], F.upper(path))
