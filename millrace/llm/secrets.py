"""Secret scans: fixed patterns plus sliding-window entropy.

The patterns give the base spans. Around them, candidate strings (long runs of one
character class that mix letters and digits) are scanned by a window: its Shannon
entropy follows from counts of the class's characters, of which a step changes two.
A candidate whose highest window entropy reaches the class's threshold is a span,
unless the allow-list names it or that window, or a base span covers part of it. All of it happens
inside a row, in SQL functions, without a shuffle.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group that is measured, its least length; in order of kinds.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: A run that passes has at least so many characters; for these kinds the pattern may ask for them
#: itself, since a shorter run is no match of either form and hides none.
LONG_RUN = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: Character classes of candidates: kind, alphabet, pattern, what a candidate must have, window, bits a
#: character from which a window counts. A candidate is a whole run of letters, digits and joining signs.
CLASSES = (
    ("entropy_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"(?<![A-Za-z0-9+/_-])[A-Z0-9]{20,}+(?![a-z+/_-])", ("[0-9]", "[A-Z]"), 20, 3.6),
    ("entropy_lower", "abcdefghijklmnopqrstuvwxyz0123456789", r"(?<![A-Za-z0-9+/_-])[a-z0-9]{24,}+(?![A-Z+/_-])", ("[0-9]", "[a-z]"), 24, 4.0),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+", ("[0-9]", "[a-z]", "[A-Z]"), 24, 4.0),
)
#: What lets a candidate pass as a whole: placeholders as words of their own, one repeated group, paths and identifiers of several words.
ALLOWED_RUN = (
    r"(?i)(?<![a-z])(example|sample|dummy|placeholder|changeme|redacted|test)(?![a-z])",
    r"^(.{1,8})\1++$",
    r"^[A-Za-z]++(?:[/_-][A-Za-z]++)++[0-9]{0,4}$",
)
#: What lets a window pass: placeholders and counting strings inside it.
ALLOWED_WINDOW = (
    r"(?i)(example|sample|dummy|placeholder|changeme|redacted|xxxx|test)",
    r"(?i)(0123456789|1234567890|abcdefghij)",
)
#: Counts of a window are held in numbers of so many bits each, so many in one 64-bit number.
COUNT_BITS, COUNTS = 5, 12


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    """Spans of the pattern's matches: structs (start, end, value), code points, end exclusive.

    What lies between matches has its length from ``split``, which cuts at the same places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)").alias("spans"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["found"])).alias("at"),
        F.concat(
            acc["spans"],
            F.array(F.struct((acc["at"] + F.char_length(x["gap"])).alias("start"), (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["found"])).alias("end"), x["value"].alias("value"))),
        ).alias("spans"),
    )
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found"), values.alias("value")), lambda x: x["found"].isNotNull())
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(zipped, zero, step)["spans"]).otherwise(none)


def windows(value: Column, alphabet: str, window: int) -> Column:
    """(best, at): the highest Shannon entropy, in bits a character, of the windows of a string over
    the alphabet, and where the first such window starts, from 0.

    With counts c the entropy is log2(n) - sum(c log2 c) / n. A step of the window counts one
    character up and one down: it changes two counts, held in a few packed numbers, and the
    sum by their parts alone. A string shorter than the window has 0.
    """
    words = -(-len(alphabet) // COUNTS)
    part = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(value, ""), lambda ch: F.position(ch, F.lit(alphabet)) - 1)
    gone = F.concat(F.array_repeat(F.lit(-1), window), codes)
    steps = F.filter(F.arrays_zip(codes.alias("new"), gone.alias("old")), lambda x: x["new"].isNotNull() & (x["new"] >= 0))
    packed = {f"c{i}": F.lit(0).cast("long") for i in range(words)}
    start = F.struct(F.lit(0).alias("n"), *[c.alias(k) for k, c in packed.items()], F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        def held(code: Column) -> Column:
            number = F
            for i in range(words):
                number = number.when(F.floor(code / COUNTS) == i, acc[f"c{i}"])
            shifted = F.call_function("shiftrightunsigned", number.otherwise(F.lit(0).cast("long")), ((code % COUNTS) * COUNT_BITS).cast("int"))
            return shifted.bitwiseAND((1 << COUNT_BITS) - 1).cast("int")

        def one(code: Column, i: int) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), ((code % COUNTS) * COUNT_BITS).cast("int"))
            return F.when((code >= 0) & (F.floor(code / COUNTS) == i), bit).otherwise(F.lit(0).cast("long"))

        new, old = x["new"], x["old"]
        up = F.get(part, held(new) + 1) - F.get(part, held(new))
        down = F.when(old >= 0, F.get(part, held(old) - 1) - F.get(part, held(old))).otherwise(0.0)
        total = acc["sum"] + F.when(new == old, 0.0).otherwise(up + down)
        n = acc["n"] + 1
        # Sums of the same counts in another order differ in their last bits.
        entropy = F.round(F.when(n >= window, math.log2(window) - total / window).otherwise(0.0), 9)
        better = entropy > acc["best"]
        counts = [(acc[f"c{i}"] + one(new, i) - one(old, i)).alias(f"c{i}") for i in range(words)]
        return F.struct(n.alias("n"), *counts, total.alias("sum"), F.when(better, entropy).otherwise(acc["best"]).alias("best"), F.when(better, n - window).otherwise(acc["at"]).alias("at"))

    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["best"].alias("best"), acc["at"].alias("at")))


def scan(docs: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
    """Adds ``out``, the spans of secrets in the whole text: structs (start, ord, kind, end), sorted.

    Kinds are those of BASE, then of CLASSES. A null or empty text has none. Matches of a
    kind are leftmost and don't overlap; base spans of different kinds may. An added span
    overlaps no base span. A column named like ``out`` is replaced, all others stay. Repeated
    rows are scanned each for itself, and an empty table gives none. Finding n spans in one text costs n squared small steps at most.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = [kind for kind, *_ in (*BASE, *CLASSES)]

    def labelled(spans: Column, kind: str) -> Column:
        of = (F.lit(kinds.index(kind)).alias("ord"), F.lit(kind).alias("kind"))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), *of, s["end"].alias("end")))

    def long_enough(kind: str, pattern: str, group: int, least: int) -> Column:
        return F.filter(matched(whole, LONG_RUN.get(kind, pattern), group), lambda s: F.char_length(s["value"]) >= least)

    def random_enough(base: Column, alphabet: str, pattern: str, has: tuple, window: int, bits: float) -> Column:
        def kept(s: Column) -> Column:
            value = s["value"]
            fit = ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
            for some in has:
                fit = fit & F.rlike(value, F.lit(some))
            for allow in ALLOWED_RUN:
                fit = fit & ~F.rlike(value, F.lit(allow))
            # One round over a single element binds the best window for both tests.
            found = F.transform(F.array(windows(value, alphabet, window)), lambda w: (w["best"] >= bits) & ~reduce(or_, [F.rlike(F.substr(value, w["at"] + 1, F.lit(window)), F.lit(a)) for a in ALLOWED_WINDOW]))
            return F.when(fit, found[0]).otherwise(False)

        return F.filter(matched(whole, pattern), kept)

    base = F.concat(*[labelled(long_enough(*rule), rule[0]) for rule in BASE])
    held = docs.withColumn(out, base)  # out holds the base spans first: no column of another name is touched
    added = [labelled(random_enough(F.col(out), *rule), kind) for kind, *rule in CLASSES]
    return held.withColumn(out, F.array_sort(F.concat(F.col(out), *added)))


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "<secret>") -> DataFrame:
    """Replaces every span in the text by the mask; overlapping spans become one. Other texts and all other columns stay as they are."""
    out = "found"
    while out in docs.columns:
        out += "_"
    found = scan(docs, text, out)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], F.array(gap, F.lit(mask)))).otherwise(acc["parts"]).alias("parts"))

    done = F.aggregate(out, start, step)
    clean = F.concat(F.array_join(done["parts"], ""), F.substr(F.col(text), done["at"] + 1, F.char_length(F.col(text))))
    return found.withColumn(text, F.when(F.size(out) > 0, clean).otherwise(F.col(text))).drop(out)
