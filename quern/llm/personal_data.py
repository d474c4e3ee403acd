"""Personal data in whole texts, with DataFrame functions only.

Base spans come from fixed patterns with checks. Around them a bootstrapped contextual extraction runs: base spans are
the seeds, the words before a seed or an identifier-like token are its lexical pattern, and pattern and instance scores
are computed in turns over the pattern-instance graph. Tokens in patterns of high confidence become spans of the kind "id".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import materialise

#: Kinds in order. Possessive and anchored forms of the stated patterns: the same matches, without retries inside a run.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*_PATTERNS, "id"]
#: Which texts can hold a kind at all.
_HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: An identifier-like token: at least 6 letters, digits, hyphens or underscores with a digit among them.
_TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
#: A pattern's words are looked for in so many code points before a match.
_REACH = 100
#: Code points of a text that are redacted at once.
_CHUNK = 512


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, as a lambda's argument."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _luhn(digits: Column) -> Column:
    def add(total: Column, x: Column) -> Column:
        return total + x

    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    reversed_ = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int"))
    return F.aggregate(F.transform(reversed_, lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d)), F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return _once(digits, lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _running(values: Column, add) -> Column:
    """The folds of the first 1, 2, ... whole numbers by an associative `add` that 0 is neutral to. In blocks of about the
    square root of their number, so that long arrays are not copied for each element."""
    none, last = F.array().cast("array<int>"), lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    step = lambda a, x: F.concat(a, F.array(add(last(a), x)))

    def scan(v: Column, width: Column) -> Column:
        block = lambda i: F.transform(F.sequence(i * width, F.least((i + 1) * width, F.size(v)) - 1), lambda k: F.get(v, k))
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda i: F.aggregate(block(i), none, step))
        return _once(blocks, lambda b: _once(F.aggregate(b, none, lambda a, x: step(a, last(x))), lambda tops: F.flatten(F.transform(b, lambda own, i: F.transform(own, lambda x: add(F.coalesce(F.get(tops, i - 1), F.lit(0)), x))))))

    return _once(values, lambda v: F.when(F.size(v) == 0, none).otherwise(_once(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda width: scan(v, width))))


def _before(values: Column, test) -> Column:
    """How many of sorted values pass a test that holds for a first part of them: a binary search."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        open_, more = at["low"] < at["high"], test(F.get(values, middle))
        return F.struct(F.when(open_ & more, middle + 1).otherwise(at["low"]).alias("low"), F.when(open_ & ~more, middle).otherwise(at["high"]).alias("high"))

    return F.when(F.size(values) == 0, 0).otherwise(F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), halve, lambda at: at["low"]))


def _context(before: Column) -> Column:
    """The last two words that hold a letter or digit, in lower case, digits as 0."""
    words = F.regexp_extract_all(F.lower(before), F.lit(r"[^\s\p{L}\p{N}]*+[\p{L}\p{N}]\S*+"), F.lit(0))
    return F.regexp_replace(_once(words, lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)), " ")), "[0-9]+", "0")


def _chunks(text: Column, size: int) -> Column:
    """The text in pieces of so many code points."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))


def _matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """(start, kind, end, value) of all matches that `keep` holds for, in code points: the lengths of matches and of what
    lies between them add up."""

    def place(m: Column, good: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        ends = _running(F.zip_with(gaps, m, lambda gap, x: F.length(gap) + F.length(x)), lambda a, x: a + x)
        span = lambda e, k, x: F.struct((F.get(e, k) - F.length(x)).alias("start"), F.lit(kind).alias("kind"), F.get(e, k).alias("end"), F.xxhash64(x).alias("value"))
        return _once(ends, lambda e: F.transform(good, lambda k: span(e, k, F.get(m, k))))

    def found(m: Column) -> Column:
        kept = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda k: keep(F.get(m, k)))
        return F.when(F.size(m) > 0, _once(kept, lambda good: F.when(F.size(good) > 0, place(m, good))))

    return F.coalesce(_once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found), F.array().cast("array<struct<start:int,kind:int,end:int,value:bigint>>"))


def _scan(text: Column) -> Column:
    """Base spans by start and kind, then the identifier-like tokens that overlap none, with their contexts."""

    def of(kind: str) -> Column:
        maybe = text.contains(_HINTS[kind]) & (F.lit(True) if kind == "email" else text.rlike("[0-9]"))
        return _matches(F.when(maybe, text).otherwise(""), _PATTERNS[kind], KINDS.index(kind), lambda m: _holds(kind, m))

    def unseen(base: Column) -> Column:
        tokens = _matches(F.when(text.rlike("[0-9]"), text).otherwise(""), _TOKEN, KINDS.index("id"), lambda _: F.lit(True))
        free = lambda t, reach: F.coalesce(F.get(reach, _before(base, lambda s: s["start"] < t["end"]) - 1) <= t["start"], F.lit(True))
        return _once(_running(base["end"], F.greatest), lambda reach: F.filter(tokens, lambda t: free(t, reach)))

    def seen(c: Column, s: Column) -> Column:
        at = F.floor(s["start"] / _REACH).cast("int")
        near = F.concat(F.coalesce(F.get(c, at - 1), F.lit("")), F.coalesce(F.get(c, at), F.lit("")))
        first = F.greatest(s["start"] - _REACH, F.lit(0))
        before = F.substring(near, first - F.greatest(at - 1, F.lit(0)) * _REACH + 1, s["start"] - first)
        return F.struct(s["start"], s["kind"], s["end"], s["value"], _context(before).alias("context"))

    base = F.sort_array(F.concat(*map(of, _PATTERNS)))
    with_contexts = lambda spans: _once(_chunks(text, _REACH), lambda c: F.transform(spans, lambda s: seen(c, s)))
    spans = _once(base, lambda b: F.concat(b, unseen(b)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:bigint,context:string>>")
    return _once(spans, lambda x: F.when(F.size(x) > 0, with_contexts(x)).otherwise(none))


def _learn(tokens: DataFrame, rounds: int, confidence: float, support: int) -> DataFrame:
    """Contexts of high confidence, by turns: a pattern's confidence is the mean of its instances' scores, smoothed; an
    unseen instance's score is that of the best supported pattern it occurs in; seeds keep score 1. A pattern is supported
    by its seeds and by the instances that the turn before accepted, as their score reached `confidence`."""
    edges = materialise(tokens.where("context != ''").groupBy("context", "value").agg(F.max(F.col("seed").cast("int")).alias("seed")))
    seeds = materialise(edges.groupBy("value").agg(F.max("seed").cast("double").alias("score")))
    scores = seeds
    for turn in range(rounds):
        backing = F.sum((F.col("score") >= confidence).cast("long"))
        told = edges.join(scores, "value").groupBy("context").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), backing.alias("backing"))
        patterns = materialise(told)
        if turn == rounds - 1:
            break
        heard = edges.join(patterns.where(F.col("backing") >= support), "context").groupBy("value").agg(F.max("confidence").alias("best"))
        scores = materialise(seeds.join(heard, "value", "left").select("value", F.greatest("score", F.coalesce("best", F.lit(0.0))).alias("score")))
    return materialise(patterns.where((F.col("confidence") >= confidence) & (F.col("backing") >= support)).select("context"))


def extract(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 4, carry: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, base and found: arrays of (start, kind, end), kind as the place in KINDS, code points, end exclusive; `carry` adds the row's own columns as the struct `row`.

    base holds emails, ip addresses, cards and phones by the fixed patterns; found adds tokens that follow a pattern with
    at least `support` distinct seeds or accepted instances and a confidence of at least `confidence`, where they overlap no base span. Null and
    empty texts have no spans. Null ids and repeated rows are handled like any others, as rows get numbers of their own.
    An empty table gives an empty result. The texts are scanned once; the result of the scan is written to the shared
    folder and everything after works on it. A text's cost grows with its length, and a little faster (as n sqrt(n), in
    copied numbers) with its matches. A pattern's words lie within 100 code points before the match.
    """
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    own = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    scanned = docs.select(F.monotonically_increasing_id().alias("row_id"), docs[id_column].cast("long").alias("doc_id"), text.alias("text"), *own)
    scanned = materialise(scanned.select("row_id", "doc_id", *(["row"] if carry else []), _scan(F.col("text")).alias("spans")))
    tokens = scanned.select("row_id", F.explode("spans").alias("t")).select("row_id", "t.*")
    tokens = materialise(tokens.withColumn("seed", F.col("kind") < KINDS.index("id")))
    good = _learn(tokens, rounds, confidence, support)
    found = tokens.where(~F.col("seed")).join(good, "context", "left_semi")
    span = F.struct(F.col("start"), F.lit(KINDS.index("id")).alias("kind"), F.col("end"))
    found = found.groupBy("row_id").agg(F.sort_array(F.collect_list(span)).cast(_SPAN).alias("found"))
    out = scanned.join(found, "row_id", "left")
    base = F.transform(F.filter("spans", lambda s: s["kind"] < KINDS.index("id")), lambda s: F.struct(s["start"], s["kind"], s["end"])).cast(_SPAN)
    return out.select("doc_id", base.alias("base"), F.coalesce("found", F.array().cast(_SPAN)).alias("found"), *(["row"] if carry else []))


def said(spans: Column) -> Column:
    """kind:start:end of all spans by start and kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first names them all. The text
    is taken apart once into chunks, each of which finds its spans by a binary search."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def merged(s: Column, reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k)["start"] >= F.get(reach, k - 1)))
        group = lambda h, k, g: F.struct(F.get(s, k)["start"].alias("start"), F.get(reach, F.coalesce(F.get(h, g + 1), F.size(s)) - 1).alias("end"), F.get(names, F.get(s, k)["kind"]).alias("name"))
        return _once(heads, lambda h: F.transform(h, lambda k, g: group(h, k, g)))

    def chunk(groups: Column, x: Column, at: Column) -> Column:
        def written(low: Column, high: Column) -> Column:
            def piece(g: Column) -> Column:
                own = F.get(groups, g)
                start = F.when(g > low, F.get(groups, g - 1)["end"] - at).otherwise(0)
                gap = F.substring(x, start + 1, F.greatest(own["start"] - at - start, F.lit(0)))
                return F.concat(gap, F.when(own["start"] >= at, own["name"]).otherwise(""))

            rest = F.substring(x, F.get(groups, high - 1)["end"] - at + 1, F.lit(_CHUNK))
            return F.when(low >= high, x).otherwise(F.concat(F.array_join(F.transform(F.sequence(low, F.greatest(high - 1, low)), piece), ""), rest))

        first, last = _before(groups, lambda g: g["end"] <= at), _before(groups, lambda g: g["start"] < at + _CHUNK)
        return _once(first, lambda low: _once(last, lambda high: written(low, high)))

    done = lambda groups: F.array_join(F.transform(_chunks(text, _CHUNK), lambda x, i: chunk(groups, x, i * _CHUNK)), "")
    ordered = lambda s: _once(_running(s["end"], F.greatest), lambda reach: _once(merged(s, reach), done))
    return F.when(F.size(spans) == 0, text).otherwise(_once(F.sort_array(spans), ordered))
