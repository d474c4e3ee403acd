"""Quality rules over whole texts with DataFrame functions only: repetition counts and distribution divergence.

A text's character classes and its common words are compared with the reference of its language by Jensen-Shannon
distance. References are means over the corpus: one histogram for each language, of the texts that pass the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import materialise

# The commonest words of each language that has a reference.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au"],
}
#: Regular-expression classes of characters besides a-z and white space; what fits none is the last class.
_CLASSES = ["A-Z", "0-9", r".,;:'\"()?!\-", r"#*$%&|<>@~^_=+/\\\[\]{}"]
_HISTOGRAM = len(_CLASSES) + 3
#: Distinct repeated windows up to which membership is tested one by one.
_FEW = 64
#: Words of a text below which only the base rules decide.
LEAST_WORDS = 100


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, as a lambda's argument."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur at least twice; windows are compared by 64-bit hashes within the text."""
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.concat(at, F.transform(at, lambda p: p + 1), F.transform(at, lambda p: p + 2))))

    def by_membership(g: Column, twice: Column) -> Column:
        return F.array_compact(F.transform(g, lambda x, i: F.when(F.array_contains(twice, x), i)))

    def by_order(g: Column) -> Column:
        def neighbours(s: Column) -> Column:
            of = lambda k: F.get(s, k)["g"]
            both = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: ((k > 0) & (of(k) == of(k - 1))) | ((k < F.size(s) - 1) & (of(k) == of(k + 1))))
            return F.transform(both, lambda k: F.get(s, k)["p"])

        return _once(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p")))), neighbours)

    def repeated(g: Column) -> Column:
        twice = _once(F.sort_array(g), lambda s: F.array_distinct(F.array_compact(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x == y, x)))))
        return _once(twice, lambda t: _once(F.when(F.size(t) <= _FEW, by_membership(g, t)).otherwise(by_order(g)), covered))

    return F.when(n < 3, 0).otherwise(_once(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(repeated(g))))


def _counted(joined: Column, word: Column) -> Column:
    """How often a word stands in words that are joined by two blanks and have one at each end."""
    return ((F.length(joined) - F.length(F.replace(joined, F.concat(F.lit(" "), word, F.lit(" ")), F.lit("")))) / (F.length(word) + 2)).cast("int")


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang)


def measure(docs: DataFrame, carry: bool = False, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, lang (null without a reference), base counts, base_failed, the two histograms, and with `carry` the row's own columns as the struct `row`."""
    own = ["row"] if carry else []
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), _language(docs[lang_column].cast("string")).alias("lang"), text.alias("text"), *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    listed = F.lit(None).cast("array<string>")
    for lang, common in COMMON_WORDS.items():
        listed = F.when(F.col("lang") == lang, F.array(*map(F.lit, common))).otherwise(listed)
    size = len(COMMON_WORDS["en"])
    rows = rows.withColumn("n", F.size("words")).withColumn("listed", listed)
    joined = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))
    rows = rows.withColumn("rest", F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", "")).withColumn("joined", F.when(F.col("listed").isNotNull(), joined))
    kept = lambda c: F.length(F.regexp_replace("rest", f"[^{c}]+", ""))
    rows = rows.select(
        *own,
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        kept("#*$%&|<>").cast("long").alias("n_symbols"),
        _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("n")).cast("long").alias("n_repeat_words"),
        F.length("text").alias("chars"),
        F.length("rest").alias("others"),
        F.array(*map(kept, _CLASSES)).alias("kinds"),
        F.when(F.col("listed").isNotNull(), F.array(*(_counted(F.col("joined"), F.get("listed", F.lit(k))) for k in range(size)))).alias("common"),
    )
    blank = F.col("chars") - F.col("word_chars").cast("int")
    rows = rows.withColumn("classes", F.concat(F.array(F.col("chars") - F.col("others") - blank, blank), F.col("kinds")))
    share = lambda counts, total: F.transform(F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0), lambda a, x: a + x))), lambda x: x / total)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.select(
        *own,
        *("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
        F.when(F.col("chars") > 0, share(F.col("classes"), F.col("chars"))).alias("classes"),
        F.when(F.col("n_words") > 0, share(F.col("common"), F.col("n_words").cast("int"))).alias("common"),
    )


def references(measured: DataFrame) -> DataFrame:
    """Mean histograms of each language (at most one row for each key of COMMON_WORDS)."""
    mean = lambda c, size: F.array(*(F.avg(F.get(c, F.lit(k))) for k in range(size)))
    sound = measured.where(~F.col("base_failed") & F.col("lang").isNotNull() & (F.col("n_words") >= LEAST_WORDS))
    return sound.groupBy("lang").agg(mean("classes", _HISTOGRAM).alias("classes_reference"), mean("common", len(COMMON_WORDS["en"]) + 1).alias("common_reference"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance to base 2, 0 to 1."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _judged(measured: DataFrame, most_classes: float, most_common: float) -> DataFrame:
    """The measured rows with both distances and the verdict `kept`."""
    found = measured.join(F.broadcast(references(measured)), "lang", "left")  # one small row for each language of COMMON_WORDS
    found = found.withColumn("class_distance", distance(F.col("classes"), F.col("classes_reference"))).withColumn("word_distance", distance(F.col("common"), F.col("common_reference")))
    far = F.coalesce((F.col("class_distance") > most_classes) | (F.col("word_distance") > most_common), F.lit(False))
    return found.withColumn("kept", ~F.col("base_failed") & ~((F.col("n_words") >= LEAST_WORDS) & far))


def judge(docs: DataFrame, most_classes: float = 0.25, most_common: float = 0.3, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and both distances.

    Words are runs of characters other than space and U+0009-U+000D. base_failed: under 50 words, or over half of the
    words lie in 3-word windows that the text repeats. Otherwise a text of at least 100 words in a language with a
    reference is kept if both distances are within their limits; other texts are kept. Null and empty texts have no
    words and fail. Null ids and repeated rows are judged like any others. Other columns are not read. An empty table
    gives an empty result. Every row is measured once and written to the shared folder, as references need all rows.
    """
    found = _judged(materialise(measure(docs, False, id_column, text_column, lang_column)), most_classes, most_common)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def keep_good(docs: DataFrame, most_classes: float = 0.25, most_common: float = 0.3) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang and any other columns) that `judge` keeps."""
    return _judged(materialise(measure(docs, True)), most_classes, most_common).where("kept").select("row.*")
