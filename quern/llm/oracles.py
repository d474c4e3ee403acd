"""SQL that states the results of the queries that SQL can express."""

from __future__ import annotations

from quern.llm.quality_rules import COMMON_WORDS, LEAST_WORDS

#: All pairs of vectors, and a transitive closure.
CAP_FILTERS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(max(n), 0)::BIGINT AS n_links, min(reach.b) AS component_id, min(reach.b) = vec_id AS kept
FROM reach JOIN v ON reach.a = vec_id LEFT JOIN counts ON counts.a = vec_id GROUP BY vec_id
"""


def _quality_rules() -> str:
    blank = r"[\x20\x09-\x0D]"
    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in COMMON_WORDS.items())
    kinds = ["[A-Z]", "[0-9]", r"""[.,;:''"()?!\-]""", r"[#*$%&|<>@~^_=+/\\\[\]{}]"]
    number = lambda c: f"length(regexp_replace(text, '{c}', '', 'g'))"
    keep = ", ".join(f"length(text) - {number(c)}" for c in kinds)
    places = len(COMMON_WORDS["en"])
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    js = lambda p, q: f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(f'{p}[i]', f'{q}[i]')} + {term(f'{q}[i]', f'{p}[i]')}))) / 2)"
    mean = lambda c, n: "[" + ", ".join(f"avg({c}[{i}])" for i in range(1, n + 1)) + "]"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({', '.join(repr(x) for x in COMMON_WORDS)}) THEN lang END AS lang FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '{blank}+'), lambda x: x <> '') AS words, CASE lang {lists} END AS listed FROM d
), g AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (
    SELECT doc_id, unnest(range(1, len(words) - 1)) AS p, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i:i+2])) AS gram FROM w WHERE len(words) >= 3
  )
), covered AS (
  SELECT doc_id, count(DISTINCT p + k)::BIGINT AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, lang, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - {number('[#*$%&|<>]')})::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(text) AS chars,
    [length(text) - {number('[a-z]')}, length(text) - {number(blank)}, {keep}] AS kinds,
    list_transform(listed, lambda x: len(list_filter(words, lambda y: y = x))) AS common
  FROM w LEFT JOIN covered USING (doc_id)
), h AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN chars > 0 THEN list_transform(list_append(kinds, chars - list_sum(kinds)), lambda x: x / chars) END AS classes,
    CASE WHEN n_words > 0 THEN list_transform(list_append(common, n_words - list_sum(common)), lambda x: x / n_words) END AS shares
  FROM m
), r AS (
  SELECT lang, {mean('classes', 7)} AS c, {mean('shares', places + 1)} AS s FROM h WHERE NOT base_failed AND lang IS NOT NULL AND n_words >= {LEAST_WORDS} GROUP BY lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {LEAST_WORDS} AND coalesce({js('classes', 'c')} > 0.25 OR {js('shares', 's')} > 0.3, false)) AS kept
FROM h LEFT JOIN r USING (lang)
"""


QUALITY_RULES = _quality_rules()
