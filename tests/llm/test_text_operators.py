"""Personal data, quality rules, URL templates, the classifier and the language model against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import quality_model
from quern.llm.elias_fano import Bits, EliasFano, LevelFile, Trie
from quern.llm.language_model import Corpus, score_documents
from quern.llm.personal_data import KINDS, extract, redact, said
from quern.llm.quality_model import Features, Machine, features, keep_good, score_quality
from quern.llm.quality_rules import distance, judge
from quern.llm.runtime import materialise
from quern.llm.url_templates import judge_urls, merge_branches

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(kind, m.group()))


def spell(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def odd_texts():
    rng = random.Random(9)
    parts = ["a@b.co", "x.y_z%+-@q-r.s.t", "@", ".", "..", "1.2.3.4", "256.1.1.1", "0010.020.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (974) 555-3436", "+49.30.123456", "+1 2", " ", "-", "é", "😀", "\n", "abc", "7", "12", "a@b@c.d", "_x@y.z", "+", "(0)", "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2500)]


def test_base_spans(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in extract(df).select("doc_id", "base", said("base").alias("said")).collect():
        want = base_spans(texts[r.doc_id])
        assert [(s.start, s.kind, s.end) for s in r.base] == want and r.said == spell(want)


def test_personal_data_edge_cases(spark, edge):
    rows = {r.doc_id: r.text for r in edge.collect()}
    got = extract(edge, carry=True).collect()
    assert len(got) == len(edge.collect()) and sum(r.doc_id == 8 for r in got) == 2
    for r in got:
        if r.doc_id is not None:
            assert [(s.start, s.kind, s.end) for s in r.base] == base_spans(rows[r.doc_id] or "")
            assert r.row.text == rows[r.doc_id]
    assert extract(edge.limit(0)).collect() == []


def test_patterns_find_unseen_identifiers(spark):
    cards = ["4111111111111111", "378282246310005", "6011111111111117", "5555555555554444", "30569309025904", "3530111333300000"]
    texts = [f"words here then customer account {c} and more" for c in cards]
    texts += ["please see customer account 99X7712-AB in our files", "an order number 12345678 alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in extract(df, support=4, confidence=0.6).collect()}
    assert [[(s.start, s.end) for s in found[k].found] for k in range(8)] == [[]] * 6 + [[(28, 38)], []]
    assert texts[6][28:38] == "99X7712-AB"


def test_whole_entities_seed_patterns_and_accepted_tokens_support_others(spark):
    texts = [f'you can mail user = " name{n}@site.org today' for n in range(40)]
    texts += [f'see mail user = " tok{k}77-XY here and then badge code: tok{k}77-XY here' for k in range(8)]
    texts += ["the badge code: new5511-Q here", "an order number 12345678 alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.found] for r in extract(df, rounds=3, support=4, confidence=0.6).collect()}
    assert [found[k] for k in range(len(texts))] == [[]] * 40 + [[f"tok{k}77-XY"] * 2 for k in range(8)] + [["new5511-Q"], []]


def test_redaction(spark):
    texts = ["mail a@b.co now", "", "+1 (974) 555-3436 and 4111 1111 1111 1111", "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.t for r in extract(df, carry=True).select("doc_id", redact(F.col("row.text"), F.col("base")).alias("t")).collect()}
    assert out == {0: "mail [EMAIL] now", 1: "", 2: "[PHONE] and [CARD]", 3: "none"}


def plain_redaction(text, spans):
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_redaction_of_many_spans(spark):
    rng = random.Random(10)
    rows = []
    for k in range(60):
        text = "".join(rng.choice("ab é😀\n") for _ in range(rng.choice([3, 511, 512, 513, 1500, 4000])))
        cuts = [sorted((rng.randint(0, len(text)), rng.randint(0, len(text)))) for _ in range(rng.choice([0, 1, 5, 80]))]
        rows.append((k, text, [(a, rng.randint(0, 4), min(b, a + rng.choice([1, 5, 600]))) for a, b in cuts if b > a]))
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,kind:int,end:int>>")
    got = {r.doc_id: r.t for r in df.select("doc_id", redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {k: plain_redaction(t, s) for k, t, s in rows}


def plain_extraction(texts, rounds, confidence, support):
    """Base spans and found tokens by the stated method, in plain Python."""
    token = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{6,}"
    edges, scores, spans = {}, {}, []

    def context(text, at):
        before = text[max(0, at - 100) : at].lower()
        words = re.findall(r"(?:(?!\w)\S|_)*(?:(?!_)\w)\S*", before)
        return re.sub("[0-9]+", "0", " ".join(words[-2:]))

    for text in texts:
        base, here = base_spans(text), []
        for k, (kind, p) in enumerate([*PATTERNS.items(), ("id", token)]):
            for m in re.finditer(p, text):
                if kind == "id" and any(a < m.end() and m.start() < b for a, _, b in base) or not holds(kind, m.group()):
                    continue
                here.append((m.start(), k, m.end(), m.group(), context(text, m.start())))
        spans.append(here)
        for _, k, _, value, c in here:
            if c:
                edges[c, value] = max(edges.get((c, value), 0), int(k < 4))
    for (_, v), seed in edges.items():
        scores[v] = max(scores.get(v, 0.0), float(seed))
    seeds = dict(scores)
    for _ in range(rounds):
        about = {}
        for c, v in edges:
            about.setdefault(c, []).append(scores[v])
        judged = {c: (sum(x) / (len(x) + 1), sum(y >= confidence for y in x)) for c, x in about.items()}
        scores = {v: max([s, *(judged[c][0] for c, w in edges if w == v and judged[c][1] >= support)]) for v, s in seeds.items()}
    good = {c for c, (conf, backing) in judged.items() if conf >= confidence and backing >= support}
    return [[(a, k, b) for a, k, b, _, c in here if k == 4 and c in good] for here in spans]


def test_discovery_against_plain_turns(spark):
    rng = random.Random(21)
    leads = ["mail", "user:", "account no", "call me", "card -", "id", "ref #", "my", "see ="]
    things = ["a{n}@b{n}.org", "10.{n}.3.7", "+1 (974) 555-{n:04d}", "tok{n}77-XY", "K{n:07d}", "ab_{n}cdef", "word", "411111111111111{n}"]
    texts = []
    for _ in range(250):
        own = rng.choice(leads)
        texts.append(" ".join(f"{rng.choice(['then', 'and', '', '.'])} {own if rng.random() < 0.8 else rng.choice(leads)} {rng.choice(things).format(n=rng.randint(1, 30))}" for _ in range(rng.randint(1, 5))))
    texts.append(" ".join(f"x{n}yzzz{n}" for n in range(400)) + " mail a1@b1.org " * 50)
    want = plain_extraction(texts, 3, 0.4, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.found] for r in extract(df, rounds=3, confidence=0.4, support=3).collect()}
    assert [got[k] for k in range(len(texts))] == [sorted(w) for w in want] and any(want)


def test_long_texts_of_identifiers_and_emails(spark):
    ids, mails = " ".join(f"tok{n:06d}x" for n in range(40_000)), " ".join(f"n{n}@mail.example.org" for n in range(20_000))
    df = spark.createDataFrame([(1, ids), (2, mails)], "doc_id long, text string").repartition(2)
    out = {r.doc_id: r for r in extract(df, carry=True).select("doc_id", F.size("base").alias("n"), redact(F.col("row.text"), F.concat("base", "found")).alias("t")).collect()}
    assert (out[1].n, out[1].t) == (0, ids) and (out[2].n, out[2].t) == (20_000, " ".join(["[EMAIL]"] * 20_000))


def plain_rules(text):
    w = WORD.findall(text)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many, cover = Counter(tri), set()
    for k, g in enumerate(tri):
        if many[g] > 1:
            cover |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_rules(spark, edge):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "c", "é", " ", " ", "\n", "\t", "#", "|", "\x85", "😀"]) for _ in range(rng.randint(0, 160))) for _ in range(400)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    rows = {r.doc_id: r.text or "" for r in edge.collect()}
    for r in judge(edge).collect():
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(rows[r.doc_id])
    assert judge(edge.limit(0)).collect() == []


def test_rules_keep_clean_and_reject_strange_texts(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = judge(docs).join(labels, "doc_id").where("not base_failed and n_words >= 100").groupBy("quality").agg({"kept": "count"}).collect()
    kept = {r[0]: r[1] for r in judge(docs).join(labels, "doc_id").where("not base_failed and n_words >= 100 and kept").groupBy("quality").count().collect()}
    total = {r[0]: r[1] for r in got}
    assert kept[1] == total[1] and kept.get(0, 0) < 0.6 * total[0]


def test_divergence(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [1.0, 0.0])]
    df = spark.createDataFrame(pairs, "p array<double>, q array<double>").select(distance(F.col("p"), F.col("q")).alias("d"))
    got = [r.d for r in df.collect()]
    assert got[0] == 0 and got[1] == 1
    m = [0.75, 0.25]
    want = math.sqrt((0.5 * math.log2(0.5 / m[0]) + 0.5 * math.log2(0.5 / m[1]) + math.log2(1 / m[0])) / 2)
    assert abs(got[2] - want) < 1e-12


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def plain_url(url, rules=RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split(r"[?#]", rest[cut:], maxsplit=1)[0]
    fit = [(len(r), r, v) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


def test_urls(spark):
    urls = ["http://Example.ORG/en/12?x#y", "https://a.example.org/es/", "example.org/es/", None, "", "://", "http://org", "http://org/", "http://borg/", "ftp://x.COM/fr/a", "http://x.com/de/b://c", "http://É.com?q=/de/", "http://a.com#/de/", "http://h.net/" + "a/" * 3000, "http://h.net/x\ny", "x://y.com:80/de/1"]
    rows = [(k, u, "h", "t") for k, u in enumerate(urls)] + [(0, urls[0], "h", "t"), (None, "http://a.org/", "", "")]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, template string"), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = plain_url("http://a.org/" if r.page_id is None else urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


def test_templates_learn_from_labels(spark):
    rules = [("block", "h.com/shop/1"), ("allow", "h.com/news/1")]
    rows = [(f"http://h.com/shop/{n}.html",) for n in [*range(100, 200), *range(300, 340)]] + [(f"http://h.com/news/{n}.html",) for n in [*range(100, 200), *range(300, 340)]] + [("http://other.net/a",)]
    df = spark.createDataFrame([(k, u) for k, (u,) in enumerate(rows)], "page_id long, url string")
    got = {u: r for r in judge_urls(df, rules).collect() for u in [rows[r.page_id][0]]}
    free = [r for u, r in got.items() if r.rule is None]
    assert {r.verdict for r in free if "/shop/" in r.path} == {"block"} and {r.verdict for r in free if "/news/" in r.path} == {"allow"}
    assert got["http://other.net/a"].verdict == "allow"


def plain_templates(urls, rules):
    """The tree by recursion over lists of pages."""
    pages = []
    for u in urls:
        host, path, rule, verdict = plain_url(u, rules)
        shape = re.sub("[0-9]+", "<n>", re.sub(r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{8,}(?![0-9A-Za-z])", "<x>", path))
        pages.append((host, tuple(shape.split("/")[1:]), verdict))
    out = {}

    def grow(host, rows, level, name):
        here = [r for r in rows if len(r[1]) <= level]
        if len(rows) < 5 or len({r[1] for r in rows}) == 1:
            for r in rows:
                out[host, r[1]] = name + "".join("/" + ("*" if len(rows) < 5 else s) for s in r[1][level:])
            return
        for r in here:
            out[host, r[1]] = name
        groups = {}
        for r in rows:
            if len(r[1]) > level:
                groups.setdefault(r[1][level], []).append(r)
        big = sorted(s for s, g in groups.items() if len(g) >= 5 and len(g) >= 0.005 * len(rows))
        kinds = sorted({r[1][level + 1 :] for g in groups.values() for r in g})
        below = np.array([[sum(r[1][level + 1 :] == k for r in groups[s]) for k in kinds] for s in big], float).reshape(len(big), len(kinds))
        labels = np.array([[sum(r[2] == v for r in groups[s]) for v in ("allow", "block")] for s in big], float).reshape(len(big), 2)
        branch = dict(zip(big, merge_branches(big, below, labels, 1.645), strict=True))
        pooled = {}
        for s, g in groups.items():
            pooled.setdefault(branch.get(s, "*"), []).extend(g)
        for b, g in pooled.items():
            grow(host, g, level + 1, f"{name}/{b}")

    for host in {p[0] for p in pages}:
        grow(host, [p for p in pages if p[0] == host], 0, "")
    leaves, hosts, total = {}, {}, [0, 0]
    for host, segments, verdict in pages:
        for sums in (leaves.setdefault((host, out[host, segments]), [0, 0]), hosts.setdefault(host, [0, 0]), total):
            sums[0] += verdict is not None
            sums[1] += verdict == "block"
    share = (total[1] + 5) / (total[0] + 10)
    found = []
    for host, segments, verdict in pages:
        prior = (hosts[host][1] + 10 * share) / (hosts[host][0] + 10)
        n, b = leaves[host, out[host, segments]]
        purity = (b + 10 * prior) / (n + 10)
        found.append((out[host, segments], round(purity, 9), verdict or ("block" if purity >= 0.8 else "allow")))
    return found


def test_templates_against_a_plain_tree(spark):
    rng = random.Random(11)
    urls = []
    for host in ("a.com", "b.com", "c.org"):
        urls += [f"http://{host}/{lang}/{kind}/{rng.randint(1, 999)}" for lang in ("en", "de", "fr") for kind in rng.choices(["news", "shop", "faq", "blog"], [4, 2, 1, 1], k=40)]
    urls += [f"http://x.net/{a}/{p}/{rng.randint(1, 9)}" for a, ps in (("x", "abcdefghijklmno"), ("y", "abcdefghpqrstuv"), ("z", "abcdefghijklmno")) for p in ps for _ in range(6)]
    urls += [f"http://d.org/1/2/3/4/5/{w}/{rng.randint(1, 99)}" for w in ("spam", "docs") for _ in range(30)]
    urls += [f"http://e.net/{k}x/{'y/' * k}" for k in range(12)] + ["http://deep.com" + "/a" * 500 + f"/{'bc'[k % 2]}/x" for k in range(12)] + ["nothing", "http://h.com"]
    rules = [("block", "com/de/"), ("allow", "com/fr/"), ("allow", "d.org/1/2/3/4/5/docs/"), ("block", "d.org/1/2/3/4/5/spam/1"), ("block", "d.org/1/2/3/4/5/spam/2"), ("block", "d.org/1/2/3/4/5/spam/3"), ("block", "d.org/1/2/3/4/5/spam/4")]
    got = {r.page_id: (r.template, round(r.purity, 9), r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3), rules).collect()}
    assert [got[k] for k in range(len(urls))] == plain_templates(urls, rules)
    templates = {u.split("/")[2] + "/" + u.split("/")[3]: got[k][0].split("/")[1] for k, u in enumerate(urls) if u.count("/") > 3}
    assert templates["x.net/x"] == templates["x.net/z"] == "{x+}" and templates["x.net/y"] == "y"
    deep = [got[k] for k, u in enumerate(urls) if u.startswith("http://d.org")]
    assert {t.split("/")[6] for t, *_ in deep} == {"spam", "docs"}


def test_interactions_in_linear_time():
    rng = np.random.default_rng(0)
    machine = Machine()
    machine.w = rng.normal(size=machine.w.shape).astype(np.float32)
    x = features(pa.array(["the cat sat on the mat", "a | b"]))
    logit = machine._sums(x)[0]
    for k in range(2):
        cols, vals = x.columns[x.offsets[k] : x.offsets[k + 1]], x.values[x.offsets[k] : x.offsets[k + 1]]
        pairs = sum(float(machine.v[a] @ machine.v[b]) * p * q for i, (a, p) in enumerate(zip(cols, vals, strict=True)) for b, q in list(zip(cols, vals, strict=True))[i + 1 :])
        assert abs(logit[k] - (machine.bias + float(machine.w[cols] @ vals) + pairs)) < 1e-3


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_classifier_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    got = score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_learned(spark, labelled):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = quality_model.train(docs, labels), quality_model.train(docs, flipped)
    assert (a.w == b.w).all() and (a.v == b.v).all()


def test_classifier_edge_cases(spark, edge, labelled):
    got = score_quality(edge, labelled[1]).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert score_quality(edge.limit(0), labelled[1]).collect() == []
    assert all(0 <= r.score <= 1 for r in score_quality(edge, labelled[1].limit(0)).collect())
    kept = keep_good(edge, labelled[1])
    assert kept.columns == edge.columns and kept.count() <= edge.count()


def test_features_of_no_words():
    x = features(pa.array([None, "", " \n"]))
    assert isinstance(x, Features) and (np.diff(x.offsets) == len(quality_model._KINDS) + 5).all() and np.isfinite(x.values).all()


@pytest.mark.parametrize("universe", [1, 1000, 2**40, 2**64 - 1])
def test_elias_fano(universe):
    rng = np.random.default_rng(1)
    for n in (0, 1, 300, 5000, 150_000):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64, endpoint=True))
        ef = EliasFano(values, universe, LevelFile())
        assert (ef.access(np.arange(len(values))) == values).all()
        keys = np.concatenate([values, rng.integers(0, universe, 200, dtype=np.uint64, endpoint=True)])
        place = {int(v): k for k, v in enumerate(values)}
        assert ef.find(keys).tolist() == [place.get(int(x), -1) for x in keys]


def test_select():
    rng = np.random.default_rng(2)
    for size, n in ((1, 1), (512, 512), (513, 0), (5000, 700), (70_000, 69_000)):
        ones = np.sort(rng.choice(size, n, replace=False))
        bits = Bits(ones, size, LevelFile())
        assert (bits.select(np.arange(n)) == ones).all()
        assert (bits.select(np.arange(size - n), 0) == np.setdiff1d(np.arange(size), ones)).all()


def trie():
    return Trie(
        np.array([5, 9], np.uint64),
        np.array([3, 1]),
        (np.array([0, 2, 3]), np.array([1, 7, 1], np.uint32), 32),
        (np.array([0, 1, 3, 3]), np.array([4, 4, 6], np.uint32), 24),
        pair=np.array([-0.1, -1.0, -2.0]),
        triple=np.array([-0.5, -1.5, -3.0]),
    )


def test_trie():
    own = trie()
    number = own.words.find(np.array([5, 6, 9], np.uint64))
    assert number.tolist() == [0, -1, 1]
    pairs = own.pairs.find(number[[0, 0, 0, 1, 2]], np.array([1, 7, 8, 1, 1], np.uint32))
    assert pairs.tolist() == [0, 1, -1, -1, 2]
    assert np.allclose(Trie.value(own.read("pair", pairs, Trie.NONE)), [10**-0.1, 0.1, 0, 0, 0.01])
    triples = own.triples.find(pairs[[0, 1, 1, 2, 4, 1]], np.array([4, 4, 6, 4, 4, 5], np.uint32))
    assert triples.tolist() == [0, 1, 2, -1, -1, -1]


def test_a_trie_is_lost_without_its_pointers():
    own = trie()
    own.pairs.pointers = EliasFano(np.array([0, 1, 3], np.uint64), 3, LevelFile())
    assert own.pairs.find(np.array([0, 0, 1]), np.array([1, 7, 1], np.uint32)).tolist() == [0, -1, 2]


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text)) + ["</s>"]


def check_language_model(df, mu=100.0, nu=2.0):
    """All results against a plain model, whose terms are rounded as the tries round them."""
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10 != 0]
    one, two, three = Counter(), Counter(), Counter()
    for w in train:
        w = ["<s>", *w]
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
        three.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(one.values()) - one["<s>"], len(set(one) - {"<s>"})
    rounded = lambda p: 10 ** (-0.05 * round(-20 * math.log10(p))) if p else 0.0
    want, scores = Counter(), []
    for i, t in rows:
        w = ["<s>", *tokens(t)]
        base = score = 0.0
        for k in range(1, len(w)):
            p1 = (one[w[k]] + 0.1) / (n + 0.1 * (v + 1))
            p = rounded(two[w[k - 1], w[k]] / (one[w[k - 1]] + mu)) + mu / (one[w[k - 1]] + mu) * p1
            if k > 1:
                context = two[w[k - 2], w[k - 1]]
                p = rounded(three[w[k - 2], w[k - 1], w[k]] / (context + nu)) + rounded(nu / (context + nu)) * p
            base, score = base + math.log10(p1), score + math.log10(p)
        want[i, zlib.crc32(str(i).encode()) % 10 == 0, len(w) - 1, sum(one[x] > 0 for x in w[1:]), n, round(base, 3)] += 1
        scores.append((repr(i), score))
    got = score_documents(df, mu=mu, nu=nu).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    for (i, score), (j, own) in zip(sorted(scores), sorted((repr(r.doc_id), r.score) for r in got), strict=True):
        assert i == j and abs(own - score) < 1e-6 * abs(score) + 1e-6
    return got


def test_language_model(spark):
    got = check_language_model(spark.read.parquet(f"{DATA}/documents.parquet").repartition(3))
    assert all(r.score < 0 for r in got)
    for held in (True, False):
        assert np.mean([r.score / r.n_tokens for r in got if r.held_out == held]) > np.mean([r.base_score / r.n_tokens for r in got if r.held_out == held])


def test_language_model_edge_cases(spark, edge):
    got = check_language_model(edge)
    assert all(np.isfinite(r.score) for r in got)
    assert score_documents(edge.limit(0)).collect() == []
    held = edge.where("doc_id = 11").unionAll(edge.where("doc_id = 2"))
    check_language_model(held)


def test_words_dealt_over_several_tries(spark, monkeypatch):
    from quern.llm import language_model

    monkeypatch.setattr(language_model, "_TRIE_TOKENS", 2000)
    check_language_model(spark.read.parquet(f"{DATA}/documents.parquet").repartition(3))


def test_ranges_keep_the_order():
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(0, 2**64 - 1, 300, dtype=np.uint64))
    own = Corpus(words[[3, 50, 299 % len(words)]], np.array([9, 9, 9]), np.array([5, 1, 40]), 1, 100, 10, 7)
    first, second = np.repeat(words, len(words)), np.tile(words, len(words))
    found = own.range(first, second)
    assert (np.diff(found) >= 0).all()
    assert len(set(found[first == words[3]])) == 5 and len(set(found[first == words[4]])) == 1


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "MinHash near-dedup", "PII", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialise(stage(spark, docs, DATA))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before) and len(after) == docs.count()
        if name == "PII":
            assert set(after) == set(before)
            for k, r in after.items():
                assert not base_spans(r.text) and r.n_chars == len(r.text)
                if not base_spans(before[k].text):
                    assert r.text == before[k].text or "[ID]" in r.text
        else:
            assert all(after[k] == before[k] for k in after)
    pieces = stage_pack(spark, corpus_pipeline, docs)
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}


def stage_pack(spark, corpus_pipeline, docs):
    return corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()


def test_pipeline_runs_its_stages_in_order(spark, monkeypatch):
    import corpus_pipeline

    def mark(name):
        return name, lambda s, docs, d: docs.withColumn("source", F.concat("source", F.lit(name)))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [mark(x) for x in "abc"])
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() == 200 and all(r.source.endswith("abc") for r in out.select("source").collect())


def test_pipeline_stages_on_awkward_rows(spark, edge):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, DATA)
        assert out.collect() is not None and stage(spark, edge.limit(0), DATA).collect() == []
        if name != "packing":
            assert out.columns == edge.columns


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
