"""Periodic runs, the filter audit and URL rules on hand-made tables, against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations
from math import floor

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import SPACED, corpus, frame, odd

from barloom.llm import filter_audit, runs, url_filter
from barloom.llm import queries as q
from barloom.llm.filter_audit import audit, audit_texts, gallop, posting_lists, sizes, split, text_filters
from barloom.llm.runs import find_runs, periodic_runs
from barloom.llm.sql import ORACLES
from barloom.llm.url_filter import judge_urls
from barloom.llm.words import mix

RULES = "pattern string, action string"


def runs_brute(words, least=2):
    """Every run by looking at all periods: {(start, end): smallest period}."""
    w, out = np.asarray(words), {}
    for period in range(1, len(w) // 2 + 1):
        turn = np.flatnonzero(np.diff(np.concatenate([[False], w[:-period] == w[period:], [False]]).astype(np.int8)))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            if b - a >= period:
                out.setdefault((a, b + period), period)
    return sorted((a, b - a, p) for (a, b), p in out.items() if b - a >= least)


def sequence(rng):
    """Words of one of the shapes that periods hide in."""
    kind, n = rng.randrange(8), rng.randint(0, 260)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(40) for _ in range(n)]
    if kind == 2:
        a, b = [0], [0, 1]
        for _ in range(rng.randint(1, 11)):
            a, b = b, b + a
        return b
    if kind == 3:
        out = [0]
        for _ in range(rng.randint(1, 8)):
            out = out + [1 - x for x in out]
        return out
    if kind == 4:
        out, at = list(range(n + 1)), rng.randrange(n + 1)
        period = 1 + rng.randrange(max(1, (n + 1 - at) // 3))
        return [out[i] if i < at else out[at + (i - at) % period] for i in range(n + 1)]
    if kind == 5:  # stretches of one period that touch out of phase
        base, out = [rng.randrange(3) for _ in range(rng.randint(1, 4))], []
        for _ in range(rng.randint(1, 6)):
            out += base * rng.randint(1, 25) + base[: rng.randrange(len(base) + 1)]
        return out
    if kind == 6:
        own = [0, 1] * rng.randint(5, 60) + [0]
        return own + own + [rng.randrange(3) for _ in range(5)] + own
    out = list(range(n))
    for _ in range(3):
        at, size = rng.randrange(n + 1), rng.randrange(1, 40)
        out[at:at] = out[at : at + size]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_shapes(seed):
    rng = random.Random(seed)
    texts = [sequence(rng) for _ in range(60)]
    first = np.cumsum([0, *map(len, texts)])
    start, end, period = find_runs(mix(np.array([x for t in texts for x in t], np.uint64) + np.uint64(seed + 1)), first)
    got = [[] for _ in texts]
    for a, b, p in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
        i = int(np.searchsorted(first, a, "right")) - 1
        got[i].append((a - int(first[i]), b - a, p))
    assert [sorted(g) for g in got] == [runs_brute(t) for t in texts]


def test_chosen_positions_depend_on_their_context():
    rng = random.Random(4)
    block = [rng.randrange(9) for _ in range(90)]
    x = mix(np.array([*range(100, 140), *block, *range(200, 233), *block, *range(300, 310)], np.uint64))
    for t in (1, 2, 4, 8):
        fingerprint, size = x, 1
        while size < t:
            fingerprint, size = runs.joined_windows(fingerprint, size), size * 2
        at = {*runs.chosen(fingerprint, t, (np.zeros(0, np.int64), np.zeros(0, np.int64))).tolist()}
        inner = range(90 - 2 * t + 1)
        assert [i + 40 in at for i in inner] == [i + 40 + 90 + 33 in at for i in inner]
        assert all(any(i + d in at for d in range(t)) for i in range(len(x) - 3 * t))


def test_runs_far_longer_than_the_windows_that_are_compared():
    for words, want in ((np.zeros(50_000, int), [(0, 50_000, 1)]), (np.arange(30_000) % 7_000, [(0, 30_000, 7_000)]), (np.arange(60_000) % 3, [(0, 60_000, 3)])):
        start, end, period = find_runs(mix(words.astype(np.uint64)), np.array([0, len(words)]))
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == want


def text_runs_brute(text):
    w = SPACED.findall(text or "")
    number = {x: i for i, x in enumerate(dict.fromkeys(w))}
    found = runs_brute([number[x] for x in w], 12)
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    return len(w), found, " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs_of_texts(spark):
    rows, _ = odd(spark)
    tail = "é ü\tö"
    rows += [(200, " ".join([tail] * 9)), (201, "x y\n" * 7 + "x"), (202, "no " * 11), (203, "no " * 12), (204, " ".join(map(str, range(500))) + " end of it" * 9000), (205, "same\x1cword " * 20)]
    extra = [(200, rows[-6][1]), (None, rows[-6][1]), (None, None)]
    got = periodic_runs(frame(spark, [*rows, *extra]).withColumn("runs", F.lit("clash"))).collect()
    key = lambda i, t: (i is None, i or 0, *text_runs_brute(t))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(key(i, t) for i, t in [*rows, *extra])
    assert periodic_runs(frame(spark, []).limit(0)).count() == 0


def planted(i, text):
    """A tenth of the texts goes on periodically."""
    w = SPACED.findall(text or "")
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    n = len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]


def test_op11_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, text in docs:
        _, found, collapsed = text_runs_brute(" ".join(planted(i, text)))
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        exponent = None if best[1] is None else floor(1000 * best[1] / best[2])
        want[i] = (len(found), *best, exponent, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(collapsed))
    assert {r[0]: tuple(r)[1:] for r in q.op11_periodic_runs(spark, sf_dir).collect()} == want
    assert sum(v[0] > 0 for v in want.values()) > 10


def test_no_text_is_planted_without_id_or_words(spark):
    got = q.with_repeats(frame(spark, [(None, "a b c"), (4, " \n"), (4, None)])).collect()
    assert sorted(str(r.text) for r in got) == [" \n", "None", "a b c"]


def test_gallop_and_merges():
    rng = random.Random(2)
    for _ in range(60):
        lists = [np.array(sorted(rng.sample(range(1000), rng.randrange(0, rng.choice((4, 700))))), np.int64) for _ in range(5)]
        assert gallop(lists[0], lists[1]).tolist() == np.searchsorted(lists[1], lists[0]).tolist()
        assert {*split(lists[0], lists[1])[0].tolist()} == {*lists[0].tolist()} - {*lists[1].tolist()}
    own = [{*x.tolist()} for x in lists]
    for f, before, gone, removed, marked in sizes(lists[:4], lists[4:]):
        union = set().union(*(own[g] for g in range(4) if before >> g & 1))
        assert (gone, removed, marked) == (len(union | own[f]), len(own[f] - union), [len((own[f] - union) & own[4])])


def audit_brute(rows, labels):
    """Rows (doc_id, text, lang); labels doc_id -> (good, toxic)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = {}
    for i, t, lang in rows:
        text = t or ""
        w = SPACED.findall(text)
        fails = {c for c, bad in zip("ABCDE", (len(w) < 200, 100 * len({*w}) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text), i is not None and i > first[text]), strict=True) if bad}
        parts.setdefault(lang or "", []).append((fails, labels.get(i, (0, 0))))
    out = {}
    for part, own in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = {*order[: step - 1]}
                removed = [m for fails, m in own if f in fails and not fails & before]
                failing = sum(f in fails for fails, _ in own)
                kept = sum(not fails & (before | {f}) for fails, _ in own)
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [kept, len(removed), failing - len(removed), sum(fails == {f} for fails, _ in own), sum(m[0] for m in removed), sum(m[1] for m in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in df.collect()}


def marks():
    return {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}


def test_filter_audit(spark):
    rng = random.Random(9)
    texts = [t for _, t in corpus()] + ["A B C D", "x " * 300 + "#", "ÀÉ Ünder", "AAAA" + "b" * 96, "AAA" + "b" * 97, " ".join(map(str, range(200)))]
    rows = [(i, rng.choice(texts), rng.choice(("en", "en", "en", "de", None, ""))) for i in range(90)]
    rows += [(None, texts[6], "en")] * 5 + [(17, texts[6], "fr")] * 4 + [(17, "x", "fr")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 90, 2)] + [(2, 1, 0), (None, 1, 1)]
    marked = {}
    for i, good, toxic in labels:
        if i is not None:
            old = marked.get(i, (0, 0))
            marked[i] = (max(old[0], int(good == 1)), max(old[1], toxic))
    docs = spark.createDataFrame([(*r, 1, True, "z") for r in rows], "doc_id long, text string, lang string, row int, E boolean, digest string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(audit_texts(docs, known, marks())) == audit_brute(rows, marked)
    assert audit_texts(docs.limit(0), known, marks()).count() == 0
    assert audited(audit_texts(docs, known.limit(0), marks())) == audit_brute(rows, {})


def test_posting_lists_hold_the_failing_ids_of_bounded_ranges(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("en").alias("part"), F.col("id").alias("row"), (F.col("id") % 7 == 0).alias("F"), F.lit(None).cast("boolean").alias("G"), (F.col("id") % 5 == 0).alias("M"))
        lists = posting_lists(rows, ["F", "G"], ["M"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r.n for r in lists) <= 50 and sum(r.n for r in lists) == 1000
    assert sorted(r.ids[i] for r in lists for i in r.failing[0] if r.ids[i] is not None) == [i for i in range(0, 1000, 7) if i % 3]
    assert all(not r.failing[1] and r.marked[0] == sorted({*r.marked[0]}) for r in lists)


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([(i, "p", i, i % 2 == 0, i % 3 == 0) for i in range(12)], "doc_id long, part string, row long, X boolean, Y boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit(posting_lists(rows, ["X", "Y"], []), ["X", "Y"], []).collect()}
    assert got == {("XY", 1): (6, 6, 0, 4, 10), ("XY", 2): (4, 2, 2, 2, 6), ("YX", 1): (8, 4, 0, 2, 6), ("YX", 2): (4, 4, 2, 4, 10)}
    with pytest.raises(ValueError):
        audit(rows, list("ABCDEFGH"), [])


def test_filters_of_odd_texts(spark):
    rows = text_filters(frame(spark, [(1, None), (2, ""), (3, "ABC"), (4, "|")]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.doc_id: (r.part, r.A, r.B, r.C, r.D) for r in rows} == {1: ("", True, False, False, False), 2: ("", True, False, False, False), 3: ("", True, False, True, False), 4: ("", True, False, False, True)}


def url_brute(url, rules, words=()):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), host)
    fits = []
    for pattern, action in rules:
        own, slash, start = pattern.partition("/")
        if own and (host == own or host.endswith("." + own)) and path.startswith(slash + start):
            fits.append((len(pattern), len(own), pattern, action))
    if fits:
        return host, path, max(fits)[2], None, max(fits)[3]
    listed = max((w for w in re.split("[.-]", host) if w in words), key=lambda w: (len(w), w), default=None)
    return host, path, None, listed, "block" if listed else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/a", "https://a.net/", "https://anet/", "https://a.net?x=/", "https://example.net/en", "https://example.net/en/1",
    "https://x.example.net/en/?q", "https://xexample.net/en/", "https://example.com/de/9", "https://example.com/dex", "http://q.org/fr/", "http://org/fr/#a", "http://org/FR/", "ftp://a.b.c.org/fr/x://y",
    "http://casino-win.example.com/", "http://www.spam.example.org/fr/", "http://ÀÉ.net/ü/", "x://" + "a." * 3000 + "net/" + "p" * 9000, "http://a.net:80/", "http://free-bets.example.net/en/",
]


@pytest.mark.parametrize("block", [2, url_filter.BLOCK_KEYS])
def test_urls(spark, block):
    rules = [*q.URL_RULES, ("casino-win.example.com", "allow"), ("a.net/", "allow"), ("/nohost", "block")]
    pages = spark.createDataFrame([(i, u, 7, "r", "v") for i, u in enumerate([*URLS, URLS[7]])], "page_id long, url string, host int, rule string, verdict string").repartition(3)
    got = judge_urls(pages, spark.createDataFrame(rules, RULES), block_keys=block)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "listed", "verdict"]
    assert {r.page_id: tuple(r)[2:] for r in got.collect()} == {i: url_brute(u, rules, url_filter.BLOCKED_WORDS) for i, u in enumerate([*URLS, URLS[7]])}
    assert judge_urls(pages.limit(0), spark.createDataFrame(rules, RULES)).count() == 0


def test_urls_without_rules_and_with_rules_given_twice(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://spam.org/x")], "page_id long, url string")
    got = judge_urls(pages, spark.createDataFrame([], RULES), words=())
    assert {r.verdict for r in got.collect()} == {"allow"}
    got = judge_urls(pages, spark.createDataFrame([("ORG/", "allow"), ("org/", "block"), ("org/", "block")], RULES))
    assert {(r.rule, r.verdict) for r in got.collect()} == {("org/", "block")}


def test_keys_that_share_a_digest_are_told_apart():
    held = np.array([3, 5, 5, 5, 9], np.int64)
    full = pa.array([b"c", b"e", b"f", b"g", b"i"], pa.large_binary())
    block = held, np.array([1, 2, 1, 2, 1], np.uint8), full
    asked = pa.array(["g", "f", "x", "i", "c", "zz"])
    assert url_filter.probe(np.array([5, 5, 5, 9, 3, 10]), asked, block).tolist() == [2, 1, 0, 1, 1, 0]


def test_digests_are_xxhash(spark):
    row = spark.sql("SELECT xxhash64('example.net/en/') AS h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"example.net/en/", seed=42)


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_url_filter"])
def test_query_equals_sql(spark, sf_dir, same, name):
    same(getattr(q, name)(spark, sf_dir), ORACLES[name])


def test_first_copies_of_a_text_that_a_third_of_all_rows_holds(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.col("id").cast("string").cast("binary")).alias("digest"))
    got = filter_audit.first_copies(rows, "E").filter("E").agg(F.count("*"), F.min("doc_id")).first()
    assert tuple(got) == (999, 3)
