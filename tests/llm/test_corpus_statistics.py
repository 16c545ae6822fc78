"""Collocations, line dedup and whitening against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import compare
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import collocations, license_scan, line_dedup, queries, url_rules, warc_revisit, whitening

SCHEMA = "doc_id long, text string, lang string"
LOWER = {c: c + 32 for c in range(65, 91)}


def with_clashes(df):
    return df.withColumns({c: F.lit("?") for c in ("phrase", "f", "words", "low", "high", "first", "gone", "lines", "place", "key", "x", "c", "d", "n", "whitened", "component", "no_id", "id")})


# --- collocations ---


def plain_phrases(rows, most_words=3, least=10, top=2000, share=50):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(LOWER)):
            words = re.findall("[^\\x20\\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most_words + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        covered = defaultdict(int)
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    covered[p[i : i + size]] = max(covered[p[i : i + size]], a)
        scored = []
        for p, a in candidates.items():
            if p in covered and 100 * covered[p] >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -score) for i, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(seed, n, words=("a", "b", "the", "É", "new", "york", "city", "日本", "x")):
    rng = random.Random(seed)
    ends = [" ", " ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "?! ", "\x0b"]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60))) + rng.choice(["", "New York City", "NEW york"])) for _ in range(n)]


ODD = [(None, None), ("en", None), ("en", ""), ("de", " \t\n.,"), ("en", "new york city " * 3000), ("und", "x" * 40_000), ("en", "a\x00b a\x00b " * 12), ("fr", "a a a a a a a a a a a a a a"), ("fr", "naïve Ünder\x85x y　z " * 11), ("en", "one, two. three")]


@pytest.mark.parametrize("run,cells,most", [(collocations.RUN, collocations.CELLS, 3), (200, 1 << 16, 3), (200, 1 << 16, 4), (50, 1 << 16, 2)])
def test_phrases_equal_a_plain_version(spark, run, cells, most):
    rows = texts(1, 300) + ODD + ODD[-3:]
    docs = with_clashes(spark.createDataFrame([(i % 7 or None, t, lang) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3))
    got = sorted(map(tuple, collocations.mine_phrases(docs, most_words=most, run=run, cells=cells).collect()))
    want = plain_phrases(rows, most)
    assert got == want and len(want) > 50


def test_thresholds_and_the_first_ranks(spark):
    rows = texts(2, 200)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], SCHEMA)
    got = sorted(map(tuple, collocations.mine_phrases(docs, least=3, top=5, share=80).collect()))
    assert got == plain_phrases(rows, 3, 3, 5, 80) and len(got) == 15


def test_phrases_of_no_rows(spark):
    assert collocations.mine_phrases(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.mine_phrases(spark.createDataFrame([(1, None, None)], SCHEMA)).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 10**13
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 7)], "lang string, phrase string, words int, f long")
    assert collocations.scored(counts).first()["score"] == 1_000_000 * big * big // ((big + 1) * (big + 7))


def test_bounds_lose_no_phrase():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 5000):
        places = np.sort(rng.integers(0, collocations.BLOCK, n))
        assert (collocations.decoded(collocations.coded(places)) == places).all()
    cells = collocations._capped(np.array([3] * 14 + [1] * 2 + [9], dtype=np.uint32), 10)
    assert cells.tolist() == [1, 1] + [3] * 10 + [9]


def test_long_texts_are_cut_between_pieces():
    import pyarrow as pa

    text = "one two three. " * 50
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", "de"]), pa.array([text, "no end " * 40, None])], ["lang", "text"])
    got = list(collocations.runs([batch], 100))
    assert max(len(t) for _, t in got if b"no end" not in t) <= 101 and sum(t.count(b"one two three") for _, t in got) == 50
    assert any(t.count(b"no end") == 40 for _, t in got)


# --- line dedup ---


def plain_lines(rows, shortest=10, documents=2):
    blanks = " \t\n\x0b\x0c\r"
    keyed = [(doc_id, text, [(line, line.strip(blanks).translate(LOWER)) for line in (text or "").split("\n")]) for doc_id, text in rows]
    holders = defaultdict(set)
    for doc_id, _, lines in keyed:
        for _, key in lines:
            if len(key) >= shortest:
                holders[key].add(doc_id)
    out = []
    for doc_id, _, lines in keyed:
        kept = [line for line, key in lines if len(key) < shortest or len(holders[key]) < documents or min(h for h in holders[key] if h is not None) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(3)
    pool = ["a common long line", "  A COMMON long line\t", "Ünïcödé line here", "short", "", "exactly10!", "exactly 9", " \t ", "İstanbul İstanbul", "a shared line\r", "a shared line", "日本日本日本日本日本", "日本日本日本日本日"]
    rows = [(rng.choice([*range(1, 40), None]), "\n".join(rng.choice([*pool, f"own line {rng.random()}"]) for _ in range(rng.randrange(1, 9)))) for _ in range(120)]
    return [*rows, (50, None), (51, ""), (None, None), (52, "\n"), (53, "a common long line\n" * 3000), (54, "a common long line"), (1, rows[0][1]), *[(60, "twice the same row\nother")] * 2, (None, "only of rows without an id"), (None, "only of rows without an id\n")]


@pytest.mark.parametrize("shortest,documents", [(10, 2), (1, 3), (5, 1)])
def test_lines_equal_a_plain_version(spark, shortest, documents):
    rows = line_rows()
    if documents == 1:  # every key goes but from its first document; a key of no id has none
        rows = [r for r in rows if r[0] is not None]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = line_dedup.drop_shared_lines(docs, shortest, documents)
    got = sorted(map(tuple, found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()), key=str)
    assert got == plain_lines(rows, shortest, documents)


def test_lines_of_no_rows(spark):
    assert line_dedup.drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- whitening ---


VECTORS = "vec_id long, embedding array<float>"


def plain_whitening(rows, most=32):
    """By numpy's symmetric eigenvectors; sums and deviations by Python's numbers."""
    good = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    lengths = Counter(len(v) for _, v in good)
    d = max(lengths, key=lambda k: (lengths[k], k))
    good = [(i, [math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v]) for i, v in good if len(v) == d]
    n, total = len(good), [sum(v[j] for _, v in good) for j in range(d)]
    dev = [[n * v[j] - total[j] for j in range(d)] for _, v in good]
    squares = [sum(e * e for e in own) for own in dev]
    centred = np.array(dev, dtype=float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:most]
    order = order[values[order] > 1e-12 * values[order[0]]]
    trace = float(Fraction(sum(squares), n**3))
    return [i for i, _ in good], n, squares, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / trace


def vectors(n=120, d=40, seed=5):
    rng = np.random.default_rng(seed)
    own = (rng.normal(size=(n, d)) * np.linspace(1, 5, d)).astype(np.float32)
    return [(i, [float(e) for e in v]) for i, v in enumerate(own)]


def compared(spark, rows, most=32):
    found = whitening.whiten(with_clashes(spark.createDataFrame(rows, VECTORS).repartition(3)), most).collect()
    ids, n, squares, white, explained = plain_whitening(rows, most)
    k = white.shape[1]
    assert len(found) == len(ids) * k and {r["n"] for r in found} == {n} and max(r["identity_error"] for r in found) < 1e-4
    own = sorted(((r["component"], str(r["vec_id"]), int(r["deviation"]), r["whitened"], r["explained"]) for r in found), key=lambda r: (r[0], r[1], r[2], abs(r[3])))
    want = sorted(((c + 1, str(i), s, float(w), float(explained[c])) for i, s, own_w in zip(ids, squares, white, strict=True) for c, w in enumerate(own_w)), key=lambda r: (r[0], r[1], r[2], abs(r[3])))
    for c in range(k):
        a, b = own[c * len(ids) : (c + 1) * len(ids)], want[c * len(ids) : (c + 1) * len(ids)]
        assert [r[:3] for r in a] == [r[:3] for r in b]
        x, y = np.array([r[3] for r in a]), np.array([r[3] for r in b])
        assert np.allclose(x, y * np.sign(x @ y), atol=1e-9)
        assert math.isclose(a[0][4], b[0][4], rel_tol=1e-9)


def test_whitening_equals_a_plain_version(spark):
    rows = vectors()
    compared(spark, rows)
    odd = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [1.0] * 39 + [float("-inf")]), (904, [1.0, 2.0]), (905, []), (None, [0.5] * 40), rows[0], rows[0]]
    compared(spark, rows + odd)
    compared(spark, rows, 3)


def test_whitening_of_few_dimensions_and_of_less_rank(spark):
    compared(spark, vectors(50, 4))
    compared(spark, [(i, [*v, v[0]]) for i, v in vectors(12, 20)])  # rank 11 at most


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4, [(1, [])]])
def test_nothing_varies(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect() == []


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [float(2**40) if i % 2 else 0.0, float(i)]) for i in range(1000)]
    found = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).where("component = 1").collect()}
    ids, _, squares, _, _ = plain_whitening(rows)
    assert found == dict(zip(ids, squares, strict=True)) and max(squares) > 2**63


def test_the_query_covers_every_vector(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, n, squares, white, _ = plain_whitening(rows)
    got = queries.op13_whitening(spark, sf).where("component = 32").collect()
    assert {(r["vec_id"], r["deviation"]) for r in got} == set(zip(ids, squares, strict=True)) and {r["n"] for r in got} == {n}
    x = np.array([r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"])])
    y = white[np.argsort(ids), 31]
    assert np.allclose(x, y * np.sign(x @ y), atol=1e-8)


# --- captures and URLs that leave something open ---


def test_captures_with_nulls(spark):
    """No word on being a revisit: a response; no record id: no response that a revisit could take."""
    rows = [(1, "http://a/x", 10, False), (None, "http://a/x", 20, False), (2, "http://a/x", 30, True), (3, "http://b/x", 10, None), (4, "http://b/x", 20, True), (None, "http://c/x", 10, False), (5, "http://c/x", 20, True), (None, "http://a/x", 40, True)]
    captures = spark.createDataFrame([(i, u, t, r, "tag", None, None, {"ETag": "tag"}) for i, u, t, r in rows], warc_revisit.CAPTURES)
    found = {(r["record_id"], r["canonical"]): (r["response_id"], r["outcome"]) for r in warc_revisit.resolve_revisits(captures).collect()}
    assert found == {(2, "a/x"): (1, "resolved"), (4, "b/x"): (3, "resolved"), (5, "c/x"): (None, "no earlier response"), (None, "a/x"): (1, "resolved")}


def test_rules_of_several_words_are_filed_under_the_rarest(spark):
    urls = ["http://a.com/x/Payday-LOAN/1", "http://a.com/loan/payday", "http://loan.com/payday_loan.html", "http://a.com/caſino", "http://a.com/casıno", "http://a.com/CASINO", "http://a.com/paydayloan", "http://wp.a.com/wp/login.php", *[f"http://a.com/loan/{i}" for i in range(9)], None, "nothing"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    counts = url_rules.token_counts(pages, url_rules.PATTERNS)
    assert counts["loan"] > counts["payday"] > counts["php"] == 1
    index = url_rules.RuleIndex(url_rules.PATTERNS, counts)
    names = {t: {url_rules.PATTERNS[k].name for k in own} for t, own in index.filed.items()}
    assert "payday loan" in names["payday"] and "payday loan" not in names.get("loan", ()) and "wp login php" in names["login"]
    got = {r["page_id"]: (r["verdict"], r["pattern"]) for r in url_rules.filter_urls(pages).collect()}
    blocked = {0: "payday loan", 2: "payday loan", 5: "casino", 7: "wp login php"}
    assert got == {i: ("block", blocked[i]) if i in blocked else ("allow", None) for i in range(len(urls))}
    plain = re.compile("|".join(f"(?:^|[^0-9a-z]){'[^0-9a-z]+'.join(p.split())}(?:[^0-9a-z]|$)" for p in url_rules.PATTERN_WORDS))
    for i, url in enumerate(urls):
        host, path = url_rules.host_and_path(url)
        assert bool(plain.search((host + path).translate(LOWER))) == (i in blocked)


def test_license_sql_knows_runs_of_words_and_letters_of_ascii(spark):
    notice = license_scan.TEMPLATES[5].sequence + license_scan.TEMPLATES[1].sequence
    texts = [
        "\n".join(notice), " ".join(notice), "\n\n".join(" ".join(notice[k : k + 3]).upper() for k in range(0, len(notice), 3)), " x ".join(license_scan.TEMPLATES[7].sequence),
        "Released\nunder the\nMİT License", "released under\nthe mit Åicense", "PerKission İ is", "Released under\nlicense", "Licensed\nunder CC BY-NC\n4.0", "MIT\nLicense", "", None,
        f"{'the of a ' * 300}\n{' '.join(notice[:4])}\n{' '.join(notice[4:])}",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (1, " ".join(notice))], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = license_scan.scan_licenses(docs, wrapped=True).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    compare.assert_same(got, con, queries.OP3_SQL)
    assert {r["labels"] for r in got.collect()} >= {"bsd,mit", "cc-by-nc", "mit", ""}
