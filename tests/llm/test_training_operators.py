"""Each operator against a brute-force version, and on odd rows: nulls, empty and long texts, ties, repeats, no rows, other columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from ledgerline.llm import bpe, common, components, exact_dedup, language_id, license_scan, ngram_join, packing, quality_ranker, queries, repetition, url_rules, warc_revisit

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    """The small table's documents, with rows of every odd kind."""
    own = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [
        (10_001, None, None, None, None), (10_002, "", "en", "x", 0), (10_003, " \t\n ", "en", "x", 4), (10_004, "a", "en", "x", 1), (10_005, "a b", "en", "x", 3), (10_006, "A b", "en", "x", 3), (10_007, "1 2 3 ...", "en", "x", 9),
        (10_008, "word " * 30_000, "en", "x", 150_000), (10_009, "x" * 50_000, "en", "x", 50_000), (10_010, "same text here\n" * 4, "en", "x", 60), (10_011, "same text here\n" * 4, "en", "x", 60), (10_011, "same text here\n" * 4, "en", "x", 60),
        (None, "same text here\n" * 4, "en", "x", 60), (None, "no id at all, only words", None, "x", 24), (10_012, "Released under the MIT License, mit license MIT LICENSE", "en", "x", 50), (10_013, "It's <|endoftext|>naïve ΑΣ 日本 İ\x1c\x85b", "fr", "x", 20), (10_014, "# * $ % & | < >" * 9, "en", "x", 99),
    ]
    return own.unionByName(spark.createDataFrame(odd, SCHEMA)).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df):
    """Columns whose names the operators use themselves."""
    return df.withColumns({c: F.lit("?") for c in ("digest", "salt", "score", "rank", "a", "b", "member", "keep_id", "low", "line", "ids", "n", "features", "rejected", "own_digest", "component_id", "fold")})


# --- queries with SQL ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare.assert_same(queries.QUERIES[name](spark, SF), compare.connection(SF), queries.ORACLE_SQL[name])


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 11))


# --- 1 and 9: tokens ---


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_ids_and_decoded_text_equal_the_library(docs, rows, library):
    expected = Counter()
    for doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        expected[doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(told.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_digests(with_clashes(docs), VOCABULARY).collect())) == expected


def test_random_text_encodes_as_the_library_does(library):
    own, rnd = bpe.encoder(VOCABULARY), random.Random(3)
    texts = ["".join(chr(rnd.choice((rnd.randrange(32, 127), rnd.randrange(0x20, 0x2FFF), rnd.randrange(0x1F000, 0x1FAFF)))) for _ in range(60)) for _ in range(300)]
    texts += ["ab" * 500, "aaaa" * 100 + " b", "x'll'RE 'd'", "<|startoftext|><|endoftext|> <|endoftext"]
    for text in texts:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(own.encode(text)) == library.decode(own.encode(text).tolist(), skip_special_tokens=False)


def test_forgetting_runs_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    own = bpe.WordBpe(VOCABULARY)
    for text in ("one two three four five six " * 3, "seven eight nine ten eleven twelve one two", "a b c d e f g h i j k l m n o p q r s t u v"):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_how_much_is_remembered_changes_no_piece(docs):
    few, many = (Counter(map(tuple, packing.pack_documents(docs.coalesce(1), VOCABULARY, remembered=n).collect())) for n in (20, 1_000_000))
    assert few == many


def test_what_is_remembered_is_bounded_in_bytes(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 1 << 20)
    own, rnd = bpe.WordBpe(VOCABULARY), random.Random(9)
    for _ in range(12):
        text = "".join(rnd.choices("0123456789abcdef,日本", k=200_000))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.now.bytes + own.elder.bytes < 2 * (1 << 20) + 2 * 8 * 200_000


def test_encoding_of_nothing(nothing):
    assert bpe.encode_digests(nothing, VOCABULARY).isEmpty()
    assert bpe.encode_documents(nothing, VOCABULARY).isEmpty()


def test_documents_with_their_ids(docs, rows, library):
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in bpe.encode_documents(docs, VOCABULARY).collect())
    assert got == Counter((d, tuple(library.encode(t, add_special_tokens=False).ids)) for d, t in rows)


@pytest.mark.parametrize("block", [2, 128])
def test_pieces_cover_documents_and_sequences(docs, rows, library, block):
    pieces = packing.pack_documents(with_clashes(docs), VOCABULARY, block=block).collect()
    whole = Counter()
    for doc_id, text in rows:
        whole[doc_id] += len(library.encode(text, add_special_tokens=False).ids) + 1
    found = defaultdict(int)
    for p in pieces:
        found[p["doc_id"]] += p["length"]
    assert dict(found) == dict(whole)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"], p["sequence_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == parts[0][2] <= 4096 and at & (at - 1) == 0


def test_pieces_hold_the_documents_ids(spark, library):
    df = spark.createDataFrame([(i, f"some words of number {i} " * (i * 40 + 1)) for i in range(40)], "doc_id long, text string").coalesce(1)
    by_doc = defaultdict(list)
    for p in packing.pack_documents(df, VOCABULARY, keep_ids=True).collect():
        assert zlib.crc32(struct.pack(f"<{p['length']}I", *p["ids"])) == p["ids_crc32"]
        by_doc[p["doc_id"]].append((p["start"], p["ids"], p["doc_tokens"]))
    for r in df.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids + [2]
        assert [i for _, own, _ in sorted(by_doc[r["doc_id"]]) for i in own] == ids
        assert {n for *_, n in by_doc[r["doc_id"]]} == {len(ids)}


def test_costs_are_balanced():
    rnd = random.Random(1)
    packer = packing.Packer()
    pieces = [p for k in range(3000) for p in packer.add(k, rnd.randrange(1, 2000))] + list(packer.finish())
    cost = defaultdict(float)
    for _, _, n, sequence, _, size in pieces:
        if size == 4096:
            cost[sequence] += n + n * n / 4096
    values = sorted(cost.values())
    assert values[-1] / values[0] < 1.6


def test_packing_nothing(nothing):
    assert packing.pack_documents(nothing, VOCABULARY).isEmpty()
    with pytest.raises(ValueError):
        packing.Packer(1000)


# --- 2 ---


@pytest.mark.parametrize("digest,hot,salts", [(exact_dedup.sha256, 512, 64), (lambda c: F.length(c) % 7, 8, 3), (lambda c: F.lit("one"), 4, 5)])
def test_dedup_compares_texts_whatever_the_digest(docs, rows, digest, hot, salts):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text].append(doc_id)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = Counter((d, largest[t], len(groups[t])) for d, t in rows)
    got = exact_dedup.duplicates(with_clashes(docs), digest, hot, salts).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_one_of_equal_rows_stays(spark):
    rows = [(None, "x")] * 5 + [(7, "y")] * 4 + [(3, "y"), (7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for digest in (exact_dedup.sha256, lambda c: F.lit("one")):
        got = exact_dedup.duplicates(df, digest).where("kept").collect()
        assert Counter((r["doc_id"], r["group_size"]) for r in got) == Counter([(None, 5), (7, 5), (7, 1)])


def test_dropping_keeps_columns_of_any_name(spark, docs, rows):
    names = {"own_digest": "?", "kept_id": 1, "kept_digest": "?", "own_id": 2, "row": "?"}
    df = docs.withColumns({k: F.lit(v) for k, v in names.items()})
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(r["text"] or "" for r in got) == sorted({t for _, t in rows})
    assert all(r[k] == v for r in got for k, v in names.items())


def test_dropping_leaves_one_row_for_each_text(docs, rows):
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t for _, t in rows})


def test_dedup_of_nothing(nothing):
    assert exact_dedup.duplicates(nothing).isEmpty()
    assert exact_dedup.drop_duplicates(nothing).isEmpty()


# --- 3 ---


def brute_licenses(text):
    low = text.translate(LOWER)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, best = set(base), 1.0 if base else 0.0
    for line in low.split("\n"):
        held = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for t in license_scan.TEMPLATES:
            share = len(held & set(t.words)) / len(t.words)
            if share >= license_scan.THRESHOLD:
                labels.add(t.label)
                best = max(best, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best


def test_licenses_equal_brute_force(spark, docs):
    rnd = random.Random(5)
    pool = sorted({w for t in license_scan.TEMPLATES for w in t.words} | {"zebra", "apache", "mit", "license", "general", "public"})
    texts = ["\n".join(" ".join(rnd.choices(pool, k=rnd.randrange(30))) for _ in range(4)) for _ in range(150)] + [t.text.upper() + "!" for t in license_scan.TEMPLATES] + ["mit license mit license", "mit-license,MIT\nLicense", "mitlicense", None, "", "M\u0130T license, Mozilla Public L\u0130cense", "B\u212a mit \u212aLicense \u212a"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = license_scan.scan_licenses(with_clashes(df)).drop("n_matches").collect()
    expected = Counter((r["doc_id"], *brute_licenses(r["text"] or "")) for r in df.collect())
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in got) == expected


def brute_wrapped(text):
    """Labels and score with runs of words beside lines."""
    *_, labels, best = brute_licenses(text)
    words, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER)), {x for x in labels.split(",") if x}
    for t in license_scan.TEMPLATES:
        for i in range(len(words)):
            share = len(set(words[i : i + len(t.sequence)]) & set(t.words)) / len(t.words)
            if share >= license_scan.THRESHOLD:
                labels.add(t.label)
                best = max(best, share)
    return ",".join(sorted(labels)), best


def test_wrapped_notices(spark, tmp_path):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mpl = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at http://mozilla.org/MPL/2.0/."
    far = "Released\n" + "other words\n" * 9 + "under the MIT\n" + "other words\n" * 9 + "License"
    rnd = random.Random(6)
    pool = sorted({w for t in license_scan.TEMPLATES for w in t.words} | {"zebra", "other"})
    texts = [bsd, mpl, far, None, ""] + [re.sub(" ", lambda m: rnd.choice(" \n"), rnd.choice(license_scan.TEMPLATES).text + " " + " ".join(rnd.choices(pool, k=rnd.randrange(20)))) for _ in range(40)]
    texts += ["\n".join(" ".join(rnd.choices(pool[:15], k=rnd.randrange(8))) for _ in range(12)) for _ in range(40)] + ["\n".join(t.text.split()) for t in license_scan.TEMPLATES]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in queries.QUERIES["op3_license_scan"](spark, str(tmp_path)).collect()}
    assert (got[0][0], got[1][0], got[2][0]) == ("bsd", "mpl", "")
    assert got == {i: brute_wrapped(t or "") for i, t in enumerate(texts)}


def test_licenses_of_nothing(nothing):
    assert license_scan.scan_licenses(nothing).isEmpty()


# --- 4 ---


def test_revisits_take_the_latest_earlier_response(spark):
    rnd = random.Random(2)
    urls = ["http://A.example/x", "https://www.a.example:443/x/#f", "http://b.example/?b=2&a=1&utm_source=z", "http://b.example/?a=1&b=2", None, ""]
    caps = [(i, rnd.choice(urls), rnd.choice([None, rnd.randrange(40)]) if rnd.random() < 0.1 else rnd.randrange(40), rnd.random() < 0.5, rnd.choice([None, '"1"', 'W/"1"', '"2"']), rnd.choice([None, "d1", "d2"]), None, {"ETag": "x", "Server": "a", "DATE": str(i)} if rnd.random() < 0.8 else None) for i in range(400)]
    caps += [caps[0], (None, urls[0], 39, True, None, None, None, None)]
    df = spark.createDataFrame(caps, warc_revisit.CAPTURES)
    names = {urls[0]: "a.example/x", urls[1]: "a.example/x", urls[2]: "b.example?a=1&b=2", urls[3]: "b.example?a=1&b=2", None: None, "": None}
    expected = []
    for i, url, t, revisit, tag, date, _, _ in caps:
        if not revisit:
            continue
        before = [(c[2], c[0]) for c in caps if not c[3] and names[c[1]] and names[c[1]] == names[url] and c[2] is not None and t is not None and c[2] < t]
        found = next(c for c in caps if c[0] == max(before)[1]) if before else None
        same_tag = None if found is None or tag is None or found[4] is None else tag.removeprefix("W/") == found[4].removeprefix("W/")
        same_date = None if found is None or date is None or found[5] is None else date == found[5]
        outcome = "no earlier response" if found is None else "other entity tag" if same_tag is False else "other modification date" if same_date is False else "no common validator" if same_tag is None and same_date is None else "resolved"
        expected.append((i, names[url], found[0] if outcome == "resolved" else None, outcome))
    got = warc_revisit.resolve_revisits(df, bucket=7)
    assert Counter(map(tuple, got.select("record_id", "canonical", "response_id", "outcome").collect())) == Counter(expected)
    assert warc_revisit.resolve_revisits(df.limit(0)).isEmpty()


def test_equal_record_ids_take_the_largest_content(spark):
    rows = [(1, "http://a/", 5, False, tag, None, None, {"x": x}) for tag, x in (('"1"', "a"), ('"2"', "a"), ('"2"', "b"))] + [(9, "http://a/", 8, True, '"2"', None, None, {"Date": "d"})]
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, warc_revisit.CAPTURES).withColumns({c: F.lit("?") for c in ("canonical", "bucket", "response_id", "outcome", "salt", "answer", "their_etag")})
        assert [(r["record_id"], r["outcome"], r["headers"]) for r in warc_revisit.resolve_revisits(df).collect()] == [(9, "resolved", {"x": "b", "date": "d"})]


def test_only_permitted_headers_are_merged(spark):
    df = spark.createDataFrame([({"ETag": "1", "Content-Type": "a", "content-length": "5", "Etag": "0"}, {"etag": "2", "Content-Length": "0", "Date": "d", "Connection": "close"})], "r map<string,string>, v map<string,string>")
    merged = df.select(warc_revisit.merged_headers(F.col("r"), F.col("v")).alias("m")).first()["m"]
    assert merged == {"etag": "2", "content-type": "a", "content-length": "5", "date": "d"}


# --- 5 ---


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality_ranker(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r["n"] > 50 and r["right"] > 0.95
    assert got.where("score < 0 or score > 1 or score is null").isEmpty()
    assert got.where("predicted != cast(score >= 0.3 as int)").isEmpty()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got.collect())


def test_quality_of_odd_rows(spark, docs, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (10_004, None, 0), (10_005, 0, 0), (10_005, 1, 0)], "doc_id long, quality int, toxic int").select([F.col(c).cast(labels.schema[c].dataType) for c in labels.columns]))
    assert quality_ranker.ranked(with_clashes(docs), odd).count() == docs.count()
    assert quality_ranker.ranked(nothing, labels).isEmpty()
    unknown = quality_ranker.ranked(docs, labels.limit(0))
    assert {r["score"] for r in unknown.select("score").distinct().collect()} == {0.5}


def plain_features(text):
    """As quality_ranker.FEATURES, one by one."""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n, chars = max(len(words), 1), max(sum(map(len, words)), 1)

    def repeated(k):
        at = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        return len({j for i in range(len(words) - k + 1) if at[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}) / n

    def share(signs):
        return sum(c in signs for c in text) / chars

    symbols = share("#*$%&|<>{}[]\\^~_=+@`")
    five = repeated(5)
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, np.log1p(len(lines)), repeated(3), five, (len(lines) - len(set(lines))) / max(len(lines), 1), len(set(words)) / n, sum(len(w) == 1 for w in words) / n, sum(len(w) > 20 for w in words) / n,
        share(".,;:!?'\"()-"), share("0123456789"), min(symbols, 1), min(symbols * 20, 1), min(five * 3, 1), min(symbols, 1) ** 2,
    ]


def test_features_equal_plain_ones(rows):
    texts = [t for _, t in rows]
    assert np.allclose(quality_ranker.features(texts), [plain_features(t) for t in texts], atol=1e-12)


def test_scores_equal_a_plain_fit(spark):
    """The whole query again: same sample, pairs and threshold, the loss minimised by plain gradient steps."""
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in texts}
    good, bad = (np.array([plain_features(texts[d]) for d in sorted(labels) if labels[d] == q]) for q in (1, 0))
    both = np.concatenate((good, bad))
    mean, spread = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-6)

    def scaled(x):
        return np.clip((x - mean) / spread, -8, 8)

    differences = (scaled(good)[:, None, :] - scaled(bad)[None, :, :]).reshape(-1, good.shape[1])
    w = np.zeros(good.shape[1])
    for _ in range(60_000):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
        w -= 0.2 * (-(differences * p[:, None]).mean(axis=0) + quality_ranker.PENALTY * w)
    ranks = np.sort(scaled(both) @ w)
    k = len(bad) - 1
    cut = (ranks[k] + ranks[k + 1]) / 2
    expected = {d: 1 / (1 + np.exp(-np.clip(scaled(np.array([plain_features(t)])) @ w - cut + np.log(0.3 / 0.7), -30, 30)))[0] for d, t in texts.items()}
    got = {r["doc_id"]: r["score"] for r in queries.op5_quality_ranker(spark, sf).collect()}
    assert max(abs(got[d] - expected[d]) for d in texts) < 0.02
    near = {d for d in texts if abs(expected[d] - 0.3) < 0.02}
    assert all((got[d] >= 0.3) == (expected[d] >= 0.3) for d in set(texts) - near)


def test_training_on_an_id_that_repeats(spark):
    many = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("same words here "), (F.col("id") % 3).cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs = many.unionByName(spark.createDataFrame([(8, "der hund und die katze", "de"), (9, "# # $ $", "de")], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(7, 1), (8, 1), (9, 0), (7, 1)], "doc_id long, quality int")
    one = quality_ranker.train(docs.where("doc_id != 7").unionByName(many.limit(3)), labels, F.lit(True))
    assert np.allclose(quality_ranker.train(docs, labels, F.lit(True)).weights, one.weights)
    model = language_id.train(docs, F.lit(True))
    assert model.languages == ["de", "en"] and (model.owner == 1).sum() == 1


def test_models_replace_columns_of_their_names(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_ranker.score(with_clashes(docs), quality_ranker.train(docs, labels, F.lit(True)))
    told = language_id.identify(with_clashes(docs).withColumn("lang_pred", F.lit("?")), language_id.train(docs, F.lit(True)))
    assert scored.where("score >= 0").count() == told.where("score >= 0 and rejected is not null and lang_pred != '?'").count() == docs.count()
    assert scored.columns.count("score") == told.columns.count("score") == told.columns.count("rejected") == 1


def test_ranks_order_pairs_and_the_quantile_cuts():
    rnd = np.random.default_rng(0)
    good, bad = rnd.normal(1, 1, (300, 4)), rnd.normal(-1, 1, (100, 4))
    model = quality_ranker.fit(good, bad, 0.25)
    both = np.concatenate((good, bad))
    assert abs((model.scores(both) < 0.3).mean() - 0.25) < 0.02
    assert (model.ranks(good)[:, None] > model.ranks(bad)[None, :]).mean() > 0.95


def test_the_fit_is_that_of_all_rows_and_pairs(spark):
    """4,200 rows of a label and 8.8 million pairs: weights at which the plain loss of all of them is flat, and the exact quantile."""
    rnd = random.Random(5)
    rows = [(i, i % 3 > 0, " ".join(rnd.choice(["a", "tree", "#", "12", "houses."] + ["|", "the"] * (i % 3 > 0 or rnd.random() < 0.3)) for _ in range(rnd.randint(3, 30)))) for i in range(6300)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string").repartition(5)
    model = quality_ranker.train(docs, spark.createDataFrame([(i, int(q)) for i, q, _ in rows], "doc_id long, quality int"), F.lit(True))
    x, good = quality_ranker.features([t for _, _, t in rows]), np.array([q for _, q, _ in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.spread, np.maximum(x.std(axis=0), 1e-6))
    z, ranks = model.scaled(x), model.ranks(x)
    p = 1 / (1 + np.exp(ranks[good][:, None] - ranks[~good][None, :]))
    slope = -(z[good].T @ p.sum(axis=1) - z[~good].T @ p.sum(axis=0)) / p.size + quality_ranker.PENALTY * model.weights
    assert np.abs(slope).max() < 1e-4
    assert model.threshold == pytest.approx(np.sort(ranks)[[2099, 2100]].mean(), abs=1e-9)


def test_sums_by_cell_give_the_loss_of_all_pairs():
    rnd = np.random.default_rng(3)
    good, bad, w = rnd.normal(0.5, 1, (70, 4)), rnd.normal(0, 1, (50, 4)), np.array([3.0, -1, 0.2, 5])
    t = (good @ w)[:, None] - (bad @ w)[None, :]
    loss, slope, _ = quality_ranker._loss(quality_ranker._sums(good, w), quality_ranker._sums(bad, w), 4)
    p = 1 / (1 + np.exp(t))
    assert loss == pytest.approx(np.logaddexp(0, -t).mean(), abs=1e-9)
    assert np.allclose(slope, -(p[:, :, None] * (good[:, None] - bad[None, :])).mean(axis=(0, 1)), atol=1e-8)


def test_order_statistics_are_exact(spark):
    rnd = random.Random(2)
    rows = [(g, rnd.choice([rnd.gauss(0, 1), 0.25, rnd.random() * 1e-9])) for g in "abc" for _ in range(900)] + [("one", 4.0)]
    values = {g: sorted(v for h, v in rows if h == g) for g in ("a", "b", "c", "one")}
    wanted = {"a": [0, 45, 46, 899], "b": [450], "c": [300, 301], "one": [0]}
    got = common.order_statistics(spark.createDataFrame(rows, "group string, value double"), wanted, 8)
    assert got == {(g, k): values[g][k] for g, places in wanted.items() for k in places}


# --- 6 ---


def brute_components(rows, shingle, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(text.translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else []))
    parent, links = list(range(len(rows))), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * (n := len(sets[i] & sets[j])) >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
                links.update((i, j))
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    return Counter((doc_id, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None), links[i]) for i, (doc_id, _) in enumerate(rows))


def near_copies(seed, n=150):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.choice((4, 30, 60, 120)))] for _ in range(6)]
    passage = [f"p{i}" for i in range(25)]
    out = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 4))):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10_000)}"
        if rnd.random() < 0.3:
            words = passage + words
        out.append((i, rnd.choice((" ", "\n", "\t ")).join(words)))
    return out


@pytest.mark.parametrize("seed,shingle,percent,light", [(0, 3, 90, 64), (1, 3, 90, 2), (2, 5, 80, 4), (3, 1, 60, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, shingle, percent, light):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 600)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 9)
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, ngram_join.similar_groups(df, shingle, percent, light).collect())) == brute_components(rows, shingle, percent)


def test_groups_of_odd_rows(docs, rows, nothing):
    assert Counter(map(tuple, ngram_join.similar_groups(with_clashes(docs)).collect())) == brute_components(rows, 3, 90)
    assert ngram_join.similar_groups(nothing).isEmpty()


def alternating(k):
    """Two words of 2**k letters that polynomials modulo 2**64 don't tell apart."""
    one = "a"
    for _ in range(k):
        one += one.translate({97: 98, 98: 97})
    return one, one.translate({97: 98, 98: 97})


@pytest.mark.parametrize("k", [10, 11, 12])
def test_words_that_simple_hashes_confuse(spark, k):
    x, y = alternating(k)
    repeated = f"{x} one two three four {y} one two three four five six"
    assert repetition.measure([repeated])["n_repeat_words"][0] == brute_repetition(repeated)[4] == 0
    rows = [(1, f"{x} {y} {x}"), (2, f"{y} {x} {y}"), (3, f"{x} {x} {x}"), (4, f"{x} {y}"), (5, f"{y} {x}"), (6, x), (7, y)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, ngram_join.similar_groups(df).collect()))
    assert got == brute_components(rows, 3, 90) == Counter((d, 1, d, 0) for d, _ in rows)


@pytest.mark.parametrize("percent,light", [(90, 64), (80, 3)])
def test_groups_of_whole_table_equal_brute_force(spark, percent, light):
    """The documents of the middle table: brute force over pairs that share a shingle."""
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, ngram_join.similar_groups(df, 3, percent, light).collect())) == brute_components(rows, 3, percent)


def test_chance_candidates_are_not_fetched(spark, monkeypatch):
    """With a sketch that tells no counts apart, as of a large table, texts far from alike share prefix members."""
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", (4, 4))
    monkeypatch.setattr(ngram_join, "PRIOR", 1e-6)
    rnd, fetched, members = random.Random(4), [], ngram_join._members
    vocabulary = [f"w{i}" for i in range(800)]
    rows = [(i, " ".join(rnd.sample(vocabulary, 100))) for i in range(120)]
    rows += [(200 + i, f"{t} more") for i, t in rows[:3]]
    monkeypatch.setattr(ngram_join, "_members", lambda docs, wanted, shingle: fetched.append(wanted.count()) or members(docs, wanted, shingle))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90).collect()}
    assert got == {i: i - 200 if i >= 200 else i for i, _ in rows}
    assert fetched == [6]


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_signatures_never_rule_out_a_link(percent):
    rnd = np.random.default_rng(percent)
    for n in (1, 7, 60, 511, 512, 520, 5000):
        own = rnd.integers(0, 2**63, n).astype(np.uint64)
        for gone in {0, n // 20, n // 9, n // 5, n // 3}:
            other = np.concatenate((own[gone:], rnd.integers(0, 2**63, rnd.integers(0, gone + 1)).astype(np.uint64)))
            apart = len(np.setxor1d(own, other))
            told = ngram_join.difference(ngram_join.signature(own), ngram_join.signature(other)[None, :])[0]
            assert told <= apart
            shared = len(np.intersect1d(own, other))
            assert (100 * shared >= percent * (n + len(other) - shared)) == (apart <= ngram_join.most_difference(n, np.array([len(other)]), percent)[0])


def test_equal_hashes_of_windows_are_confirmed(monkeypatch):
    monkeypatch.setattr("ledgerline.llm.common.sequence_hashes", lambda low, high, at, n: np.zeros(len(at), dtype=np.uint64))
    for text in ("a b c d e f g h i j", "a b c d e x a b c d e", "a a a a a a a"):
        assert repetition.measure([text])["n_repeat_words"][0] == brute_repetition(text)[4]


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(-60, 60), rnd.randrange(-60, 60)) for _ in range(50)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 1), (5, 5), (-(2**63), 2**63 - 1)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()}
    assert got == {x: root(x) for x in list(parent)}


# --- 7 ---


def test_only_candidates_run_and_verdicts_equal_all_rules():
    rules = [*url_rules.SITES, *url_rules.PATTERNS, url_rules.site_rule("block", "io"), url_rules.Rule("any", "block", r".*\?never", ())]
    index = url_rules.RuleIndex(rules, {"com": 1000, "en": 900, "example": 800, "net": 5})
    rnd = random.Random(4)
    hosts = ["example.com", "a.example.com", "badexample.com", "x.net", "example.net", "casino.org", "mycasino.org", "x.io", "io", "", "com", "EXAMPLE.com"]
    urls = [f"http://{rnd.choice(hosts)}{rnd.choice(('/', ':80/', ''))}{rnd.choice(('en/7', 'en/', 'de/8x', 'de/', 'es/', 'Casino/x', 'poker-night'))}{rnd.choice(('?q=casino', '#f', ''))}" for _ in range(400)] + [None, "", "nothing", "://", "a://b://c"]
    ran = 0
    for url in urls:
        host, path = url_rules.host_and_path(url)
        site, verdict, _, n = index.judge(host, path)
        ran += n
        fits = [r for r in url_rules.SITES if (host == (h := r.name.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.name.partition("/")[2])]
        best = max(fits, key=lambda r: len(r.name), default=None)
        if host == "io" or host.endswith(".io"):
            assert site == "io"
            continue
        assert site == (best and best.name)
        words = re.split("[^0-9a-z]+", (host + path).lower())
        assert verdict == (best.verdict if best else "block" if set(words) & set(url_rules.UNWANTED) else "allow"), url
    assert ran < len(urls) * len(rules) / 3


def test_odd_urls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (None, "HTTP://Ä.Com/a?b"), (5, "http://h"), (5, "http://h")], "page_id long, url string").withColumn("rule", F.lit(1))
    got = sorted(((r["page_id"] or 0), r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.filter_urls(df).collect())
    assert got == [(0, "Ä.com", "/a", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (5, "h", "", None, "allow"), (5, "h", "", None, "allow")]
    assert url_rules.filter_urls(df.limit(0)).isEmpty()
    assert url_rules.filter_urls(df, []).count() == 6


# --- 8 ---


def brute_repetition(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def test_repetition_equals_brute_force(spark, docs):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab \n\té\x0b\x85") for _ in range(rnd.randrange(90))) for _ in range(300)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = repetition.repetition_rules(with_clashes(df)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *[r[c] for c in names]) for r in got) == Counter((r["doc_id"], *brute_repetition(r["text"] or "")) for r in df.collect())
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_shares_are_of_characters():
    found = repetition.measure(["aa bb cc aa bb dd\nline of text\nline of text"])
    assert found["share_2"][0] == pytest.approx((8 + 20) / 32)
    assert found["dup_line_share"][0] == pytest.approx(10 / 32)


def test_repetition_of_nothing(nothing):
    assert repetition.repetition_rules(nothing).isEmpty()
    with pytest.raises(ValueError):
        repetition.repetition_rules(nothing, {4: 0.1})


# --- 10 ---


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    assert got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got.collect())


def test_language_of_odd_rows(docs, rows, nothing):
    got = language_id.predictions(with_clashes(docs)).collect()
    assert len(got) == len(rows)
    letters = {d: any(c.isalpha() for c in t) for d, t in rows}
    known = {"de", "en", "es", "fr"}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] in known) if letters[r["doc_id"]] else (r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0)
        assert 0 <= r["score"] <= 1
    assert language_id.predictions(nothing).isEmpty()
    assert {r["lang_pred"] for r in language_id.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_grams(text):
    """Counts of the hashed grams, one character after the other."""
    if not text or not any(c for c in text.lower() if __import__("unicodedata").category(c)[0] == "L"):
        return None
    kept, was = [32], False
    for c in text.lower():
        letter = __import__("unicodedata").category(c)[0] == "L"
        if letter or was:
            kept.append(ord(c) if letter else 32)
        was = letter
    kept.append(32)
    a, b, c, m = int(language_id._A), int(language_id._B), int(language_id._C), 2**32 - 1
    grams = [x * a & m for x in kept[1:-1]] + [((x * a + y) * b) & m for x, y in zip(kept, kept[1:])]
    grams += [(((x * a + y) * b & m) + z) * c & m for x, y, z in zip(kept, kept[1:], kept[2:])]
    out = [0] * language_id.SIZE
    for g in grams:
        out[((g ^ g >> 15) * b & m) >> 20] += 1
    return out


def test_predictions_equal_plain_ones(spark):
    """The whole query again in plain steps: counts, weights, clusters, cosines and cuts."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = {d: plain_grams(t) for d, t, _ in rows}
    known = [(lang, counts[d]) for d, _, lang in rows if lang is not None and zlib.crc32(str(d).encode()) % 3 != 1 and counts[d] is not None]
    n, size = len(known), language_id.SIZE
    held = [sum(c[k] > 0 for _, c in known) for k in range(size)]
    idf = [np.log((1 + n) / (1 + h)) + 1 for h in held]

    def vector(c):
        v = [np.log1p(x) * w for x, w in zip(c, idf, strict=True)]
        length = sum(x * x for x in v) ** 0.5
        return np.array(v) / length

    centres, cuts = [], {}
    for lang in sorted({x for x, _ in known}):
        own = [vector(c) for x, c in known if x == lang]
        mine = [sum(own) / len(own)]
        mine = [mine[0] / np.linalg.norm(mine[0])]
        while len(mine) < min(3, len(own)):
            mine.append(min(own, key=lambda v: max(float(v @ c) for c in mine)))
        for _ in range(language_id.ROUNDS):
            groups = defaultdict(list)
            for v in own:
                groups[max(range(len(mine)), key=lambda i: float(v @ mine[i]))].append(v)
            mine = [(m := sum(groups[i]) / len(groups[i])) / np.linalg.norm(m) if groups[i] else mine[i] for i in range(len(mine))]
        centres += [(lang, c) for c in mine]
        cuts[lang] = 0.35 * float(np.quantile([max(float(v @ c) for c in mine) for v in own], 0.05))
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, SF).collect()}
    for d, _, _ in rows:
        if counts[d] is None:
            assert got[d]["lang_pred"] == "und"
            continue
        v = vector(counts[d])
        best = max(((float(v @ c), lang) for lang, c in centres), key=lambda x: x[0])
        assert got[d]["score"] == pytest.approx(min(1, max(0, best[0])), abs=1e-9)
        assert got[d]["lang_pred"] == best[1] and got[d]["rejected"] == (best[0] < cuts[best[1]])


def test_the_model_is_that_of_all_texts(spark):
    """1,300 texts of one language and 40 of another, against the fit of all of them in memory."""
    rnd = random.Random(6)
    parts = {"en": ["the", "and", "house", "tree", "walking"], "de": ["der", "und", "haus", "baum", "gehen"]}
    rows = [(i, " ".join(rnd.choices(parts[x], k=rnd.randint(2, 12))), x) for i, x in enumerate(["en"] * 1300 + ["de"] * 40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), F.lit(True))
    told = sorted((lang, language_id.packed(language_id.counted(t)), t) for _, t, lang in rows)
    plain = language_id.fit(np.array([language_id.counted(t) for _, _, t in told], dtype=float), [lang for lang, _, _ in told])
    assert model.languages == plain.languages and (model.owner == plain.owner).all()
    assert np.allclose(model.idf, plain.idf) and np.allclose(model.centroids, plain.centroids) and np.allclose(model.least, plain.least)


@pytest.mark.parametrize("text", ["a", "naïve ΑΣ 日本 İ", "word " * 70_000])
def test_counts_are_packed_whole(text):
    counts = language_id.counted(text)
    at, own, starts = language_id.unpacked([language_id.packed(counts)] * 2)
    assert (np.bincount(at[: starts[1]], weights=own[: starts[1]], minlength=language_id.SIZE) == counts).all()
    assert (at[starts[1] :] == at[: starts[1]]).all()


def test_other_languages_and_random_letters_are_rejected(spark):
    sf, rnd = "/root/testdata/sf0.01", random.Random(1)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs, F.lit(True))
    far = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Wszyscy ludzie rodzą się wolni i równi w swej godności i prawach", "жук"]
    far += ["".join(rnd.choice("bcdfghjklmnpqrstvwxz ") for _ in range(200)) for _ in range(20)]
    assert all(model.predict(t)[2] for t in far)
    assert language_id.identify(docs.where("lang is not null and length(text) > 20"), model).where("rejected").isEmpty()


def test_a_thousand_languages_are_learned(spark, monkeypatch):
    texts = {f"l{i:04d}": "".join(chr(0x4E00 + i * 12 + k % 12) + (" " if k % 5 == 4 else "") for k in range(40)) for i in range(1000)}
    df = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(texts.items())], "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True), rounds=1)
    assert model.languages == sorted(texts)
    told = model.predict_all(list(texts.values()))
    assert [t[0] for t in told] == list(texts) and not any(t[2] for t in told)
    monkeypatch.setattr(language_id, "MODEL_BYTES", 8 * language_id.SIZE * language_id.CLUSTERS * 999)
    with pytest.raises(ValueError, match="999 languages"):
        language_id.train(df, F.lit(True))


def test_far_vectors_are_rejected():
    texts = {"en": ["the cat and the dog", "the house and the tree"], "de": ["der hund und die katze", "das haus und der baum"]}
    counts = np.array([language_id.counted(t) for own in texts.values() for t in own], dtype=float)
    model = language_id.fit(counts, [k for k, own in texts.items() for _ in own], clusters=2)
    assert model.predict("the dog and the house")[0] == "en"
    assert model.predict("жук")[2]
    assert not model.predict("der baum und die katze")[2]
