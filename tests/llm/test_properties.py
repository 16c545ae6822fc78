"""Properties of the kernels that run inside tasks, on generated inputs."""

import re
import sys
import time
import weakref
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import bpe, common, language_id, ngram_join, packing, repetition, url_rules

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
TEXT = st.text(st.characters(exclude_categories=("Cs",)), max_size=200)
WORDY = st.lists(st.sampled_from(["a", "B", "ab", "é", " ", "\n", "\t", "\x85", "\x1c", "ΑΣ", "日"]), max_size=60).map("".join)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT | WORDY, max_size=4))
def test_encoding_equals_the_library(texts):
    for text, ids in zip(texts, bpe.encoder(VOCABULARY).encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_cost_no_search_through_far_ranges():
    """Words take about as long as with ranges up to U+FFFF alone, and far characters part where the library parts them."""
    words, near = bpe.word_pattern(), re.compile("[^\\W\\d_]+|[\\W\\d_]")
    text = "word, and more. " * 20_000

    def least(pattern):
        times = []
        for _ in range(5):
            began = time.thread_time()
            pattern.findall(text)
            times.append(time.thread_time() - began)
        return min(times)

    assert least(words) < 3 * least(near)
    for far in ("a\U00010400b\U00010428", "1\U0001d7ce2\U0001f600!\U0001f468?", "\U00020000日\U0001f600\U0001f600x", "'s\U0001f600's"):
        assert bpe.encoder(VOCABULARY).encode(far).tolist() == LIBRARY.encode(far, add_special_tokens=False).ids
    assert "".join(words.findall("".join(map(chr, range(0xE000, sys.maxunicode + 1))))) == "".join(c for c in map(chr, range(0xE000, sys.maxunicode + 1)) if c not in bpe.WHITE)


def test_a_worker_lets_go_of_the_encoder_for_another_operator():
    first = weakref.ref(bpe.encoder(VOCABULARY))
    assert bpe.encoder(VOCABULARY) is first()
    list(language_id._runs([], []))
    assert first() is None


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abcdt<|>/w'"), min_size=1, max_size=120))
def test_heap_and_scan_agree(word):
    own = bpe.encoder(VOCABULARY)
    for part in own.words(own.normalise(word)):
        raw = part.encode()
        assert own._merge_long(raw) == own._merge_short([raw], np.array([len(raw)]))[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([1, 2, 16, 32]), st.integers(1, 5))
def test_packing_fills_every_sequence(sizes, most, block):
    packer = packing.Packer(most, block)
    pieces = [p for k, n in enumerate(sizes) for p in packer.add(k, n)] + list(packer.finish())
    held, filled = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset, size in pieces:
        held[doc].append((start, n))
        filled[sequence].append((offset, n, size))
    for doc, n in enumerate(sizes):
        at = 0
        for start, own in sorted(held[doc]):
            assert start == at
            at += own
        assert at == n
    for parts in filled.values():
        at = 0
        for offset, n, size in sorted(parts):
            assert offset == at
            at += n
        assert at == size <= most


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDY, min_size=1, max_size=5))
def test_words_are_those_of_the_pattern(texts):
    found = common.Words(texts)
    expected = [WORD.findall(t) for t in texts]
    assert found.counts.tolist() == [len(x) for x in expected]
    assert found.code_points.tolist() == [len(w) for x in expected for w in x]
    names = [w for x in expected for w in x]
    assert len(set(zip(*[x.tolist() for x in found.hashes], strict=True))) == len(set(names))
    assert [found.distinct[i].decode() for i in found.ids] == names


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDY, min_size=1, max_size=5), st.integers(1, 4))
def test_shingle_sets_have_the_right_sizes(texts, n):
    for text, members in zip(texts, ngram_join.shingle_sets(texts, n), strict=True):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        assert len(members) == (len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) if len(w) >= n else bool(w))


SETS = st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=25), min_size=2, max_size=12)


@settings(max_examples=100, deadline=None)
@given(SETS, st.sampled_from([50, 80, 90]), st.integers(0, 2**32))
def test_linked_sets_share_enough_prefix_members(sets, percent, seed):
    rnd = np.random.default_rng(seed)
    levels = rnd.integers(0, 4, 1 << 20).astype(np.uint8)
    frequent = rnd.random(1 << 20).astype(np.float32) * 50
    spread = [np.unique(common.mixed(np.array(sorted(s), dtype=np.uint64))) for s in sets]
    prefixes = [ngram_join.prefix(s, levels, frequent, percent) for s in spread]
    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                shared = len(set(prefixes[i][0].tolist()) & set(prefixes[j][0].tolist()))
                behind = max(len(sets[k]) - len(prefixes[k][0]) for k in (i, j))
                overlap = -(-percent * (len(sets[i]) + len(sets[j])) // (100 + percent))
                assert shared >= max(min(prefixes[i][1], prefixes[j][1]), overlap - behind)


@settings(max_examples=150, deadline=None)
@given(SETS, st.sampled_from([50, 80, 90, 100]), st.integers(0, 12), st.booleans())
def test_blocks_find_every_link_of_theirs_once(sets, percent, cut, is_one):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    before = [np.array(sorted(x for x in s if x < 3), dtype=np.uint64) for s in sets]
    cut = min(cut, len(sets))
    sides = [(arrays[:cut], before[:cut]), (arrays[cut:], before[cut:])]
    whole = (arrays, before)
    found = list(ngram_join.block_links(*((whole, None) if is_one else sides), percent))
    pairs = [(i, j if is_one else j + cut) for i, own in found for j in own.tolist()]
    expected = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if (j < i if is_one else i < cut <= j) and not {x for x in sets[i] & sets[j] if x < 3} and 100 * (n := len(sets[i] & sets[j])) >= percent * (len(sets[i]) + len(sets[j]) - n)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    rows = np.arange(1, len(sets) + 1)
    forest, counts = ngram_join.forest_and_counts(iter(found), rows, 0 if is_one else cut)
    assert counts.tolist() == [sum(int(rows[j]) for i, j in expected if i == k) + sum(int(rows[i]) for i, j in expected if j == k) for k in range(len(sets))]

    def roots(edges):
        parent = list(range(len(sets)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for x, y in edges:
            parent[root(x)] = root(y)
        return [min(k for k in range(len(sets)) if root(k) == root(i)) for i in range(len(sets))]

    assert roots(forest) == roots(expected) and {tuple(map(int, p)) for p in forest} <= expected


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_any_url_has_a_host_and_a_path(url):
    host, path = url_rules.host_and_path(url)
    assert not set(host) & set("/?#") and not set(path) & set("?#")
    index = url_rules.RuleIndex(url_rules.SITES + url_rules.PATTERNS, {})
    assert index.judge(host, path)[1] in ("allow", "block")


@settings(max_examples=100, deadline=None)
@given(TEXT | WORDY)
def test_kernels_take_any_text(text):
    found = repetition.measure([text])
    assert all(0 <= found[f"share_{n}"][0] <= 1 for n in repetition.LIMITS)
    counts = language_id.counted(text)
    assert (counts is None) == (not re.search(r"[^\W\d_]", text) or not any(__import__("unicodedata").category(c)[0] == "L" for c in text.lower()))
