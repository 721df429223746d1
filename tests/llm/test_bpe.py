import hashlib
import random
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docsleuth.llm import bpe

PATH = bpe.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.TextEncoder(PATH)


def both(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "  ", "a<|endoftext|>b <|startoftext|>", "İI ΑΣ é \x1c\x1d a\x1fb", "It's WE'LL 123 don't'd　漢字 🙂👍🏽", "\x85​ a﻿", "!!!!!! aaaaaaaaaaaaaaaa", "\x00 \x00a", "é ́e"])
def test_like_the_library(text):
    assert OURS.encode(text) == both(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert OURS.encode(text) == both(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["ation", "th", "un", "the", "ing", "Z", "é", "'s", ",", "9"]), max_size=12))
def test_long_words(parts):
    assert OURS.encode("".join(parts)) == both("".join(parts))


def test_shrinking_memo(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 20)
    monkeypatch.setattr(bpe, "MAX_NODES", 50)
    own = bpe.TextEncoder(PATH)
    for i in range(40):
        text = " ".join(f"token{i}{k}word" for k in range(15))
        assert own.encode(text) == both(text)


@pytest.mark.parametrize("word", ["ab" * 150_000, "漢字" * 50_000 + "x", "xyzzy" * 30_000, "".join(random.Random(2).choices("etaoinshr", k=150_000))])
def test_very_long_words(word):
    """Time and memory in proportion to the word, and nothing of it kept."""
    assert OURS.encode(word) == both(word)
    assert word not in OURS.ids and max(map(len, OURS.trie.last)) <= bpe.SHARED


def test_a_word_of_a_million_letters():
    own = bpe.TextEncoder(PATH)
    tracemalloc.start()
    ids, _ = own.encode("ab" * 500_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.count(" ") > 100_000 and peak < 400 << 20


def test_rows(docs, no_docs, rows):
    found = sorted((tuple(r) for r in bpe.encode(docs).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids, text = both(t or "")
        want.append((i, len(ids.split()), [int(x) for x in ids.split()], hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == sorted(want, key=str)
    assert bpe.encode(no_docs).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back[8] == both("one")[1] and back[6] == ""


def test_pairs_as_by_joining():
    """may_follow() agrees with joining the two tokens' symbols from scratch."""
    trie = bpe.TrieEncoder(bpe.vocabulary_path())
    rng = random.Random(3)
    ids = [i for i, t in trie.names.items() if t not in trie.special]
    short = [i for i in ids if len(trie.names[i]) <= 4]
    seen = set()
    for n in range(20_000):
        a, b = rng.choice(short if n % 2 else ids), rng.choice(short if n % 3 else ids)
        left, right = trie.names[a], trie.names[b]
        if not left.endswith(trie.end):
            want = trie.merged([s for t in (left, right) for s in trie.symbols(t)]) == [left, right]
            seen.add(want)
            assert trie.may_follow(a, b) == want, (left, right)
    assert seen == {True, False}
