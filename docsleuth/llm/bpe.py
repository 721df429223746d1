"""BPE encoding and decoding with a ready vocabulary, by traversal of a trie of words.

In byte-pair encoding every prefix of a word has one encoding, and dropping the last token of an
encoding leaves the encoding of the shorter prefix. So a trie node needs only one number, the last
token of its prefix; it is the longest vocabulary entry that ends there and that may follow the last
token of the node where it starts. Words with a common prefix share those nodes and their states.

Null and empty texts have no tokens. Repeated rows give repeated results. Texts and words may have any length: texts
are cut at white space, which the tokenizer drops, and words cost memory in proportion to their length.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docsleuth.llm.common import map_texts

#: The place of the default vocabulary on executors: the file's name in the installed package of public tokenizers.
VOCABULARY = "word_bpe_49k.json"
#: At these sizes a worker's trie and memo lose their long entries, which seldom recur, and if that isn't enough all: its memory is bounded whatever the input.
MAX_NODES = 700_000
MAX_WORDS = 500_000
MAX_PAIRS = 500_000
#: Longer prefixes are no nodes of the trie.
SHARED = 24
#: Longer pieces of texts are not kept in the memo.
KEPT_PIECE = 100
KEPT_LENGTH = 7


def shrunk(memo: dict, most: int) -> dict:
    kept = {k: v for k, v in memo.items() if len(k) <= KEPT_LENGTH}
    return kept if len(kept) <= most // 2 else {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters that compose with nothing before them and have no lower case that depends on their neighbours, then marks without the apostrophe.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


class TrieEncoder:
    """Encodes pre-split words; symbols are characters, the last one with the end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        #: for the last four symbols, the sizes of the longer tokens that end so
        self.sizes: dict[str, set[int]] = {}
        for t in self.vocab:
            body, end = (t.removesuffix(self.end), self.end) if t.endswith(self.end) and len(t) > len(self.end) else (t, "")
            if len(body) > 3:
                self.sizes.setdefault(body[-4:] + end, set()).add(len(body))
        self.sizes = {k: (*sorted(v, reverse=True), 3, 2, 1) for k, v in self.sizes.items()}
        self.follows: dict[int, bool] = {}
        self.halves: dict[str, tuple[str, str, int]] = {}
        self.reset()

    def reset(self) -> None:
        #: the trie: a node is addressed by its prefix, of SHARED characters at most, and holds the last token of it, -1 at the root
        self.last: dict[str, int] = {"": -1}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """The plain definition: join the pair of the lowest rank, leftmost first, until none is left."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        return parts

    def half(self, token: str) -> tuple[str, str, int]:
        """The two parts whose joining makes the token last, and that joining's rank; -1 for a symbol, and 1 << 61 for a token that joining never makes."""
        if (known := self.halves.get(token)) is None:
            parts = self.symbols(token)
            known = (token, token, -1) if len(parts) == 1 else (token, token, 1 << 61)
            while len(parts) > 1:
                rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 60:
                    break
                if len(parts) == 2:
                    known = (parts[0], parts[1], rank)
                parts[at : at + 2] = ["".join(parts[at : at + 2])]
            self.halves[token] = known
        return known

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the two stand side by side in an encoding; before is -1 at a word's start.

        They do unless a joining over their border comes first: both are taken apart from their last joinings backwards, and
        the parts that meet at the border must not be joined earlier than they became what they are.
        """
        right = self.names[token]
        if before < 0:
            return self.half(right)[2] < 1 << 61
        left = self.names[before]
        made = 1 << 60  # when the parts that meet now were joined to something else
        (_, l2, lr), (r1, _, rr) = self.half(left), self.half(right)
        if max(lr, rr) == 1 << 61:
            return False
        while True:
            if self.ranks.get((left, right), 1 << 60) < made:
                return False
            if lr < 0 and rr < 0:
                return True
            if lr > rr:  # the joinings of equal rank go from left to right
                left, made = l2, lr
                _, l2, lr = self.half(left)
            else:
                right, made = r1, rr + 1
                r1, _, rr = self.half(right)

    def last_token(self, word: str, depth: int, end: str, path: array | None = None) -> tuple[int, int]:
        """The last token of word[:depth], and where it starts; path, or else the trie, has the last tokens of the word's shorter prefixes."""
        get, last, follows = self.vocab.get, self.last, self.follows
        for size in self.sizes.get(word[depth - 4 : depth] + end, (3, 2, 1)) if depth > 3 else (3, 2, 1):
            if size <= depth and (token := get(word[depth - size : depth] + end)) is not None:
                key = ((last[word[: depth - size]] if path is None else path[depth - size]) + 1) << 20 | token
                if (known := follows.get(key)) is None:
                    if len(follows) > MAX_PAIRS:
                        follows.clear()
                    known = follows[key] = self.may_follow((key >> 20) - 1, token)
                if known:
                    return token, depth - size
        raise ValueError(f"no token ends {word[max(0, depth - 40) : depth]!r}")

    def encode_word(self, word: str) -> list[int]:
        """Walks down to the deepest known node, makes the missing ones, then reads the tokens from the end."""
        if len(word) > SHARED:
            return self.encode_long(word)
        last, n = self.last, len(word)
        depth = n - 1
        while word[:depth] not in last:
            depth -= 1
        for d in range(depth + 1, n):
            last[word[:d]] = self.last_token(word, d, "")[0]
        token, at = self.last_token(word, n, self.end)
        out = [token]
        while at:
            token = last[word[:at]]
            out.append(token)
            at -= len(self.names[token])
        return out[::-1]

    def encode_long(self, word: str) -> list[int]:
        """The same for words whose longer prefixes are no nodes: the states beyond are an array, so a word costs memory in proportion to its length."""
        last, n = self.last, len(word)
        path = array("i", [-1])
        for d in range(1, n):
            known = last.get(word[:d]) if d <= SHARED else None
            if known is None:
                known = self.last_token(word, d, "", path)[0]
                if d <= SHARED:
                    last[word[:d]] = known
            path.append(known)
        token, at = self.last_token(word, n, self.end, path)
        out = array("i", [token])
        while at:
            out.append(path[at])
            at -= len(self.names[path[at]])
        return out[::-1].tolist()

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of each distinct word; in sorted order, which walks the trie depth first."""
        if len(self.last) > MAX_NODES:
            self.last = shrunk(self.last, MAX_NODES) or {"": -1}
        return {w: self.encode_word(w) for w in sorted(words)}

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens' strings, joined by spaces."""
        return " ".join(self.names[i] for i in ids)


class TextEncoder:
    """Whole texts: white space separates pieces, special strings stand for themselves, the file's own normaliser and splitter cut words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normal, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.trie = TrieEncoder(path)
        self.text = {i: str(i) for i in self.trie.names}
        self.bytes = {c: "".join(w for w, _ in self.split(chr(c))) for c in range(0xC0, 0x300) if c not in (0xD7, 0xF7)}
        self.special = re.compile("(" + "|".join(map(re.escape, self.trie.special)) + ")") if self.trie.special else None
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def words(self, piece: str) -> list[str]:
        """The piece's words in byte-level symbols. Latin letters with ASCII marks after them are the common case and need no library call."""
        if m := PLAIN.fullmatch(piece):
            head, tail = m.groups()
            return [head.lower().translate(self.bytes), tail] if tail else [head.lower().translate(self.bytes)]
        return [w for w, _ in self.split(self.normal(piece))]

    def learn(self, pieces: set[str]) -> None:
        """Adds pieces to the memo: first all their words, then one pass through the trie, then the pieces' ids."""
        special, cut = self.trie.special, {}
        for piece in pieces:
            parts = self.special.split(piece) if self.special and "<|" in piece else [piece]
            cut[piece] = [x for p in parts if p for x in ([special[p]] if p in special else self.words(p))]
        words = self.trie.encode_words({x for xs in cut.values() for x in xs if isinstance(x, str)})
        names, text = self.trie.names, self.text
        for piece, xs in cut.items():
            ids = [i for x in xs for i in (words[x] if isinstance(x, str) else [x])]
            self.ids[piece] = " ".join([text[i] for i in ids])
            self.decoded[piece] = " ".join([names[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        # the tokenizer's white space lacks four separators that str.split() takes
        return re.split(r"[^\S\x1c-\x1f]+", text) if re.search(r"[\x1c-\x1f]", text) else text.split()

    def encode(self, text: str) -> tuple[str, str]:
        """Ids joined by spaces, and the decoded text."""
        pieces = self.pieces(text)
        fresh = set(pieces).difference(self.ids)
        if fresh:
            if len(self.ids) > MAX_WORDS:
                self.ids = shrunk(self.ids, MAX_WORDS)
                self.decoded = {k: self.decoded[k] for k in self.ids}
                fresh = set(pieces).difference(self.ids)
            self.learn(fresh)
        ids, decoded = " ".join(map(self.ids.__getitem__, pieces)), " ".join(map(self.decoded.__getitem__, pieces))
        if "" in fresh or "  " in ids or ids[:1] == " " or ids[-1:] == " ":  # pieces without a token
            ids, decoded = " ".join(ids.split()), " ".join(d for p in pieces if (d := self.decoded[p]))
        for p in fresh:
            if len(p) > KEPT_PIECE:
                del self.ids[p], self.decoded[p]
        return ids, decoded


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """id, n_tokens, token_ids (array, unless with_ids is false), ids_sha256, decoded_sha256: one row per input row, without a shuffle."""
    path = path or vocabulary_path()

    def make():
        own = encoder(path)

        def work(texts: list[bytes]) -> list[pa.Array]:
            n, ids, a, b = [], [], [], []
            for t in texts:
                joined, decoded = own.encode(t.decode("utf-8", "replace"))
                n.append(joined.count(" ") + 1 if joined else 0)
                if with_ids:
                    ids.append(np.fromstring(joined, np.int32, sep=" "))
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
            listed = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))] if with_ids else []
            return [pa.array(n, pa.int64()), *listed, pa.array(a, pa.string()), pa.array(b, pa.string())]

        return work

    extra = with_ids * ["token_ids"]
    return map_texts(df, id_col, text_col, make, "n_tokens bigint, " + "token_ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string", ["n_tokens", *extra, "ids_sha256", "decoded_sha256"])


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """id and text: the tokens' strings joined by spaces, as the library decodes without a decoder. Null ids decode to the empty text."""
    path = path or vocabulary_path()
    inner = df.select(id_col, ids_col)

    def run(batches):
        own = encoder(path).trie
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return inner.mapInArrow(run, f"{id_col} {inner.schema[0].dataType.simpleString()}, text string")
