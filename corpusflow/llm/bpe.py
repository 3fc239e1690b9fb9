"""Byte-level BPE encoding and decoding by segment trees, many words at a time.

A text is cut into chunks at places that no token can cross (a single space between two
non-spaces); each chunk is split by the vocabulary's pattern into pre-tokens.  The adjacent pairs of
a pre-token are the leaves of a segment tree that holds ``rank * width + position``; its root is the
leftmost pair of lowest rank.  A merge changes at most three leaves, each updated in log(width)
steps, until the root is empty.  All new pre-tokens of a slice of text with the same tree width are
merged together, one numpy row each, so a step costs a few array operations for thousands of words.

A pre-token that is still merging when few others are, such as one of a million letters, goes on in a
plain tree of its own.

Workers keep a bounded dictionary of chunks already encoded, until another operator takes the worker; it
changes speed, never results.
Everything is a narrow map over the documents: no shuffle, and memory is bounded by one slice.

Defined results
  NULL counts as the empty text: no tokens, digests of the empty string.
  Special tokens that occur in a text are encoded as that token, as the vocabulary's own library does.
  Decoding gives the exact text back; bytes that are no UTF-8 become U+FFFD.
  Very long texts and very long pre-tokens are encoded whole.  Repeated rows give repeated rows.
"""
from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import add_columns, slices, take_worker, with_columns

#: Encoded chunks a worker keeps.
KEPT = 400_000
#: Characters whose new chunks are encoded together.
TOGETHER = 1_000_000
#: Pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single space between two characters that are no white space.
BORDER = re.compile(r"(?<=\S) (?=\S)")
#: White space next to a single space; elsewhere every single space is such a border.
IRREGULAR = re.compile(r"  | [\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
#: The same for texts of ASCII only.
UNEVEN = ["  ", *(p for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" for p in (" " + c, c + " "))]
#: Words of these letters are one pre-token, and so is one of these marks behind them.
SIMPLE, MARKS = "\u0250", ".,;:!?"
#: Pre-tokens that are stepped together at least; fewer are merged one by one.
FEW = 8
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """Letter of byte-level vocabularies -> byte: printable bytes stand for themselves, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Vocabulary:
    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        self.width = 1 + max(self.bytes_of)
        self.kind = np.dtype("<u2" if self.width <= 1 << 16 else "<u4")
        self.names = [str(i) for i in range(self.width)]
        self.raw = [self.bytes_of.get(i, b"") for i in range(self.width)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs] or [-1], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs] or [0], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.pairs = dict(zip(self.keys.tolist(), self.rank.tolist()))
        self._file()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None

    def _file(self) -> None:
        """Keys by hash, each in the first free place from its own on."""
        bits = max(4, (4 * len(self.keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.place, self.value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        for key, at, rank in zip(self.keys.tolist(), self._home(self.keys).tolist(), self.rank.tolist()):
            while self.place[at] >= 0:
                at = (at + 1) & self.mask
            self.place[at], self.value[at] = key, rank

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NONE where the vocabulary has no such merge."""
        key = left.astype(np.int64) * self.width + right
        at = self._home(key)
        there = self.place[at]
        out = np.where(there == key, self.value[at], NONE)
        left_over = np.flatnonzero((there != key) & (there >= 0))
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & self.mask
            there = self.place[at[left_over]]
            same = there == key[left_over]
            out[left_over[same]] = self.value[at[left_over[same]]]
            left_over = left_over[~same & (there >= 0)]
        return out


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Token ids of each pre-token (none empty)."""
    return [np.frombuffer(x, vocab.kind).tolist() for x in merged(words, vocab)]


def merged(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Token ids of each pre-token (none empty) as little-endian bytes, by a segment tree per word."""
    out: list = [None] * len(words)
    sizes = np.array([len(w) for w in words], np.int64)
    widths = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64))
    for width in np.unique(widths):
        members = np.flatnonzero(widths == width)
        step = max(1, 4_000_000 // int(width))
        for k in range(0, len(members), step):
            part = members[k:k + step]
            for i, ids in zip(part, _merge_block([words[i] for i in part], sizes[part], int(width), vocab)):
                out[i] = ids
    return out


def _merge_block(words: list[bytes], sizes: np.ndarray, width: int, vocab: Vocabulary) -> list[bytes]:
    rows, across = len(words), width + 1
    text = np.zeros((rows, across), np.int32)
    used = np.arange(across)[None, :] < sizes[:, None]
    text[used] = vocab.first[np.frombuffer(b"".join(words), np.uint8)]
    # links over the symbols still there; ``width`` stands for "none" on both sides
    following = np.where(np.arange(1, width + 2)[None, :] < sizes[:, None], np.arange(1, width + 2)[None, :], width).astype(np.int32)
    before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (rows, across)).copy()
    before[:, 0] = width
    tree = np.full((rows, 2 * width), NONE, np.int64)
    real = np.arange(1, width)[None, :] < sizes[:, None]
    ranks = np.full((rows, width - 1), NONE, np.int64)
    ranks[real] = vocab.ranks(text[:, :width - 1][real], text[:, 1:width][real])
    tree[:, width:2 * width - 1] = np.where(ranks != NONE, ranks * width + np.arange(width - 1)[None, :], NONE)
    level = width // 2
    while level >= 1:
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        level //= 2
    # from here on flat views: position p of row r is r * across + p, node n is r * 2 * width + n
    text, following, before, nodes, kept = text.ravel(), following.ravel(), before.ravel(), tree.ravel(), used.ravel()
    live = np.flatnonzero(nodes[1::2 * width] != NONE)
    while len(live) > FEW:
        line, base = live * across, live * (2 * width)
        rank, at = np.divmod(nodes[base + 1], width)
        here = line + at
        gone = following[here]
        after = following[line + gone]
        prior = before[here]
        text[here] = vocab.made[rank]
        kept[line + gone] = False
        following[here] = after
        linked, led = after < width, prior < width
        before[(line + after)[linked]] = at[linked]
        leaf = np.full((3, len(live)), NONE, np.int64)
        for row, left, right, has in ((0, at, after, linked), (1, prior, at, led)):
            found = vocab.ranks(text[(line + left)[has]], text[(line + right)[has]])
            leaf[row, has] = np.where(found == NONE, NONE, found * width + left[has])
        # the removed symbol's pair, the merged symbol's pair and the pair before it
        for place, value in ((gone, leaf[2]), (at, leaf[0]), (np.where(led, prior, gone), np.where(led, leaf[1], leaf[2]))):
            _set_leaf(nodes, base, place, value, width)
        live = live[nodes[base + 1] != NONE]
    for r in live.tolist():
        own, tree = slice(r * across, (r + 1) * across), slice(r * 2 * width, (r + 1) * 2 * width)
        text[own], kept[own] = _merge_one(text[own].tolist(), following[own].tolist(), before[own].tolist(), kept[own].tolist(),
                                          nodes[tree].tolist(), width, vocab)
    kept = kept.reshape(rows, across)[:, :width]
    flat = text.reshape(rows, across)[:, :width][kept].astype(vocab.kind).tobytes()
    ends = (np.cumsum(kept.sum(axis=1)) * vocab.kind.itemsize).tolist()
    return [flat[a:b] for a, b in zip([0] + ends[:-1], ends)]


def _merge_one(text: list[int], following: list[int], before: list[int], kept: list[bool], nodes: list[int], width: int,
               vocab: Vocabulary) -> tuple[list[int], list[bool]]:
    """The same steps for one pre-token alone."""
    made, pairs, size = vocab.made.tolist(), vocab.pairs, vocab.width

    def put(leaf: int, value: int) -> None:
        node = leaf + width
        nodes[node] = value
        while node > 1:
            value = min(value, nodes[node ^ 1])
            node >>= 1
            if nodes[node] == value:
                break
            nodes[node] = value

    while nodes[1] != NONE:
        rank, at = divmod(nodes[1], width)
        gone = following[at]
        after, prior = following[gone], before[at]
        text[at], kept[gone], following[at] = made[rank], False, after
        put(gone, NONE)
        found = None
        if after < width:
            before[after] = at
            found = pairs.get(text[at] * size + text[after])
        put(at, NONE if found is None else found * width + at)
        if prior < width:
            found = pairs.get(text[prior] * size + text[at])
            put(prior, NONE if found is None else found * width + prior)
    return text, kept


def _set_leaf(nodes: np.ndarray, base: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
    """Set one leaf per word and renew the nodes above it up to the root."""
    node = leaf + width
    nodes[base + node] = value
    while width > 1:
        # the sibling differs in the last bit
        value = np.minimum(value, nodes[base + (node ^ 1)])
        node = node >> 1
        width >>= 1
        nodes[base + node] = value


class Encoder:
    """Chunk -> its ids as bytes; chunks other than a text's first begin with a space."""

    def __init__(self, vocab: Vocabulary, kept: int = KEPT):
        import regex
        self.vocab, self.kept = vocab, kept
        self.split = regex.compile(PATTERN).findall
        self.marks = {m: np.array([vocab.first[ord(m)]], vocab.kind).tobytes() for m in MARKS}
        self.forget()

    def forget(self) -> None:
        self.first: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        plain = text.isascii() and not any(w in text for w in UNEVEN)
        regular = plain or not (text[0] == " " or text[-1] == " " or IRREGULAR.search(text))
        return text.split(" ") if regular else BORDER.split(text)

    def learn(self, lists: list[list[str]]) -> None:
        """Encode what the dictionaries lack of these chunk lists."""
        if len(self.inner) + len(self.first) > self.kept:
            self.forget()
        words, ended, odd = set(), [], []
        for c in set().union(*lists) - self.inner.keys():
            if c.isalpha() and (c.isascii() or max(c) < SIMPLE):
                words.add(c)
            elif c[-1:] in self.marks and (w := c[:-1]).isalpha() and (w.isascii() or max(w) < SIMPLE):
                ended.append((c, w))
            else:
                odd.append((self.inner, c, self.split(" " + c)))
        odd += [(self.first, c, self.split(c)) for c in {x[0] for x in lists} - self.first.keys()]
        words.update([w for _, w in ended if w not in self.inner])
        words, pieces = list(words), list(set().union(*[p for _, _, p in odd]))
        coded = merged([(" " + w).encode() for w in words] + [p.encode("utf-8", "surrogatepass") for p in pieces], self.vocab)
        self.inner.update(zip(words, coded))
        for c, w in ended:
            self.inner[c] = self.inner[w] + self.marks[c[-1]]
        known = dict(zip(pieces, coded[len(words):]))
        for kept, chunk, parts in odd:
            kept[chunk] = b"".join([known[p] for p in parts])

    def ids_of(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text."""
        special, kind = self.vocab.special, self.vocab.kind
        plans, lists = [], []
        for text in texts:
            text = text or ""
            marked = [text]
            if any(s in text for s in special):
                marked = [p for p in self.vocab.split_special.split(text) if p]
            plan = [p if p in special else self.chunks(p) for p in marked if p]
            plans.append(plan)
            lists += [p for p in plan if not isinstance(p, str)]
        self.learn(lists)
        out = []
        for plan in plans:
            found: list[bytes] = []
            for p in plan:
                if isinstance(p, str):
                    found.append(np.array([special[p]], kind).tobytes())
                else:
                    found.append(self.first[p[0]])
                    found += map(self.inner.__getitem__, p[1:])
            out.append(np.frombuffer(b"".join(found), kind).tolist())
        return out

    def encode_all(self, texts: list[str | None]) -> list[tuple[str, bytes]]:
        """Per text its ids joined by commas, and the bytes those ids decode to."""
        names, raw = self.vocab.names.__getitem__, self.vocab.raw.__getitem__
        return [(",".join(map(names, ids)), b"".join(map(raw, ids))) for ids in self.ids_of(texts)]


def decode(ids: list[int], vocab: Vocabulary) -> str:
    return b"".join(map(vocab.raw.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, which every machine has at ``path``."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            _ENCODERS[path] = Encoder(Vocabulary(f.read()))
    return _ENCODERS[path]


def forget() -> None:
    """Drop the encoded chunks: the worker serves another operator next."""
    for found in _ENCODERS.values():
        found.forget()


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _map(docs: DataFrame, text_col: str, more: T.StructType, columns) -> DataFrame:
    def run(batches):
        take_worker("bpe", forget)
        for whole in batches:
            for start, stop in slices(whole.column(text_col), TOGETHER):
                batch = whole.slice(start, stop - start)
                yield add_columns(batch, columns(batch.column(text_col).to_pylist()))
    return docs.mapInArrow(run, with_columns(docs.schema, more))


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (the text those ids give back)."""
    path = path or default_vocabulary()

    def columns(texts):
        enc = encoder(path)
        found = enc.ids_of(texts)
        return {"ids": pa.array(found, pa.list_(pa.int32())), "decoded": pa.array([decode(ids, enc.vocab) for ids in found], pa.string())}
    return _map(docs, text_col, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())),
                                              T.StructField("decoded", T.StringType())]), columns)


def digests(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, without moving the ids themselves."""
    path = path or default_vocabulary()

    def columns(texts):
        enc = encoder(path)
        found, names = enc.ids_of(texts), enc.vocab.names.__getitem__
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {"n_tokens": pa.array([len(ids) for ids in found], pa.int64()),
                "ids_sha256": pa.array([sha(",".join(map(names, ids)).encode()) for ids in found], pa.string()),
                "decoded_sha256": pa.array([sha(decode(ids, enc.vocab).encode()) for ids in found], pa.string())}
    names = (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))
    return _map(docs, text_col, T.StructType([T.StructField(n, t) for n, t in names]), columns)
