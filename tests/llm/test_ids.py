"""BPE, token-id files and their Elias-Fano boundaries."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusflow.llm import bpe, elias_fano, token_files

PARTS = ["a", "B", "The", " ", "  ", "\n", "\t", "'s", "'re", "1", "23", "é", "É", "e\u0301", "ß", "İ", "Σ", "!!", "<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>", ".", ",", ".,", "a.b", "_.",
         "\x1c", "\x1f", "\xa0", "\u0085", "\u2028", "日本", "😀", "ﬁ", "'", "_", "\u200b", "\x00", "각"]


def texts(seed, n=400):
    rnd = random.Random(seed)
    return [None, "", " ", "\n\n", "q" * 3000, "ab" * 2000 + " c"] + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_tokens string, ids int")


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = list(enumerate(texts(1)))
    out = {r.doc_id: r for r in bpe.encode(wide(spark, rows)).collect()}
    sums = {r.doc_id: r for r in bpe.digests(wide(spark, rows + rows[:3])).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert list(out[i]["ids"]) == ids and out[i].decoded == back, t
        assert sums[i].n_tokens == len(ids) and sums[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert sums[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.digests(wide(spark, [])).count() == 0


def test_a_small_dictionary_changes_nothing():
    library = bpe.encoder(bpe.default_vocabulary())
    small = bpe.Encoder(library.vocab, kept=3)
    for a in range(0, 400, 40):
        assert small.encode_all(texts(2)[a:a + 40]) == library.encode_all(texts(2)[a:a + 40])


def test_merges_are_leftmost_of_lowest_rank():
    vocab = bpe.encoder(bpe.default_vocabulary()).vocab
    ranks = {(int(k) // vocab.width, int(k) % vocab.width): (int(r), int(vocab.made[r])) for k, r in zip(vocab.keys, vocab.rank)}

    def plain(word):
        ids = [int(vocab.first[b]) for b in word]
        while True:
            found = [(ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
            if not found:
                return ids
            _, i = min(found)
            ids[i:i + 2] = [ranks[ids[i], ids[i + 1]][1]]
    rnd = random.Random(3)
    words = ["".join(rnd.choice("etaoin hé") for _ in range(rnd.randint(1, 60))).encode() for _ in range(300)] + [b"a", b"aaaaaaaaa"]
    assert bpe.merge_words(words, vocab) == [plain(w) for w in words]


def test_decode_replaces_broken_bytes():
    vocab = bpe.encoder(bpe.default_vocabulary()).vocab
    assert bpe.decode([int(vocab.first[0xC3])], vocab) == "\ufffd"


@pytest.mark.parametrize("n", [0, 1, 2, 700, 3000])
@pytest.mark.parametrize("top", [0, 3, 5000, 2 ** 40, 2 ** 62])
def test_elias_fano(n, top):
    rnd = random.Random(n + top)
    values = np.sort(np.array([rnd.randint(0, top) for _ in range(n)], np.int64)) - 7
    coded = elias_fano.encode(values)
    found = elias_fano.Sequence(b"12345678" + coded, 8)
    assert len(found) == n and (found.all() == values).all() and found.size == len(coded)
    assert all(found[i] == values[i] for i in rnd.sample(range(n), min(n, 200)))
    if n == 3000 and top == 5000:
        assert len(coded) < 3000 * 8 / 10
    with pytest.raises(IndexError):
        found[n]


def test_token_files_give_the_library_ids_back(spark, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(7 * i % 1000 - 50, t) for i, t in enumerate(texts(4))] + [(None, "no id"), (3, "twice"), (3, "Twice")]
    docs = wide(spark, rows).repartition(5)
    manifest = token_files.write(docs)
    monkeypatch.setattr(token_files, "READ_IDS", 50)
    out = sorted(token_files.read(spark, manifest).collect(), key=lambda r: r.start)
    assert len(out) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [1])
    at = 0
    for r in out:
        assert r.start == at and list(r["ids"]) in want[r.id]
        at += len(r["ids"])
    names = [r.id for r in out]
    assert names[0] is None and names[1:] == sorted(names[1:])
    sums = {(r.doc_id, r.start): r for r in token_files.read_digests(spark, manifest).collect()}
    for r in out:
        found = sums[r.id, r.start]
        assert found.n_tokens == len(r["ids"]) and found.ids_crc32 == zlib.crc32(np.array(r["ids"], "<u4").tobytes())


def test_one_document_is_read_by_position(spark):
    manifest = token_files.write(wide(spark, [(i, f"word {i} and more") for i in range(40)]).coalesce(1))
    seen = {}
    for r in manifest.collect():
        part = token_files.Part(r.path)
        assert len(part) == r.n_docs
        seen.update({part.name(i): part.document(i).tolist() for i in range(len(part))})
    whole = {r.id: list(r["ids"]) for r in token_files.read(spark, manifest).collect()}
    assert seen == whole and len(whole) == 40


def test_no_documents(spark):
    manifest = token_files.write(wide(spark, []))
    assert token_files.read_digests(spark, manifest).count() == 0


def test_reading_decodes_run_by_run(spark, monkeypatch):
    rnd = random.Random(12)
    for low, n in ((0, 300), (3, 700), (11, 1000), (1 << 40, 500)):
        values = np.sort(np.array([rnd.randint(0, n * (low + 1)) for _ in range(n)], np.int64))
        code = elias_fano.Sequence(elias_fano.encode(values))
        for _ in range(60):
            first = rnd.randint(0, n)
            stop = rnd.randint(first, n)
            assert code.run(first, stop).tolist() == values[first:stop].tolist()
    rows = [(None if i < 5 else i, "word " * (i % 7)) for i in range(60)]
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"))
    monkeypatch.setattr(token_files, "READ_IDS", 20)
    monkeypatch.setattr(token_files, "READ_DOCS", 7)
    monkeypatch.delattr(elias_fano.Sequence, "all")
    seen = 0
    for r in manifest.collect():
        part = token_files.Part(r.path)
        for first, bounds, ids in token_files._runs(part):
            names = part.run_names(first, first + len(bounds) - 1)
            assert 1 <= len(names) <= 7
            for k, name in enumerate(names):
                assert name == part.name(first + k) and ids[bounds[k] - bounds[0]:bounds[k + 1] - bounds[0]].tolist() == part.document(first + k).tolist()
            seen += len(names)
    assert seen == 60


def test_a_pre_token_of_a_million_letters_ends_and_equals_the_library():
    import time
    enc = bpe.encoder(bpe.default_vocabulary())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(9)
    text = "".join(rnd.choice("etaoinshrdlu") for _ in range(1_000_000))
    begin = time.process_time()
    (ids,) = enc.ids_of([text])
    assert time.process_time() - begin < 60
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_a_worker_forgets_when_another_operator_takes_it():
    from corpusflow.llm import common
    enc = bpe.encoder(bpe.default_vocabulary())
    common.take_worker("bpe", bpe.forget)
    enc.ids_of(["some words here."])
    common.take_worker("bpe", bpe.forget)
    assert enc.inner
    common.take_worker("quality")
    assert not enc.inner and not enc.first
