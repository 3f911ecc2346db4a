import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from botlog.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = bpe.default_vocabulary()
    with open(path, encoding="utf-8") as f:
        return bpe.PrefixBpe(f.read(), bpe.unicode_classes()), Tokenizer.from_file(path)


def same(both, texts):
    ours, theirs = both
    for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        ids = ours.encode(t).tolist()
        assert ids == e.ids, repr(t[:80])
        assert ours.decode(ids) == theirs.decode(e.ids, skip_special_tokens=False)


def test_every_token_and_pairs_of_tokens(both):
    ours, theirs = both
    texts = [ours.bytes_of[i].decode("utf-8", "ignore") for i in range(50257)]
    same(both, texts)
    rng = random.Random(1)
    same(both, ["".join(rng.choices(texts, k=rng.randrange(2, 12))) for _ in range(20000)])


def test_every_character_in_context(both):
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    bad, byte, split = [], bpe.byte_characters(), both[0]._split
    for c in chars:
        t = f"a{c}a 1{c}1 {c} {c}{c}.\n{c}"
        if [w.encode() for w in split.findall(t)] != [
                bytes(byte[x] for x in w) for w, _ in both[1].pre_tokenizer.pre_tokenize_str(t)]:
            bad.append(hex(ord(c)))
    assert not bad, (len(bad), bad[:20])


def test_white_space_and_odd_texts(both):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "　", "a", "B", "é", "ß", "12", "'s", "'S",
             "'ll", ".", "...", "<|endoftext|>", "<|endoftext", "🙂", "ก", "\x00", "�", "don't", "AKIA", "中文"]
    same(both, ["", " ", "a", "a" * 5000, "ab" * 4000, " " * 3000, "\n" * 999 + "x", "=" * 2500]
         + ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(20000)])


def test_tie_merges(both):
    same(both, [c * n for c in "aeot -=.0 " for n in range(1, 70)])


def test_documents(spark, docs_of, both):
    rows = [(1, None), (2, ""), (2, "same id"), (None, "no id"), (3, "x <|endoftext|> y" * 3), (4, "Größe, naïve  text.\n" * 9000)]
    df = bpe.encode_documents(docs_of(rows, extra=True))
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    got = df.collect()
    want = [(i, both[1].encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got], key=str) == sorted([
        (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids)
        for i, ids, t in want], key=str)
    back = bpe.decode_documents(df).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    assert bpe.encode_documents(docs_of(rows).limit(0)).count() == 0


def test_query_against_library(spark, sf, both):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op9_bpe(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = both[1].encode(rows[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
