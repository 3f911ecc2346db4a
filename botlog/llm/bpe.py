"""Byte-level BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word there is exactly one token that can come last in
the prefix's encoding. An Aho-Corasick automaton over the vocabulary (the
suffix links give every token that ends at a position) proposes the last
tokens; a token is the right one if the prefix before it is encoded with a
last token that it is pair-compatible with. Following the back-pointers from
the end gives the ids that applying the merges in order would give.

Two tokens are pair-compatible if no merge ever crosses the border between
them. Undoing their merges newest first, the border pair must at no time have
a merge that comes before the merges that consume either side.

The vocabulary file is read on the driver and broadcast (it is a fixed few
megabytes); texts are encoded where they lie, without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from botlog.llm import common

#: The published split pattern of this family of byte-level
#: vocabularies. LETTERS, NUMBERS and SPACES stand for Unicode classes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[LETTERS]+| ?[NUMBERS]+| ?[^SPACESLETTERSNUMBERS]+|[SPACES]+(?![^SPACES])|[SPACES]+"""
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces whose ids one worker remembers; beyond it, it starts afresh.
REMEMBERED = 400_000
_NO_PARENT = 1 << 60
#: A single space between two characters that are not white space always starts a new word.
_UNITS = re.compile(r"(?<=\S)(?= \S)")


def unicode_classes() -> tuple[str, str]:
    """Ranges of the letters and of the numbers, as the tokenizers library has
    them. Unicode grows, and every package has the tables of its own year: the
    characters on which Python and the regex package disagree are looked up in
    the library's splitter. Run on the driver; the ranges are broadcast."""
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    spans: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        kind = unicodedata.category(x)[0]
        if 0xD800 <= c < 0xE000:
            continue
        if ("L" if letter.match(x) else "N" if number.match(x) else "") != (kind if kind in "LN" else ""):
            kind = "L" if len(split("a" + x)) == 1 else "N" if len(split("1" + x)) == 1 else ""
        if kind in spans:
            if spans[kind] and spans[kind][-1][1] == c - 1:
                spans[kind][-1][1] = c
            else:
                spans[kind].append([c, c])
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans[k]) for k in "LN")


def split_pattern(classes: tuple[str, str]) -> re.Pattern:
    """The split of a text into words, as the library does it."""
    text = SPLIT
    for name, chars in zip(("SPACES", "LETTERS", "NUMBERS"), (SPACES, *classes)):
        text = text.replace(name, chars)
    return re.compile(text)


def byte_characters() -> dict[str, int]:
    """The characters that stand for the 256 bytes in vocabulary files: those
    that print stand for themselves, the rest are numbered from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    out.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))})
    return out


class PrefixBpe:
    """Encoder and decoder for one ``tokenizers`` JSON file of byte-level BPE."""

    def __init__(self, spec: str, classes: tuple[str, str]):
        j = json.loads(spec)
        if j.get("normalizer") or j["model"]["type"] != "BPE" or j["model"].get("ignore_merges"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        pre = j["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError("only the plain byte-level split is supported")
        chars = byte_characters()
        vocab = j["model"]["vocab"]
        self.bytes_of = {i: bytes(chars[c] for c in t) for t, i in vocab.items()}
        self.byte_id = [vocab[c] for c in sorted(chars, key=chars.get)]
        # Merge number, left and right half of every merged token.
        self.rank, self.left, self.right, self.pair = {}, {}, {}, {}
        for r, m in enumerate(j["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            t = vocab[a + b]
            self.pair[vocab[a], vocab[b]] = r
            self.rank.setdefault(t, r)
            self.left.setdefault(t, vocab[a])
            self.right.setdefault(t, vocab[b])
        self.memo: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        sound = set(self.byte_id)
        for t in sorted(self.rank, key=self.rank.get):  # halves come before wholes
            if self.left[t] in sound and self.right[t] in sound and self.compatible(
                    self.left[t], self.right[t], self.rank[t]):
                sound.add(t)  # the merges applied to its own bytes give the token itself
        for t in sound:
            self.automaton.add_word(self.bytes_of[t].decode("latin-1"), (t, len(self.bytes_of[t])))
        self.automaton.make_automaton()
        self.added = {a["content"]: a["id"] for a in j.get("added_tokens") or []}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in j.get("added_tokens") or []):
            raise ValueError("added tokens with conditions are not supported")
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")"
                                 ) if self.added else None
        self._split = split_pattern(classes)
        self.pieces = _Pieces(self)

    def compatible(self, a: int, b: int, before: int = _NO_PARENT) -> bool:
        """Whether no merge of a number below ``before`` crosses the border of ``a`` and ``b``."""
        key = (a, b)
        if before == _NO_PARENT and key in self.memo:
            return self.memo[key]
        rank, up_a, up_b, good = self.rank, before, before, True
        while True:
            p = self.pair.get((a, b))
            # Equal merges run from the left: the left side's own merge wins a tie, the right side's loses it.
            if p is not None and p < up_a and (p <= up_b if up_b != before else p < up_b):
                good = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                up_a, a = ra, self.right[a]
            else:
                up_b, b = rb, self.left[b]
        if before == _NO_PARENT:
            if len(self.memo) > 2_000_000:
                self.memo.clear()
            self.memo[key] = good
        return good

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word of the split, by the last token of every prefix."""
        text = word.decode("latin-1")
        last, memo, compatible = [-1] * (len(text) + 1), self.memo, self.compatible
        size = [0] * (len(text) + 1)
        for end, (t, n) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - n
            if start:
                p = last[start]
                if p < 0:
                    continue
                good = memo.get((p, t))
                if not (compatible(p, t) if good is None else good):
                    continue
            last[end], size[end] = t, n
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _UNITS.split(text))) if text else b""

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self._added is None:
            raw = self._plain(text)
        else:
            raw = b"".join(self.added[x].to_bytes(4, "little") if k % 2 else self._plain(x)
                           for k, x in enumerate(self._added.split(text)))
        for known in (self.pieces, self.pieces.words):
            if len(known) > REMEMBERED:
                known.clear()
        return np.frombuffer(raw, np.uint32).astype("<u4", copy=False)

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Words(dict):
    """Packed ids by word of the split; a word is encoded when first seen."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        raw = self[word] = array("I", self.bpe.word_ids(word.encode())).tobytes()
        return raw


class _Pieces(dict):
    """Packed ids by piece of text between single spaces."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.split, self.words = bpe._split.findall, _Words(bpe)

    def __missing__(self, piece: str) -> bytes:
        raw = self[piece] = b"".join(map(self.words.__getitem__, self.split(piece)))
        return raw


_LOADED: dict[int, PrefixBpe] = {}


def _loaded(spec) -> PrefixBpe:
    """One encoder in each worker, whatever the number of its tasks."""
    key = spec.id if hasattr(spec, "id") else id(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PrefixBpe(*spec.value)
    return _LOADED[key]


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _broadcast(spark: SparkSession, vocabulary: str | None):
    """The vocabulary file and the character classes for the workers: both of fixed size."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast((f.read(), unicode_classes()))


def encode_documents(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids) for each row; ``ids``
    only ``with_ids``. The hashes are those of the packed ids and of the
    decoded text in UTF-8.

    A null or empty text has no ids and decodes to the empty text. Strings of
    added tokens in a text become those tokens. Null and repeated ids are
    carried as they are; other columns are not read; an empty table gives no
    rows. ``vocabulary`` is the path of a byte-level BPE file on the driver."""
    spark = docs.sparkSession
    common.prepare(spark)
    spec = _broadcast(spark, vocabulary)
    fields = [(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches):
        bpe = _loaded(spec)
        for b in batches:
            n, hashed, decoded, kept = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t)
                n.append(len(ids))
                hashed.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back = bpe.decode_bytes(ids.tolist())
                decoded.append(hashlib.sha256(back if back == t.encode() else
                                              back.decode("utf-8", "replace").encode()).hexdigest())
                if with_ids:
                    kept.append(ids.astype(np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(hashed), pa.array(decoded)]
            cols += [pa.array(kept, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

    ddl = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return narrow.mapInArrow(run, ddl)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of a table with ``ids`` as ``encode_documents`` gives it; null ids decode to the empty text."""
    spark = encoded.sparkSession
    common.prepare(spark)
    spec = _broadcast(spark, vocabulary)

    def run(batches):
        bpe = _loaded(spec)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([bpe.decode(ids or []) for ids in b.column(1).to_pylist()], pa.string())],
                names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` long, text string")


@common.query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents encoded with the 50k byte-level vocabulary and decoded again."""
    return encode_documents(common.table(spark, sf_dir, "documents"), with_ids=False)
