import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from botlog.llm import katz as K

END, START = "\n", "\t"


def tokens(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + [END]


class Brute:
    """Katz backoff with dictionaries; contexts are padded with START to one symbol."""

    def __init__(self, texts, order):
        self.order, self.count = order, [Counter() for _ in range(order)]
        for t in texts:
            w = tokens(t)
            for k in range(1, order + 1):
                for i in range(len(w)):
                    self.count[k - 1][self.key(w, i, k)] += 1
        self.d = []
        for c in self.count:
            n = Counter(c.values())
            self.d.append(K.discounts([n[r] for r in range(1, K.CUTOFF + 2)]))
        self.n, self.v = sum(self.count[0].values()), len(self.count[0])
        self.after = [defaultdict(list) for _ in range(order)]
        for k, c in enumerate(self.count):
            for g, r in c.items():
                self.after[k][g[:-1]].append((g[-1], r))
        self.memo, self.unseen = {}, None

    @staticmethod
    def key(w, i, k):
        return tuple(([START] + w[:i + 1])[-k:]) if i + 1 < k else tuple(w[i - k + 1:i + 1])

    def kept(self, k, r):
        return self.d[k - 1][r - 1] * r if r <= len(self.d[k - 1]) else r

    def unigram(self, w):
        if self.unseen is None:
            self.unseen = sum(r - self.kept(1, r) for r in self.count[0].values()) / self.n if self.n else 1.0
        unseen = self.unseen
        r = self.count[0][w,]
        if unseen <= 0:
            return (r + 0.5) / (self.n + 0.5 * (self.v + 1))
        return self.kept(1, r) / self.n if r else unseen

    def p(self, gram, shorter):
        """Probability of the last word of ``gram``; ``shorter`` lists the lower-order grams, longest first."""
        k = len(gram)
        if not shorter:
            return self.unigram(gram[0])
        seen = self.after[len(shorter)].get(gram[:-1])
        low = self.p(shorter[0], shorter[1:])
        if not seen:
            return low
        total, kept = sum(r for _, r in seen), sum(self.kept(len(shorter) + 1, r) for _, r in seen)
        total += kept >= total
        r = self.count[len(shorter)][gram]
        if r:
            return self.kept(len(shorter) + 1, r) / total
        if (len(shorter), gram[:-1]) not in self.memo:
            below = sum(self.p(s[0], s[1:]) for s in ([x[:-1] + (w,) for x in shorter] for w, _ in seen))
            self.memo[len(shorter), gram[:-1]] = (1 - kept / total) / (1 - below)
        return self.memo[len(shorter), gram[:-1]] * low

    def grams(self, w, i):
        return [self.key(w, i, k) for k in range(self.order, 0, -1)]

    def score(self, t):
        w, out = tokens(t), 0.0
        for i in range(len(w)):
            g = self.grams(w, i)
            out += math.log10(self.p(g[0], g[1:]))
        return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = []
    for i in range(n):
        t = []
        while rng.random() < 0.985 and len(t) < 200:
            t.append(words[(int(t[-1][1:]) * 7 + 1) % 400] if t and rng.random() < 0.5 else rng.choices(words, weights)[0])
        rows.append((i, " ".join(t).replace("w3", "W3")))
    return rows


HELD = "crc32(binary(coalesce(string(doc_id), ''))) % 5 = 1"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(docs_of, order):
    rows = corpus(order, 500) + [(900, None), (901, ""), (None, "w1 w2 w1"), (902, "unseen Ünseen w1"), (5, "w1 w2"), (5, "w1 w2"),
                                 (903, "w1\x1cw2\x0bw3 \n w4")]
    got = sorted(K.score(docs_of(rows, extra=True), order, HELD, block_tokens=3000).collect(), key=lambda r: (str(r[0]), r[-1]))
    model = Brute([t for i, t in rows if not held(i)], order)
    plain = {}
    want = []
    for i, t in rows:
        w = tokens(t)
        known = [model.count[0][x,] for x in w]
        plain = sum(math.log10((c + 0.5) / (model.n + 0.5 * (model.v + 1))) for c in known)
        want.append((i, held(i), len(w), sum(c > 0 for c in known), model.n, plain, model.score(t)))
    want.sort(key=lambda r: (str(r[0]), r[-1]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([tuple(r)[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    if order > 1:
        assert sum(r[-1] for r in got if r[1]) > sum(r[-2] for r in got if r[1])


def test_distributions_sum_to_one():
    model = Brute([t for _, t in corpus(4, 300)], 3)
    words = [w for w, in model.count[0]] + ["never seen"]
    for context in (["w0", "w1"], ["w1"], [], ["w7", "w50"], ["never", "w2"], ["w399", "w398"]):
        total = 0.0
        for w in words:
            g = model.grams(context + [w], len(context))
            total += model.p(g[0], g[1:])
        assert abs(total - 1) < 1e-9


def test_no_training_text_and_empty_table(docs_of):
    got = K.score(docs_of([(1, "a b"), (2, None)]), 2, "true").collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [
        (1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert K.score(docs_of([(1, "a")]).limit(0), 2).count() == 0


def test_long_text(docs_of):
    got = K.score(docs_of([(1, "a b c " * 100_000), (2, "a b")]), 2, "doc_id = 2").collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 300_001, 2: 3}


def test_query_beats_base_on_held_out(spark):
    got = K.op2_katz_backoff(spark, "/root/testdata/sf0.01").collect()
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(rows)
    model = Brute([t for i, t in rows.items() if not held(i)], 2)
    out = [r for r in got if r.held_out]
    assert out and all(r.held_out == held(r.doc_id) and r.train_tokens == model.n for r in got)
    for r in out[:40]:
        assert math.isclose(r.score, model.score(rows[r.doc_id]), rel_tol=1e-9)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_the_coded_corpus_is_not_shuffled(docs_of):
    """Only answers travel: the coded side of every step is a bucketed scan without an exchange."""
    out = K.score(docs_of([(i, f"a b {i}") for i in range(20)]), 2, block_tokens=12)
    assert out.count() == 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    coded = plan[plan.index("FlatMapCoGroupsInArrow"):plan.index("stream#")]
    assert "Exchange" not in coded and "Bucketed: true" in plan
