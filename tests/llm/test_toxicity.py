import random
import zlib

import pytest

from botlog.llm import toxicity as T


def test_fold():
    assert T.fold("You \u0405\u0422UP1D, id!0t—ｃlown! a$$$ 42 4040") == " you stupid idiot clown a 42 4040 "
    assert T.fold("") == "  " and T.fold("Été crème") == " ete creme "
    for long in ("1" * 300_000, "a" * 300_000, "a1" * 150_000, "!a" * 150_000, " ! " * 100_000):
        T.fold(long)


def test_matches_exceptions_and_length():
    lex = T.Lexicon({" clown ": 5.0, " stupi": 4.0}, {" clown fish "}, (-4.0, 2.0, 1.0))
    a = lex.automaton()
    assert lex.matches(a, T.fold("a clown fish")) == []
    assert [w for _, _, w in lex.matches(a, T.fold("the clown, a stup1dity"))] == [5.0, 4.0]
    assert lex.score(a, "clown") > lex.score(a, "clown " + "fine " * 500) > lex.score(a, "fine") == lex.score(a, "")


def test_rows_without_labels_and_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "x"), (3, "same"), (3, "same"), (4, "word " * 60_000)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(rows, extra=True)
    kept = T.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == 6
    one = spark.createDataFrame([(1, 0, 0), (2, 1, None), (None, 1, 1), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert T.drop_toxic(docs, one).count() == 6
    assert T.drop_toxic(docs.limit(0), one).count() == 0


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark, docs_of):
    texts = [(i, ("you scum moron %d" if i % 3 == 0 else "a fine day %d") % i) for i in range(300)]
    out = []
    for flip in (False, True):
        labels = [(i, 0, int(i % 3 == 0) ^ int(flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i, _ in texts]
        lex = T.fit(docs_of(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        out.append((lex.weights, lex.coefficients))
    assert out[0] == out[1] and " scum " in out[0][0]


def brute_matches(lex, folded):
    """Every word on its own: the heaviest entry that it starts with or is, unless an exception phrase holds it."""
    words, out = folded.split(), []
    for k, w in enumerate(words):
        hits = [v for e, v in lex.weights.items() if (f" {w} " == e if e.endswith(" ") else f" {w} ".startswith(e))]
        near = [f" {a} {b} " for a, b in zip(words[max(0, k - 1):k + 1], words[max(0, k - 1) + 1:k + 2])]
        if hits and not set(near) & lex.exceptions:
            out.append(max(hits))
    return out


def test_matches_and_exceptions_equal_brute_force():
    rng = random.Random(4)
    parts = ["scum", "scummy", "stupid", "clown", "fish", "clownish", "a", "the", "moronic", "moron", "fine", "sc", "stup"]
    for _ in range(200):
        weights = {(f" {w} " if rng.random() < 0.5 else f" {w[:rng.randint(3, 6)]}"): rng.randint(1, 9) + rng.random()
                   for w in rng.sample(parts, rng.randint(0, 8))}
        pairs = {f" {rng.choice(parts)} {rng.choice(parts)} " for _ in range(rng.randint(0, 6))}
        lex = T.Lexicon(weights, pairs)
        folded = T.fold(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))))
        assert sorted(w for _, _, w in lex.matches(lex.automaton(), folded)) == sorted(brute_matches(lex, folded))


def test_lexicon_is_by_rate(spark, docs_of):
    """An entry that clean texts hold once and toxic ones over and over is found; one that both hold alike is not."""
    rng = random.Random(2)
    filler = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]

    def text(i):
        words = [rng.choice(filler) for _ in range(60)] + ["rarely"]
        return " ".join(words + ["rarely"] * (20 if i % 4 == 0 else 0) + ["common"] * 5)
    texts = [(i, text(i)) for i in range(400)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _ in texts], "doc_id long, quality int, toxic int")
    lex = T.fit(docs_of(texts), labels)
    assert " rarely " in lex.weights and not any(w in lex.weights for w in (" common ", " alpha "))
    a = lex.automaton()
    assert all((lex.score(a, t) >= 0.5) == (i % 4 == 0) for i, t in texts)


# By rate, a probe of entries, weights and the two features reaches 0.97 and 0.95 on these
# rows; the toxic texts that are left hold no word that any other toxic text
# holds, so that no lexicon finds them. The bars lie just under that.
@pytest.mark.parametrize("least_precision, least_recall", [(0.96, 0.94)])
def test_held_out_accuracy(spark, least_precision, least_recall):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = T.op4_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p and y for p, y in held)
    precision, recall = hit / max(1, sum(p for p, _ in held)), hit / sum(y for _, y in held)
    print(precision, recall, len(held))
    assert precision >= least_precision and recall >= least_recall
