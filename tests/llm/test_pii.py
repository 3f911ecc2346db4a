import hashlib
import random
import re

from botlog.llm import pii as P


def plain_base(t):
    """The patterns as they are written, searched from left to right."""
    out = []
    out += [(0, m.start(), m.end()) for m in P.EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t, re.A) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in P.CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in P.PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_against_the_patterns():
    rng = random.Random(1)
    bits = ["a", "é", "@", ".", "-", "_", "%", "x.y", "1", "25", "256", "0004", "10.0.0.1", "4111111111111111", "4111 1111-1111 1111",
            " ", "+", "+1 (555) 010-9999", "(", ")", "a@b.c", "a@b", "@@", "b-.c", "٣", "\n", "4242424242424242"]
    for _ in range(30_000):
        t = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        assert P.base_spans(t) == plain_base(t), repr(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "a." * 150_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "a@b" * 100_000,
              "+" + "1 " * 150_000, "0" * 300_000 + ".0.0.0"):
        P.base_spans(t)


def brute(rows, flagged=None):
    """Spans by dictionaries over the whole corpus; the flagged words are added to ``flagged``."""
    words, near, ents = {}, {}, {}
    for r, (_, t) in enumerate(rows):
        t = t or ""
        for w in P._WORD.findall(t.lower()):
            words[w] = words.get(w, 0) + 1
        spans, mine = plain_base(t), set()
        for k, s, e in spans:
            v = P.entity(k, t[s:e])
            mine.add((v, 0))
            free = [m for m in P._WORD.finditer(t) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
            for m in [m for m in free if m.end() <= s][-P.WINDOW:] + [m for m in free if m.start() >= e][:P.WINDOW]:
                near.setdefault((m[0].lower(), v), set()).add((r, m.start(), m.end()))
        for v in {v for v, _ in mine}:
            if any(x[1] == v and any(q[0] == r for q in near[x]) for x in near):
                ents[v] = ents.get(v, 0) + 1
    n, extra = sum(words.values()), {}
    for (w, v), where in near.items():
        share = len(where) / words[w]
        if len(where) >= P.LEAST_TOGETHER and share >= P.LEAST_SHARE and \
                P.np.log2(len(where) * n / (words[w] * ents[v])) >= P.LEAST_BITS:
            if flagged is not None:
                flagged.add(w)
            for r, s, e in where:
                was = extra.setdefault(r, {}).get((s, e))
                extra[r][s, e] = max(was or "", "remove" if share >= P.REMOVE else "generalise")
    return [(i, [(k, s, e, "remove") for k, s, e in plain_base(t or "")]
             + sorted((4, s, e, a) for (s, e), a in extra.get(r, {}).items())) for r, (i, t) in enumerate(rows)]


def brute_everywhere(rows):
    """(id, base spans and every word that is flagged anywhere and touches none of them), in contract order."""
    flagged = set()
    brute(rows, flagged)
    out = []
    for i, t in rows:
        base = plain_base(t or "")
        free = [m for m in P._WORD.finditer(t or "") if not any(a < m.end() and m.start() < b for _, a, b in base)]
        out.append((i, base + [(4, m.start(), m.end()) for m in free if m[0].lower() in flagged]))
    return out


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 7))) for _ in range(500)]
    fill = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, fill(rng.randrange(0, 60))) for i in range(150)]
    for i in range(6):
        rows.append((200 + i, f"{fill(9)} Zorblax chief Quimby writes from Q.Smith@corp.example.com daily {fill(9)}"))
        rows.append((300 + i, f"{fill(5)} +1 (555) 010-{1000 + i} {fill(5)} 10.0.0.{i}"))
    return rows + [(200, fill(3) + " quimby"), (400, None), (401, ""), (None, "a@b.example.com"), (402, "same a@c.example.org"),
                   (402, "same a@c.example.org"), (403, fill(20_000) + " q.smith@corp.example.com")]


def test_against_brute_force(docs_of):
    rows = corpus()
    got = P.personal_spans(docs_of(rows, extra=True)).collect()
    mine = sorted([(r.doc_id, [tuple(s) for s in r.spans]) for r in got], key=str)
    assert mine == sorted(brute(rows), key=str)
    actions = {s.action for r in got for s in r.spans if s.kind == 4}
    assert "remove" in actions
    one = next(r for r in got if r.doc_id == 201)
    text = dict(rows)[201]
    clean = P.sanitise(text, one.spans)
    assert "Zorblax" not in clean and "[email]" in clean and "Smith" not in clean
    assert P.personal_spans(docs_of(rows).limit(0)).count() == 0


def check_query(got, rows):
    for i, spans in brute_everywhere(rows):
        base = ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in spans if k < 4)
        assert [got[i][f"n_{k}"] for k in P.KINDS[:4]] == [sum(s[0] == k for s in spans) for k in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[i].spans == ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in spans)


def test_query_has_all_spans_once(spark, docs_of, tmp_path):
    """Flagged terms near their entity, far from it, and in texts that do not name it."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 7))) for _ in range(500)]
    fill = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, fill(40)) for i in range(100)]
    rows += [(200 + i, f"{fill(9)} quimby account ZX48213 of q@corp.example.com {fill(30)} {'quimby' * (i == 0)}") for i in range(6)]
    rows += [(300, "Quimby called"), (301, f"{fill(3)} zx48213 {fill(9)} far@x.example.org {fill(9)} Zx48213"), (303, None), (304, "")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in P.op5_personal_data(spark, str(tmp_path)).collect()}
    check_query(got, rows)
    assert got[300].spans == "term:0:6" and got[301].spans.count("term") == 2


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in P.op5_personal_data(spark, sf).collect()}
    assert len(got) == len(rows)
    check_query(got, rows)
    assert any(r.n_email for r in got.values())


def test_flagged_terms_go_wherever_they_stand(docs_of):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 7))) for _ in range(500)]
    fill = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, fill(40)) for i in range(100)]
    rows += [(200 + i, f"{fill(9)} quimby account ZX48213 of q@corp.example.com {fill(9)}") for i in range(6)]
    rows += [(300, "Quimby called"), (301, f"{fill(3)} zx48213 {fill(3)} far@x.example.org {fill(9)}"), (302, "quimbys ZX482130"), (302, None)]
    got = {r.doc_id: r for r in P.personal_spans(docs_of(rows)).collect()}
    texts = dict(rows)
    cut = lambda i: {texts[i][s.start:s.end] for s in got[i].elsewhere}
    assert cut(300) == {"Quimby"} and not got[300].spans and P.sanitise(texts[300], got[300].elsewhere) == "[word] called"
    assert "zx48213" in cut(301) | {texts[301][s.start:s.end] for s in got[301].spans if s.kind == 4}
    assert "zx48213" not in P.sanitise(texts[301], got[301].spans + got[301].elsewhere)
    assert got[302].elsewhere == [] and all(r.elsewhere == [] for i, r in got.items() if i < 100 or 200 <= i < 300)
    assert all("ZX48213" not in P.sanitise(texts[200 + i], got[200 + i].spans) for i in range(6))
