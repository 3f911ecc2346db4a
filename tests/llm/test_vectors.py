import numpy as np

from botlog.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, e string"


def brute(rows, threshold=0.93):
    ok = [k for k, (_, e, y) in enumerate(rows) if y is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {k: set() for k in range(len(rows))}
    groups = {}
    for k in ok:
        groups.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for ks in groups.values():
        x = np.array([rows[k][1] for k in ks], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                links[ks[a]].add(ks[b])
    return links


def component(links):
    out = {}
    for s in sorted(links):
        todo = [s] if s not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = s
                todo += links[x]
    return out


def test_small_cases(spark):
    rng = np.random.default_rng(1)
    rows = []
    for y in (0, 1, 1, 1):
        c = rng.standard_normal(16)
        rows += [(len(rows) + k, [float(np.float32(v)) for v in c + 0.04 * rng.standard_normal(16)], y) for k in range(40)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(n + k, e, 0) for k, e in enumerate(odd)]
    rows += [(n + 10, rows[0][1], None), (n + 11, rows[0][1], 0), (n + 12, rows[0][1], 0), (n + 13, [1.0] * 15, 0),
             (n + 14, [2.0 * v for v in rows[0][1]], 0), (None, rows[0][1], 0), (n + 15, [-0.0] + [1.0] * 3, 5),
             (n + 16, [0.0] + [1.0] * 3, 5), (n + 15, [5.0, 0.0, 0.0, 0.0], 5)]
    links = brute(rows)
    comp = component(links)
    ids = {}
    for k, c in comp.items():
        ids.setdefault(c, []).append(rows[k][0])
    least = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    want = sorted([(rows[k][0], len(links[k]), least[comp[k]], rows[k][0] == least[comp[k]]) for k in range(len(rows))], key=str)
    df = spark.createDataFrame([(i, e, y, "x", "x") for i, e, y in rows], SCHEMA)
    for tile in (V.TILE, 16):
        assert sorted([tuple(r) for r in V.vector_links(df, tile=tile).collect()], key=str) == want
    assert V.vector_links(df.limit(0)).count() == 0


def test_recall_of_the_count():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((3000, 64))
    b -= (b * a).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = 0.9301
    i, j = V.linked_pairs(a, c * a + np.sqrt(1 - c * c) * b, 0.93, False)
    assert (i == j).sum() >= 0.98 * 3000  # pairs at the very threshold


def test_recall_and_precision_on_the_table(spark):
    """All vectors of the table and near copies of a third of them, from well inside to well outside the threshold."""
    df = V.common.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    rng = np.random.default_rng(3)
    for k, (i, e, y) in enumerate(rows[::3]):
        noise = rng.standard_normal(len(e)) * np.linalg.norm(e) / np.sqrt(len(e)) * rng.uniform(0.05, 0.5)
        rows.append((10_000_000 + k, [float(np.float32(v)) for v in np.array(e) + noise], y))
    near = spark.createDataFrame([(i, e, y, "x", "x") for i, e, y in rows], SCHEMA)
    got = {r.vec_id: r for r in V.vector_links(near).collect()}
    links = brute(rows)
    total, found = sum(map(len, links.values())), sum(r.n_links for r in got.values())
    assert total > 400 and 0.99 * total <= found <= total
    assert all(got[rows[k][0]].n_links <= len(v) for k, v in links.items())
    comp = component(links)
    assert sum(got[rows[k][0]].component_id == rows[c][0] for k, c in comp.items()) >= 0.99 * len(rows)


def test_query(spark, sf):
    got = V.op8_embedding_near_dedup(spark, sf).collect()
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    links = brute(rows)
    assert {r.vec_id: r.n_links for r in got} == {rows[k][0]: len(v) for k, v in links.items()}
