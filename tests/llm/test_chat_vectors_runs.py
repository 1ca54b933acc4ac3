"""Chat formatting, whitening and periodic runs against brute force, on the small tables and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heapspark.llm import chat, common, periodic, queries, whitening

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- chat formatting

PARTS = ["\\", "#", "##", "###", "</turn>", "<", "/turn>", ": ", ":", " ", "\n", "a", "### Assistant: ", "é🙂"]
TURNS = [
    (1, 0, "user", None), (1, 1, "assistant", ""), (2, 5, "assistant", "ends in \\"), (2, 4, "user", "a</turn>\n### assistant: no"), (2, None, None, "first"),
    (3, 1, "assistant", "twice"), (3, 1, "assistant", "twice"), (3, 0, "odd: role\\ ###", "x"), (None, 0, "assistant", "no id"), (None, 1, "assistant", "no id either"),
    (4, 0, "system", "y" * 50_000), (4, 1, "assistant", "\\\\ ### " * 9_000), (-7, 0, "user", "ours"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*t, "z", 1) for t in TURNS], "conv_id long, turn long, role string, text string, piece string, last int").repartition(3)


def conversations(given):
    out = defaultdict(list)
    for conv, turn, role, text in given:
        out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in out.items()}


def expected(given):
    out = {}
    for conv, turns in conversations(given).items():
        said = [t for r, t in turns if r == "assistant"]
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, said)), sha("".join(said)))
    return out


def test_turns_come_back_whatever_they_hold():
    random.seed(2)
    for _ in range(3000):
        given = [("".join(random.choices(PARTS, k=random.randint(0, 4))), "".join(random.choices(PARTS, k=random.randint(0, 7)))) for _ in range(3)]
        text = "".join(chat.render(*t) for t in given)
        got = chat.parse(text)
        assert [t[:2] for t in got] == given
        assert all(text[a:b].count("</turn>") == text[a:b].count("\\</turn>") for _, _, a, b in got)  # no bare control string inside a text


def test_plain_turns_are_not_escaped():
    assert chat.render("user", r"C:\dir < a # b") == "### user: C:\\dir < a # b</turn>\n"
    assert chat.render("user", r"\### Assistant: </turn> ok") == "### user: \\\\\\### Assistant: \\</turn> ok</turn>\n"


@pytest.mark.parametrize("text", ["x", "### user", "### user: x", "### user: x</turn>", "### user: ### y</turn>\n", "### user: x</turn>\ny"])
def test_grammar_refuses(text):
    with pytest.raises(chat.Malformed):
        chat.parse(text)


@pytest.mark.parametrize("piece", [chat.PIECE, 10])
def test_conversations(turns, piece):
    formatted = chat.format_conversations(turns, piece).cache()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows(chat.digest(formatted))}
    assert got == expected(TURNS)
    texts = defaultdict(str)
    for r in sorted(rows(formatted), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["piece"])):
        texts[r["conv_id"]] += r["text"]
    assert {c: [t[:2] for t in chat.parse(x)] for c, x in texts.items()} == conversations(TURNS)
    assert {r["conv_id"]: r["formatted_chars"] for r in rows(chat.digest(formatted))} == {c: len(t) for c, t in texts.items()}
    if piece == 10:
        assert formatted.where("piece > 0").count() > 0
    formatted.unpersist()


def test_no_conversations(turns):
    assert rows(chat.round_trip(turns.where("conv_id = 99"))) == []


def test_chat_query(spark, sf):
    got = queries.op11_chat_format(spark, sf)
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    given += [(-7, 0, "user", queries.COLLIDING), (-7, 1, "assistant", queries.COLLIDING)]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()} == expected(given)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_chat_format"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


# --- whitening


@pytest.mark.parametrize("kind", ["random", "clusters", "tight", "graded", "rank", "equal", "wilkinson", "one"])
def test_singular_values_and_directions(kind):
    rng = np.random.default_rng(7)
    q, p = (np.linalg.qr(rng.standard_normal((40, 40)))[0] for _ in range(2))
    a = {
        "random": rng.standard_normal((300, 40)), "clusters": (q * np.array([5.0] * 8 + [3.0] * 20 + [1e-6] * 12)) @ p, "tight": (q * (1 + 1e-9 * np.arange(40))) @ p, "graded": (q * np.geomspace(1e6, 1e-9, 40)) @ p,
        "rank": np.outer(rng.standard_normal(90), rng.standard_normal(40)), "equal": np.repeat(np.eye(40), 2, axis=0), "one": rng.standard_normal((9, 1)),
        "wilkinson": np.linalg.cholesky(np.diag(np.abs(np.arange(-10, 11.0)) + 2) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T,
    }[kind]
    d = a.shape[1]
    diagonal, above, v = whitening.bidiagonal(whitening._merged([a], d))
    got, want = whitening.dqds(diagonal, above), np.zeros(d)
    s = np.linalg.svd(a, compute_uv=False)
    want[: len(s)] = s
    assert np.abs(np.sqrt(got) - want).max() < 1e-13 * want[0]
    k = int((np.sqrt(got) > 1e-12 * np.sqrt(got[0])).sum())
    axes = v @ whitening.directions(diagonal, above, got[:k])
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12
    assert np.abs(a.T @ (a @ axes) - axes * got[:k]).max() < 1e-12 * got[0]


def test_small_singular_values_keep_their_digits():
    diagonal = np.array([1.0, 1e-3, 1e-6, 1e-9, 1e-12])
    above = diagonal[:-1] * 0.5
    b = [[int(x * 10**30) for x in row] for row in (np.diag(diagonal) + np.diag(above, 1))]
    product = math.prod(b[i][i] / 10**30 for i in range(5))
    assert math.isclose(math.prod(np.sqrt(whitening.dqds(diagonal, above)).tolist()), product, rel_tol=1e-13)  # the determinant, which the least values decide


def brute_whitening(vectors, components=16):
    """By the covariance itself, in exact sums."""
    x = {v: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e] for v, e in vectors}
    fit = sorted({tuple(e) for e in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(e, sums)] for e in fit], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for v, e in x.items():
        apart = [n * a - s for a, s in zip(e, sums)]
        y = np.array(apart, float) / n @ axes[:, :components] / np.sqrt(values[:components])
        out[v] = (n, sum(a * a for a in apart), y, values[:components] / values.sum())
    return out


def test_whitening_query(spark, sf):
    got = defaultdict(dict)
    for r in queries.op12_whitening(spark, sf).collect():
        got[r.vec_id][r.component] = r
    want = brute_whitening([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    assert set(got) == set(want)
    sign = {}
    for v, (n, far, y, share) in want.items():
        assert sorted(got[v]) == list(range(1, 17))
        for c, r in got[v].items():
            assert (r.n, r.deviation) == (n, far) and r.identity_error < 1e-9 and math.isclose(r.explained, share[c - 1], rel_tol=1e-9)
            if abs(y[c - 1]) > 0.1:
                sign.setdefault(c, math.copysign(1, y[c - 1] * r.whitened))
    assert all(math.isclose(got[v][c].whitened, sign[c] * y[c - 1], abs_tol=1e-6) for v, (_, _, y, _) in want.items() for c in sign)


def vectors_df(spark, given):
    return spark.createDataFrame([(v, e, 5, 0.5, 1) for v, e in given], "vec_id long, embedding array<float>, n long, whitened double, x int").repartition(3)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    random.seed(5)
    plain = [(k, [random.gauss(0, 1) for _ in range(6)]) for k in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (103, [nan] * 6), (104, [inf] + [0.0] * 5), (105, [1.0, 2.0]), (None, plain[0][1]), (1, plain[3][1]), (1, plain[3][1])]
    got = whitening.whiten(vectors_df(spark, plain + odd)).collect()
    assert {r.component for r in got} == set(range(1, 7)) and len(got) == 43 * 6
    want = brute_whitening(plain)
    assert all(r.n == 40 and r.deviation in {w[1] for w in want.values()} and r.identity_error < 1e-9 for r in got)
    assert math.isclose(sum({r.component: r.explained for r in got}.values()), 1.0, rel_tol=1e-12)
    again = whitening.whiten(vectors_df(spark, plain).repartition(90), components=3).collect()  # many tasks: the tree merges
    first = {(r.vec_id, r.component): abs(r.whitened) for r in got if r.vec_id in range(2, 40)}
    assert all(math.isclose(abs(r.whitened), first[r.vec_id, r.component], abs_tol=1e-9) for r in again if r.vec_id in range(2, 40)) and len(again) == 120


def test_whitening_of_few_or_no_vectors(spark):
    assert whitening.whiten(vectors_df(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(vectors_df(spark, [(1, None)])).collect() == []
    two = whitening.whiten(vectors_df(spark, [(1, [1.0, 2.0, 9.0]), (2, [1.0, 3.0, 9.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.explained) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    huge = whitening.whiten(vectors_df(spark, [(1, [1e30, 2.0]), (2, [-1e30, 3.0]), (3, [0.0, 0.0])])).collect()
    assert len(huge) == 3 and {r.deviation for r in huge if r.vec_id < 3} == {None} and all(r.identity_error < 1e-6 for r in huge)


# --- periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(12, 2 * q):
                part = w[i : i + size]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def naive_lyndon(w):
    return [max(e - i for e in range(i + 1, len(w) + 1) if all(w[i:e] < w[k:e] for k in range(i + 1, e))) for i in range(len(w))]


def test_lyndon_arrays_under_both_orders():
    random.seed(1)
    for _ in range(150):
        parts = [[random.randint(1, random.choice([1, 2, 3])) for _ in range(random.randint(1, 14))] for _ in range(3)]
        line = np.array([0, *[x for p in parts for x in [*p, 0]]])
        for falling in (False, True):
            got, at = periodic.lyndon_array(line, falling).tolist(), 1
            for p in parts:
                assert got[at : at + len(p)] == naive_lyndon([-x for x in p] if falling else p)
                at += len(p) + 1


def test_runs_of_small_alphabets():
    random.seed(3)
    for _ in range(200):
        docs = []
        for _ in range(4):
            d = [random.randint(0, random.choice([1, 2, 3, 30])) for _ in range(random.randint(0, 60))]
            docs.append(d + d[-random.randint(1, len(d)) :] * random.randint(0, 4) if d else d)
        first = np.cumsum([0, *map(len, docs)])
        got = periodic.runs_of(np.array([x for d in docs for x in d], np.int64), np.repeat(np.arange(4), [len(d) for d in docs]))
        want = [(s + a, n, q) for a, d in zip(first, docs) for s, n, q in brute_runs(d)]
        assert list(zip(*(x.tolist() for x in got))) == want


EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a " * 11), (5, "a " * 12), (6, " ".join("abc" * 9) + "\x1c\x85"), (6, " ".join("abc" * 9)), (7, "x y " * 5000 + "z " + "p q r " * 4000),
    (8, "é🙂 " * 40), (9, "w" * 2_000_000), (10, ("one two three four five six seven\n" * 3) + "end"), (None, " ".join(map(str, range(90)))), (-3, "b\x0bb\x0cb\rb b b b b b b b b b"),
]


def test_runs_edges(spark):
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in EDGE], "doc_id long, text string, start string, length int, n_runs int").repartition(3)
    small = [(i, t) for i, t in EDGE if i != 7]
    order = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    got = sorted((tuple(r) for r in periodic.digest(docs).collect()), key=order)
    assert [r for r in got if r[0] != 7] == sorted((brute_digest(i, t) for i, t in small), key=order)
    found = sorted(tuple(r)[1:] for r in periodic.runs(docs.where("doc_id = 7")).collect())
    assert found == [(0, 10000, 2), (10001, 12000, 3)]
    assert periodic.collapse(docs.where("doc_id = 7")).first().text == "x y z p q r"
    assert periodic.digest(docs.where("doc_id = 99")).collect() == [] and periodic.runs(docs.where("doc_id = 1")).collect() == []


def test_runs_query(spark, sf):
    got = {tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 6000).select("doc_id", "text").collect()
    assert len(docs) > 150 and {brute_digest(r.doc_id, r.text) for r in docs} <= got
