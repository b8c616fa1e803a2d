"""Whitening, the Merkle manifest and main texts against plain versions, on small tables with odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import htmltext, merkle, whitening

# --- whitening -------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, n string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS).repartition(3)


def plain_whitening(rows, k, width):
    """Eigenvectors of the whole covariance matrix, whole numbers kept exact."""
    kept = [(i, [np.float64(np.float32(c)) for c in v] + [0.0] * (width - len(v))) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    xs = [(i, tuple(int(np.floor(64 * c)) + 1_000_000 for c in v)) for i, v in kept]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, {
        (i, x): (sum((n * c - s) ** 2 for c, s in zip(x, sums)), (np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ axes) / np.sqrt(np.maximum(values, 1e-300))) for i, x in xs
    }, values, np.trace(v), xs


def test_whitening_matches_whole_eigenvectors(spark):
    dice = np.random.default_rng(5)
    base = dice.standard_normal((150, 12)) * np.linspace(3, 0.5, 12) + 7
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(3, rows[3][1]), (None, rows[5][1]), (300, [1.0, 2.0]), (301, []), (302, None), (303, [None] * 12), (304, [float("nan")] * 12), (305, [float("inf")] * 12)]
    for k, block in ((3, 4), (16, None)):
        got = whitening.whiten(vectors(spark, rows), k=k, block=block).collect()
        n, want, values, trace, xs = plain_whitening(rows, k, 12)
        assert len(got) == len(xs) * min(k, 12) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
        assert sorted({(r.component, round(r.explained, 12)) for r in got}) == sorted((c + 1, round(e / trace, 12)) for c, e in enumerate(values))
        assert sorted(r.deviation for r in got if r.component == 1) == sorted(want[x][0] for x in xs)
        first = {i: want[(i, x)][1] for i, x in xs}
        for c in range(min(k, 12)):
            ours = {r.vec_id: r.whitened for r in got if r.component == c + 1}
            sign = np.sign(ours[0] * first[0][c])
            assert max(abs(ours[i] - sign * first[i][c]) for i in ours) < 1e-6


def test_whitening_defined_cases(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [float("nan")])])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []  # no variance, no component
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and all(abs(r.explained - 1) < 1e-12 for r in flat)
    with pytest.raises(OverflowError):
        whitening.whiten(vectors(spark, [(1, [1e30]), (2, [0.0])])).collect()
    wide = [(i, [c * 1e9 for c in v]) for i, v in [(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.5, 0.25])]]
    with pytest.raises(Exception, match="does not fit"):
        whitening.whiten(vectors(spark, wide)).collect()


def test_many_partial_products_are_added_on_executors(spark, monkeypatch):
    rows = [(i, [float(c) for c in np.random.default_rng(i).standard_normal(6)]) for i in range(40)]
    want = sorted((r.vec_id, r.component, round(r.whitened, 8)) for r in whitening.whiten(vectors(spark, rows), k=2).collect())
    monkeypatch.setattr(whitening, "GATHER_BYTES", 1)
    assert sorted((r.vec_id, r.component, round(r.whitened, 8)) for r in whitening.whiten(vectors(spark, rows), k=2).collect()) == want


def test_passes_have_as_many_tasks_as_the_bytes_ask_for(spark, monkeypatch):
    rows = [(i, [float(c) for c in np.random.default_rng(i).standard_normal(6)]) for i in range(60)] + [(100 + i, [1.0] * 6) for i in range(60)]
    parts, cut = [], whitening.cut
    monkeypatch.setattr(whitening, "cut", lambda df: (out := cut(df), parts.append(out.rdd.getNumPartitions()))[0])
    held = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        few = sorted((r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 8)) for r in whitening.whiten(vectors(spark, rows), k=2).collect())
        monkeypatch.setattr(whitening, "TASK_BYTES", 1)  # as if there were many bytes; their products are added up on executors
        monkeypatch.setattr(whitening, "GATHER_BYTES", 1)
        many = sorted((r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 8)) for r in whitening.whiten(vectors(spark, rows), k=2).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert parts == [1, 37] and few == many and {r[2] for r in few} == {61}


@pytest.mark.parametrize("gap", [1.5, 1.01, 1.00001])
def test_subspace_iteration_certifies(gap):
    dice = np.random.default_rng(1)
    turn = np.linalg.qr(dice.standard_normal((40, 40)))[0]
    values = np.concatenate([[900, 30], np.linspace(gap, 1.0, 6) * 8, np.linspace(8, 1, 32)])
    v = (turn * values) @ turn.T
    passes = []
    found = whitening.subspace_iteration(lambda q: (passes.append(q.shape[1]), (v @ q, float(np.trace(v))))[1], 40, 4, block=8, patience=60)
    exact = np.linalg.eigvalsh(v)[::-1][:4]
    assert np.allclose(found.values, exact, rtol=1e-12) and found.passes == len(passes)
    assert (np.linalg.norm(v @ found.vectors - found.vectors * found.values, axis=0) < 1e-10).all()
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(4), atol=1e-12)


# --- Merkle manifest -------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, n int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 8 * 8
        out.append((level[lo:i], level[i + 1 : lo + 8]))
        i //= 8
    return out


def plain_manifest(rows):
    def leaf(r, text):
        return h(told(r[0]), told(r[3]), told(r[2]), told(r[4]), told(text))

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([t[2] for t in sorted(by[g], key=lambda t: t[:3])]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by[g], key=lambda t: t[:3])):
            path = plain_path(trees[g], i) + plain_path(top, at)
            x = leaf(r, lowered(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            for a, b in path:
                x = h(*a, x, *b)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], h(*[y for a, b in path for y in a + b]), x, x == top[-1][0]))
    return out


def our_manifest(docs):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = merkle.manifest(docs, {"text": lower}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    return [tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("n", [0, 1, 9, 700, 1300])
def test_manifest(spark, n):
    langs = ["en", None, "", "é", "Z", "de"]
    rows = [(i * 7 % max(n, 1) - 5, [f"Text {i} ÄB", None, "", "no capitals"][i % 4], "en" if i % 3 else langs[i % 6], [None, "s"][i % 2], i, "x", "y", 1) for i in range(n)]
    rows += [rows[0], rows[0], (None, "Q", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "A" * 100_000, "fr", "s", 1, "", "", 0)] if n > 1 else []
    got, want = our_manifest(spark.createDataFrame(rows, DOCS).repartition(4)), plain_manifest(rows)
    assert sorted(map(key, got)) == sorted(map(key, want))
    if n > 9:
        assert {r[-1] for r in got} == {True, False}


def test_manifest_of_many_groups(spark, monkeypatch):
    rows = [(i, "T", f"g{i}" if i % 3 else "hot", "s", i, "", "", 0) for i in range(900)]
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    assert sorted(map(key, our_manifest(spark.createDataFrame(rows, DOCS)))) == sorted(map(key, plain_manifest(rows)))


@pytest.mark.parametrize("levels", [1, 2, 3, 4])
def test_traversal_is_ready_and_small(levels):
    most = 0
    for n in {1, 5, 8, 8**levels // 2 + 1, 8**levels - 3, 8**levels}:
        leaves = [h(str(i)).encode() for i in range(n)]
        if n > 8**levels:
            continue
        walk, root = merkle.Traversal(leaves, levels), merkle.root_of(leaves, levels)
        for leaf, path in zip(leaves, walk):
            assert merkle.fold(leaf, path) == root
            most = max(most, walk.nodes())
    assert most <= 24 * levels  # while leaves are 8^levels


# --- main text -------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, text string, host string, n long"
LONG = "Alpha beta gamma delta epsilon, one two three four five six seven. " * 3


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("just  words\n here", "just words here"),
        ("<article><h1>T</h1><p>a<b>b</b> c<p>d<br>e <!-- no --> &eacute;&#233;&nbsp;f</article>", "T ab c d e éé f"),
        (f"<body><nav>m</nav><div class=ad>buy</div><article><h1>T</h1><p>{LONG}</p></article><footer>&copy;</footer>", f"T {LONG.strip()}"),
        (f"<header><h1>S</h1></header><main><header><h1>T</h1></header><p>{LONG}</p><section class='user-comments'><p>{LONG * 5}</p></section></main><aside>{LONG}</aside>", f"T {LONG.strip()}"),
        (f"<div class='cookie-notice'>{LONG}</div><div class=wrap><h1>T</h1><div class='post has-sidebar'><p>{LONG}</p><form><p>mail</p></form></div></div>", f"T {LONG.strip()}"),
        ("<p>x<script>if (a < b) '</p>'</script>y<style>p{}</style><p>3 < 4 <3", "xy 3 < 4 <3"),
        (f"<form id=all><ul class=menu><li>m</ul><p>{LONG}</p></form>", LONG.strip()),
        ("<p title='a>b\">quoted</p><p title=\"open>rest</p>", "rest"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("<p>before<foo", "before"),
    ],
)
def test_text_of_a_page(source, text):
    if "quoted" in source:
        assert "rest" in htmltext.extract(source, {})[0]
    else:
        assert htmltext.extract(source, {})[0] == text


def test_hosts_agree(spark):
    """A page whose comments (under an unknown name) outweigh its article follows the other pages of its host."""
    page = "<body><div class='body-{i}'><h1>T{i}</h1><p>{a}</p></div><div class='talk'><p>{c}</p></div></body>"
    rows = [(i, f"http://u@h.example:80/{i}", page.format(i=i, a=LONG * 5, c="hm"), "x", "y", 1) for i in range(9)]
    rows += [(20, "HTTP://H.example/x", page.format(i=20, a="short text", c=LONG * 9), "x", "y", 1), (21, None, page.format(i=21, a="short text", c=LONG * 9), "x", "y", 1)]
    rows += [(22, "http://h.example/", None, None, None, None), (23, "", "", None, None, None), (None, "no url", "<p>words</p>", None, None, None), rows[0]]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = sorted(((r.page_id, r.text) for r in htmltext.main_text(pages).collect()), key=str)
    want = [(r[0], f"T{r[0]} {(LONG * 5).strip()}") for r in [*rows[:9], rows[0]]] + [(20, "T20 short text"), (21, (LONG * 9).strip()), (22, ""), (23, ""), (None, "words")]
    assert got == sorted(want, key=str)
    counts = {r.page_id: r.n_chars for r in htmltext.main_text(pages).collect()}
    assert counts[20] == len("T20 short text") and counts[22] == 0
    assert htmltext.main_text(pages.where("false")).collect() == []
    won = {r.host: (r.n, len(r.winners or ())) for r in htmltext.winning_paths(pages).collect()}
    assert won == {"h.example": (12, 1), "": (3, 0)}


def test_winners_of_many_hosts_go_by_shuffle(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.example/", f"<article><p>{LONG} {i}</p></article><div>x</div>", "", "", 0) for i in range(60)]
    pages = spark.createDataFrame(rows, PAGES)
    want = sorted((r.page_id, r.text) for r in htmltext.main_text(pages).collect())
    monkeypatch.setattr(htmltext, "BROADCAST_BYTES", 0)
    assert sorted((r.page_id, r.text) for r in htmltext.main_text(pages).collect()) == want


def test_odd_nesting_takes_linear_time():
    for source in ("<div>" * 30000 + "x", "<i>" * 30000 + "<li>x" * 30000, "<b><div>" + "<i>" * 30000 + "</b>" * 30000, '<a "' * 30000, "<!--" * 30000, "<script>" * 30000, "<" * 100000):
        htmltext.extract(source, {})
