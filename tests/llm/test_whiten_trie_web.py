"""Whitening against NumPy, the conversation trie against nested dictionaries, page text against planted articles."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from alphaloom.llm import trie, webtext, whiten
from alphaloom.llm.queries import op11_embedding_whitening, op12_conversation_trie, op13_html_extraction

# --- op 11


def _whitened(frame):
    """Plain whitening of all usable rows: ids, matrix of whitened values up to sign, deviations, explained shares."""
    usable = frame[[v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) for v in frame.embedding]]
    x = np.floor(64 * np.array([list(v) for v in usable.embedding], dtype=float)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    centred = distinct - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    kept = values > 1e-9 * values[0]
    return usable.vec_id.tolist(), (x - sums / n) @ vectors[:, kept] / np.sqrt(values[kept]), ((n * x - sums) ** 2).sum(1), values[kept] / np.trace(centred.T @ centred / n), n


def _compare(result, frame):
    ids, want, deviations, explained, n = _whitened(frame)
    got = result.toPandas().sort_values(["vec_id", "component"], kind="stable")
    k = want.shape[1]
    assert len(got) == len(ids) * k and set(got.n) == {n}
    order = np.argsort(ids, kind="stable")
    found = got.pivot_table(index="vec_id", columns="component", values="whitened").to_numpy()
    expected = pd.DataFrame(want[order]).groupby(np.array(ids)[order]).mean().to_numpy()
    signs = np.sign((found * expected).sum(0))
    assert np.abs(found - expected * signs).max() < 1e-8
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == dict(zip(ids, deviations.tolist(), strict=True))
    assert np.allclose(got.explained.to_numpy()[:k], explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-8


def test_whitening_equals_numpy(spark, small):
    _compare(op11_embedding_whitening(spark, small), pd.read_parquet(f"{small}/embeddings.parquet"))


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(v) for v in rng.normal(size=3)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, good[0]) for i in range(30)]
    rows += [(7, good[7]), (200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 0.0, 1.0]), (205, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as x", "1 as component", "2 as n")
    frame = pd.DataFrame(rows[:-1], columns=["vec_id", "embedding"])
    _compare(whiten.whiten(table), frame)
    assert whiten.whiten(table).count() == 71 * 3
    assert whiten.whiten(table.limit(0)).collect() == []
    assert whiten.whiten(table.where("vec_id >= 100 and vec_id < 130")).collect() == []


def test_deviations_beyond_a_long_are_null():
    found = whiten.Whitening(3_000_000_000, (3 * 10**18 + 5,), np.eye(1), np.ones(1), np.ones(1), 0.0, False)
    assert found.deviations(np.array([[1_000_000_000], [1_000_000_004], [0]])) == [25, None, None]


# --- op 12


def _trie(built):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
        ends[s].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(ends[p])) for p, m in members.items()]


def _rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(s)] for c, s in own.items()}
    hold = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: tuple(own.get(c - c % 5, [])[: hold[c]] + s[hold[c] :]) for c, s in own.items()}


def _same(got, want):
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_trie_equals_brute_force(spark, small):
    turns = pd.read_parquet(f"{small}/conversations.parquet")
    _same(op12_conversation_trie(spark, small).collect(), _trie(_rebuilt(turns.itertuples(index=False, name=None))))


def test_trie_of_awkward_conversations(spark):
    rows = [(0, 1, "user", "a"), (0, 2, "bot", "b"), (0, None, None, "first"), (1, 1, None, None), (1, 1, "user", "tie"), (1, 1, "user", "tie"), (2, 5, "user", "é" * 5000)]
    rows += [(None, 1, "user", "lost"), (23, 1, "user", "base is absent"), (7, 1, "", "")] + [(c, t, "user", f"same {t}") for c in range(100, 1900) for t in range(3)]
    rows += [(5000, t, "user", f"turn {t % 7}") for t in range(700)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' as path", "'clash' as key", "1 as depth", "2 as place")
    _same(trie.prefix_trie(table).collect(), _trie(_rebuilt(rows)))
    assert trie.prefix_trie(table.limit(0)).collect() == []


def _paths(built):
    turn = lambda t: hashlib.md5(repr(t).encode()).digest()
    groups = defaultdict(list)
    for c, s in built.items():
        groups[s, c >> trie.ID_BLOCK_BITS].append(c)
    rows = [{"path": b"".join(map(turn, s)), "sizes": [len(t[1].encode()) for t in s], "n": len(ids), "smallest": min(ids), "members": ",".join(map(str, sorted(ids)))} for (s, _), ids in groups.items()]
    return [pa.RecordBatch.from_pylist(rows[i : i + 50]) for i in range(0, len(rows), 50)]


@pytest.mark.parametrize(("run_bytes", "block_rows", "waiting"), [(1 << 24, 256, 4096), (700, 3, 2), (50, 1, 1)])
def test_many_small_runs_merge_to_the_same_nodes(monkeypatch, run_bytes, block_rows, waiting):
    for name, value in (("RUN_BYTES", run_bytes), ("BLOCK_ROWS", block_rows), ("WAITING", waiting)):
        monkeypatch.setattr(trie, name, value)
    rng = random.Random(run_bytes)
    built = {c: tuple(("user", rng.choice("abc") * rng.randint(1, 2)) for _ in range(rng.randint(0, 6))) for c in range(1500)}
    blocks = sorted((r for b in trie._runs(iter(_paths(built))) for r in b.to_pylist()), key=lambda b: (not b["header"], b["first"], b["first_id"]))
    rows = list(trie.merged(iter(blocks)))
    assert [(r.path, r.smallest) for r in rows] == sorted((r["path"], r["smallest"]) for b in _paths(built) for r in b.to_pylist())
    assert [r.lcp for r in rows[1:]] == [trie.shared(a.path, b.path) for a, b in zip(rows, rows[1:], strict=False)]
    out = []
    path = trie.OpenPath(0, out.append)
    for row in rows:
        path.take(row)
    while path.stack:
        path.finish(True)
    asked = {r["key"]: r["conv_id"] for r in out if r["sort"] in ("asked", "edge")}
    nodes = [r for r in out if r["sort"] == "node"]
    want = _trie(built)
    got = [(r["conv_id"], r["depth"], r.get("parent_conv_id", asked.get(r.get("parent_key"))), r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in nodes]
    assert set(got) <= set(want) and len(got) == len(want) - sum(r["sort"] == "edge" for r in out)


def test_merging_compares_no_turn_twice(monkeypatch):
    """Sequences that share 400 turns: the merge looks at what follows them, not at what they share."""
    looked = [0]
    plain = trie.shared

    def counted(a, b, known=0):
        found = plain(a, b, known)
        looked[0] += found - known + 1
        return found

    rng = random.Random(5)
    common = tuple(("user", str(i)) for i in range(400))
    built = {c: common + tuple(("user", str(rng.randint(0, 9))) for _ in range(4)) for c in range(600)}
    monkeypatch.setattr(trie, "RUN_BYTES", 200_000)
    blocks = sorted((r for b in trie._runs(iter(_paths(built))) for r in b.to_pylist()), key=lambda b: (not b["header"], b["first"], b["first_id"]))
    runs = sum(b["header"] for b in blocks)
    monkeypatch.setattr(trie, "shared", counted)
    rows = list(trie.merged(iter(blocks)))
    assert runs > 10 and looked[0] < 400 * runs + 12 * len(rows)


# --- op 13

LONG = "The first long paragraph of the story tells a reader what has happened in the town over the last few days and why it matters to them."
MORE = "A second paragraph goes on with many more words, so that the ratio of text to tags stays high over the whole body of the article."
LINKS = '<ul><li><a href="/1">One</a><li><a href="/2">Two</a><li><a href="/3">Three</a></ul>'
PAGES = {
    "tagged": (f"<body><nav>{LINKS}</nav><div class='ad'>{LONG}</div><article><header><h1>T &amp; t</h1></header><p>{LONG}<p>x</p><form>Mail<input></form><aside>{MORE}</aside>"
               f"<ul><li>one</li><li>two</li></ul><p><b>{MORE}<br>end</p></article><footer>&copy; by us</footer>", ["T & t", LONG, "x", "one", "two", f"{MORE} end"]),
    "untagged": (f"<html><body><div id='header'><h1>Site</h1>{LINKS}</div><div id='content'><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{MORE}</p></div><div class='sidebar'><p>{MORE} {MORE}</p></div>"
                 f"<div id='comments'><p>{LONG} says one</p><p>{MORE} says two</p><p>{MORE}</p></div><div id='footer'>Copyright</div>", ["Title", LONG, "Short.", MORE]),
    "bare": (f"<body>{LINKS}<h1>Title</h1><p>{LONG}<p>Short.<p>{MORE}<div>Copyright</div>", ["Title", LONG, "Short.", MORE]),
    "cookies": (f"<body><div class='cookieNotice'><p>{LONG}</p><button>Yes</button></div><main><p>{MORE}</p><p>x</p></main>", [MORE, "x"]),
    "comment articles": (f"<article class='post'><h1>T</h1><p>{LONG}</p></article><section class='comment-list'><article><p>{MORE} {MORE}</p></article></section>", ["T", LONG]),
    "small article": (f"<div class='ad'>{LONG}</div><article><h1>Hi</h1><p>ok</p></article><footer>{MORE}</footer>", ["Hi", "ok"]),
    "code": (f"<article><script>var a='<p>no</p></article>';</script><style>p{{}}</style><p>{LONG}</p><!-- <p>no</p> --><noscript>no</noscript></article>", [LONG]),
    "white space": ("<article><p> a \n\t b&nbsp;c <i>d</i>e </p><p> </p></article>", ["a b c de"]),
    "text": ("only text &lt;here&gt;", ["only text <here>"]),
    "furniture": (f"<nav>{LINKS}</nav><footer>{LONG}</footer>", []),
    "broken": ("<<p><b <article", None),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of_page_shapes(name):
    html, want = PAGES[name]
    got = webtext.main_text(html)
    assert want is None or got == "\n\n".join(want)
    assert webtext.main_text(html) == got


def test_extraction_finds_every_article_word_for_word(spark, small):
    """The generated pages keep their articles between two tags: cut out by hand, block by block."""
    import html as references
    import re

    pages = pd.read_parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in op13_html_extraction(spark, small).collect()}
    assert len(got) == len(pages)
    for page_id, url, page in pages.itertuples(index=False, name=None):
        inside = page[page.index("<article>") + 9 : page.index("</article>")].replace("<b>", "").replace("</b>", "")
        blocks = [" ".join(references.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        want = "\n\n".join(filter(None, blocks))
        assert (got[page_id].url, got[page_id].text, got[page_id].n_chars) == (url, want, len(want))


def test_extraction_of_awkward_rows(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, None, None), (2, "u", ""), (None, "u", page), (3, "u", page), (3, "u", page), (4, "u", "<article>" + f"<p>{'word ' * 2000}</p>" * 100 + "</article>"), (5, "u", "&" * 70_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "1 as n_chars")
    got = webtext.extract_text(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((r.page_id or 0, r.n_chars) for r in got.collect())
    assert found == [(0, len(LONG)), (1, 0), (2, 0), (3, len(LONG)), (3, len(LONG)), (4, 100 * 9999 + 99 * 2), (5, 70_000)]
    assert webtext.extract_text(table.limit(0)).collect() == []


def test_smoothing_is_a_mean_of_neighbours():
    assert np.allclose(webtext.smooth(np.full(7, 3.0)), 3.0) and np.allclose(webtext.smooth(np.array([5.0])), 5.0)
    spread = webtext.smooth(np.array([0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]))
    assert spread.argmax() == 3 and spread[0] == 0 and spread[1] > 0 and np.allclose(spread, spread[::-1])
