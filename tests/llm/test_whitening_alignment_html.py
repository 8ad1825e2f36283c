"""Whitening, token alignment and page text against numpy, a token-by-token loop, and pages whose article is known."""

import hashlib
import html
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from listenlake.llm import html_text, queries, token_alignment, whitening
from listenlake.llm.bpe_automaton import _byte_letters

from .conftest import prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- whitening


def matrices():
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    shapes = {
        "random": None,
        "equal": np.ones(40),
        "pairs": np.repeat(np.linspace(5, 1, 20), 2),
        "close": 1 + 1e-9 * np.arange(40)[::-1],
        "closer": np.array([1, 1 - 1e-13, 1 - 1e-12, 0.5] + [0.1] * 36),
        "graded": 10.0 ** -np.arange(40),
        "rank": np.array([3.0, 2, 1] + [0] * 37),
    }
    for name, s in shapes.items():
        yield name, rng.normal(size=(60, 40)) if s is None else np.linalg.qr(rng.normal(size=(40, 40)))[0] @ np.diag(s) @ turn.T
    yield "one", np.array([[2.0]])
    yield "diagonal", np.diag([3.0, 1, 2])
    yield "column of zeros", np.array([[1.0, 0, 2], [0, 0, 0], [3, 0, 1]])


@pytest.mark.parametrize(("name", "m"), list(matrices()), ids=lambda x: x if isinstance(x, str) else "")
def test_singular_values_and_vectors(name, m):
    r = np.linalg.qr(m)[1]
    values, vectors, total = whitening.singular(r, 8)
    want = np.linalg.svd(m, compute_uv=False) ** 2
    assert np.allclose(values, want[: len(values)], rtol=0, atol=1e-13 * want[0]) and total == pytest.approx(want.sum())
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(m.T @ (m @ vectors) - vectors * values).max() < 1e-13 * want[0]


def test_dqds_keeps_small_values():
    q, e = [1.0, 1e-12, 4.0, 1e-20], [1e-8, 1e-14, 1e-10]
    b = np.diag(np.sqrt(q)) + np.diag(np.sqrt(e), 1)
    want = np.linalg.svd(b, compute_uv=False) ** 2
    assert np.allclose(whitening.dqds(q, e)[:2], want[:2], rtol=1e-13)
    assert np.prod(whitening.dqds(q, e)) == pytest.approx(np.prod(q), rel=1e-12)  # the determinant shows the relative accuracy of all


def steps(vectors):
    return [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]


def test_whitening_agrees_with_numpy(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) + 50
    rows = [(i, [float(x) for x in v], "k") for i, v in enumerate(base)] + [(3, [float(x) for x in base[3]], "k"), (None, [float(x) for x in base[4]], "k")]
    odd = [(900, None, "k"), (901, [float("nan")] * 12, "k"), (902, [1.0] * 11 + [None], "k"), (903, [float("inf")] + [0.0] * 11, "k")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component string").repartition(7)
    got = whitening.whiten(df).collect()
    x = np.array(steps(v for _, v, _ in rows), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x * n - sums).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == 8 * n and Counter(r.vec_id for r in got) == {i: 8 * k for i, k in Counter(i for i, *_ in rows).items()}
    place = {i: k for k, (i, *_) in enumerate(rows)}
    signs = {}
    for r in got:
        k, c = place[r.vec_id], r.component - 1
        assert r.n == n and int(r.deviation) == sum((int(a) * n - int(s)) ** 2 for a, s in zip(x[k], sums))
        white = centred[k] @ v[:, c] / np.sqrt(e[c])
        sign = signs.setdefault(c, np.sign(white * r.whitened))
        assert r.whitened == pytest.approx(sign * white, abs=1e-8)
        assert r.explained == pytest.approx(e[c] / e.sum()) and r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], kind)).collect()
    assert [(r.component, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one] == [(1, None, None, None, 0), (2, None, None, None, 0)]
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [])], kind)).collect()  # one of three dimensions, a short vector
    by = {(r.vec_id, r.component): r for r in flat}
    assert len(by) == 6 and by[1, 1].n == 3 and by[1, 1].identity_error < 1e-9
    line = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()}
    assert abs(line[1, 1].whitened) == pytest.approx(1) and line[1, 2].whitened is None and line[1, 2].explained == pytest.approx(0, abs=1e-12)
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0])], kind)).collect()
    assert len(huge) == 4 and all(int(r.deviation) > 2**63 for r in huge)
    assert whitening.whiten(spark.createDataFrame([(1, [])], kind)).count() == 0  # no dimension, no component


def test_exact_deviations_of_large_numbers():
    model = whitening.Whitening(3, [3 * 10**15 + 1, 7], np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[10**15, 2], [-5, 10**14]])
    assert model.deviation(x) == [sum((3 * int(a) - s) ** 2 for a, s in zip(row, model.sums)) for row in x]


# --- token alignment


def test_runs_and_groups_agree_with_common_ends():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(1, 60)
        p, q = rng.choice([0.2, 0.5, 0.9, 0.99, 1.0]), rng.choice([0.2, 0.5, 0.9, 0.99, 1.0])
        a, b = (sorted({x for x in range(n) if rng.random() < share} | {n}) for share in (p, q))
        common = sorted(set(a) & set(b))
        in_a, in_b, irregular = token_alignment.align(a, b)
        assert [a[i - 1] for i in in_a] == common == [b[j - 1] for j in in_b]
        size = [(i - before, j - then) for i, before, j, then in zip(in_a, [0, *in_a], in_b, [0, *in_b])]
        assert irregular == [g for g, s in enumerate(size) if s != (1, 1)]


def aligned_by_hand(texts):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    first.no_truncation(), first.no_padding()
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = _byte_letters()
    bytes_a = {i: bytes(letters.get(c, 63) for c in token) for token, i in first.get_vocab().items()}
    bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in range(second.vocab_size()))]
    rows, held = [], Counter()
    for text in texts:
        a, b, whole = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or ""), (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            rows.append(None)
            continue
        over = lambda ids, of: np.cumsum([len(of[i]) for i in ids]).tolist()
        end_a, end_b = over(a, bytes_a), over(b, bytes_b)
        links, j = Counter(), 0
        for i, stop in enumerate(end_a):
            start = end_a[i - 1] if i else 0
            while j and end_b[j - 1] > start:
                j -= 1
            while j < len(b) and end_b[j] <= start:
                j += 1
            k = j
            while k < len(b) and (end_b[k - 1] if k else 0) < stop:
                links[a[i], b[k]] += 1
                k += 1
        cuts = sorted(set(end_a) & set(end_b))
        groups, x, y = [], 0, 0
        for cut in cuts:
            u, w = end_a.index(cut, x) + 1, end_b.index(cut, y) + 1
            groups.append(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:w])))
            x, y = u, w
        held.update(links.keys())
        rows.append((len(a), len(b), len(groups), links, sha(";".join(groups))))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], sum(r[3].values()), sum(n for k, n in r[3].items() if held[k] == top[k[0]]), sum(n * held[k] for k, n in r[3].items()), r[4]) for r in rows]


ODD = ["a  b\n c\t\td  ", " ", "  ", "\n", "▁ is no blank", "see <|endoftext|> and <s> <0x0A> <unk>", "x\u001cy \u001c z", "end᠎ next", "ﬁ ² Å", "naïve 漢字 \U0001f600  it's", "don't \r\n stop", "  nb  sp ", "word" * 3000, "a" * 5000, "\x00 nul", " lead", "trail ", "﻿bom", "é" * 300 + "  " + "é"]


def test_alignment_agrees_with_a_loop(spark, texts, monkeypatch):
    rng = random.Random(12)
    data = [(i, t) for i, t in texts if t is None or len(t) < 20_000] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000 + i, prose(rng, 40) + rng.choice(ODD[:6]) + prose(rng, 5)) for i in range(40)]
    want = sorted((str(i), *row) for (i, _), row in zip(data, aligned_by_hand([t for _, t in data])))
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in data], "doc_id long, text string, block string, place int, pairs int")
    for block, part in ((1 << 24, 1 << 20), (3000, 1000)):  # the second makes many blocks
        monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
        monkeypatch.setattr(token_alignment, "PART_BYTES", part)
        got = token_alignment.alignments(df.repartition(3), keep_groups=False)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got.collect()) == want
    whole = {str(r.doc_id): r.groups for r in token_alignment.alignments(df).collect()}
    assert all(sha(whole[i]) == row[-1] if row[-1] else whole[i] == "" for i, *row in want if i != "None" and i != "0")
    assert all(links == a + b - groups for _, a, b, groups, links, *_ in want)
    assert token_alignment.alignments(df.where("false")).count() == 0
    assert [tuple(r)[1:] for r in token_alignment.alignments(df.where("text is null")).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_pieces_are_aligned_as_in_their_text(monkeypatch):
    encoders = token_alignment.Encoders(token_alignment.vocabulary(), token_alignment.piece_model())
    for together in (1, 4096):
        monkeypatch.setattr(token_alignment, "TOGETHER", together)
        encoders.forget()
        for text in ODD:
            numbers, _ = encoders.pieces([text])
            a, b = encoders.ids(" " + text)
            groups = [encoders.groups[i] for i in numbers]
            if text == "▁ is no blank":
                assert None in groups
                continue
            halves = [g.split("|") for g in ";".join(groups).split(";")]
            assert [int(x) for g, _ in halves for x in g.split(",")] == a and [int(x) for _, g in halves for x in g.split(",")] == b, text
            assert encoders.sizes.take(numbers)[0].reshape(-1, 3).sum(axis=0).tolist() == [len(a), len(b), len(halves)]
            assert encoders.links.take(numbers)[1].sum() == len(a) + len(b) - len(halves)


# --- page text


def known(page):
    """The article of a generated page, by its own tags."""
    found = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page)
    blocks = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:h1|p)>", found[1]))
    return "\n".join(x for x in blocks if x)


def test_every_page_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.QUERIES["op13_html_text"](spark, folder).collect()
    assert len(rows) == len(pages) and all(r.text == known(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)


def made_page(rng, article):
    """A page around paragraphs, in one of several layouts, with all that does not belong."""
    p = lambda n: prose(rng, n).capitalize() + "."
    links = lambda n: "".join(f'<li><a href="/{i}">{prose(rng, 2)}</a></li>' for i in range(n))
    body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p><em>{}</em></p>\n", '<blockquote class="q">{}</blockquote>', "<h2>{}</h2>"]).format(html.escape(x)) for x in article)
    top = f'<header id="masthead"><h1>{p(3)}</h1><p>{p(9)}</p></header><nav><ul>{links(7)}</ul></nav>'
    notice = f'<div class="cookie-notice"><p>{p(15)}, {p(6)}</p><button>OK</button></div>'
    ad = rng.choice([f'<div class="ad">{p(14)}</div>', f'<aside>{p(12)}, {p(12)}</aside>', f'<div id="AdSlot">{p(20)}</div>', f'<section role="complementary"><p>{p(30)}</p></section>'])
    remarks = rng.choice([f'<section id="comments"><h3>2 Comments</h3><p>{p(25)}, {p(20)}</p><p>{p(15)}</p></section>', f'<div class="comment-list"><article class="comment"><p>{p(40)}, {p(9)}</p></article></div>', f"<section><h2>Comments (3)</h2><p>{p(30)}, {p(10)}</p></section>"])
    form = f'<form action="/s"><label>{p(5)}</label><textarea>{p(9)}</textarea><select><option>{p(2)}</select></form>'
    script = '<script>var t = "</p><p>" + 1 < 2;</script><style>p > b {}</style><!-- <p>no</p> --><noscript><p>enable</p></noscript>'
    side = f'<div class="sidebar"><h4>{p(2)}</h4><p>{p(20)}</p><ul>{links(4)}</ul></div>'
    low = f'<div class="related-posts"><h3>{p(2)}</h3><p>{p(30)}, {p(10)}</p></div><footer><p>&copy; {p(9)}</p></footer>'
    middle = rng.choice(
        [
            f"<article>{body[: len(body)]}{ad}{script}{form}</article>",
            f'<main><div class="wrap">{script}{body}{ad}</div></main>',
            f'<div id="content"><div class="post-body">{body}{ad}{form}</div></div>',
            f"<div><div>{body}</div></div>",
            f'<table><tr><td class="menu"><ul>{links(6)}</ul></td><td>{body}</td></tr></table>',
        ]
    )
    return f"<!DOCTYPE html><html><head><title>{p(4)}</title>{script}</head><body>{top}{notice}<div class='page'>{side}{middle}{remarks}</div>{low}</body></html>"


def test_articles_come_out_whole_and_alone():
    rng = random.Random(77)
    for _ in range(300):
        article = [prose(rng, rng.randint(12, 60)).capitalize() + rng.choice([".", ", and so on.", " & more <b>."]) for _ in range(rng.randint(2, 9))]
        assert html_text.main_text(made_page(rng, article)) == "\n".join(article)


def test_odd_pages(spark):
    text = html_text.main_text
    assert text(None) == text("") == text("<p></p>") == text("<script>x</script>") == text("<nav><a href=1>Home</a></nav>") == text("<!-- only") == ""
    assert text("<p>Short") == "Short" and text("plain &lt;text&gt; &amp &#x41;&eacute;&nbsp; x") == "plain <text> & Aé x"
    assert text("<div>one<div>two</div>three</div>") == "one\ntwo\nthree"
    assert text("<p>a<br>b  <i>c</i>d<wbr>e</p>") == "a b cde"
    assert text('<p title="a > b" data-x=\'<p>\'>seen</p><p>unfinished <b') == "seen\nunfinished"
    assert text("<p>x <span hidden>no</span><span style='display: none'>no</span> <svg><text>no</text></svg>y</p>") == "x y"
    assert text("<ul><li>one<li>two</ul><dl><dt>k<dd>v</dl>") == "one\ntwo\nk\nv"
    assert text("<DIV><P>Upper</P></DIV>") == "Upper"
    assert text("</div></p><p>stray end tags</p>") == "stray end tags"
    assert text("<form><div><p>The whole page stands in a form, as some systems do.</p><p>It is kept.</p></div><input></form>") == "The whole page stands in a form, as some systems do.\nIt is kept."
    assert text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    long = "word, " * 200_000
    assert text(f"<article><p>{long}</p></article>") == long.strip()
    kind = "page_id long, url string, html string, text int, n_chars string"
    rows = [(1, None, None, 5, "x"), (1, "u", "<p>a</p>", 5, "x"), (None, "u", "", 5, "x")]
    got = html_text.extract(spark.createDataFrame(rows, kind))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, None, "", 0), (1, "u", "a", 1), (None, "u", "", 0)]))
    assert html_text.extract(spark.createDataFrame([], kind)).count() == 0


def test_new_queries_take_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    whitened = queries.QUERIES["op11_whitening"](spark, folder)
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    assert dict(whitened.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert whitened.count() == 8 * n and whitened.select(F.max("identity_error")).first()[0] < 1e-4
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = dict(zip(docs, aligned_by_hand(docs.values())))
    got = queries.QUERIES["op12_token_alignment"](spark, folder).collect()
    assert len(got) == len(docs) and all(tuple(r)[1:] == want[r.doc_id] for r in got)
