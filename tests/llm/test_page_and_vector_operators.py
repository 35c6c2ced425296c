import hashlib
import html
import os
import random
import re
import sys
from array import array
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
from parcelweave.llm import alignment, blocks, codes, pages  # noqa: E402

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    with open(BYTE_LEVEL, encoding="utf-8") as f, open(PIECES, "rb") as g:
        return alignment.TokenPair(f.read(), g.read())


# Cross-tokenizer alignment

def plain_alignment(pair, texts):
    """The contract's columns of each text, links found by comparing every two byte ranges' borders."""
    out, corpus = [], Counter()
    for text in texts:
        a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
            out.append((0, 0, 0, "", []))
            continue
        spans = [[(e - len(table[i]), e) for i, e in zip(ids, accumulate(len(table[i]) for i in ids), strict=True)]
                 for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b))]
        ends = [e for e in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})]
        groups, links, start = [], [], 0
        for end in ends:
            own = [[n for n, (s, e) in enumerate(side) if start <= s and e <= end] for side in spans]
            groups.append(",".join(str(a[n]) for n in own[0]) + "|" + ",".join(str(b[n]) for n in own[1]))
            links += [(a[i], b[j]) for i in own[0] for j in own[1]
                      if max(spans[0][i][0], spans[1][j][0]) < min(spans[0][i][1], spans[1][j][1])]
            start = end
        corpus.update(links)
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    highest = Counter()
    for (_, b), n in corpus.items():
        highest[b] = max(highest[b], n)
    return [(a, b, g, len(links), sum(corpus[x] == highest[x[1]] for x in links), sum(corpus[x] for x in links), sha)
            for a, b, g, sha, links in out]


TEXTS = [None, "", " ", "a", "Hello, world!", "<|endoftext|> and </s> are text", "tab\tand\r\nline", "x ▁y", "  two  blanks ",
         "naïve café 漢字かな 😀 ", "Hello, world!", "unbelievably internationalised", "0x41 <0x41>", "\x00\x1c", "é" * 40,
         "the cat sat on the mat " * 30]


def test_alignment_against_every_byte_range(spark, pair):
    rows = [(i if i % 5 else None, t, i, "s") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_a int, _row string")
    for shared in (1, 1 << 16):
        got = alignment.align_tokenizers(docs, BYTE_LEVEL, PIECES, shared_pairs=shared).collect()
        columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(plain_alignment(pair, TEXTS))
        assert got[0]["_row"] == "s"
    assert alignment.align_tokenizers(docs.limit(0), BYTE_LEVEL, PIECES).count() == 0


def test_alignment_of_random_ends():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 60)
        share = rng.random()
        cuts = [sorted({x for x in range(1, n) if rng.random() < share or x % 7 == 0} | {n}) for _ in range(2)]
        runs, groups, link_a, link_b = alignment.align(*(array("q", c) for c in cuts))
        ends = sorted([cuts[0][i + k] for i, _, m in runs for k in range(m)] + [cuts[0][past - 1] for _, past, _, _ in groups])
        assert ends == sorted(set(cuts[0]) & set(cuts[1]))
        links = {(i + k, j + k) for i, j, m in runs for k in range(m)} | set(zip(link_a, link_b, strict=True))
        spans = [list(zip([0, *c], c, strict=False)) for c in cuts]
        assert links == {(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if max(x[0], y[0]) < min(x[1], y[1])}


def test_words_have_the_tokens_of_the_whole_text(pair, monkeypatch):
    assert pair.ranked is not None
    rng = random.Random(5)
    texts = ["".join(rng.choices(["word", " ", "  ", "\n", "Ünï", ". ", "42", "'s", "漢", " a", "_", "\u00a0", "don't", "!?"], k=3000)) for _ in range(6)]
    texts += ["x" * 3000, "no-blank\n" * 500, "".join(map(chr, range(1, 0x2581)))]
    for cached in (1 << 20, 10):
        monkeypatch.setattr(alignment, "CACHED_WORDS", cached)
        for text, (a, b) in zip(texts, pair.ids(texts), strict=True):
            assert a.tolist() == pair.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == pair.b.encode(text)
        pair.forget()


# Vector codes

def plain_codes(vectors, parts, size, rounds, scale):
    """vectors: (id, components) in codebook order."""
    ints = [[int(np.floor(scale * x)) for x in v] for v in vectors]
    dim = len(ints[0]) // parts
    cut = [[v[p * dim:(p + 1) * dim] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:size]] for p in range(parts)]

    def near(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for v in cut:
                met.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for i, members in met.items():
                books[p][i] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return ["".join(f"{i:02x}" for _, i in f) for f in found], [sum(d for d, _ in f) for f in found], hashlib.sha256(text.encode()).hexdigest()


def test_codes_against_a_plain_search(spark):
    rng = random.Random(7)
    rows = [(i // 2 if i < 20 else i, [round(rng.gauss(0, 1), 1) for _ in range(8)], rng.choice([None, 1, 1, 1, 2])) for i in range(120)]
    rows += [rows[50], (None, rows[3][1], None), (500, None, 1), (501, [1.0, None] + [0.0] * 6, 1), (502, [float("nan")] * 8, 1),
             (503, [float("-inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, _code string")
    kept = [(r[0], np.float32(r[1]).tolist(), r[2]) for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for parts, size, rounds in ((4, 9, 2), (2, 64, 1), (8, 200, 2)):
        code, error, digest = plain_codes([v for _, v, _ in kept], parts, size, rounds, 256)
        got = codes.vector_codes(df, parts=parts, size=size, rounds=rounds).collect()
        labels = Counter()
        for e, (_, _, label) in zip(error, kept, strict=True):
            labels[label] += e
        want = [(i, c, e, labels[label], digest, "x") for (i, _, label), c, e in zip(kept, code, error, strict=True)]
        columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256", "_code")
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in got))) == sorted(map(str, want))
    assert codes.vector_codes(df.limit(0)).count() == 0
    assert codes.vector_codes(df.where("vec_id >= 500")).count() == 0


def test_codes_of_uneven_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], None), (2, [1.0], None), (3, [], None)],
                               "vec_id bigint, embedding array<double>, label int")
    code, error, digest = plain_codes([[1.0, 2.0, 3.0, 0.0], [1.0, 0.0, 0.0, 0.0], [0.0] * 4], 2, 64, 2, 256)
    got = sorted(codes.vector_codes(df, parts=2).collect())
    assert [r["code"] for r in got] == code and [r["error"] for r in got] == error
    assert {r["codebooks_sha256"] for r in got} == {digest} and {r["label_error"] for r in got} == {sum(error)}


def test_nearest_settles_ties_by_index():
    rng = np.random.default_rng(1)
    for _ in range(50):
        entries, values = rng.integers(-3, 4, (rng.integers(1, 12), 3)), rng.integers(-4, 5, (40, 3))
        far = ((values[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, best = codes.nearest(values, entries)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


# Page extraction

def plain_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 27, 20])
def test_common_lines_are_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(pages, "TABLE_BITS", bits)
    rng = random.Random(9)
    for _ in range(300):
        a, b = (rng.choices(range(rng.randrange(1, 9)), k=rng.randrange(0, 25)) for _ in range(2))
        at = pages.common(a, b)
        assert len(at) == plain_common(a, b) and at == sorted(set(at))
        rest = iter(b)
        assert all(a[i] in rest for i in at)


def site(body, extra=""):
    return (f"<html><head><title>T</title><script>if (a<b) x('<p>no</p>')</script></head><body><div>Site name</div>{extra}"
            f"{body}<p>All rights&nbsp;reserved &copy; 2020</p></body></html>")


PAGES = [
    ("http://a.example/news/1.html", site("<p>First story.\n It  goes on.</p><p>Shared quote.</p>")),
    ("http://a.example/news/2.html?x=1", site("<p>Second &amp; <b>last</b> story</p><ul><li>one<li>two</ul>")),
    ("http://b.example/x", site("<article><h1>A</h1><p>Shared quote.<p>Own<br>text <div class='social-share'>Tweet</div>"
                                "<section id=comments><article><p>Nice!</p></article></section></article>")),
    ("http://b.example/y", site("<article><header><h2>B</h2><p>by me</p></header><p>Shared quote.</p></article>")),
    ("http://c.example/", site("<p>Alone</p>", "<nav><a href='/'>Menu</a></nav><!-- <p>hidden</p> -->")),
    (None, "<p>No address</p>"), ("http://d.example/1", None), ("http://d.example/2", ""),
    ("http://e.example/1", site("<p>Copy</p>")), ("http://e.example/2", site("<p>Copy</p>")),
    ("http://e.example/2", site("<p>Copy</p>")), ("not a url", "a < b & c &lt;i&gt; <b>x"),
]
TEXT = ["First story. It goes on.\nShared quote.", "Second & last story\none\ntwo", "A\nShared quote.\nOwn text", "B\nShared quote.",
        "Site name\nAlone\nAll rights reserved © 2020", "No address", "", "", *["Site name\nCopy\nAll rights reserved © 2020"] * 3,
        "a < b & c <i> x"]


def test_main_text_by_differencing_and_markup(spark):
    rows = [(i, u, h, "t", -1) for i, (u, h) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, _host int")
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r["page_id"]: r for r in pages.main_text(df).collect()}
        assert [got[i]["text"] for i in range(len(PAGES))] == TEXT
        assert all(r["n_chars"] == len(r["text"]) and r["_host"] == -1 for r in got.values())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert pages.main_text(df.limit(0)).count() == 0


def test_pairs_are_neighbours_in_path_order(spark):
    rng = random.Random(13)
    urls = [f"http://{'hot' if rng.random() < 0.5 else rng.choice('abc')}.example/{rng.choice('xy')}/{rng.randrange(50)}" for _ in range(150)]
    table = pages._line_table(pages._keyed(spark.createDataFrame([(u, u) for u in urls], "url string, html string"), "url", "html"))
    keys = sorted(tuple(r) for r in table.select(*pages.KEY).collect())
    want = {}
    for i, key in enumerate(keys):
        near = [(len(os.path.commonprefix([key[1], keys[j][1]])), -j, keys[j]) for j in (i - 1, i + 1)
                if 0 <= j < len(keys) and keys[j][0] == key[0]]
        if near:
            want[key] = max(near)[2][1:]
    assert {tuple(r[:3]): tuple(r[3:]) for r in pages.paired(table).collect()} == want


def test_broken_markup_and_very_long_pages():
    assert blocks.blocks("<p>a<p>b<div>c</div") == [("a", blocks.OPEN), ("b", blocks.OPEN), ("c", blocks.OPEN)]
    assert blocks.blocks("<p class=\"x>y\">a</p><!-- open <p>b") == [("a", blocks.OPEN)]
    assert blocks.blocks("<td>a<td>b<script>c") == [("a", blocks.OPEN), ("b", blocks.OPEN)]
    text = "".join(f"<p><b>word {i} &amp" for i in range(50_000)) + "<a \"" * 5000
    found = blocks.blocks(text)
    assert len(found) >= 50_000 and found[7] == ("word 7 &", blocks.OPEN)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_articles_of_the_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in df.collect()}
    for row in pages.main_text(df).collect():
        article = re.search(r"<article>(.*)</article>", source[row["page_id"]], re.DOTALL).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert row["text"] == "\n".join(p for p in parts if p)


def test_awkward_documents_align(spark):
    docs = plain.documents(spark)
    assert alignment.align_tokenizers(docs, BYTE_LEVEL, PIECES).count() == docs.count()
