"""Small cases of every corpus operator: nulls, empties, ties, copies, brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hemicycle.llm import embedding_dedup, hilbert, jaccard, maxent, packing, piece_codec, quality, repeats, toxicity, wrapper
from hemicycle.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, count int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(5)]
    out = [None, "", " ", "\n\n", "a", "one two three four", "x" * 5000, "the of and to in a is that it for was", base[0], base[0], base[0].upper()]
    for _ in range(60):
        part = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = rng.choice(words)
        out.append(" ".join(part[: rng.randint(30, 60)]) + rng.choice(["", "\n", " end.\nend.\nend."]))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (7, None)], "a long, b long")
    assert dict(components(edges).collect()) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(np.r_[base, base[:20] + 0.1 * rng.normal(size=(20, 8)), base[:5], 3 * base[:3]])]
    rows += [(100, None), (101, [0.0] * 8), (102, [float("nan")] + [1.0] * 7), (103, [None] + [1.0] * 7), (104, [1.0]), (105, []), (106, [float("inf")] * 8)]
    rows += [(None, base[0].tolist())]
    cell, chunk = embedding_dedup.CELL, embedding_dedup.CHUNK
    embedding_dedup.CELL, embedding_dedup.CHUNK = 12, 5  # several cells and chunks
    try:
        got = {r.vec_id: tuple(r[1:]) for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    finally:
        embedding_dedup.CELL, embedding_dedup.CHUNK = cell, chunk
    good = [(i, np.array(v)) for i, v in rows if i is not None and i < 100]
    links = {i: {j for j, w in good if j != i and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9} for i, v in good}
    low = {i: i for i in links}
    for _ in links:
        low = {i: min([low[i], *(low[j] for j in links[i])]) for i in links}
    assert got == {**{i: (len(links[i]), low[i], low[i] == i) for i in links}, **{i: (0, i, True) for i in range(100, 107)}, None: (0, None, False)}


def test_hilbert(spark, docs, empty):
    grid = spark.range(512).selectExpr("cast(id % 8 as int) a", "cast(id div 8 % 8 as int) b", "cast(id div 64 as int) c")
    path = sorted(hilbert.with_curve_index(grid, ["a", "b", "c"], 3).collect(), key=lambda r: r.curve)
    assert [r.curve for r in path] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p[:3], q[:3], strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))
    rows = hilbert.shard_rows(docs, 7).collect()
    count = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in count.items())
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in rows)
    assert hilbert.shard_rows(empty, 7).collect() == []


def test_quality(docs, texts, empty):
    def brute(t):
        w = WORD.findall(t or "")
        five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(five)
        again = {i + k for i, g in enumerate(five) if n[g] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)

    rows = quality.judge(docs).collect()
    assert all(tuple(r[c] for c in quality.BASE) == brute(texts[r.doc_id]) for r in rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    good = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == good and 7 in good
    assert quality.judge(empty).collect() == [] and quality.keep_good(docs).columns == docs.columns


def test_pieces(docs, texts, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in piece_codec.encode_pieces(docs, path, full=True).collect():
        ids = [1, *lib.encode(texts[r.doc_id] or ""), 2]
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, lib.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    coder = piece_codec.codec(path)
    odd = ["a  b", " x", "▁a▁", "\n \n", "漢字😀\x00", "<s></s><0x0A>", "ab" * 400, "  " * 30, "a \nb"]
    assert [x.tolist() for x in coder.encode(odd)] == [[1, *lib.encode(t), 2] for t in odd]
    assert piece_codec.encode_pieces(empty, path).collect() == []


def test_jaccard(spark, docs, texts, empty):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    low = list(range(len(sets)))
    linked = [[j for j, y in enumerate(sets) if x and y and 100 * len(x & y) >= 80 * len(x | y)] for x in sets]
    for _ in sets:
        low = [min([low[i], *(low[j] for j in linked[i])]) for i in range(len(sets))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(s), low[i]) for i, s in enumerate(sets)}
    assert jaccard.jaccard_components(empty).collect() == []


def test_jaccard_short_and_crowded(spark):
    def shingles(t):
        w = t.split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [rng.sample(words, 90), rng.sample(words, 13), rng.sample(words, 12), rng.sample(words, 20), rng.sample(words, 30)]
    rows = []
    for i in range(700):
        t = list(base[0] if i < 400 else rng.choice(base))
        for _ in range(rng.randint(0, 6) if len(t) == 90 else rng.choice([0, 0, 0, 1])):
            t[rng.randrange(len(t))] = rng.choice(words)  # most are too far from each other, all share pieces
        cut = rng.randint(0, 3)
        rows.append((i if i % 50 else 7, " ".join(t[cut : len(t) - rng.randint(0, 3)])))
    rows += [(800 + i, " ".join(base[1][: 4 + i])) for i in range(10)]
    sets = [shingles(t) for _, t in rows]
    low = {i: i for i, _ in rows}
    linked = [(rows[i][0], rows[j][0]) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 100 * len(x & y) >= 80 * len(x | y)]
    while True:
        before = dict(low)
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), low[i]) for (i, _), s in zip(rows, sets))


def test_jaccard_groups_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 400)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    rows, homes = [], []
    for sig in range(120):  # copies of one set, of which more than half are too far from it
        s = np.unique(np.r_[base[rng.random(40) > rng.choice([0.02, 0.1, 0.2])], rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)])
        rows.append((sig, s.tobytes()))
        homes.append((7, sig, len(s), sig if sig % 4 else 0))
    homes += [(8, 5, 40, 5), (8, 6, 40, 6), (9, 5, 40, 5)]
    sets = [set(np.frombuffer(m, np.uint64).tolist()) for _, m in rows]
    want = {
        (a, b) for b in range(120) for a in range(b)
        if (a % 4 or b % 4) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    }
    made = jaccard.linked_in_groups(
        spark.createDataFrame(homes, "lead long, sig long, n long, component long"), spark.createDataFrame(rows, "sig long, members binary"))
    got = [(min(r), max(r)) for r in made.collect()]
    assert set(got) == want and len(want) > 100


def test_jaccard_sketches():
    rng = np.random.default_rng(4)
    for n in [*range(4, 40), 150]:
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = np.union1d(x[rng.integers(0, 2) :], rng.integers(0, 2**63, rng.integers(0, 1 + n // 5)).astype(np.uint64))
            common = len(np.intersect1d(x, y))
            if common * 100 < 80 * (len(x) + len(y) - common) or common == len(x) == len(y):
                continue
            if min(len(x), len(y)) <= 8:
                a, b = sorted((x, y), key=len)
                assert jaccard.signature(a) in jaccard.smaller_sums(b)
                continue
            found = False
            for level in set(jaccard.levels(len(x))) & set(jaccard.levels(len(y))):
                for kx, code, spare in jaccard.sketch_keys(x, level):
                    for ky, other, spared in jaccard.sketch_keys(y, level):
                        found |= code == other and len(np.intersect1d(kx, ky)) > max(spare, spared, 0)
            assert found


def test_toxicity(spark, empty):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    bad = ["idiotic", "worthless", "scummy"]
    rows = [(i, " ".join(rng.sample(words, 20) + (rng.sample(bad, 2) if i % 3 == 0 else []))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (301, ""), (None, "idiotic scummy")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(300) if got[i].held_out} == set(held)
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert got[300].score == got[301].score < 0.5 and got[None].predicted == 1
    model = toxicity.fit(docs, labels)
    at, w = model.vector(model.known(toxicity.stems(rows[3][1])))
    ids, cos = model.nearest(at, w)
    all_cos = (w @ model.postings[list(at)].reshape(len(at), -1))
    assert np.allclose(np.sort(cos)[::-1], np.sort(all_cos)[::-1][: len(cos)])  # pruning loses nothing
    assert toxicity.score_toxicity(empty.select("doc_id", "text"), labels).collect() == []


def test_toxicity_vectors_are_arrays():
    """Words of a text by place, without a tuple for each; the nearest are those of brute force."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    examples = [(i, i % 2, toxicity.stems(t)) for i, t in enumerate([*texts, texts[0], texts[0]])]
    found = {}
    for _, label, words in examples:
        for w in words:
            k, h = found.get(w, (0, 0))
            found[w] = k + 1, h + label
    model = toxicity.build(examples, found, {0: 76, 1: 76})
    for text in [*texts[:30], "zz a bb zz a", "zz"]:
        words = toxicity.stems(text)
        place, count = model.known(words)
        assert isinstance(place, np.ndarray) and list(zip(place.tolist(), count.tolist())) == sorted((model.place[s], c) for s, c in words.items() if s in model.place)
        at, w = model.vector((place, count))
        ids, cos = model.nearest(at, w)
        brute = w @ model.postings[list(at)].reshape(len(at), -1) if len(at) else np.zeros(1)
        best = np.sort(brute[brute > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(cos, best) and np.allclose(brute[ids], cos)


def test_toxicity_terms(spark):
    rng = random.Random(8)
    # far more than 128 words speak for the label, and clean words share their first letters
    bad = [f"vile{a}{b}{c}" for a in "abcdef" for b in "ghijkl" for c in "mnopqr"]
    fine = [w[:4] + w[4:][::-1] for w in bad]
    rows, toxic = [], []
    for i in range(900):
        toxic.append(int(i % 3 == 0))
        rows.append((i, " ".join(rng.sample(fine, 12) + (rng.sample(bad, 12) if toxic[i] else rng.sample(fine, 12)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.weight) == set(bad) | set(fine) and min(model.weight.values()) > 0  # no word is left out
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, model=model).collect()}
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == toxic[i] for i in held) >= 0.95 * len(held)
    for i in held[:40]:
        at, w = model.vector(model.known(toxicity.stems(rows[i][1])))
        exact = np.sort((w @ model.postings[list(at)].reshape(len(at), -1)))[::-1]
        cos = got[i].cosines
        assert len(cos) == toxicity.NEIGHBOURS and np.allclose(cos, exact[: len(cos)])  # pruning loses nothing


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, 64, 1).collect()
    bins: dict = {}
    for r in rows:
        ids = np.array([*lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == 64 * r.piece
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(r.length for r in rows)
    assert total == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert len(bins) <= 1.15 * total / 64 + 1
    coder = packing.word_ids(path)
    odd = ["it's I'LL", "a\x1fb\x85c", "É é", "ΑΣ σ", "x..,y. z", "a. b", "漢字12"]
    assert [x.tolist() for x in coder.encode(odd)] == [e.ids for e in lib.encode_batch(odd, add_special_tokens=False)]
    assert packing.pack(empty, path).collect() == []


def test_pages(spark):
    page = (
        "<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>menu</a></nav><div class='site-notice'>Same for all</div>"
        "<p>Also the same</p><article><h1>Head {0}</h1><p>One &amp; <b>two\n three.<br><p>Four {0}</p><form>f</form><div class='comments'>c</div></article><footer>f</footer>"
    )
    rows = [(i, "http://h.example/x", page.format(i)) for i in range(8)] + [(20, None, None), (21, "x", ""), (22, "http://g.example/", "<p>only<p>text <")]
    rows += [(30 + i, "http://k.example/", f"<body><p>Site line</p><div>Text {i}</div></body>") for i in range(9)]
    got = {r.page_id: r.text for r in wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3\nOne & two three.\nFour 3" and got[20] == got[21] == "" and got[22] == "only\ntext <"
    assert got[34] == "Text 4"  # the constant line is template
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert wrapper.main_text(deep) == "x"


def test_page_templates_inside_articles(spark):
    page = (
        "<body><{1}><h1>Head {0}</h1><div class='zq7'><p>Read this on our app</p></div><p>Text <b>with</b> {0}</p><a>Send it on</a><p>Last {0}</p></{1}><p>out</p></body>"
    )
    rows = [(i, "http://a.example/", page.format(i, "article")) for i in range(8)] + [(10 + i, "http://m.example/", page.format(i, "main")) for i in range(8)]
    rows += [(20 + i, "http://r.example/", page.format(0, "article")) for i in range(8)]  # one page again and again
    rows += [(100 + i, "http://p.example/", f"<article><h1>Head {i}</h1><p>Plain and constant</p><p>Text {i}</p></article>") for i in range(20)]
    got = {r.page_id: r.text for r in wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[100] == "Head 0\nText 0"  # a plain paragraph goes on more pages
    for i in range(8):
        assert got[i] == got[10 + i] == f"Head {i}\nText with {i}\nLast {i}"
        assert got[20 + i] == "Head 0\nRead this on our app\nText with 0\nSend it on\nLast 0"


def test_page_names_and_seeds(spark):
    read = lambda page: wrapper.main_text(page)
    assert read("<div class='content has-sidebar'><form><article><p>x</p></article></form></div>") == "x"
    assert read("<article><h2 id='social-impact'>a</h2><section id='related-work'>b</section><p id='search'>c</p><div class='share box'>d</div></article>") == "a\nb\nc"
    page = "<body><article><h1>Head {0}</h1><div id='comments'>By {0}</div><div class='zq7'>Same on all</div><p>Text {0}</p></article></body>"
    rows = [(None, "http://s.example/", None), (0, "http://s.example/", ""), (1, "http://s.example/", "<p>gone</p>")]
    rows += [(10 + i, "http://s.example/", page.format(i)) for i in range(8)]
    got = {r.page_id: r.text for r in wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[None] == got[0] == "" and got[1] == "gone" and all(got[10 + i] == f"Head {i}\nText {i}" for i in range(8))


def test_page_alignment(monkeypatch):
    def tree(page):
        root = wrapper.parse(page)
        wrapper.number(root)
        return root

    def brute(a, b):
        if a.tag != b.tag:
            return 0
        row = [0] * (len(b.kids) + 1)
        for x in a.kids:
            new = [0]
            for j, y in enumerate(b.kids):
                m = brute(x, y)
                new.append(max(row[j + 1], new[-1], row[j] + m if m else 0))
            row = new
        return 1 + row[-1]

    rng = random.Random(5)
    make = lambda d: "".join(f"<{t}>{make(d - 1) if d else ''}</{t}>" for t in rng.choices(["div", "ul", "b"], k=rng.randint(0, 4)))
    for cells in (wrapper.CELLS, 1):
        monkeypatch.setattr(wrapper, "CELLS", cells)
        for _ in range(150):
            a, b = tree(make(3)), tree(make(3))
            pairs = wrapper.align(a, b)
            assert len(pairs) == brute(a, b) and all(x.tag == y.tag for x, y in pairs)
            assert sorted(y.number for _, y in pairs) == [y.number for _, y in sorted(pairs, key=lambda p: p[0].number)]  # order kept
    monkeypatch.undo()
    long = [tree(f"<body><{t}>0</{t}>" + "".join(f"<div><i>{k}</i></div><ul></ul>" for k in range(n)) + "<p>end</p></body>") for t, n in (("h1", 1000), ("h2", 900))]
    assert len(wrapper.align(*long)) == 2 + 1 + 900 * 3
    deep = [tree("<div>" * 2000 + t + "</div>" * 2000) for t in ("<p>x</p>", "<p>x</p><ul></ul>")]
    assert len(wrapper.align(*deep)) == 2002


def test_cells_join_in_batches(spark, monkeypatch):
    """Batches send at most as many vectors as asked at a time, and find together what one batch finds."""
    rng = np.random.default_rng(3)
    near = rng.normal(size=(40, 6))
    rows = [(i, [float(x) for x in near[i % 40] + rng.normal(size=6) * 0.15]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(10)] + [(500, [1.0, 2.0]), (501, [2.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = sorted(map(tuple, embedding_dedup.link_vectors(table).collect()))
    cos = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v in rows}
    assert {r[0]: r[1] for r in want} == {i: sum(j != i and len(w) == len(v) and v @ w >= 0.9 for j, w in cos.items()) for i, v in cos.items()}
    made, whole = [], embedding_dedup._assigned

    def watched(vectors, pivots, radius, limit, part):
        made.append((int(part.sum()), len(pivots)))
        return whole(vectors, pivots, radius, limit, part)

    monkeypatch.setattr(embedding_dedup, "_assigned", watched)
    for name, value in {"CELL": 40, "CHUNK": 4, "PARTS": 8, "WIDEST": 16, "SENT": 1, "ROWS": 3, "HELD": 5}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    assert sorted(map(tuple, embedding_dedup.link_vectors(table).collect())) == want
    assert len(made) > 3 and sum(cells for cells, _ in made) <= made[0][1]
    sizes = {0: (50, 20), 1: (0, 9), 2: (30, 0), 4: (1000, 1), 5: (8, 8)}
    parts = embedding_dedup._batches(sizes, 32, 300, 6)
    assert [np.flatnonzero(p).tolist() for p in parts] == [[0, 2], [4], [5]]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_scores(docs, texts, empty):
    rows = {r.doc_id: r for r in maxent.score_texts(docs).collect()}
    cut = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in cut(texts[i]))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w, r = cut(t), rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    assert maxent.score_texts(empty).collect() == []


def test_gain_keeps_with_tasks(spark, texts):
    """What few tasks learnt is not divided by all tasks' tokens; the head is whole words of a count."""
    rows = [(i, t) for i, t in enumerate(texts)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gains = []
    for tasks in (1, 16):
        found = maxent.score_texts(docs.repartition(tasks)).filter("NOT held_out")
        gains.append(found.agg(F.sum(F.col("score") - F.col("base_score"))).first()[0])
    assert gains[1] > 0.3 * gains[0] > 0
    counts = spark.createDataFrame([(w, 5 if w < 1500 else 2 if w < 2000 else 1) for w in range(9000)], "word long, c long").repartition(7)
    head, least = maxent.HEAD, maxent.CLASSES * maxent.PER_CLASS
    try:
        sizes = {}
        for maxent.HEAD in (1, 1600, 2000, 1 << 18):
            model = maxent.start(counts)
            sizes[maxent.HEAD] = len(model.words)
            assert (model.place >= 0).sum() == least and sorted(model.counts.tolist(), reverse=True)[:least] == [5] * least
    finally:
        maxent.HEAD = head
    assert sizes == {1: least, 1600: 1500, 2000: 2000, 1 << 18: 9000}


def test_contexts_are_words(docs, monkeypatch):
    """Words out of the head are not one context."""
    model, seen, whole = maxent.start(maxent.word_counts(docs)), [], maxent.Model.contexts

    def watched(self, words, ends):
        seen.append(len(set(words.tolist())))
        return whole(self, words, ends)

    monkeypatch.setattr(maxent.Model, "contexts", watched)
    words = np.arange(1, 400, dtype=np.uint64)
    model.logs(words, np.array([len(words)]), model.weights)
    assert seen == [399] and len(set(whole(model, words, np.array([len(words)]))[0].tolist())) > 300


def test_probabilities(docs):
    """Class and word probabilities of the model sum to one."""
    model = maxent.train(docs, maxent.start(maxent.word_counts(docs)))
    history = maxent.tokens("the of")[:2]
    logs = [model.logs(np.r_[history, w], np.array([3]), model.weights)[0][2] for w in model.words[model.place >= 0]]
    other = model.logs(np.r_[history, np.uint64(12345)], np.array([3]), model.weights)[0][2]
    assert np.exp(logs).sum() + np.exp(other) == pytest.approx(1, abs=1e-3)


def test_repeats(spark, docs, texts, empty):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd é\n") for _ in range(300)) for _ in range(4)]
    more = ["".join(b[a : a + rng.randint(1, 120)] for b, a in ((rng.choice(base), rng.randint(0, 250)) for _ in range(rng.randint(0, 5)))) for _ in range(150)]
    more += ["a" * 500, "a" * 700, "ab" * 300, "b" + "ab" * 40]
    rows = [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(more))]
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    rng.shuffle(rows)
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), full=True).collect()}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept)
    same = spark.createDataFrame([(1, base[0]), (1, base[0]), (2, base[0]), (None, base[0])], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in repeats.remove_repeats(same).collect()) == [(0, 0), (1, 0), (1, 0), (2, len(base[0].encode()))]
    assert repeats.remove_repeats(empty).collect() == []


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.select("doc_id").distinct().count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] == counts[4] > 0
