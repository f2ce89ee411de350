"""Encoding, edits, pages, languages, decontamination, sharding and quality on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import bpe, decontaminate, html_text, language_id, quality_model, quality_rules, sharding, token_counts
from loomwork.llm._shared import vocabulary_path

TEXTS = ["", " ", "a", "don't stop 12 ...  \n\n end ", "日本語 テキスト", "🙂" * 900, "ab" * 3000, "é ü\t\x0b x", "'ll's THE the"]


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def tokenizer(request):
    import public_tokenizers
    import tiktoken

    table = bpe.load_table(vocabulary_path(request.param))
    return table, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.ranks, special_tokens={})


def test_encoding_equals_tiktoken(tokenizer):
    table, other = tokenizer
    random.seed(1)
    texts = TEXTS + ["".join(random.choice("ab é1 \n'lsr🙂ñ") for _ in range(120)) for _ in range(200)]
    encoder, decoder = bpe.Encoder(table), bpe.Decoder(table)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert decoder.decode(ids) == text.encode()


def test_a_small_cache_changes_nothing(tokenizer):
    table, other = tokenizer
    random.seed(7)
    texts = [" ".join("".join(random.choice("abcdeé") for _ in range(random.randint(1, 90))) for _ in range(40)) for _ in range(30)]
    for cached in (0, 3, 50, 500):
        encoder = bpe.Encoder(table, cached)
        for k in range(0, 30, 5):
            for text, ids in zip(texts[k : k + 5] + texts[:2], encoder.encode(texts[k : k + 5] + texts[:2]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert len(encoder.cache) <= max(cached, 0)


def test_long_pieces_merge_alike(tokenizer):
    table, _ = tokenizer
    random.seed(2)
    pieces = [bytes(random.choice(b"abe tion\xc3\xa9") for _ in range(random.randint(2, 300))) for _ in range(60)]
    assert [bpe._merge_folded(table, p) for p in pieces] == [bpe._merge_matrix(table, [p])[0] for p in pieces]


def test_round_trip_query(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, None, 1), (0, "", 2)]
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), vocabulary_path(bpe.VOCABULARY)).collect()
    assert len(got) == len(rows)
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t, _ in rows)


def test_edits_equal_a_full_recount():
    table = bpe.load_table(vocabulary_path(token_counts.VOCABULARY))
    encoder = bpe.Encoder(table)
    random.seed(3)
    alpha = "ab é1 \n'lsr  tv.🙂"
    word = lambda sizes: "".join(random.choice(alpha) for _ in range(random.choice(sizes)))
    for _ in range(150):
        text = word([0, 1, 30, 900])
        counted = token_counts.CountedText(text, token_counts.leaves_of([text], encoder)[0], encoder)
        for _ in range(6):
            counted.edit(random.randint(-2, len(counted.text) + 3), random.choice([0, 1, 5, 400]), word([0, 1, 9, 200]))
            want = token_counts.leaves_of([counted.text], encoder)[0]
            assert counted.leaves.tolist() == want.tolist()
            assert counted.tree.tokens == want[:, 1].sum()


def test_attached_edits(spark):
    path = vocabulary_path(token_counts.VOCABULARY)
    trees = token_counts.build_trees(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string"), path)
    edits = spark.createDataFrame([(1, 2, 0, 0, "B"), (1, 1, 0, 3, "A"), (1, 3, None, None, None)], "doc_id long, seq int, start long, remove long, insert string")
    got = {r["doc_id"]: r for r in token_counts.apply_edits(token_counts.attach_edits(trees, edits), path).collect()}
    assert got[1]["text"] == "BA two" and got[1]["n_edits"] == 3
    assert got[2]["n_tokens"] == 0 and got[2]["n_edits"] == 0
    rows = [(None, "one two three", 1), (None, "one two three", 1), (5, None, 1), (6, "long text " * 20_000, 1), (7, "", 1)]
    docs = token_counts.standard_edits(spark.createDataFrame(rows, "doc_id long, text string, tree int"))
    encoder = bpe.Encoder(bpe.load_table(path))
    done = token_counts.edit_counts(docs, path).collect()
    assert len(done) == 5
    for r in done:
        assert r["n_tokens"] == int(token_counts.leaves_of([r["text"]], encoder)[0][:, 1].sum()) and r["n_edits"] == 4
    assert token_counts.edit_counts(docs.limit(0), path).count() == 0


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies and ask you to agree to all of them now please.</div><div id="content">{article}</div>
<aside class="sidebar">Other things to read that are long enough to look like text of an article, really.</aside><form>Name <input></form>
<section id="comments"><p>A reader's comment that is also quite long, so that its ratio is high and it would pass.</p></section><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(tag):
    body = f"<{tag}><h1>Head &amp; line</h1><p>First   paragraph of <b>bo</b>ld text that goes on and on for a while.<br>Next<p>Short.</p><p>Last paragraph, which has some more words to say.</p></{tag}>"
    want = "Head & line First paragraph of bold text that goes on and on for a while. Next Short. Last paragraph, which has some more words to say."
    assert html_text.main_text(PAGE.format(article=body)) == want


def _page(r, article, wrapped):
    """A page with furniture around the paragraphs, and its main text."""
    words = lambda n: " ".join(r.choice(["river", "stone", "field", "cloud", "under", "slowly", "walks"]) for _ in range(n))
    blocks = [words(r.randint(3, 9))] + [words(r.randint(6, 80)) for _ in range(r.randint(1, 8))]
    tags = ["h1", *["p"] * (len(blocks) - 1)]
    body = "".join(f"<{t}>{b}" + (f"</{t}>" if r.random() < 0.7 or t == "h1" else "") for t, b in zip(tags, blocks, strict=True))
    if wrapped:
        body = f"<div class='wrap'><section>{body}</section></div>"
    menu = "".join(f"<li><a href='/{k}'>{words(1)}</a></li>" for k in range(r.randint(3, 9)))
    before = f"<nav><ul>{menu}</ul></nav><div class='ad'>{words(r.randint(5, 15))}</div>"
    after = f"<div id='comments'><p>{words(r.randint(5, 20))}</p></div><footer>&copy; {words(8)}</footer>"
    return f"<html><head><title>x</title></head><body>{before}<{article}>{body}</{article}>{after}</body></html>", " ".join(blocks)


@pytest.mark.parametrize("wrapped", [False, True])
@pytest.mark.parametrize("article", ["article", "main", "div", "section"])
def test_pages_with_and_without_article(article, wrapped):
    r = random.Random(11)
    pages = [_page(r, article, wrapped) for _ in range(120)]
    assert sum(html_text.main_text(h) == want for h, want in pages) >= 118


def test_ratios_choose_the_regions(monkeypatch):
    """Two regions that differ in their ratios only: the output follows the smoothed ratios."""
    dense = "<div><p>" + "a long sentence of many words without a single tag in it " * 4 + "</p></div>"
    sparse = "<div>" + "".join(f"<p><b><i>t{k}</i></b></p>" for k in range(12)) + "</div>"
    html = f"<html><body>{sparse}{dense}</body></html>"
    assert html_text.main_text(html) == " ".join(("a long sentence of many words without a single tag in it " * 4).split())
    monkeypatch.setattr(html_text, "smoothed", lambda ratios, alike, sigma=1: [1 / (1 + x) for x in ratios])
    assert html_text.main_text(html) == " ".join(f"t{k}" for k in range(12))


def test_smoothing_equals_the_plain_sum():
    r = np.random.default_rng(2)
    x, alike = r.random(30).tolist(), (r.random(30) < 0.3).tolist()
    for i, got in enumerate(html_text.smoothed(x, alike)):
        near = [k for k in range(30) if abs(k - i) <= 3 and alike[k] == alike[i]]
        w = [np.exp(-((k - i) ** 2) / 2) for k in near]
        assert got == pytest.approx(np.dot(w, [x[k] for k in near]) / sum(w))


@pytest.mark.parametrize("html", [None, "", "<", "<!DOCTYPE", "<![CDATA[x", "<p", "<script>never closed", "&#xffffff;&bogus;"])
def test_odd_pages(html):
    assert isinstance(html_text.main_text(html), str)


def test_pages_query(spark):
    got = html_text.extract(spark.createDataFrame([(None, None, None, "t"), (1, "u", "<p>a&nbsp;b</p>", "t"), (1, "u", "<p>a&nbsp;b</p>", "t"), (2, "u", "<p>" + "word " * 200_000, "t")], "page_id long, url string, html string, text string"))
    assert sorted(r["text"] for r in got.collect())[:3] == ["", "a b", "a b"]
    assert {r["page_id"]: len(r["text"]) for r in got.collect()}[2] == 999_999
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_gradients_are_right():
    net = language_id.Network.fresh(["x", "y", "z"], 5, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, label, weight = np.array([[97, 98, 99], [100, 97, 101], [102, 97, 98], [1, 2, 3]]), np.array([0, 2, 1]), np.array([0.5, 1.0, 2.0])
    _, grad = net.gradients(x, label, weight)
    r = np.random.default_rng(0)
    for name, g in grad.items():
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in g.shape) if name[0] != "w" else (int(r.choice(x.ravel())), int(r.integers(0, g.shape[1])))
            old, step = net.weights[name][at], 1e-5
            net.weights[name][at] = old + step
            up = net.gradients(x, label, weight)[0]
            net.weights[name][at] = old - step
            down = net.gradients(x, label, weight)[0]
            net.weights[name][at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-7)


def test_languages(spark):
    r = random.Random(4)
    words = {"aa": ["kama", "kolo", "kiki", "maka"], "bb": ["stren", "schtor", "blst", "ströf"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(20)), lang) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa"), (501, "12 !!", "bb"), (502, "kama" * 50, None)]
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, lang_pred string")
    net = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.predict(df, net).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[502]["lang_pred"] == "aa"
    assert {r["doc_id"] for r in language_id.keep_identified(df, net).collect()} == set(got) - {500, 501}
    assert language_id.keep_identified(df, net, 1.1).count() == 0
    none = language_id.fit(df.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.least_score(df.limit(0), none) == 1 and language_id.predict(df.limit(0), net).count() == 0
    again = spark.createDataFrame([(None, "kama kolo", "s"), (None, "kama kolo", "s"), (1, "kama kolo " * 30_000, "s")], "doc_id long, text string, score string")
    assert [r["lang_pred"] for r in language_id.predict(again, net).collect()] == ["aa"] * 3


def test_reader_equals_a_plain_pass():
    """Every run read by itself, state by state, against the cached and batched reader."""
    net = language_id.Network.fresh(["x", "y", "z"], 4, 3)
    w = {k: v.astype(float) for k, v in net.weights.items()}

    def states(raw, d):
        h, out = np.zeros(4), []
        for byte in raw:
            a, g = w["w" + d][byte] + w["b" + d], h @ w["u" + d]
            z, r = (1 / (1 + np.exp(-(a[k : k + 4] + g[k : k + 4]))) for k in (0, 4))
            h = (1 - z) * np.tanh(a[8:] + r * g[8:]) + z * h
            out.append(h)
        return out

    texts = ["one two one", "Größe é" + "ü" * 100 + " one", "", "12", "a" * 64 + "ö"]
    for text, lang, score in zip(texts, *language_id.Reader(net).label(texts), strict=True):
        logs = []
        for run in language_id.RUN.findall(text.lower()):
            for raw in language_id.pieces_of(run):
                raw.decode()
                for f, b in zip(states(raw, "f"), states(raw[::-1], "b")[::-1], strict=True):
                    y = np.concatenate([f, b]) @ w["o"] + w["c"]
                    logs.append(y - np.log(np.exp(y).sum()))
        if not logs:
            assert (lang, score) == ("und", 0)
            continue
        best = int(np.sum(logs, axis=0).argmax())
        assert lang == net.langs[best] and score == pytest.approx(np.exp(logs).mean(axis=0)[best], abs=1e-5)


def test_pieces_are_whole():
    for run in ("a", "é" * 200, "日" * 50, "x" * 64, "x" * 65):
        pieces = language_id.pieces_of(run)
        assert b"".join(pieces).decode() == run and all(p.decode() and len(p) <= 64 for p in pieces)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(docs)
    judged = language_id.predict(docs, net, keep=("lang",)).filter(language_id.held_out(5)).filter("lang is not null and lang_pred <> 'und'").collect()
    assert len(judged) > 100 and sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.98 * len(judged)


def test_overlaps_with_substitutions(spark):
    r = random.Random(5)
    vocabulary = [f"q{k}" for k in range(4000)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(20))) for k in range(30)] + [(90, "two words"), (91, None), (92, ""), (93, "an item of exactly eight words to match"), (94, "an item of only seven words here")]
    docs = []
    for k in range(30):
        w = items[k][1].upper().split()
        for at in r.sample(range(20), 2):
            w[at] = "zzz"
        docs.append((k, ", ".join([*r.choices(vocabulary, k=30), *w, *r.choices(vocabulary, k=30)])))
    docs += [(100, " ".join(r.choices(vocabulary, k=300))), (101, None), (102, "so, Two! words here"), (103, "see: An item of EXACTLY eight words, to match."), (104, "an item of only seven words here")]
    docs += [(None, docs[0][1]), (200, docs[1][1]), (200, docs[1][1]), (200, docs[100 % 30][1]), (300, " ".join(r.choices(vocabulary, k=60_000)) + " " + items[3][1])]
    d, b = spark.createDataFrame([(*x, 1, "k") for x in docs], "doc_id long, text string, _doc_id int, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(k, k) for k in range(30)] + [(103, 93), (None, 0), (200, 1), (200, 1), (200, 10), (300, 3)], key=str)
    assert sorted(((x["doc_id"], x["item_id"]) for x in decontaminate.overlaps(d, b).collect()), key=str) == want
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns and {x["doc_id"] for x in left.collect()} == {100, 101, 102, 104}
    assert decontaminate.overlaps(d, b.limit(0)).count() == 0 and decontaminate.clean(d, b.limit(0)).count() == len(docs)
    assert decontaminate.overlaps(d.limit(0), b).count() == 0


def test_overlaps_equal_all_alignments(spark):
    """Every text against every item on every diagonal, without seeds."""
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([8, 10, 14, 25])))) for k in range(25)]
    docs = []
    for k in range(60):
        w = r.choices(vocabulary, k=40)
        own = items[r.randrange(25)][1].split()
        for _ in range(r.randrange(4)):
            own[r.randrange(len(own))] = "other"
        w[10:10] = own[r.randrange(4) :]
        docs.append((k, " ".join(w)))
    hashed, want = decontaminate.Words(), set()
    for i, text in docs:
        for j, item in items:
            w, own = hashed(text), hashed(item)
            best = decontaminate.verified(w, own, list(range(-len(own) + 1, len(w))))
            if best is not None and best[0] >= 13:  # what the masks promise
                want.add((i, j))
            elif best is not None and best[0] == best[1] >= 8:
                want.add((i, j))
    found = {(x["doc_id"], x["item_id"]): x for x in decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want and {k for k in want if k not in found} == set()
    for (i, j), x in found.items():
        w, own = hashed(docs[i][1]), hashed(items[j][1])
        assert decontaminate.verified(w, own, list(range(-len(own) + 1, len(w))))[0] >= x["n_matched"]


def test_the_bitmap_loses_no_seed(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_WORDS", 64)
    seeds = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    bitmap, shift = decontaminate._bitmap(spark.createDataFrame([(int(x),) for x in seeds], "seed long"))
    assert len(bitmap) == 64 and len(decontaminate.passes(seeds.view(np.uint64), bitmap, shift)) == 5000


def test_masks_find_every_short_run():
    from itertools import combinations

    for n, k in ((13, 2), (15, 3)):
        for gone in combinations(range(n), k):
            assert any(all(s + p not in gone for p, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for s in range(n - len(m) + 1))


def _loads(got):
    size, slots, of = {}, {}, {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        of.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())  # equal texts stay together
    return size


def test_shards(spark):
    r = random.Random(3)
    rows = [(i, f"{i} " + "x" * r.randrange(60), ("en", "de", None)[i % 3]) for i in range(1500)] + [(900 + i, "same text", "en") for i in range(40)] + [(7, None, "en"), (None, "y", "de"), (None, "y", "de")]
    df = spark.createDataFrame([(*x, 1, 2, "crc") for x in rows], "doc_id long, text string, lang string, shard int, id int, w string")
    got = sharding.shard(df, shards=8).collect()
    size = _loads(got)
    assert sorted(zlib.crc32((t or "").encode()) for _, t, _ in rows) == sorted(x["text_crc32"] for x in got)
    assert sum(size.values()) == sum(len(t or "") + 16 for _, t, _ in rows)
    largest = 40 * (len("same text") + 16)
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= largest
    counts = {}
    for x in sharding.shard(df, shards=5, law="rows").collect():
        counts[x["shard"]] = counts.get(x["shard"], 0) + 1
    assert sorted(counts) == list(range(5)) and max(counts.values()) - min(counts.values()) <= 40
    assert len(_loads(sharding.shard(df, target_bytes=10_000).collect())) == -(-sum(size.values()) // 10_000)
    assert sharding.shard(df.limit(0), shards=4).count() == 0
    assert sharding.shard(df.limit(1), shards=4).count() == 1


def test_a_group_larger_than_a_shard(spark):
    """It gets a shard of its own, and the others stay near equal."""
    rows = [(i, f"text number {i:05d}") for i in range(700)] + [(1000 + i, "copies of this text") for i in range(300)]
    size = _loads(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect())
    mean = (max(size.values()), sorted(size.values())[:-1])
    assert mean[0] >= 300 * 35 and max(mean[1]) - min(mean[1]) <= 0.4 * max(mean[1])


def test_rules(spark):
    prose = " ".join(f"word{k % 97} tail{k % 89}" for k in range(60))
    rows = [(i, prose + f" more{i}", "en", "s") for i in range(60)] + [(100, "a b", "en", "s"), (101, None, None, None), (102, " ".join(["w###"] * 3 + [f"u{k}$$" for k in range(40)]), "en", "s"), (103, "one two three four five six " * 30, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in (100, 101, 102, 103))
    assert got[103]["n_repeat_words"] == 180 and got[100]["base_failed"] and not got[102]["base_failed"]
    assert sorted(r["doc_id"] for r in quality_rules.keep_good(df).collect()) == list(range(60))


def test_fences_follow_the_groups(spark):
    """Groups get fences of their own, every rule rejects some row that passes the base rule, and SQL agrees."""
    import duckdb

    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(900):
        lang, source = ("en", "de", None)[i % 3], ("s", "t", None, "rare")[min(3, r.randrange(60) if i % 50 == 0 else r.randrange(3))]
        long = 5 if lang == "en" else 8
        lines = [" ".join(word(max(1, long + r.randrange(-2, 3))) for _ in range(9)) for _ in range(r.randrange(6, 14))]
        if i % 131 == 0:
            lines = [x for line in lines for x in (line, "same")]
        if i % 89 == 0:
            lines = [" ".join(w * 3 for w in x.split()) for x in lines]
        if i % 83 == 0:
            lines = [x.replace(" ", " ## ") for x in lines]
        if i % 151 == 0:
            k = lines[0].split()
            lines.append(" ".join(k[:6]))
        if source == "t":
            lines += [lines[-1]] * (i % 2)
        rows.append((i, "\n".join(lines), lang, source, "x"))
    rows += [(None, None, None, None, "x"), (5, "", "en", "s", "x"), (5, "", "en", "s", "x"), (7, "long words " * 50_000, "en", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, q_n_words string")
    judged = quality_rules.judge(df).cache()
    fences = judged.select("lang", "source", *[f"{x}_high" for x in quality_rules.RULES], "word_len_low").distinct().collect()
    assert len({f["word_len_high"] for f in fences}) > 3 and len({f["dup_lines_high"] for f in fences}) > 1
    passed = [x for x in judged.collect() if not x["base_failed"]]
    over = {x: 0 for x in quality_rules.RULES}
    for x in passed:
        for rule, (top, bottom, scale, _, _) in quality_rules.RULES.items():
            over[rule] += x[top] * scale // max(1, x[bottom]) > 1.01 * x[f"{rule}_high"]
    assert all(over.values()), over
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == judged.filter("kept").count()
    assert quality_rules.judge(df.limit(0)).count() == 0 and quality_rules.keep_good(df.limit(0)).count() == 0
    documents = df.drop("q_n_words").toPandas()  # noqa: F841  read by the SQL
    want = duckdb.sql(quality_rules.ORACLE).fetchall()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    same = lambda v: None if v != v else v
    assert sorted((tuple(same(v) for v in x) for x in want), key=str) == sorted((tuple(x) for x in judged.select(*names).collect()), key=str)


def test_labellers_are_told_apart():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.3
    votes = np.stack([np.where(r.random(4000) < a, truth, ~truth) for a in (0.9, 0.8, 0.6, 0.75)], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, theta, prior = quality_model.estimate(patterns, counts.astype(float), np.array([0.8] * 4))
    assert prior == pytest.approx(0.3, abs=0.05)
    assert [theta[j, 1, 1] for j in range(4)] == pytest.approx([0.9, 0.8, 0.6, 0.75], abs=0.06)


def test_posterior_equals_bayes_by_hand():
    """One more round over what estimate() returns, pattern by pattern, changes nothing."""
    r = np.random.default_rng(4)
    truth = r.random(3000) < 0.4
    votes = np.stack([np.where(r.random(3000) < 0.2, 2, np.where(r.random(3000) < a, truth, ~truth)) for a in (0.85, 0.75, 0.7)], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, theta, prior = quality_model.estimate(patterns, counts.astype(float), np.array([0.8] * 3), 2000)
    for p, got in zip(patterns, post, strict=True):
        of = [np.prod([theta[j, c, v] for j, v in enumerate(p)]) * (prior if c else 1 - prior) for c in (0, 1)]
        assert got == pytest.approx(of[1] / sum(of), abs=1e-4)


def test_scorer_equals_plain_steps():
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 50, 8)) for _ in range(200)]
    target = r.random(200)
    z, n = np.zeros(50), np.zeros(50)
    weight = lambda i: 0.0 if abs(z[i]) <= 0.5 else -(z[i] - np.sign(z[i]) * 0.5) / ((1 + n[i] ** 0.5) / 0.3 + 1)
    for _ in range(2):
        for f, y in zip(rows, target, strict=True):
            w = {i: weight(i) for i in f}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in f:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3 * w[i]
                n[i] += g * g
    got = quality_model.Linear().fit(rows, target, 2).weights()[:50]
    assert got == pytest.approx([weight(i) for i in range(50)], abs=1e-9) and np.abs(got).max() > 0


def test_hashed_parts_follow_the_parts():
    """Equal parts hash alike, other parts do not, and lexicon words are found by their hashes."""
    words = ["", "abc", "abcd", "abcde", "abcdef", "abcdefgh", "abcdxx", "öäüß", "x" * 40, "x" * 39 + "y", "日本語テキスト"]
    hashes, of = quality_model.hash_parts(words), {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        parts = quality_model._parts(w) if w else ()
        assert sum(x != 0 for x in h) == len(parts)
        for part, x in zip(parts, h, strict=False):
            assert of.setdefault(part, x) == x
    assert len(set(of.values())) == len(of)
    lexicon = frozenset(["abcd", "öäüß$", "x" * 40 + "$"])
    tokens = quality_model.Tokens((lexicon, frozenset()))
    (rows,) = tokens.rows(["abcdefgh öäüß! " + "x" * 40 + " abc " + "x" * 39 + "y"])
    assert tokens.flags[rows, 3].tolist() == [True, True, True, False, False] and not tokens.flags[:, 4].any()


def test_cuts_tell_bad_from_good():
    r = np.random.default_rng(6)
    good = np.concatenate([np.ones(2000, bool), np.zeros(200, bool)])
    shares = np.stack([np.where(good, r.random(2200) * 0.1, 0.5 + r.random(2200) * 0.5), r.random(2200)], axis=1)
    (first, second), clean = quality_model.best_cuts(shares, good)
    assert 0.1 < first < 0.6 and clean[0] < 0.2 and second > 0.95
    assert quality_model.best_cuts(shares[:0], good[:0]) == quality_model.CUTS


def test_quality_model(spark):
    r = random.Random(6)
    clean = [(i, " ".join(r.choice(["river", "stone", "cloud", "field", "walks", "slowly", "under"]) + str(r.randint(0, 9)) for _ in range(60))) for i in range(150)]
    toxic = [(200 + i, t + " zorgish blathering nitwits zorgish") for i, (_, t) in enumerate(clean[:50])]
    junk = [(300 + i, " ".join("x" * r.randint(1, 5) + "%%%" for _ in range(40))) for i in range(40)]
    odd = [(999, None), (None, clean[0][1]), (998, ""), (5, clean[5][1]), (997, clean[1][1] * 500)]
    docs = spark.createDataFrame([(*x, 1, "f") for x in [*clean, *toxic, *junk, *odd]], "doc_id long, text string, quality int, features string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean[::2]] + [(i, 1, 1) for i, _ in toxic[::2]] + [(i, 0, 0) for i, _ in junk[::2]] + [(None, 0, 1), (1, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.score(docs, labels).collect()
    got = {x["doc_id"]: x for x in rows}
    assert len(rows) == docs.count()
    assert all(got[i]["kept"] for i, _ in clean) and got[None]["kept"] and got[997]["kept"]
    assert not any(got[i]["kept"] for i, _ in toxic + junk) and not got[999]["kept"] and not got[998]["kept"]
    alone = {x["doc_id"]: x["quality_score"] for x in quality_model.score(docs, labels.limit(0)).collect()}
    assert min(alone[i] for i, _ in clean) > max(alone[i] for i, _ in junk)
    assert quality_model.score(docs.limit(0), labels).count() == 0


def test_texts_that_repeat_an_id_are_learnt_from_as_their_own(spark, monkeypatch):
    sizes = {"fit": [], "cuts": []}
    fit, cuts = quality_model.Linear.fit, quality_model.best_cuts
    monkeypatch.setattr(quality_model.Linear, "fit", lambda self, rows, target, *a: (sizes["fit"].append(len(rows)), fit(self, rows, target, *a))[1])
    monkeypatch.setattr(quality_model, "best_cuts", lambda shares, good: (sizes["cuts"].append(len(good)), cuts(shares, good))[1])
    r = random.Random(29)
    text = lambda k: " ".join(r.choice(["river", "stone", "cloud"]) + str(k) for _ in range(20))
    rows = [(i % 12, text(i)) for i in range(60)] + [(i % 12, " ".join(["%%%", "x#"] * 15) + f" {i}") for i in range(60)] + [(3, None), (None, "a b c d")]
    rows += rows[:30]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    scored = []
    for order in (rows, rows[::-1]):
        out = quality_model.score(spark.createDataFrame(order, "doc_id long, text string").repartition(3), labels, sample=50).collect()
        scored.append(sorted((x["doc_id"] or -1, x["quality_score"], x["toxic_score"]) for x in out))
    assert scored[0] == scored[1] and len(scored[0]) == len(rows)
    assert set(sizes["fit"]) == {50} and set(sizes["cuts"]) == {50}


def test_held_out_labels(spark):
    """Labels of a quarter of the documents are kept back."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    told = labels.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 0")
    judged = quality_model.score(docs, told).join(labels.join(told, "doc_id", "left_anti"), "doc_id").collect()
    right = sum((r["quality_score"] >= 0.5) == (r["quality"] == 1) for r in judged)
    toxic = [r["toxic"] == 1 for r in judged if r["toxic_score"] >= 0.5]
    assert len(judged) > 60 and right >= 0.95 * len(judged) and sum(toxic) >= 0.9 * len(toxic) > 0


def _through(spark, docs, folder):
    import corpus_pipeline

    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out.append(docs)
    return out


def test_pipeline(spark):
    import corpus_pipeline

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert 0 < len(final) < len(texts)
    assert all(hashlib.sha256(texts[i].encode()).hexdigest() == r["decoded_sha256"] for i, r in final.items())


def test_pipeline_with_odd_rows(spark):
    """Null and repeated ids, null columns, a long text, and an empty table."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    r = random.Random(1)
    pool = [w for x in rows.filter("lang = 'en' and n_chars < 3000").collect() for w in x["text"].split() if w.isalpha() and len(w) in (4, 5, 6)]
    prose = lambda n: " ".join(r.choices(pool, k=n))
    one, two, three = prose(80), prose(90), prose(4000)
    odd = [(None, one, "en", "src1", 1), (None, one, "en", "src1", 1), (1, two, "en", None, 1), (1, prose(85), None, None, None), (2, two, "en", "src1", 1), (3, None, None, None, None), (4, three, "en", "src2", 1)]
    docs = rows.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")).withColumn("key", F.lit("k"))
    *kept, last = _through(spark, docs, folder)
    assert all(x.columns == docs.columns for x in kept)
    texts = [x["text"] for x in kept[2].collect()]
    assert texts.count(one) == texts.count(two) == texts.count(three) == 1
    assert last.count() == kept[-1].count()
    assert [f(spark, docs.limit(0), folder).count() for _, f in corpus_pipeline.STAGES] == [0] * 5


def test_a_passage_of_many_texts_and_items_is_one_hit_a_text(spark):
    rng = np.random.default_rng(17)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    passage, phrase = words(20), words(9)
    items = [(i, f"{words(15)} {passage} {words(i % 7)}") for i in range(40)] + [(100 + i, f"{phrase} {words(30)}") for i in range(40)]
    items.append((200, f"{words(12)} {passage} {items[50][1]}"))
    docs = [(i, f"{words(30 + i)} {passage} {words(20)}") for i in range(50)] + [(100 + i, f"{words(20)} {phrase} {words(30)}") for i in range(50)]
    docs.append((200, f"{words(10)} {items[60][1]} {words(5)}"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.Hits(d, b.select(F.col("item_id").alias("doc_id"), "text"))
    on_text = {r["_doc_id"]: r["n"] for r in hits.shared.groupBy("_doc_id").agg(F.count("*").alias("n")).collect()}
    assert max(n for i, n in on_text.items() if i < 100) == 1
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(d, b).collect()}
    shared = [i for i, t in items if passage in t]
    assert found == {(i, k) for i in range(50) for k in shared} | {(200, items[60][0])}
    assert {r["doc_id"] for r in decontaminate.clean(d, b).collect()} == set(range(100, 150))
