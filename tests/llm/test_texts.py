"""Pages, urls, rules, classifiers, tokens and packing."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

from . import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from terrachron.llm import html_extract, packing, piece_codec, quality_model, quality_rules, spans, toxicity, url_filters

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PAGE = (
    "<html><head><title>T &amp; x</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    "<header>Site</header><nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy <p>now</p></div>"
    "<div class='cookie-notice'>We use</div><article><h1>Head&nbsp;line</h1><p><b>First   one.<br><p>Second &lt;one&gt; &amp; more"
    "<div class='newsletter'><form>Mail</form></div><p>Third.</p><ul><li>a<li>b</ul></article>"
    "<aside>Side</aside><section class='comments'><p>Reader says</p></section><footer>&copy; x</footer>"
)


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain\n  text", "plain text"),
        (PAGE, "Head line\nFirst one.\nSecond <one> & more\nThird.\na\nb"),
        ("<article><p>x</article><p cla", "x"),
        ("<main><h1>A</h1><!-- c --><p>b</p></main><p>other</p>", "A\nb"),
        ("<nav>only menu</nav>", ""),
        ("<body class='has-sidebar'><form><nav>n</nav>x<main class='search'><p>a</p><form>f</form></main></form>", "a"),
        ("<article><p>a</p><div class='comments'><article><p>c</p></article></div></article>", "a"),
        ("<div id=sidebar>s</div><h2>T</h2><p>A long paragraph of the page, with enough words.</p><p>s</p><footer>f</footer>", "T\nA long paragraph of the page, with enough words.\ns"),
        ("<article>" + "<p>word " * 2000 + "</article>", "\n".join(["word"] * 2000)),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_extract_pages(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 0), (1, 51), (1, 51)]
    assert html_extract.extract_main_text(pages.limit(0)).collect() == []


def test_thresholds_part_two_clusters():
    ratios = np.array([1.0, 2, 1, 30, 40, 35, 2])
    assert 2 < html_extract.threshold(ratios) < 30
    assert np.allclose(html_extract.smoothed(np.full(5, 3.0)), 3.0)


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups() if rest is not None else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[1] if best else "allow"


def test_judge_urls(spark):
    rng = random.Random(1)
    urls = [None, "", "x.org/", "http://", "http://ORG/", "http://a.example.org/es/x?q", "http://example.org/en/12#f", "http://xorg/", "https://b.c.com/de/", "http://com/fr", "http://c.com/fr/://d.org/", "http://..org/a", "http://É.org/"]
    urls += ["http://" + "".join(rng.choice(["org", "com", "example", ".", "/", "es", "de", "fr", "en/1", "?", "#"]) for _ in range(8)) for _ in range(300)]
    rows = [(i, u, "b") for i, u in enumerate([*urls, urls[5]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, best string")
    got = url_filters.judge_urls(pages, url_filters.RULES)
    assert got.columns == ["page_id", "url", "best", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert tuple(r)[3:] == plain_verdict(r.url, url_filters.RULES)
    assert got.count() == len(rows) and url_filters.judge_urls(pages.limit(0), url_filters.RULES).collect() == []
    with pytest.raises(ValueError):
        url_filters.judge_urls(pages, [("deny", "a", "/")])


TEXTS = ["", None, "\n\n a", "a b c d e a b c d e", "x\nx\n\nx ", "é ü $%  x", "one", "a " * 5000, " a\tb\x0bc ", "x\n" * 40]


def test_base_features():
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["a", "b", "é#", "\n", "c|d"]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    for limit in (1, 300, 1 << 20):
        got = []
        for block in spans.blocks(pa.array(texts), limit):
            found = quality_rules.features_of(block)
            got += list(zip(*[found[f].tolist() for f in quality_rules.FEATURES]))
        assert got == [brute.features(t) for t in texts]


def test_quality_rules(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    good = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, good(rng.randint(30, 200)), "en", "s0" if i % 2 else None) for i in range(200)]
    rows += [(500, " ".join(w + "$$" for w in good(60).split()), "en", "s0"), (501, good(5), "en", "s0"), (None, None, None, None), (502, good(50), "xx", "new")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.id: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    assert not got[500].kept and not got[500].base_failed
    assert got[501].base_failed and got[None].base_failed and not got[None].kept
    assert all(got[i].kept for i in [*range(200), 502])
    assert quality_rules.quality_rules(docs.limit(0)).collect() == []


def test_segments_are_maximal():
    """Each segment beats all of its prefixes and suffixes, and the best one is among them."""
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 40)
        at = sorted(rng.sample(range(n), rng.randint(0, min(n, 8))))
        odds = [rng.uniform(0.3, 4) for _ in at]
        score = [-1.0] * n
        for i, o in zip(at, odds):
            score[i] += o
        found = toxicity.segments(at, odds, 1.0)
        for a, b, s in found:
            assert abs(sum(score[a:b]) - s) < 1e-9
            assert all(sum(score[a:k]) > -1e-9 and sum(score[k:b]) > -1e-9 for k in range(a, b))
        best = max((sum(score[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        if best > 0:
            assert abs(max(s for _, _, s in found) - best) < 1e-9


def labelled(spark, label, bad):
    rng = random.Random(6)
    words = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "lmnr" for d in "aeo"]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        hit = i % 5 == 0
        docs.append((i, " ".join(bad(rng, text) if hit else text)))
        labels.append((i, int(hit) if label == "toxic" else int(not hit)))
    docs += [(None, None), (9000, ""), (9001, "a"), (3, docs[3][1])]
    labels += [(None, 1), (9100, 1), (5, None), (3, labels[3][1])]
    return spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double"), spark.createDataFrame(labels, f"doc_id long, {label} int"), docs


def checked(scored, labels, label, held):
    found = {r["doc_id"]: r["score"] for r in scored.collect()}
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r[label] is not None}
    unseen = [i for i in truth if i in found and i is not None and zlib.crc32(str(i).encode()) % held[0] == held[1]]
    assert len(unseen) > 50 and all(0 <= s <= 1 for s in found.values())
    return np.mean([(found[i] >= 0.3) == truth[i] for i in unseen])


def test_toxicity(spark):
    slurs = ["zzork", "quxxa", "vlimp!", "Grubb,"]
    docs, labels, rows = labelled(spark, "toxic", lambda rng, t: [w for x in t for w in ([x, rng.choice(slurs)] if rng.random() < 0.1 else [x])] + ["zzork"])
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_toxicity(docs, model)
    assert scored.count() == len(rows)
    assert checked(scored, labels, "toxic", (4, 2)) > 0.98
    passages = {r["doc_id"]: r["passages"] for r in scored.collect()}
    text = dict(rows)[5].encode()
    assert any(text[p.first_byte : p.end_byte].lower().rstrip(b"!,") in (b"zzork", b"quxxa", b"vlimp", b"grubb") or b"zzork" in text[p.first_byte : p.end_byte] for p in passages[5])
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 400 < kept.count() < 520
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []


def test_quality_model(spark):
    docs, labels, rows = labelled(spark, "quality", lambda rng, t: [w.upper() + "!!" for w in t])
    model = quality_model.fit(docs, labels)
    scored = quality_model.score_quality(docs, model)
    assert scored.count() == len(rows)
    assert checked(scored, labels, "quality", (5, 0)) > 0.98
    again = quality_model.score_quality(docs, quality_model.fit(docs, labels))
    assert sorted(map(str, again.collect())) == sorted(map(str, scored.collect()))
    one = quality_model.fit(docs, labels.where("quality = 1"))
    assert len({r["score"] for r in quality_model.score_quality(docs, one).collect()}) == 1
    assert quality_model.score_quality(docs.limit(0), model).collect() == []


def test_features_of_a_text_do_not_depend_on_its_block():
    texts = TEXTS + ["日本語 text", "ab"]
    alone = [quality_model.Model(np.arange(1 << quality_model.BUCKET_BITS, dtype=np.float32) % 97, 0.1).scores(b) for b in spans.blocks(pa.array(texts), 1)]
    whole = [quality_model.Model(np.arange(1 << quality_model.BUCKET_BITS, dtype=np.float32) % 97, 0.1).scores(b) for b in spans.blocks(pa.array(texts))]
    assert np.allclose(np.concatenate(alone), np.concatenate(whole))


LETTERS = list("abethinosr  ▁\n\t.,;()\r{}0123éß日本の語😀\x00²½   　<>x='-_\x1c\x85")
WORDS = ["the", "▁", "  ", "hello", "\r\n", "();", "日本", "ааа", "привет", "    ", "it's", "'ll", " \n", "\n ", "<|endoftext|>", "<s>", "<0x41>", "𝒳", "ⅷ", "²."]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(rng.randint(0, 24))) + " " * rng.choice([0, 0, 0, 1, 40]) for _ in range(n)]


def test_piece_codec_equals_the_library():
    import sentencepiece

    codec, library = piece_codec.Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in [*odd_texts(4000, 1), "a" * 5000, "word" * 900]:
        ids = library.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 258), 28705, 259, 264]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids)


def test_pairs_fit_only_when_merging_leaves_them():
    pieces = piece_codec.Pieces(PIECES)

    def merged(text):
        parts = list(text)
        while True:
            options = [(pieces.rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in pieces.rank]
            if not options:
                return parts
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(8)
    short = [p for p in pieces.split if len(p) <= 5 and p.isascii()]
    for _ in range(4000):
        x, y = rng.choice(short), rng.choice(short)
        assert pieces.compatible(x, y) == (merged(x + y) == [x, y])


def test_encode_documents(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [None, "", *odd_texts(100, 5)]
    docs = spark.createDataFrame([(i // 2, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = piece_codec.encode_documents(docs, PIECES).collect()
    expected = Counter((i // 2, len(x := library.encode(t or "")), ",".join(map(str, x)), library.decode(x)) for i, t in enumerate(texts))
    assert Counter(map(tuple, got)) == expected
    assert piece_codec.encode_documents(docs.limit(0), PIECES).collect() == []


def test_byte_tokens_equal_the_library():
    tokens = packing.ByteTokens(BYTES)
    texts = odd_texts(4000, 3)
    expected = [array("I", e.ids).tobytes() for e in tokens.whole.encode_batch(texts, add_special_tokens=False)]
    assert [tokens(t) for t in texts] == expected


def test_patterns_place_every_length_once():
    rng = random.Random(9)
    histogram = {rng.randint(1, 1024): rng.randint(1, 500) for _ in range(200)}
    patterns = packing.patterns_of(histogram)
    placed = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 1024 and count > 0
        for length in pattern:
            placed[length] += count
    assert placed == histogram
    total = sum(k * n for k, n in histogram.items())
    assert sum(n for _, n in patterns) * 1024 < 1.03 * total + 2048
    assert packing.patterns_of({}) == []
    with pytest.raises(ValueError):
        packing.patterns_of({2000: 1})


def test_packing(spark):
    rng = random.Random(11)
    texts = [None, "", "a b", "x y z " * 2000, *["w " * rng.randint(1, 900) for _ in range(120)]]
    docs = spark.createDataFrame([(i if i % 10 else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    got = packing.pack_documents(docs, BYTES, keep_ids=True).collect()
    tokens = packing.ByteTokens(BYTES)
    expected = Counter(len(tokens(t or "")) // 4 + 1 for t in texts)
    assert sum(r.length for r in got) == sum(n * c for n, c in expected.items())
    sequences = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(array("I", r.ids).tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    by_doc = defaultdict(list)
    for r in got:
        if r.doc_id is not None:
            by_doc[r.doc_id].append((r.start, list(r.ids)))
    for i, parts in by_doc.items():
        ids = [x for _, p in sorted(parts) for x in p]
        assert ids == [*array("I", tokens(texts[i] or "")), 0]
    assert packing.pack_documents(docs.limit(0), BYTES).collect() == []


def test_block_hashes_do_not_depend_on_place():
    texts = ["one two", "two", "x two one"]
    for limit in (1, 100):
        seen = defaultdict(set)
        for block in spans.blocks(pa.array(texts), limit):
            first, last, _ = block.words()
            for a, b, h in zip(first, last, block.hashed()(first, last)):
                seen[block.data[a:b].tobytes()].add(int(h))
        assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == 3


def test_digest_of_queries(spark, tmp_path):
    """The registered queries derive digests from what the operators return."""
    text = "Hello  wörld"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = piece_codec.op8_piece_codec(spark, str(tmp_path)).first()
    ids = ",".join(map(str, piece_codec.Codec(PIECES).encode(text)))
    assert row.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("wrap", ["<p>{}</p>", "<div><p>{}</p></div>", "<section><h2>{}</h2></section>", "<ul><li>{}</li></ul>"])
def test_an_advert_does_not_part_an_article(wrap):
    first, second, last = "Long words here " * 25, "More of the words " * 20, "Closing remark, thirty-six characters"
    body = "<h1>Title</h1>" + "".join(wrap.format(x) for x in (first, second)) + "<div class=ad>Buy now</div>" + wrap.format(last)
    page = f"<div id=top><div class=menu>Menu</div></div><div>{body}</div><div class=ad>Buy more</div><div><div>Imprint</div></div>"
    assert html_extract.main_text(page) == "\n".join(["Title", first.strip(), second.strip(), last])
    assert html_extract.main_text(body) == "\n".join(["Title", first.strip(), second.strip(), last])


LONG = "Long words here and there " * 15


@pytest.mark.parametrize(
    "part",
    [
        *(f"<{t}>gone</{t}>" for t in "script style noscript button svg iframe textarea template select canvas".split()),
        "<span class='ad'>gone</span>", "<b id=share-box>gone</b>", "<i hidden>gone</i>", "<span class='ad'>gone<br>away</span>",
    ],
)
def test_elements_dropped_inside_an_article(part):
    assert html_extract.main_text(f"<article><p>a</p>{part}<p>b</p></article>") == "a\nb"
    assert html_extract.main_text(f"<article><p>a {part} b</p></article>") == "a b"
    assert html_extract.main_text(f"<article>{part}<p>a{part}</p>{part}</article>") == "a"
    assert html_extract.main_text(f"<div><p>{LONG}</p>{part}<p>{LONG}</p><p>b</p></div>") == f"{LONG.strip()}\n{LONG.strip()}\nb"


@pytest.mark.parametrize("name", ["social-history", "notice-board", "search-results", "form_of_address", "widgets-and-gears"])
@pytest.mark.parametrize("tag", ["div", "p", "section"])
def test_a_name_that_only_holds_a_mark_is_left_to_the_ratios(name, tag):
    inner = LONG if tag == "p" else f"<p>{LONG}</p>"
    links = "".join(f"<li><a href=/{i}>Go {i}</a></li>" for i in range(6))
    for around in ("article", "div"):
        page = f"<{around}><p>{LONG}</p><{tag} class='{name}'>{inner}</{tag}><p>{LONG}</p></{around}>"
        assert html_extract.main_text(page) == "\n".join([LONG.strip()] * 3)
        page = f"<{around}><p>{LONG}</p><div class='{name}'><ul>{links}</ul></div><p>{LONG}</p></{around}>"
        assert html_extract.main_text(page) == "\n".join([LONG.strip()] * 2)


def test_ratios_decide_on_lists_of_links():
    """Neither an article nor a telling name; items of the text itself stay, as does a lone link."""
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Place {i}</a></li>" for i in range(5)) + "</ul>"
    items = "<ul><li>first thing</li><li>second <a href=x>thing</a></li></ul><p><a href=y>one link</a></p>"
    want = "\n".join([LONG.strip(), "first thing", "second thing", "one link", LONG.strip()])
    for around in ("article", "div"):
        assert html_extract.main_text(f"<{around}><p>{LONG}</p>{items}<p>{LONG}</p>{menu}</{around}>") == want
    assert html_extract.main_text(f"<article>{menu}</article>") == "\n".join(f"Place {i}" for i in range(5))


def test_documents_are_decoded_from_their_ids():
    """Random ids, byte pieces that form no character among them, decode as the library does it."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coder, rng = piece_codec.Codec(PIECES), random.Random(11)
    size, odd = library.get_piece_size(), list(coder.pieces.byte.values()) + [coder.pieces.unknown]
    for k in range(400):
        pool = odd if k % 2 else range(size)
        ids = [rng.choice(pool) if rng.random() < 0.5 else rng.randrange(size) for _ in range(rng.randint(0, 12))]
        ids = [i for i in ids if not library.is_control(i)]
        cut = rng.randint(0, len(ids))
        parts = [",".join(map(str, part)) for part in (ids[:cut], ids[cut:]) if part]
        assert coder.decode_decimals(parts) == library.decode(ids) == coder.decode(ids), ids
    for text in ["", " ", "   a", "a  b   ", "▁▁x", "日本 語\n\tz", " \U0001f600é", "a" * 300]:
        assert coder.decode_decimals([str(i) for i in library.encode(text)]) == library.decode(library.encode(text))


def test_each_limit_rejects_a_planted_outlier(spark):
    """One outlier per statistic and source; the same text is sound where a source is like that."""
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bcdfghjklmnpqrstvwxz" for b in "aeiou" for c in "lmnrst"]

    def text(symbols=0.0, dup=0, repeat=0, tail=""):
        lines = [[rng.choice(words) + tail for _ in range(10)] for _ in range(10)]
        lines = [[w + "#" if rng.random() < symbols else w for w in line] for line in lines]
        lines += [["same", "line"]] * (dup + 1) if dup else []
        lines += [lines[0][:repeat]] if repeat else []
        return "\n".join(" ".join(line) for line in lines)

    rows = [(i, text(symbols=0.1 if i % 2 else 0.0), "en", f"s{i % 2}") for i in range(1200)]
    planted = {
        "symbols": text(symbols=0.9), "dup_lines": text(dup=7), "repeats": text(repeat=8), "word_length": text(tail="y" * 12),
    }
    for k, name in enumerate(planted):
        rows += [(2000 + 2 * k + s, planted[name], "en", f"s{s}") for s in range(2)]
    rows += [(3000 + s, text(symbols=0.1), "en", f"s{s}") for s in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in quality_rules.quality_rules(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not any(got[i].kept for i in range(2000, 2008))
    assert not got[3000].kept and got[3001].kept
    assert sum(not got[i].kept for i in range(1200)) <= 24  # the far end of 600 noisy texts at most
