import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from babelscore.llm import html_text, langid, quality_crf, quality_rules, subword
from tests.llm.helpers import edge_rows, empty, frame, words_of
from tests.llm.layouts import LAYOUTS

SF = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_language_held_out_accuracy(spark):
    docs = read(spark, "documents")
    found = langid.identify(docs, langid.train(docs)).filter(langid.held_out("doc_id")).select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97 and len(found) > 200


def test_language_edges(spark):
    docs = frame(spark, edge_rows())
    out = langid.identify(docs, langid.train(read(spark, "documents")))
    assert out.columns == [c for c in docs.columns if c not in ("lang_pred", "lang_score")] + ["lang_pred", "lang_score"]
    rows = out.collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["lang_score"] <= 1
    # Nothing to learn from.
    assert {r["lang_pred"] for r in langid.identify(frame(spark, edge_rows()), langid.train(empty(spark))).collect()} == {"und"}
    with pytest.raises(ValueError, match="max_languages"):
        langid.train(frame(spark, edge_rows() * 3), max_languages=1)


def test_grams_stay_in_their_document():
    texts = ["abc déf", "", None, "x"]
    together = langid.grams(texts)[0]
    for i, t in enumerate(texts):
        for (both, owner), (alone, _) in zip(together, langid.grams([t])[0], strict=True):
            assert both[owner == i].tolist() == alone.tolist()


def test_quality_held_out_accuracy(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    scored = quality_crf.score(docs, quality_crf.train(docs, labels)).join(labels, "doc_id")
    rows = scored.filter(langid.held_out("doc_id")).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95 and len(rows) > 80


def test_lines_of_a_document_in_two_halves(spark):
    """A held-out label-1 and a label-0 document after one another: nine in ten lines are told apart,
    and documents are still classified."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = quality_crf.train(docs, labels)
    rows = docs.select("doc_id", "text").join(labels, "doc_id").filter(langid.held_out("doc_id")).orderBy("doc_id").collect()
    scores = quality_crf.score_column(pa.array([r["text"] for r in rows]), model)
    assert np.mean((scores >= quality_crf.LIKELY) == [r["quality"] == 1 for r in rows]) > 0.95
    good, bad = ([r["text"] for r in rows if r["quality"] == q and r["text"].count("\n") > 1] for q in (1, 0))
    right, changes = [], 0
    for i, (g, b) in enumerate(zip(good, bad * 4)):
        halves = [(g, True), (b, False)][::1 if i % 2 else -1]
        truth = [y for t, y in halves for line in t.split("\n") if line.split()]
        got = quality_crf.line_labels(pa.array(["\n".join(t for t, _ in halves)]), model)[0] >= 0.5
        right += (got == truth).tolist()
        changes += got.any() and not got.all()
    assert np.mean(right) > 0.9 and changes > 0.8 * min(len(good), 4 * len(bad))


@pytest.mark.parametrize("together", [1, 2])
def test_expected_labels_reach_the_documents_shares(together):
    """Exactly for documents alone; two in one sequence pull at each other, and come close."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 9, 40)
    first = np.concatenate([[0], np.cumsum(sizes.reshape(-1, together).sum(axis=1))])
    part, label = np.repeat(np.arange(40), sizes), rng.integers(0, 2, 40)
    x, weight = rng.normal(size=(len(part), 3)), rng.uniform(1, 50, len(part))
    p, pairs = quality_crf.expected_labels(np.concatenate([rng.normal(size=3), [1, -1, -1, 1]]), x, first, part, label, weight)
    share = np.bincount(part, weights=p * weight) / np.bincount(part, weights=weight)
    over = np.where(label == 1, quality_crf.GOOD_SHARE - share, share - 1 + quality_crf.BAD_SHARE)
    assert (over < 0.01).all() if together == 1 else np.maximum(over, 0).mean() < 0.05
    assert abs(pairs.sum() - (len(part) - len(first) + 1)) < 1e-6


def test_quality_edges(spark):
    model = quality_crf.train(frame(spark, edge_rows()), empty(spark, "doc_id long, quality int"))
    rows = quality_crf.score(frame(spark, edge_rows()), model).collect()
    assert len(rows) == len(edge_rows()) and all(abs(r["score"] - 0.5) < 1e-9 for r in rows)
    assert quality_crf.score(empty(spark), model).count() == 0


def test_chain_equals_enumeration():
    rng = np.random.default_rng(1)
    emission, turn = rng.normal(size=9), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5, 9])
    p, pairs, z = quality_crf.chain(emission, turn, first)
    want_p, want_pairs, want_z = np.zeros(9), np.zeros((2, 2)), 0.0
    for s, e in zip(first, first[1:]):
        n = e - s
        paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        w = np.exp([sum(emission[s + i] * y for i, y in enumerate(path)) + sum(turn[a, b] for a, b in zip(path, path[1:])) for path in paths])
        want_z += np.log(w.sum())
        for path, x in zip(paths, w / w.sum()):
            want_p[s:e] += x * np.array(path)
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += x
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs) and np.isclose(z, want_z)


def test_rule_counts_equal_plain_counts():
    texts = [r[1] for r in edge_rows()] + ["a b c a b c\nx\nx\n \n x\n# $ <tag>", "é é é é"]
    got = quality_rules.text_counts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        w = words_of(t)
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 500 else None
        assert got["n_words"][i] == len(w) and got["word_chars"][i] == sum(map(len, w))
        assert got["n_symbols"][i] == sum(c in "#*$%&|<>" for c in t or "")
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines)) and got["n_lines"][i] == len(lines)
        if hit is not None:
            assert got["n_repeat_words"][i] == len(hit)


def test_rules_edges(spark):
    rows = quality_rules.judge(frame(spark, edge_rows())).collect()
    assert len(rows) == len(edge_rows())
    assert all(not r["kept"] for r in rows if r["base_failed"]) and all(r["base_failed"] for r in rows if r["n_words"] < 50)
    assert any(r["kept"] for r in rows)
    assert quality_rules.judge(empty(spark)).count() == 0


def test_fences_follow_the_group(spark):
    """The same text passes where its kind is common and fails where it is not."""
    rng = random.Random(3)
    plain = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(80))
    marked = lambda: " ".join(w + "#" if rng.random() < 0.5 else w for w in plain().split())
    rows = [(i, plain(), "en", "prose", 0) for i in range(150)] + [(1000 + i, marked(), "en", "code", 0) for i in range(150)]
    rows.append((5000, marked(), "en", "prose", 0))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert not kept[5000] and all(kept[i] for i in range(150)) and all(kept[1000 + i] for i in range(150))


# -- subword ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return subword.load()


def mixed_texts():
    rng = random.Random(3)
    alphabet = "abcde the an  \n\t▁é😀ßあ中xyz.,!?0123456789"
    return ["a", " ", "  ", "", None, "hello world", "\n\n x", "ab" * 400] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(200)]


def test_without_dropout_as_sentencepiece(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=subword.MODEL)
    texts = mixed_texts()
    ids, off = subword.Codec(model, 0.0).encode(texts, range(len(texts)))
    for t, a, b in zip(texts, off, off[1:]):
        if t and "▁" not in t:
            assert ids[a:b].tolist() == sp.encode(t) and sp.decode(ids[a:b].tolist()) == t


def test_dropout_is_lossless_seeded_and_the_same_in_both_agendas(model, monkeypatch):
    texts = mixed_texts()
    got = {}
    for name, seed, long in (("lockstep", 7, 40), ("heap", 7, 2), ("again", 7, 40), ("other seed", 8, 40)):
        monkeypatch.setattr(subword, "LONG", long)
        c = subword.Codec(model, 0.2, seed)
        got[name] = c.encode(texts, range(len(texts)))
        ids, off = got[name]
        assert [c.decode(ids[a:b].tolist()) for a, b in zip(off, off[1:])] == [t or "" for t in texts]
    assert np.array_equal(got["lockstep"][0], got["heap"][0]) and np.array_equal(got["lockstep"][0], got["again"][0])
    assert not np.array_equal(got["lockstep"][0], got["other seed"][0])
    c = subword.Codec(model, 0.3, 1)
    ids, off = c.encode(["tokenization " * 200], [1])
    pieces = subword.Codec(model, 0.0).encode(["tokenization " * 200], [1])[0]
    assert len(ids) > len(pieces)  # merges were skipped


def plain_agenda(model, text, doc_id, dropout, seed):
    """The segmentation written out: of all adjacent pairs that make a piece and are not skipped, always
    the best-scored one, leftmost on ties."""
    wide = (1 << 64) - 1

    def mix(h):
        for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor & wide
        return h ^ h >> 32

    score = {p: model["scores"][i] for i, p in enumerate(model["pieces"]) if model["plain"][i]}
    number = {p: i for i, p in enumerate(model["pieces"]) if model["plain"][i]}
    spare = sorted({c for p in number for c in p} - set(number))
    number |= {c: len(model["pieces"]) + i for i, c in enumerate(spare)}
    out = []
    broken = "".join(c for c in "\n\t\r" if c not in number)
    units = re.findall(f" *[^ {broken}]+| +|[{broken}]" if broken else " *[^ ]+| +", " " + text)
    for place, unit in enumerate(units):
        key = mix(mix(mix(doc_id + seed) ^ place) + seed & wide)
        at = [(k, c.replace(" ", "▁")) for k, c in enumerate(unit)]

        def skipped(i):
            left, right = (number[s] if s in number else (1 << 21) + ord(s) for s in (at[i][1], at[i + 1][1]))
            return mix(key ^ mix(mix(at[i][0] * 0x9E3779B97F4A7C15 & wide) ^ (left << 32 | right))) < int(dropout * 2.0**64)
        while True:
            fits = [(-score[at[i][1] + at[i + 1][1]], i) for i in range(len(at) - 1) if at[i][1] + at[i + 1][1] in score and not skipped(i)]
            if not fits:
                break
            i = min(fits)[1]
            at[i:i + 2] = [(at[i][0], at[i][1] + at[i + 1][1])]
        for _, s in at:
            out += [number[s]] if s in score else [model["bytes"][b] for b in s.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_ids_of_a_plain_agenda(model, dropout):
    rng = random.Random(6)
    texts = [t for t in mixed_texts() if t and "▁" not in t][:40]
    texts += ["https://www.example.org/" + "/".join("".join(rng.choices("abcdefgh0123456789", k=9)) for _ in range(8)) + "?id=7",
              "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=300)), "tokenization and segmentation of straße"]
    c = subword.Codec(model, dropout, 9)
    ids, off = c.encode(texts, range(100, 100 + len(texts)))
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == plain_agenda(model, t, 100 + i, dropout, 9), t


def test_long_units_cost_little_more_than_words(model):
    """URLs and base64 are units of many symbols; one of them costs about as much a symbol as a word."""
    rng = random.Random(1)
    urls = "\n".join("https://www.example.org/" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz/0123456789", k=70)) for _ in range(1500))
    coded = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=140_000))
    for text in (urls, coded):
        c = subword.Codec(model, 0.1, 1)
        c.encode(["warm https://www.example.org/" + "x" * 50], [0])
        begin = time.process_time()
        ids, _ = c.encode([text], [1])
        assert time.process_time() - begin < 3 and c.decode(ids.tolist()) == text


def test_every_occurrence_draws_for_itself(model):
    texts = [" ".join(["tokenization"] * 50)] * 40 + ["https://example.org/" + "segmentation" * 4] * 40
    c = subword.Codec(model, 0.1, 1)
    ids, off = c.encode(texts, range(len(texts)))
    pieces = [tuple(ids[a:b].tolist()) for a, b in zip(off, off[1:])]
    assert len(set(pieces[:40])) == 40 and len(set(pieces[40:])) > 10
    words = {w for p in pieces[:40] for w in c.decode(p).split()}
    starts = c.encode([" ".join(["tokenization"] * 2000)], [7])[0].tolist()
    mark = " tokenization".encode()
    forms, now = set(), []
    for i in starts:
        now.append(i)
        if b"".join(c.text[x] for x in now) == mark:
            forms.add(tuple(now))
            now = []
    assert words == {"tokenization"} and not now and len(forms) > 20  # four before
    # The same ids whatever came before and however texts are cut into slices.
    parts = [subword.Codec(model, 0.1, 1).encode([t], [i])[0].tolist() for i, t in enumerate(texts)]
    assert [list(p) for p in pieces] == parts


def test_units_as_a_regular_expression_cuts_them(model):
    c = subword.Codec(model, 0.0)
    texts = [*mixed_texts(), "a\tb\r\n  c ", "\n", None, " \n ", "é  ▁ x"]
    broken = "".join(x for x in "\n\t\r" if c.broken[ord(x)])
    data, off, starts = c.unit_starts(subword.Texts(pa.array(["left out", *texts]).slice(1)))
    for k, t in enumerate(texts):
        at = [*starts[(starts >= off[k]) & (starts < off[k + 1])].tolist(), off[k + 1]]
        want = re.findall(f" *[^ {broken}]+| +|[{broken}]", " " + t) if t else []
        assert [bytes(data[a:b]).decode() for a, b in zip(at, at[1:])] == want


def test_pairs_are_found_as_in_a_dictionary(model):
    c, rng = subword.Codec(model, 0.0), np.random.default_rng(2)
    table = dict(zip(c.keys.tolist(), zip(c.ranks.tolist(), c.merged.tolist())))
    key = np.concatenate([c.keys, c.keys + 1, rng.integers(0, 1 << 43, 50_000)])
    rank, merged = c.lookup(key >> 22, key & (1 << 22) - 1)
    for k, r, m in zip(key.tolist(), rank.tolist(), merged.tolist()):
        assert (r, m) == table[k] if k in table else r == subword.NONE


def test_restores_judges_as_decoding_does(model):
    c, rng = subword.Codec(model, 0.2, 5), random.Random(8)
    texts = mixed_texts()
    ids, off = c.encode(texts, range(len(texts)))
    column = pa.array(["left out", *texts]).slice(1)
    assert c.restores(column, ids, off).all()
    piece = [i for i, x in enumerate(c.text) if len(x) > 1 and x.isascii()]
    for _ in range(20):
        other = ids.copy()
        for k in rng.sample(range(len(ids)), 10):
            other[k] = rng.choice(piece)
        want = [b"".join(c.text[i] for i in other[a:b].tolist())[1:] == (t or "").encode() for t, a, b in zip(texts, off, off[1:])]
        assert c.restores(column, other, off).tolist() == want and not all(want)


def test_trees_take_bounded_memory(model):
    """Two workers and an executor's heap share its memory; the trees of many different words stay small."""
    rng, c, most = random.Random(4), subword.Codec(model, 0.1, 1), 0
    for k in range(16):
        text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(10_000))
        ids, off = c.encode([text], [k])
        assert c.decode(ids.tolist()) == text
        held = [c.asked, c.best, c.next, c.width, c.row, c.store, c.root, *(x for pool in c.pools.values() for x in pool)]
        most = max(most, sum(x.x.nbytes for x in held))
    assert most < 120e6  # 147 MB before


def test_encode_and_decode_in_spark(spark):
    docs = frame(spark, edge_rows())
    out = subword.encode(docs, seed=3)
    rows = out.collect()
    assert len(rows) == len(edge_rows()) and all(r["lossless"] for r in rows if r["lossless"] is not None)
    assert sum(r["ids"] is None for r in rows) == sum(r[1] is None for r in edge_rows())
    back = sorted((tuple(r) for r in subword.decode(out).collect()), key=repr)
    assert back == sorted(((r[0], r[1]) for r in edge_rows()), key=repr)
    assert subword.encode(empty(spark)).count() == 0


# -- html ------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy this now</div><article><h1>Head &amp; tail</h1><p><b>First   para<br>with break<p>Second &middot; para</p>
<ul><li>item one<li>item two</ul></article><section class="comments"><div class="comment"><p>I liked this one</p></div></section>
<aside class="sidebar"><p>More stories</p></aside><form><label>Mail</label></form><div class="cookie notice">We use cookies</div>
<footer>&copy; x</footer></body></html>"""


@pytest.fixture(scope="module")
def weights(spark):
    return html_text.train(read(spark, "pages"))


def test_blocks_of_a_page():
    assert [b.text for b in html_text.blocks(PAGE)] == [
        "T", "Site", "A", "B", "Buy this now", "Head & tail", "First para with break", "Second · para", "item one", "item two",
        "I liked this one", "More stories", "Mail", "We use cookies", "© x"]


def test_pages_of_div_elements_only():
    rng = random.Random(8)
    words = "the old river town has a market where people of many trades meet each week to talk and sell".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages, bodies = [], []
    for _ in range(40):
        body = [say(rng.randint(20, 40)) for _ in range(4)]
        pages.append('<html><body><div class="menu"><div><a href="/a">Home</a></div><div><a href="/b">News</a></div></div>'
                     '<div class="text">' + "".join(f"<div>{x}</div>" for x in body) + '</div><div class="foot">Imprint</div></body></html>')
        bodies.append(body)
    found = html_text.main_texts(pa.array(pages), html_text.fit(html_text.training_pages(pages)))
    kept = [x in text for body, text in zip(bodies, found) for x in body]
    assert np.mean(kept) > 0.9 and not any("Home" in text for text in found)


def test_unseen_layout(weights):
    assert html_text.main_texts(pa.array([PAGE]), weights) == ["Head & tail\nFirst para with break\nSecond · para\nitem one\nitem two"]


def test_labels_of_unseen_pages(spark, weights):
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rows += [r["html"] for r in read(spark, "pages").collect()]
    want = ["\n".join(b.text for b in html_text.blocks(h) if html_text.weak_label(b)) for h in rows]
    assert np.mean([a == b for a, b in zip(html_text.main_texts(pa.array(rows), weights), want)]) > 0.995


def test_rebuilt_pages_held_out(spark, weights):
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages = html_text.training_pages(rows, seed=99)
    x, y = np.concatenate([p[0] for p in pages]), np.concatenate([p[1] for p in pages])
    first = np.concatenate([[0], np.cumsum([len(p[0]) for p in pages])])
    assert np.mean((html_text.label(weights, x, first) >= 0.5) == y) > 0.98


def test_gradients(monkeypatch):
    """Backward pass against finite differences."""
    rng = np.random.default_rng(0)
    z, wh = rng.normal(size=(7, 4 * html_text.HIDDEN)), rng.normal(size=(html_text.HIDDEN, 4 * html_text.HIDDEN)) * 0.3
    start, size = np.array([0, 4]), np.array([4, 3])
    aim = rng.normal(size=(7, html_text.HIDDEN))
    for back in (False, True):
        ran = html_text.run_direction(z, wh, start, size, back)
        dz, dw = html_text.back_direction(aim, *ran, wh, start, size, back)
        for grad, value in ((dz, z), (dw, wh)):
            for at in ((0, 3), (2, 40), (6, 20)):
                old, got = value[at], []
                for step in (1e-5, -1e-5):
                    value[at] = old + step
                    got.append((html_text.run_direction(z, wh, start, size, back)[0] * aim).sum())
                value[at] = old
                assert np.isclose((got[0] - got[1]) / 2e-5, grad[at], atol=1e-5)


def test_html_edges(spark, weights):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "no tags"), (4, "u", "<p>unclosed <b>x"), (5, "u", "<article><p>" + "word " * 20000),
            (6, "u", "<script>never closed"), (7, "u", "< not a tag > & &amp;"), (1, "u", None), (8, "u", "<article><p>a &amp; b</p></article>" * 300)]
    out = html_text.extract(frame(spark, rows, "page_id long, url string, html string"), weights).collect()
    assert len(out) == len(rows) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in out)
    assert {r["text"] for r in out if r["page_id"] in (1, 2)} == {""}
    assert html_text.train(empty(spark, "page_id long, html string")) is None
    assert html_text.extract(empty(spark, "page_id long, url string, html string"), None).count() == 0


def filled(layout, rng, vocab):
    """A layout with words, and the words of its main text."""
    main = []

    def words(m):
        text = [rng.choice(vocab) for _ in range(int(m.group(2)))]
        if m.group(1) == "m":
            main.extend(text)
        return " ".join(text).capitalize() + ("." if len(text) > 6 else "")
    page = re.sub(r"\[([mn])(\d+)\]", words, layout)
    return page, main


def test_layouts_labelled_by_hand(spark):
    """Trained on the test pages; judged on layouts that the training knows nothing of."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_text.train(pages)
    rng = random.Random(8)
    vocab = [w for w in " ".join(r["html"] for r in pages.limit(20).collect()).split() if w.isalpha()]
    rows, wanted = [], []
    for i, layout in enumerate(LAYOUTS):
        page, main = filled(layout, rng, vocab)
        rows.append((i, "u", page))
        wanted.append(main)
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), weights).collect()}
    assert len(LAYOUTS) >= 50
    hit = found = total = 0
    for i, main in enumerate(wanted):
        have = Counter(w.strip(".").lower() for w in got[i].split())
        want = Counter(w.lower() for w in main)
        hit += (have & want).total()
        found, total = found + have.total(), total + want.total()
    print(f"recall {hit / total:.3f}, precision {hit / found:.3f}")
    assert hit >= 0.9 * total and hit >= 0.9 * found


def test_comments_that_end_at_once():
    assert [b.text for b in html_text.blocks("<article><p>one</p><!--><p>two</p><!---><p>three<!-- x --!> four</article>")] == ["one", "two", "three four"]
    assert [b.text for b in html_text.blocks("a<!doctype")] == ["a"] and html_text.blocks("<script x") == []


@pytest.mark.parametrize("page", ["<p>x" + "<br>\n" * 160_000, "<font>" * 160_000, "<font><p>x" * 95_000, "<li>x" * 190_000, "<div>x" * 150_000,
                                  "<!" * 500_000, "<script " * 120_000, "<a href=\"" * 110_000])
def test_a_page_of_a_megabyte(page):
    """Linear time: a quadratic parser would take many minutes for these."""
    weights = html_text.new_weights(np.random.default_rng(1))
    begin = time.process_time()
    html_text.main_texts(pa.array([page]), weights)
    assert time.process_time() - begin < 30


def test_windows_of_a_long_page_label_as_the_whole(monkeypatch):
    """Each block is labelled once; away from the windows' ends the labels are those of one reading."""
    rng = random.Random(2)
    page = html_text.blocks("".join(f"<{t}>{' '.join(rng.choices(['a', 'bb', 'ccc.'], k=rng.randint(1, 9)))}</{t}>"
                                    for t in rng.choices(["p", "li", "h2", "td"], k=1500)))
    weights = html_text.new_weights(np.random.default_rng(3))
    assert sorted(i for a, b, c, d in html_text.windows(len(page)) for i in range(b, c)) == list(range(len(page)))
    parts = html_text.labelled(weights, [page, page[:10], []])
    monkeypatch.setattr(html_text, "CORE", 10_000)
    whole = html_text.labelled(weights, [page, page[:10], []])
    assert [len(p) for p in parts] == [1500, 10, 0]
    assert max(abs(parts[0] - whole[0])) < 0.01 and (parts[1] == whole[1]).all()


def test_a_long_page_is_read_as_one_sequence(monkeypatch):
    """Labels depend on the whole page: those of the full bidirectional network, at any length and with any
    memory, and a page's ends reach its middle."""
    rng = random.Random(6)
    say = lambda k: "".join(f"<{t}>{' '.join(rng.choices(['a', 'bb', 'ccc.'], k=rng.randint(1, 9)))}</{t}>"
                            for t in rng.choices(["p", "li", "h2", "td"], k=k))
    page, other = html_text.blocks("<article>" + say(1700)), html_text.blocks(say(900))
    weights = html_text.new_weights(np.random.default_rng(3))
    for d in "fb":
        weights[f"x{d}"] = weights[f"x{d}"] * 3
        weights[f"x{d}"][-1, html_text.HIDDEN:2 * html_text.HIDDEN] = 9  # forgets next to nothing
    weights["o"] = weights["o"] * 5

    def plain(found):
        z = html_text.features(found)
        score = np.zeros(len(found))
        for k, d in enumerate("fb"):
            h, c = np.zeros(html_text.HIDDEN), np.zeros(html_text.HIDDEN)
            for i in range(len(found)) if d == "f" else reversed(range(len(found))):
                i_, f, o, u = np.split(z[i] @ weights[f"x{d}"] + h @ weights[f"h{d}"], 4)
                c = c / (1 + np.exp(-f)) + np.tanh(u) / (1 + np.exp(-i_))
                h = np.tanh(c) / (1 + np.exp(-o))
                score[i] += h @ weights["o"][k * html_text.HIDDEN:(k + 1) * html_text.HIDDEN]
        return 1 / (1 + np.exp(-score - weights["c"]))

    want = [plain(p) for p in (page, other)]
    changed = html_text.blocks("<nav>" + "x y z. " * 9 + "</nav>") + page[1:]
    assert abs(plain(changed) - want[0])[400:].max() > 1e-5  # the first block is still felt far on
    monkeypatch.setattr(html_text, "CORE", 256)
    for group in (32768, 2000, 500):
        monkeypatch.setattr(html_text, "GROUP", group)
        got = html_text.labelled(weights, [page, [], other, page[:30]])
        assert [len(g) for g in got] == [1700, 0, 900, 30]
        assert abs(got[0] - want[0]).max() < 1e-9 and abs(got[2] - want[1]).max() < 1e-9
