"""Quality, toxicity, personal data and page text: held-out accuracy, brute force and odd inputs."""

import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallystone.llm import pagetext, pii, quality, toxicity
from test_words_and_links import documents


def prose(rng, n=80):
    return " ".join(rng.choice("the of and river stone house garden walks under above morning light quiet road".split()) + rng.choice(["", "", "", ".", ","])
                    + str(rng.choice(["", "", "x", "y"])) for _ in range(n)).capitalize()


def test_quality_separates_junk_from_prose(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    good = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 200))).capitalize() + "." for _ in range(600)]
    junk = []
    for k in range(90):
        words = [rng.choice(vocabulary) for _ in range(80)]
        junk.append([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(w + "$$$" for w in words), " ".join(w + " " + w + " " + w for w in words[:30])][k % 4])
    rows = [(k, t, "s") for k, t in enumerate(good + junk)] + [(9000, None, "s"), (9001, "", "s"), (None, "x", "s"), (0, good[0], "s")]
    found = quality.quality(documents(spark, rows))
    assert found.count() == len(rows)
    score = {r.doc_id: r for r in found.collect()}
    assert np.mean([score[k].keep for k in range(600)]) > 0.98
    assert np.mean([score[k].keep for k in range(600, 690)]) < 0.05
    assert all(0 <= r.score <= 1 for r in score.values())
    assert quality.quality(documents(spark, rows).limit(0)).count() == 0


def test_em_finds_the_rates_votes_were_drawn_with():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    votes = np.full((len(truth), len(quality.LABELLERS)), quality.SILENT)
    for k in range(votes.shape[1]):
        fires = rng.random(len(truth)) < np.where(truth, 0.02, 0.55)
        votes[fires, k] = quality.BAD
    patterns, inverse, counts = np.unique(quality.pattern_of(votes), return_inverse=True, return_counts=True)
    share, rates, posterior = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.02 and abs(rates[0, :, quality.BAD] - 0.55).max() < 0.04 and rates[1, :, quality.BAD].max() < 0.04
    assert ((posterior[inverse] > 0.5) == truth).mean() > 0.97


def toxic_corpus(seed=1, n=700):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    bad = ["zorkish", "blarg", "vexful", "grimolo"]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([5, 60, 600]))]
        toxic = k % 6 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", "", "en", "."]))
        rows.append((k, " ".join(words).upper() if k % 9 == 0 else " ".join(words), "s"))
        labels.append((k, int(toxic), int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_corpus()
    extra = [(9000, None, "s"), (9001, "", "s"), (None, "blarg", "s"), (0, rows[0][1], "s")]
    labelled = spark.createDataFrame([*labels, (9000, 0, 0), (None, 1, 1), (9001, 0, None)], "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity(documents(spark, rows + extra), labelled).collect()
    assert len(found) == len(rows) + len(extra)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < len(rows)]
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    toxic = [r.predicted for r in held if r.doc_id % 6 == 0]
    clean = [r.predicted for r in held if r.doc_id % 6]
    assert np.mean(toxic) > 0.95 and np.mean(clean) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    kept = toxicity.accepted(documents(spark, rows + extra), labelled)
    assert kept.columns == documents(spark, []).columns
    assert kept.count() == sum(1 - r.predicted for r in found)


def test_toxicity_without_labels_or_documents(spark):
    rows, _ = toxic_corpus(n=20)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity(documents(spark, rows), none).collect()
    assert len(found) == 20 and all(r.predicted == 0 for r in found)
    assert toxicity.toxicity(documents(spark, []), none).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    idf = rng.random(40) + 0.5
    examples = []
    for k in range(900):
        terms = np.sort(rng.choice(40, rng.integers(0, 5), replace=False))
        examples.append((k, int(rng.random() < 0.4), terms.tolist(), rng.integers(1, 4, len(terms)).tolist()))
    index = toxicity.Index(examples, idf)
    dense = np.zeros((len(index.ids), 40))
    by_id = {e[0]: e for e in examples}
    for row, doc_id in enumerate(index.ids):
        terms, weights = index.vector(by_id[doc_id][2], by_id[doc_id][3])
        dense[row, terms] = weights
    for _ in range(50):
        terms = np.sort(rng.choice(40, 3, replace=False))
        terms, weights = index.vector(terms, rng.integers(1, 4, 3))
        query = np.zeros(40)
        query[terms] = weights
        exact = dense @ query
        rows, scores = index.nearest(terms, weights, 25)
        order = np.lexsort([np.arange(len(exact)), -np.round(exact, 12)])[:25]
        assert rows.tolist() == order[exact[order] > 0].tolist()
        assert np.allclose(scores, exact[rows])


def test_toxicity_of_a_rare_class_rests_on_rates_and_on_the_whole_text(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(400)]
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 50 == 0
        words = [rng.choice(vocabulary) for _ in range(12)]
        # clean texts hold each of the two words about as often as toxic ones in number, but never both
        words += ["zork", "vex"] if toxic else [["zork"], ["vex"], *[[]] * 38][rng.randrange(40)]
        rng.shuffle(words)
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(toxic), int(toxic)))
    labelled = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    held = [r for r in toxicity.toxicity(documents(spark, rows), labelled).collect() if r.held_out]
    assert np.mean([r.predicted for r in held if r.doc_id % 50 == 0]) > 0.9
    assert np.mean([r.predicted for r in held if r.doc_id % 50]) < 0.02
    # a long clean text with one telling word is not what a short toxic one is
    space = toxicity.Space(["common", "zork"], np.array([False, True]))
    index = toxicity.Index([(1, 1, [1], [1]), (2, 0, [0], [3])], np.array([1.0, 5.0]), 4.0)
    assert index.nearest(*index.vector(*space.counts("zork")), 1)[1][0] == 1
    assert index.nearest(*index.vector(*space.counts("zork " + " ".join(vocabulary))), 1)[1][0] < 0.2


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(7)
    for _ in range(8000):
        text = "".join(rng.choice("ab1209.@+- ()%é") if rng.random() < 0.8 else rng.choice(["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 555"])
                       for _ in range(rng.choice([5, 20, 60])))
        base, spans = pii.all_spans(text)
        assert base == plain_spans(text) and set(base) <= set(spans)


DISGUISED = [
    ("write john [at] mail (dot) example (dot) com now", "email", "john [at] mail (dot) example (dot) com"),
    ("reach jane.doe at example dot org today", "email", "jane.doe at example dot org"),
    ("jоhn.smith＠exаmple．com ok", "email", "jоhn.smith＠exаmple．com"),
    ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
    ("+١ (٥٥٥) ٠١٢-٣٤٥٦", "phone", "+١ (٥٥٥) ٠١٢-٣٤٥٦"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ("ip one nine two dot one six eight dot zero dot one x", "ip", "one nine two dot one six eight dot zero dot one"),
    ("192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"),
    ("jo​hn@ma​il.com", "email", "jo​hn@ma​il.com"),
    ("john(at)mail.example.com", "email", "john(at)mail.example.com"),
]


@pytest.mark.parametrize("text,kind,span", DISGUISED)
def test_disguises_map_back_to_the_source(text, kind, span):
    (_, _, spans), = pii.batch_spans(pa.array([text]))
    assert span in [text[a:b] for k, a, b in spans if k == kind]


@pytest.mark.parametrize("text", ["meet me at example.com", "un 56.219.220.54 x", "with, at at at of the end", "plain é ü ñ ß text. One two. Three dots", ""])
def test_plain_text_gains_no_spans(text):
    base, spans = pii.all_spans(text)
    assert base == spans


def test_personal_data_rows(spark):
    rows = [(1, "a@b.cc and 10.0.0.1", "s"), (2, None, "s"), (3, "", "s"), (None, DISGUISED[0][0], "s"), (1, "+1 (555) 555-0000", "s"), (4, "x" * 200_000 + " 1" * 50_000, "s")]
    found = pii.personal_data(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    first = next(r for r in found if r.doc_id == 1 and r.n_email)
    assert first.spans == "email:0:6,ip:11:19" and first.base_sha256 == hashlib.sha256(first.spans.encode()).hexdigest()
    nameless = next(r for r in found if r.doc_id is None)
    assert (nameless.n_email, nameless.n_disguised, nameless.base_sha256) == (1, 1, hashlib.sha256(b"").hexdigest())
    hidden = {r.text for r in pii.masked(documents(spark, rows)).collect()}
    assert {"[email] and [ip]", "[phone]", None, ""} <= hidden


def truth(page):
    article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", article[1].replace("<br>", " "))
    return "\n".join(p for p in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if p)


def test_main_text_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    held = {r.page_id: r.html for r in pages.collect()}
    found = pagetext.main_text(pages).collect()
    assert len(found) == len(held)
    assert np.mean([r.text == truth(held[r.page_id]) for r in found]) > 0.98
    assert all(r.n_chars == len(r.text) for r in found)


def test_long_pages_are_trained_on(spark):
    rng = random.Random(11)

    def page():
        article = [prose(rng, 60) for _ in range(130)]
        nav = "".join(f"<li><a href=x>{prose(rng, 2)}</a></li>" for _ in range(12))
        return f"<html><body><nav><ul>{nav}</ul></nav><article>{''.join(f'<p>{p}</p>' for p in article)}</article><footer><p>{prose(rng, 6)}</p></footer></body></html>", article

    made = [page() for _ in range(40)]
    assert all(len(html) > pagetext.SAMPLE_CHARS for html, _ in made)
    assert all(sum(len(t) for _, t, _ in pagetext.window(html)[0]) <= pagetext.SAMPLE_CHARS for html, _ in made)
    pages = spark.createDataFrame([(k, "u", html) for k, (html, _) in enumerate(made)], "page_id bigint, url string, html string")
    for r in pagetext.main_text(pages).collect():
        expected = [" ".join(p.split()) for p in made[r.page_id][1]]
        assert len(set(r.text.split("\n")) ^ set(expected)) <= 0.02 * len(expected)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<script>x"), (None, "u", "<article><p>Some words of the article that are long enough to be one.</p></article>"), (3, None, "<p" * 50_000)]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id bigint, url string, html string, n_chars int")
    found = pagetext.main_text(pages).collect()
    assert len(found) == 5 and sum(bool(r.text) for r in found) <= 1
    assert pagetext.main_text(pages.limit(0)).count() == 0


def test_blocks_close_paragraphs_and_decode_references():
    found = pagetext.blocks("<body><article><p>a &amp; b&nbsp;c<br>d<p><b>e</b>f<ul><li>g<li>h</ul><script>'</p>'</script>i<!-- <p>x</p> --></article><footer>z")
    assert [text for _, text, _ in found] == ["a & b c d", "ef", "g", "h", "i", "z"]
    assert found[0][0] == (("body", ()), ("article", ()), ("p", ()))


def test_elements_that_are_not_closed_hide_nothing():
    def texts(page):
        return [text for _, text, _ in pagetext.blocks(page)]

    assert texts("<p>one <svg class=i/> two</p><p>three</p>") == ["one two", "three"]
    assert texts("<p>one <svg><text>no</text></svg> two</p><object data=x><p>three</p><canvas>") == ["one two", "three"]
    assert texts("<p>a <math><mi>x</mi><annotation>no</annotation></math> b</p>") == ["a x b"]
    assert texts("<title-bar>one</title-bar><object-view>two</object-view><p>three</p>") == ["onetwo", "three"]
    assert texts("<p>one</p><title>no</title><script>no") == ["one"]
    assert texts("<p>one" + "<svg>" * 50_000 + "two</p>") == ["onetwo"]


def test_the_trigger_finds_whatever_the_chain_changes():
    rng = random.Random(17)
    made = ["10 . 20 . 30 . 40", "10.  20.  30.  40", "j.doe at mail.3com.org", "j.doe- at mail.com", "10\x1c.20\x1c.30\x1c.40"]
    parts = ["j.doe", "a1", "-", "_", "mail", "3com", "org", "com", ".", "at", "@", "dot", "[", "]", "(", ")", "one", "two", "three", "10", "7", ",", "*"]
    for _ in range(20_000):
        made.append("".join(rng.choice(parts) + rng.choice(["", "", " ", "  ", "   ", "\x0b", "\x1f", "\n"]) for _ in range(rng.randint(3, 14))))
    found = list(pii.batch_spans(pa.array(made)))
    assert [(t, *pii.all_spans(t)) for t in made] == found
    assert [spans[0][0] for _, _, spans in found[:5]] == ["ip", "ip", "email", "email", "ip"]


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(1)
    labeller = pagetext.Labeller(inputs=7, hidden=3)
    x, mask = pagetext._padded([rng.standard_normal((n, 7)) for n in (4, 2)])
    y = (rng.random(mask.shape) < 0.5) * mask

    def loss():
        logits = labeller.logits(x, mask)[0]
        return ((np.logaddexp(0, logits) - y * logits) * mask).sum() / mask.sum()

    grads = labeller.gradients(x, mask, y)
    for name, weight in labeller.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in weight.shape)
            held = weight[at]
            weight[at] = held + 1e-5
            up = loss()
            weight[at] = held - 1e-5
            down = loss()
            weight[at] = held
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


@pytest.mark.parametrize("unit", list("-%+_.a1@ (é") + ["a@b-b-", "a.", "1.", "a at ", "x dot ", "+1", "-at-a", "a-at-b.c"])
def test_spans_of_long_runs_take_time_in_proportion(unit):
    import time

    def seconds(n):
        text = "é" + unit * (n // len(unit))
        began = time.process_time()
        pii.all_spans(text)
        return time.process_time() - began

    assert seconds(80_000) < 8 * max(seconds(20_000), 0.05)
