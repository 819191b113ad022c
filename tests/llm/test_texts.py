"""Pieces, token counts, main text, licences and toxicity."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import gru, licences, main_text, piece_codec, pieces, token_counts, toxicity

MODEL = pieces.load(piece_codec.default_model())
EDGE = ["", None, " ", "  a", "a\n\nb", "\n", "▁x ▁", "<s></s><0x41>", "é́ 中文 😀 \x00", "x" * 5000, " " * 300, "don't (stop)... ²; end", "a\t b\r\n"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_agenda_equals_library(text):
    ids = MODEL.encode(text)
    assert ids == MODEL.library.encode(text)
    assert MODEL.decode(ids) == MODEL.library.decode(ids)


def test_agenda_on_pieces():
    rng, names = random.Random(5), list(MODEL.ids)
    for _ in range(3000):
        text = "".join(rng.choice(names) if rng.random() < 0.7 else rng.choice(" .,;'²»_\n€") for _ in range(rng.randint(1, 6))).replace("▁", " ")
        assert MODEL.encode(text) == MODEL.library.encode(text)


def test_flat_and_heap_agendas_agree(monkeypatch):
    rng, names = random.Random(6), list(MODEL.ids)
    parts = ["".join(rng.choice(names) for _ in range(3)) for _ in range(500)]
    flat = [MODEL.merge(p) for p in parts]
    monkeypatch.setattr(pieces, "FLAT", 0)
    assert flat == [MODEL.merge(p) for p in parts]


def test_decoding_any_ids():
    rng = random.Random(7)
    for _ in range(500):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.choice(MODEL.bytes) for _ in range(12)]
        assert MODEL.decode(ids) == MODEL.library.decode(ids)


def test_long_parts_are_not_remembered():
    model = pieces.PieceModel(piece_codec.default_model())
    parts = ["▁ab", "▁" + "q" * 100]
    found = model.look_up(set(parts))
    assert [found[p][2] for p in parts] == [True, True] and parts[1] not in model.known and parts[0] in model.known


def test_whole_tokens():
    whole = MODEL.whole()
    assert all(MODEL.library.piece_to_id(p) == MODEL.merge(p)[0] for p in list(whole)[:500])


def test_codec(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(EDGE)], "doc_id long, text string, ids string, agreed int")
    for r in piece_codec.encode_decode(df, keep=["doc_id"]).collect():
        ids = [1, *MODEL.library.encode(EDGE[r.doc_id] or ""), 2]
        assert (bytes(r.ids), r.decoded, r.agreed) == (struct.pack(f"<{len(ids)}I", *ids), MODEL.library.decode(ids), True)
    stage = piece_codec.codec_stage(spark, df, "")
    assert stage.count() == len(EDGE) and set(stage.columns) == {"doc_id", "text", "ids", "n_tokens"}
    assert piece_codec.encode_decode(df.where("false")).count() == 0


def test_codec_query(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in piece_codec.op6_piece_codec(spark, tiny).collect():
        ids = [1, *MODEL.library.encode(texts[r.doc_id] or ""), 2]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(MODEL.library.decode(ids).encode()).hexdigest()


def test_counts(spark, tiny):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(EDGE)], "doc_id long, text string, n_tokens int")
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df).collect()}
    assert found == {i: (len((t or "").encode()), len(MODEL.library.encode(t or ""))) for i, t in enumerate(EDGE)}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in token_counts.op10_token_counts(spark, tiny).collect():
        n = len(MODEL.library.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.over_limit) == (n, n > 4096)
    assert token_counts.count_tokens(df.where("false")).count() == 0


# Main text

PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>Hello <b>wor</b>ld &lt;x&gt; and more text.<p>Second&nbsp;one<br>line.</article><footer>F</footer></body></html>", "T Hello world <x> and more text. Second one line."),
    ("<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>Some text that is long.</p><aside>side</aside><div class='ad box'>Buy</div><section id=comments><article>bad bad</article></section></article></main>", "T Some text that is long."),
    ("<div class=sidebar>aaa</div><div class=content><h1>Hi</h1><p>para one</p><p>para two</p></div><div class='cookie-notice'>We use</div>", "Hi para one para two"),
    ("<body><div><div><section><p>aaaaaaaaaaaaaaaaaaaaa</p><p>aaaaaaaaaaaaaaaaaaaaaa</p></section><section><p>bbbbbbbbbbbb</p><p>b</p></section><p>c</p></div><div class=menu>x</div></div></body>", "aaaaaaaaaaaaaaaaaaaaa aaaaaaaaaaaaaaaaaaaaaa bbbbbbbbbbbb b c"),
    ("plain &amp; text", "plain & text"),
    ("<p>a<script>var t='</p>'</script>b <style>p{}</style><form>f<input></form>", "ab"),
    ("<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table>", "a b x y z"),
    ("<p hidden>no</p><p style='display:none'>no</p><p aria-hidden=true>no</p><p>yes</p>", "yes"),
    ("<!-- <p>no</p> --><p>yes<!-- never closed", "yes"),
    ("<nav><a>only</a></nav>", ""),
    ("<p>x &#8364; &unknown; &amp", "x € &unknown; &"),
    ("a < b <3 c", "a < b <3 c"),
    ("", ""),
    (None, ""),
    ("<<<>>>", "<<<>>>"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    assert main_text.main_text(html) == text


def test_link_lists_lose_to_prose():
    links = "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><p>{'prose ' * 60}</p><p>{'more ' * 50}</p></div></body>"
    assert main_text.main_text(page) == ("prose " * 60 + "more " * 50).strip()


def test_hard_pages_take_little_time():
    for page in ("<div>" * 20_000 + "x", "<p>" * 30_000 + "y", '<a "' * 20_000, "<b>" * 10_000 + "</i>" * 10_000):
        main_text.main_text(page)


def test_extract(spark, tiny):
    df = spark.createDataFrame([(i, h, "old") for i, (h, _) in enumerate(PAGES)], "page_id long, html string, text string")
    assert {r.page_id: r.text for r in main_text.extract(df).collect()} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert main_text.extract(df.where("false")).count() == 0
    found = main_text.op1_main_text(spark, tiny)
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.where("n_chars <> length(text) OR n_chars = 0").count() == 0


# Licences


def test_licence_query(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(con.execute(licences.OP5_SQL).fetchall())
    found = licences.op5_licences(spark, small)
    assert sorted(tuple(r) for r in found.select("doc_id", "licence", "score", "n_matches").collect()) == want
    assert any(w[3] for w in want)


def test_licence_scan(spark):
    texts = [
        "Intro\nReleased under the MIT License.\nEnd",
        "RELEASED under the *MIT* license",
        "some words\n\nLicensed under the Apache\nLicense, Version 2.0.\n\nmore words here",
        "MIT MIT MIT MIT MIT",
        "", None, "\n\n", "é",
        "Released under an MIT License.",
    ]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, licences int")
    found = {r.doc_id: [(x.licence, round(x.score, 3)) for x in r.licences] for r in licences.scan(df, keep=["doc_id"]).collect()}
    assert found[0] == [("MIT", 0.8), ("MIT", 1.0)] and found[1] == [("MIT", 1.0)] and found[2] == [("Apache-2.0", 1.0)]
    assert all(found[i] == [] for i in range(3, 8))
    assert found[8] == []  # 2 of 4 bigrams
    single = licences.scan(df, {"one": "mit"}, keep=["doc_id"]).where("size(licences) > 0")
    assert single.count() == 0
    with pytest.raises(ValueError):
        licences.scan(df, {"none": "..."})
    assert licences.scan(df.where("false")).count() == 0


def _found_by_hand(text, templates, least=0.8):
    """Licences of all units of a text, windows counted start by start."""
    words = licences.normal(text).split()
    units = {licences.normal(u) for u in [*text.split("\n"), *re.split("\n[ \t\r]*\n", text), text]}
    for template in templates.values():
        order = licences.bigrams(template)
        n = len(order)
        for s in range(-n, len(words)):
            agree = sum(1 for j in range(n) if order.index(order[j]) == j and 0 <= s + j < len(words) - 1 and f"{words[s + j]} {words[s + j + 1]}" == order[j])
            if " " in order[0] and agree >= min(len(set(order)), licences.support(n)):
                units.add(" ".join(words[max(s, 0):s + n + 1]))
    found = []
    for name, template in templates.items():
        want = Counter(licences.bigrams(template))
        for unit in units - {""}:
            has = Counter(licences.bigrams(unit))
            score = 2 * (want & has).total() / (want.total() + has.total())
            if score >= least:
                found.append((name, round(score, 6), unit))
    return sorted(found)


NOTICE = licences.TEMPLATES["MIT-permission"]


def test_notices_beside_other_words(spark):
    gpl = licences.TEMPLATES["GPL-3.0-header"]
    wrapped = NOTICE.split(" ")
    lines = [" ".join(wrapped[i:i + 9]) for i in range(0, len(wrapped), 9)]
    texts = [
        "Copyright 2020 Foo Inc. Released under the MIT License. All other rights are theirs, of course.",
        "/*\n * Copyright 2020\n *\n * " + "\n * ".join(lines) + "\n *\n * The above copyright notice shall be included.\n *\n * And much more is said here about warranty and the like.\n */",
        gpl + "\nThis program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability. See the licence for more.",
        f"{NOTICE} {NOTICE}",  # one after the other
        "Licensed under the Apache License, Version 2.0. " * 3,
        " ".join(wrapped[5:]),  # cut at the start of the text
        "so it was said: " + " ".join(wrapped[:30] + ["lawfully"] + wrapped[31:]) + " end",
        "so it was said: " + " ".join(wrapped[:20] + ["and", "so"] + wrapped[20:]) + " end",
        "the license of the software is not under the terms of this work",
        "word " * 60_000 + NOTICE + " word" * 60_000,
        "license", "license license", "", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r.licences for r in licences.scan(df).collect()}
    for i, text in enumerate(texts):
        if len(text or "") < 10_000:
            assert sorted((x.licence, round(x.score, 6), x.unit) for x in rows[i]) == _found_by_hand(text or "", licences.TEMPLATES), i
    names = {i: {x.licence for x in found} for i, found in rows.items()}
    assert "MIT" in names[0] and "GPL-3.0-header" in names[2] and "Apache-2.0" in names[4]
    assert all("MIT-permission" in names[i] for i in (1, 3, 5, 6, 7, 9)) and max(x.score for x in rows[1]) == 1
    assert not any(names[i] for i in (8, 10, 11, 12, 13))


def test_random_texts_by_hand(spark):
    rng = random.Random(5)
    short = {"a": "one two three four five", "b": "two three two three six", "c": "four", "d": "one two three four five six seven one two eight"}
    words = "one two three four five six seven eight".split()
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    texts += [" ".join(rng.choices(words, k=4) + short[rng.choice("abd")].split() + rng.choices(words, k=4)) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: sorted((x.licence, round(x.score, 6), x.unit) for x in r.licences) for r in licences.scan(df, short).collect()}
    assert all(rows[i] == _found_by_hand(t, short) for i, t in enumerate(texts))


def test_anchors_and_support():
    for template in licences.TEMPLATES.values():
        grams = licences.bigrams(template)
        held = sum(1 for g in grams if set(g.split()) & set(licences.anchors(grams)))
        assert len(grams) - held < licences.bounds(len(grams))[0]  # a text without the anchors has too few
    assert [licences.support(n) for n in (1, 4, 10, 20, 40)] == [1, 4, 4, 6, 7]


def test_size_bounds_lose_no_match():
    for size in range(1, 40):
        lo, hi = licences.bounds(size)
        for n in range(1, 90):
            if 2 * min(size, n) / (size + n) >= 0.8:
                assert lo <= n <= hi


# Toxicity


def test_gradients():
    net = gru.Network(1)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(9)]
    rows, length = rng.integers(0, 9, (4, gru.STEPS)), np.array([5, 3, 0, 7])
    label, weight = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)
    gates = np.concatenate([net.inputs(words), np.zeros((1, 6 * gru.HIDDEN), np.float32)]).astype(np.float64)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    loss, dgates, g = net.gradients(gates, rows, length, label, weight)
    for name in ("u", "wa", "va", "wo", "bn"):
        at = tuple(s // 2 for s in net.w[name].shape)
        step, losses = 1e-2, []
        for sign in (1, -1):
            net.w[name][at] += sign * step
            losses.append(net.gradients(gates, rows, length, label, weight)[0])
            net.w[name][at] -= sign * step
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(g[name][at], rel=0.05, abs=2e-3)


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500, 1001):
        seen = {i for s in toxicity.starts(n) for i in range(s, min(n, s + gru.STEPS))}
        assert seen == set(range(n))


def test_held_out_accuracy(spark):
    """Marked words in a third of the documents; rows held out of training are told apart."""
    rng = random.Random(8)
    plain, bad = [f"word{i}" for i in range(300)], ["idiot", "scum", "trash"]
    rows, labels = [], []
    for i in range(900):
        toxic = int(rng.random() < 0.3)
        text = [rng.choice(bad) if toxic and rng.random() < 0.05 else rng.choice(plain) for _ in range(rng.randint(80, 200))]
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sample = toxicity.sample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scorer = toxicity.train(*sample)
    found = {r.doc_id: r.score for r in toxicity.score(docs, scorer, keep=["doc_id"]).collect()}
    import zlib

    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(sample[1]) == 900 - len(held)
    right = sum((found[i] >= 0.3) == labels[i][2] for i in held)
    assert right / len(held) > 0.9
    edge = spark.createDataFrame([(None, None, 1), (2, "", 2), (2, "", 2), (3, "idiot " * 30_000, 3)], "doc_id long, text string, score int")
    scores = toxicity.score(edge, scorer, keep=["doc_id"]).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores) and len({r.score for r in scores if r.doc_id != 3}) == 1
    assert toxicity.score(edge.where("false"), scorer).count() == 0


def test_training_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    none = toxicity.train(*toxicity.sample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert none.score([["a"]])[0] < 0.3


LONG = "Words of the article stand here. " * 8


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<article><h1>T</h1><div class='overflow-hidden lg:hidden'><p>{LONG}</p></div><p>End.</p></article>", f"T {LONG}End."),
        (f"<body><div class='content has-sidebar'><p>{LONG}</p></div><div class=sidebar>aside</div></body>", LONG.strip()),
        (f"<article><p>{LONG}</p><h2 id='related-work'>Related work</h2><p>{LONG}</p><h2 id=notice>Notice</h2><p>More.</p></article>", f"{LONG}Related work {LONG}Notice More."),
        (f"<body><div class='with-comments'><article><p>{LONG}</p></article></div></body>", LONG.strip()),
        (f"<body><div class='comments'><article><p>{LONG}</p></article></div><p>x</p></body>", LONG.strip()),
        (f"<article><p>{LONG}</p><section id=comments><article>{LONG}{LONG}</article></section></article>", LONG.strip()),
        (f"<article><p>{LONG}</p><div class='site-share'><a href=x>Tell all</a></div></article>", LONG.strip()),
    ],
)
def test_class_names_of_wrappers_and_headings(html, want):
    assert main_text.main_text(html) == want


def test_every_character_is_read():
    assert toxicity.words_of("Ab_c, d!?  \U0001f600\n" + "x" * 50) == ["ab_c", ",", "d", "!?", "\U0001f600", "x" * 24, "x" * 24, "xx"]
    assert toxicity.words_of("*** ---") == ["***", "---"] and toxicity.words_of(None) == toxicity.words_of(" \n") == []
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aB_é日*!.\U0001f600 \n\t") for _ in range(rng.randint(0, 80)))
        assert "".join(toxicity.words_of(text)) == re.sub(r"\s", "", text.lower())


def test_sample_is_bounded_and_settled(spark):
    """Repeated ids give one document each, a document with both labels is toxic, and order doesn't matter."""
    docs = [(i % 40, f"text {i} " + "w " * 100) for i in range(200)] + [(None, "nothing")]
    labels = [(i, 1, 1) for i in range(30)] + [(i, 1, 0) for i in range(10, 40)] + [(i, 1, 0) for i in range(10, 40)] + [(None, 1, 1), (5, 1, None)]
    made = []
    for turn in (1, -1):
        made.append(toxicity.sample(spark.createDataFrame(docs[::turn], "doc_id long, text string").repartition(4), spark.createDataFrame(labels[::turn], "doc_id long, quality int, toxic int"), 12, 5))
    assert made[0][0] == made[1][0] and made[0][1].tolist() == made[1][1].tolist()
    import zlib

    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    toxic = sum(i < 30 for i in free)
    assert len(made[0][1]) == min(12, toxic) + min(5, len(free) - toxic)
    assert made[0][2].sum() == pytest.approx(len(free))
    assert all(len(doc) == len(toxicity.starts(102)) for doc in made[0][0])


def test_windows_one_by_one():
    """Scores of texts in one batch equal those put together window by window, in plain steps."""
    rng = random.Random(3)
    scorer = toxicity.Scorer(gru.Network(5), np.array([-0.3, 0.7, 0.2]))
    w, h = scorer.net.w, gru.HIDDEN
    texts = [[rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(n)] for n in (0, 1, 5, 64, 65, 130, 300)]

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def logit(words):
        if not words:
            return float(w["bo"][0])
        x = scorer.net.inputs(words).astype(float)
        states = []
        for k, way in enumerate((range(len(words)), range(len(words) - 1, -1, -1))):
            s, out = np.zeros(h), {}
            for i in way:
                g, a = x[i, 3 * h * k : 3 * h * (k + 1)], s @ w["u"][k]
                r, z = sigmoid(g[:h] + a[:h]), sigmoid(g[h : 2 * h] + a[h : 2 * h])
                cand = np.tanh(g[2 * h :] + r * (a[2 * h :] + w["bn"][k, 0]))
                s = (1 - z) * cand + z * s
                out[i] = s
            states.append(out)
        hidden = np.array([np.concatenate([states[0][i], states[1][i]]) for i in range(len(words))])
        e = np.tanh(hidden @ w["wa"] + w["ba"]) @ w["va"]
        alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        return float((alpha @ hidden) @ w["wo"] + w["bo"][0])

    for text, got in zip(texts, scorer.score(texts), strict=True):
        logits = np.array([logit(text[a : a + gru.STEPS]) for a in toxicity.starts(len(text))])
        features = np.array([1, sigmoid(logits).mean() * 6 - 3, logits.max()])
        assert got == pytest.approx(sigmoid(features @ scorer.fit), abs=1e-4)
