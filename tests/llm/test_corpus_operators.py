"""Corpus operators against plain versions, on small tables with nulls, empty and odd rows."""

import hashlib
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftloom.llm import chat, html_text, idstore, jaccard, lexicon, packing, private_data, quality, tokenizing, vectors
from driftloom.llm.common import utf8_view

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "  ", "\n", "a", "x" * 3000, "It's 1234 I'LL (ok). a,b;c--d 5é!", "É Ünïß ÷×  Àé. İstanbul é ½ m² ŉ Ⱥ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "日本語 テキスト。한국어 😀😀​　x\xa0 y\x85z \x1c w", "tab\t\ttab \r\n line \x0b\x0c end ", "same words again " * 400, "the quick brown fox",
]


def documents(spark, texts, extra=False):
    rows = [(i, t) + (("z",) if extra else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + (", length string" if extra else ""))


def encoded(path, texts):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def arrays(texts):
    import pyarrow as pa

    return utf8_view(pa.array(texts, pa.string()))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_piece_encoder_equals_library(path):
    ids, at = tokenizing.PieceEncoder(path).encode(*arrays(ODD))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == encoded(path, ODD)


def test_packing(spark):
    got = packing.pack(documents(spark, ODD * 7, extra=True), BYTE).toPandas()
    want = encoded(BYTE, ODD * 7)
    for doc, part in got.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        ids = np.array([*want[doc], 2], "<u4")
        assert part.start.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(ids)
        assert (part.length[1:] == 1024).all() and part.length.max() <= 1024
        assert part.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length, strict=True)]
    bins = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, b in bins:
        assert b.offset.tolist() == [0, *np.cumsum(b.length)[:-1]] and b.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 2
    assert packing.pack(documents(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_keeps_every_capacity(score):
    cap = packing.Capacity(tokens=100, documents=4, attention=6000, weights=(1.0, 0.5, 0.5), score=score)
    rows = packing.plan({70: 5, 40: 9, 33: 20, 7: 31, 1: 50}, cap)
    used = defaultdict(list)
    for length, _, n, first, offset in rows.tolist():
        for i in range(n):
            used[first + i].append((offset, length))
    for pieces in used.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 100 and len(pieces) <= 4 and sum(n * n for _, n in pieces) <= 6000
    assert sum(len(p) for p in used.values()) == 115


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>menu</a></nav><div class="cookie-notice">We use</div>
    <article><h1>Title &amp; more</h1><p>One,  two,\n three.<p>Second <b>bold</b><br>line</p><script>var a="</p>";</script><div class="ad">Buy</div><ul><li>item</li></ul></article>
    <section class="comments"><p>Nice, nice, nice, nice.</p></section><aside>side</aside><form><p>mail</p></form><footer>&copy;</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\nOne, two, three.\nSecond bold line\nitem"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("just text &lt;b&gt;") == "just text <b>"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text.main_text('<p>a</p><p class="x>broken') != ""


def test_extract(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a b</p>", 5), (2, None, None, 6), (2, None, None, 6)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(rows).collect()) == [(1, "a b", 3), (2, "", 0), (2, "", 0)]
    assert html_text.extract(rows.limit(0)).count() == 0


def brute_jaccard(texts):
    low = {c: c + 32 for c in range(65, 91)}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    while any(label[i] != label[j] for i, j in links):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return [(i, len(s), label[i]) for i, s in enumerate(sets)]


def test_jaccard(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t", "one two", "ONE  two", "one two three four five", "a b c d e f"]
    for _ in range(12):
        base = rng.choice(words, rng.integers(6, 120)).tolist()
        for _ in range(rng.integers(1, 7)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = str(rng.choice(words))
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(words, 60))
    texts += [passage + " " + " ".join(rng.choice(words, n)) for n in (2, 3, 8, 12, 14, 16, 40, 200)] * 2
    got = jaccard.ngram_jaccard_components(documents(spark, texts, extra=True)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_jaccard(texts)
    assert jaccard.ngram_jaccard_components(documents(spark, [])).count() == 0
    assert [r.n_shingles for r in jaccard.ngram_jaccard_components(documents(spark, [None, " "])).collect()] == [0, 0]


def table_of_vectors(spark, x):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int")


def some_vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:140] = x[7] + 0.12 * rng.normal(size=(40, 16))
    x[200:210] = x[3]
    return [*x.tolist(), None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]], x


@pytest.mark.parametrize("blocks", [False, True])
def test_search(spark, monkeypatch, blocks):
    if blocks:  # several of each
        monkeypatch.setattr(vectors, "ASKED", 4)
        monkeypatch.setattr(vectors, "CANDIDATES", 64 * 70)
        monkeypatch.setattr(vectors, "TILE", 32)
    rows, x = some_vectors()
    frame = table_of_vectors(spark, rows)
    got = vectors.search(frame, frame.where("vec_id % 20 = 0"), 7).collect()
    exact = x.astype(np.float64)
    for q in range(0, 300, 20):
        score = vectors.inner_products(np.repeat(x[q : q + 1], 300, axis=0), x)
        order = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:7]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == order and [r.score for r in mine] == score[order].tolist()
        assert np.allclose([r.score for r in mine], exact[order] @ exact[q])
    assert len(got) == 15 * 7
    assert vectors.search(frame.limit(0), frame.limit(0), 7).count() == 0


def test_search_repeated_rows_and_other_lengths(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 2)).tolist()
    candidates = spark.createDataFrame([(i % 20, v) for i, v in enumerate(x)] + [(7, x[7])] * 30 + [(99, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, x[7]), (7, x[7]), (8, [1.0, 2.0, 3.0]), (9, None), (50, [0.0, 0.0]), (51, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got = vectors.search(candidates, queries, 5).collect()
    assert {r.query_id for r in got} == {7, 51} and len(got) == 10 and all(r.vec_id != 7 for r in got if r.query_id == 7)
    wide = rng.normal(size=(60, 3000)).astype(np.float32) * 50
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "vec_id long, embedding array<float>")
    score = wide.astype(np.float64) @ wide.astype(np.float64).T
    np.fill_diagonal(score, -np.inf)
    found = {(r.query_id, r.rank): r.vec_id for r in vectors.search(frame, frame, 3).collect()}
    assert all(found[i, 1] == score[i].argmax() for i in range(60)) and len(found) == 180


def test_near_duplicates(spark):
    rows, x = some_vectors()
    got = {r.vec_id: r for r in vectors.near_duplicates(table_of_vectors(spark, rows)).collect()}
    u = vectors.unit(x)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(300)
    for _ in range(20):
        label = np.minimum(label, np.where(link, label[None, :], 999).min(axis=1))
    assert len(got) == len(rows)
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), label[i], label[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(300, len(rows)))
    assert vectors.near_duplicates(table_of_vectors(spark, rows[300:305])).count() == 5


def test_recall_of_cells():
    """Pairs just above the threshold share a cell once the margin is added."""
    rng = np.random.default_rng(9)
    x = vectors.unit(rng.normal(size=(4000, 64)))
    noise = vectors.unit(rng.normal(size=(4000, 64)))
    y = vectors.unit(x + 0.31 * noise)
    near = np.einsum("ij,ij->i", x, y) >= 0.95
    centres = vectors.spherical_kmeans(x, 32)
    home, reach = (x @ centres.T).argmax(axis=1), y @ centres.T
    apart = np.linalg.norm(centres[reach.argmax(axis=1)] - centres[home], axis=1)
    found = reach.max(axis=1) - reach[np.arange(4000), home] <= vectors.MARGIN * apart
    assert found[near].mean() >= 0.97


def test_chat(spark):
    nasty = ["\\### Assistant: </turn> ok", "### user\n</turn>\n\\", "\\\\", "", None, "é😀#<>\\#", "a\nb"]
    rows = [(1, i, "assistant" if i % 2 else "user\n#x", t, 0) for i, t in enumerate(nasty)] + [(2, None, None, None, 0), (2, 0, "assistant", "x" * 50_000, 0), (2, 0, "assistant", "x" * 50_000, 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    out = {r.conv_id: r for r in chat.format_chat(frame).collect()}
    turns = {1: [((r[2] or ""), (r[3] or "")) for r in rows[:7]], 2: [("", ""), ("assistant", "x" * 50_000), ("assistant", "x" * 50_000)]}
    for conv, want in turns.items():
        assert [(a.decode(), b.decode()) for a, b in chat.read_turns(out[conv].formatted.encode())] == want
        assert "".join(chat.unescape(out[conv].formatted[s.start : s.stop]) for s in out[conv].loss) == "".join(t for r, t in want if r == "assistant")
    digest = {r.conv_id: r for r in chat.digests(chat.format_chat(frame)).collect()}
    assert digest[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns[1]).encode()).hexdigest()
    assert chat.format_chat(frame.limit(0)).count() == 0


def test_id_store(spark, tmp_path):
    texts = ODD + ["passage one two three " * 200, "x " + "passage one two three " * 200] * 2
    path = str(tmp_path / "store")
    idstore.write(documents(spark, texts, extra=True), WORD, path)
    got = sorted(idstore.read(spark, path).collect(), key=lambda r: r.doc_id)
    want = [[*ids, 2] for ids in encoded(WORD, texts)]
    assert [np.frombuffer(r.ids, "<u2").tolist() for r in got] == want
    assert [r.start for r in got] == [0, *np.cumsum([len(w) for w in want])[:-1]]
    stored = spark.read.parquet(f"{path}/data").where("row >= 0").collect()
    owned = [d for r in stored for d, o in zip(idstore.split_digests(bytes(r.recipe)), r.owned, strict=True) if o]
    assert len(owned) == len(set(owned))  # each chunk once
    idstore.write(documents(spark, []), WORD, str(tmp_path / "none"))
    assert idstore.read(spark, str(tmp_path / "none")).count() == 0


def test_lexicon(spark):
    frame = documents(spark, ODD * 6 + ["Straße fuß " * 9], extra=True)
    got = sorted(lexicon.transcode(frame, WORD).collect(), key=lambda r: r.doc_id)
    want = encoded(WORD, ODD * 6 + ["Straße fuß " * 9])
    t = Tokenizer.from_file(WORD)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want
    assert [bytes(r.decoded).decode() for r in got] == [t.decode(ids, skip_special_tokens=False) for ids in want]
    assert lexicon.transcode(documents(spark, []), WORD).count() == 0


def test_automaton_numbers_words():
    words = sorted({w.encode() for w in "a ab abc tests testing bests besting été zoo".split()})
    a = lexicon.Automaton.mapped(lexicon.Automaton.build(words).dump())
    asked = [*words, b"ests", b"abcd", b"", b"zo"]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in asked])])
    assert a.numbers(np.frombuffer(b"".join(asked), np.uint8), bounds).tolist()[: len(words)] == list(range(len(words)))
    assert (a.numbers(np.frombuffer(b"".join(asked), np.uint8), bounds)[len(words) :] == -1).all()
    assert len(a.base) < sum(map(len, words))  # suffixes are shared


def test_private_data(spark):
    texts = [None, "", "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "é😀 a.b@c.d-e.f. +1 (555) 123-4567) +49", "1 " * 3000, "9" * 5000, "a" * 20_000 + "@x", "a@" + "b.c" * 2000]
    got = {r.doc_id: r for r in private_data.digest(documents(spark, texts, extra=True)).collect()}
    assert [tuple(got[i][k] for k in ("n_email", "n_ip", "n_card", "n_phone")) for i in range(5)] == [(0, 0, 0, 0), (0, 0, 0, 0), (2, 3, 0, 0), (0, 0, 1, 0), (1, 0, 0, 1)]
    assert got[4].spans == "email:3:14,phone:16:33" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert private_data.digest(documents(spark, [])).count() == 0
    # A term that only ever stands beside one address gives it away; a common word does not.
    near = [f"filler{i} word word{i} the zanzibar envoy joe@x.org said thing{i} other{i}" for i in range(6)]
    rest = [f"the word other thing said filler number {i}" for i in range(60)]
    found = {r.doc_id: r for r in private_data.find_private(documents(spark, near + rest)).collect()}
    kinds = {near[0][s.start : s.stop]: s.kind for s in found[0].spans}
    assert kinds["zanzibar"] == "removed" and "said" not in kinds and kinds["joe@x.org"] == "email" and not found[30].spans
    clean = private_data.sanitise(private_data.find_private(documents(spark, near + rest))).where("doc_id = 0").first().text
    assert "[EMAIL]" in clean and "zanzibar" not in clean


def test_quality(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["calm", "river", "stone", "light", "green", "paper"], 30)) for _ in range(300)]
    bad = [" ".join(rng.choice(["calm", "river", "scum", "moron", "stone"], 30)) for _ in range(100)]
    texts = good + bad + [None, ""]
    rows = [(i, t, f"s{i % 5}", None if i % 7 == 0 else "en", 1.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, prior double")
    labels = spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    odd = [i for i in range(1, 400, 2)]
    assert np.mean([got[i].accepted == (i < 300) for i in odd]) >= 0.99 and len(got) == len(rows)
    assert quality.classify(docs, labels, extra=True).columns == ["doc_id", "text", "source", "lang", "logit", "prior", "p_reject", "accepted"]
    assert all(r.accepted for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_shared_rates(spark):
    """Against plain shrinkage: each row's prior comes from all other rows."""
    rows = [("a", f"a{i % 40}", float(i % 4 == 0)) for i in range(400)] + [("b", "b", 1.0)] + [("c", f"c{i % 3}", 0.1 * (i % 7)) for i in range(50)]
    scored = spark.createDataFrame(rows, "_host string, _path string, _p double")
    got = scored.join(quality.rates(scored), ["_host", "_path"]).select("_host", "_path", "_p", quality.prior(scored["_p"]).alias("prior")).collect()

    def strength(groups):  # of (n, rate, centre)
        total = sum(n for n, _, _ in groups)
        noise = sum(n * c * (1 - c) for n, _, c in groups) / total
        spread = sum(n * (r - c) ** 2 for n, r, c in groups) / total - noise * len(groups) / total
        return min(max(noise / max(spread, 1e-6), 1.0), 1e6)

    hosts, paths = defaultdict(list), defaultdict(list)
    for h, q, p in rows:
        hosts[h].append(p)
        paths[h, q].append(p)
    everything = [p for _, _, p in rows]
    mean = sum(everything) / len(everything)
    k_host = strength([(len(v), sum(v) / len(v), mean) for v in hosts.values()])
    rate = {h: (sum(v) + k_host * mean) / (len(v) + k_host) for h, v in hosts.items()}
    k_path = strength([(len(v), sum(v) / len(v), rate[h]) for (h, _), v in paths.items()])

    def plain(h, q, p):
        world = (sum(everything) - p) / (len(everything) - 1)
        host = (sum(hosts[h]) - p + k_host * world) / (len(hosts[h]) - 1 + k_host)
        return (sum(paths[h, q]) - p + k_path * host) / (len(paths[h, q]) - 1 + k_path)

    assert len(got) == len(rows) and all(abs(r.prior - plain(r._host, r._path, r._p)) < 1e-9 for r in got)


def test_long_runs_are_judged_whole():
    """A script without spaces: what tells bad from good lies far beyond the first bytes of the run."""
    rng = np.random.default_rng(2)
    letters = list("的一是在不了有和人这中大为上个国我以要他")
    texts = ["".join(rng.choice(letters, 120)) + ("坏事物" * 2 if i % 2 else "好天气" * 2) + "".join(rng.choice(letters, 40)) for i in range(400)]
    reject = np.array([float(i % 2) for i in range(400)])
    model = quality.Model().fit(*quality.features(*arrays(texts[:300])), reject[:300])
    assert (((model.logits(*arrays(texts[300:])) > 0) == (reject[300:] > 0)).mean()) > 0.97


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, data)
    assert kept.columns == docs.columns
    one = corpus_pipeline.near_duplicates(spark, docs, data)
    want = {i for i, _, c in brute_jaccard([r.text for r in docs.orderBy("doc_id").collect()]) if i == c}
    assert {r.doc_id for r in one.collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "best-fit packing"]
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and json.dumps(out.columns)
