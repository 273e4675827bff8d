"""Base spans against Python's re, terms against plain counts, sanitised texts against plain replacement."""

import hashlib
import math
import random
import re
from collections import defaultdict

from driftloom.llm import private_data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def sound(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), k, m.end()) for i, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text) if sound(k, m[0])]
    order = list(PLAIN)
    return [(k, a, b) for a, k, b in sorted(found, key=lambda x: (x[0], order.index(x[1])))]


def random_texts(n):
    rng = random.Random(5)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49", "é", "😀", " ", " ", ".", "-", "12", "0", "(", "word", "\n", "+", "a@b.c-d", "000000000000"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_base_spans_equal_re(spark):
    texts = [*random_texts(600), "a@b.cd " * 3000, "1.2.3.4, " * 2500 + "😀 4111 1111 1111 1111"]
    got = {r.doc_id: r for r in private_data.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]


def test_terms_equal_plain_counts(spark):
    rng = random.Random(9)
    words = ["alpha", "bravo", "carol", "delta", "echoes", "foxtrot", "golfer"]
    texts = [" ".join(rng.choice(words) for _ in range(6)) + f" filler{i} zanzibar w{i} joe@x.org end{i}" for i in range(8)]
    texts += [" ".join(rng.choice(words[:4]) for _ in range(8)) + f" u{i} ann@y.org bravo v{i}" for i in range(6)] + [" ".join(rng.choice(words) for _ in range(9)) for _ in range(80)]
    texts += texts[:5] * 7  # copies count once
    found = private_data.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    different = sorted(set(texts))
    together, entity_docs, term_docs, class_docs, class_together = (defaultdict(set) for _ in range(5))
    of_class = lambda k, v: {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": re.sub("[^0-9]", "", v)[:6], "phone": re.sub("[^0-9]", "", v)[:3]}[k]
    classes = {}
    for t in different:
        for w in set(re.findall(r"[^\W\d_]{4,}", t.lower())):
            term_docs[w].add(t)
        for k, a, b in plain_spans(t):
            before, after = t[max(0, a - 61) : a], t[b : b + 61]
            before = re.sub(r"(?s)\A([^\W\d_]+|.)", "", before) if a > 60 else before
            after = re.sub(r"(?s)([^\W\d_]+|.)\Z", "", after) if len(after) > 60 else after
            around, e = before + "\n" + after, t[a:b].lower()
            c = classes[e] = k, of_class(k, e)
            entity_docs[e].add(t)
            class_docs[c].add(t)
            for w in set(re.findall(r"(?<![^\W\d_])[^\W\d_]{4,}(?![^\W\d_])", around.lower())):
                together[e, w].add(t)
                class_together[c, w].add(t)
    want, n, k = set(), len(different), private_data.SHRINK
    for (e, w), both in together.items():
        c = classes[e]
        expected = (len(class_together[c, w]) + k * len(class_docs[c]) / n) / (len(term_docs[w]) + k) * len(entity_docs[e]) / len(class_docs[c])
        share = 1 - math.log2((len(both) + k * expected) / (len(term_docs[w]) + k)) / math.log2(len(entity_docs[e]) / n)
        if share >= 0.6:
            want.add((e, w, "removed" if share >= 0.85 else "general"))
    got = set()
    for r in found:
        entities = {s.value.lower() for s in r.spans if s.kind in PLAIN}
        got |= {(e, s.value.lower(), s.kind) for s in r.spans if s.kind not in PLAIN for e in entities}
    assert {(w, k) for _, w, k in want} == {(w, k) for _, w, k in got} and {"removed", "general"} >= {k for *_, k in want} and any(w == "zanzibar" for _, w, _ in want)


def kind_of(value):
    return "ACRONYM" if value.upper() == value != value.lower() else "NAME" if value[:1].upper() == value[:1] != value[:1].lower() else "WORD"


def test_sanitised_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abCDé😀 ") for _ in range(rng.randint(0, 300)))
        spans = sorted({(a := rng.randint(0, len(text)), min(len(text), a + rng.randint(1, 9)), rng.choice(private_data.KINDS)) for _ in range(rng.randint(0, 40)) if text})
        rows.append((i, text, [(k, a, b, text[a:b]) for a, b, k in spans if a < b], i % 3))
    got = {r.doc_id: r.text for r in private_data.sanitise(spark.createDataFrame(rows, f"doc_id long, text string, spans {private_data.SPAN}, other int")).collect()}
    for i, text, spans, _ in rows:
        out, at = "", 0
        for k, a, b, _ in spans:
            if a >= at:
                out += text[at:a] + ("" if k == "removed" else f"[{kind_of(text[a:b]) if k == 'general' else k.upper()}]")
            at = max(at, b)
        assert got[i] == out + text[at:]


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "x a@b.cd", "s", 2)], "doc_id long, text string, spans string, _text int")
    got = private_data.find_private(rows)
    assert got.columns == ["doc_id", "text", "_text", "spans"] and [(r._text, r.spans[0].value) for r in got.collect()] == [(2, "a@b.cd")]
