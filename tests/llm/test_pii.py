"""Base spans against Python's regular expressions; disguises map back to their source."""

import random
import re

import pytest
from tessera.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 13 <= len(d) <= 19 and luhn(d)) or (k == 3 and 9 <= len(d) <= 15):
                out.append((k, *m.span()))
    return out


@pytest.mark.parametrize("seed", range(200))
def test_base(seed):
    rng = random.Random(seed)
    bits = ["a.b", "@", "@x.com", "1.2.3.4", "256", ".", "4111111111111111", "4111 1111 1111 1111", "+1 (269) 555-3296", "+", "-", " ", "é", "9", "12", "()", "user%"]
    text = "".join(rng.choice(bits) for _ in range(rng.randrange(80)))
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text,kind,part", [
    ("mail joe [at] site [dot] org now", 0, "joe [at] site [dot] org"),
    ("mail joe at site dot co dot uk now", 0, "joe at site dot co dot uk"),
    ("écrire à jое@site.com merci", 0, "jое@site.com"),
    ("card four one one one one one one one one one one one one one one one end", 2, "four one one one one one one one one one one one one one one one"),
    ("ip １０．０．０．１ end", 1, "１０．０．０．１"),
    ("call +1 269 five five five 3296 ok", 3, "+1 269 five five five 3296"),
    ("zero​width a​b@site.com", 0, "width"),
])
def test_disguises(text, kind, part):
    base, every = pii.all_spans(text)
    found = [text[a:b] for k, a, b in every if k == kind]
    if part == "width":
        assert found and found[0].endswith("b@site.com")
    else:
        assert part in found
    assert set(base) <= set(every)


@pytest.mark.parametrize("text,kind,part", [
    ("card 4111\u20111111\u20111111\u20111111 end", 2, "4111\u20111111\u20111111\u20111111"),
    ("call +1 269\u2013555\u20133296 ok", 3, "+1 269\u2013555\u20133296"),
    ("mail joe@my\u2010site.org now", 0, "joe@my\u2010site.org"),
    ("mail joe [at] site dot org now", 0, "joe [at] site dot org"),
    ("mail joe at site [dot] org now", 0, "joe at site [dot] org"),
    ("mail joe@site dot org now", 0, "joe@site dot org"),
    ("mail joe@site [dot] co dot uk now", 0, "joe@site [dot] co dot uk"),
    ("mail joe (at) site.org now", 0, "joe (at) site.org"),
    ("mail joe.doe at site.org now", 0, "joe.doe at site.org"),
    ("mail joe dot doe at site.org now", 0, "joe dot doe at site.org"),
    (f"mail joe at {'s' * 70} dot {' dot '.join('abcdefgh')} now", 0, f"joe at {'s' * 70} dot {' dot '.join('abcdefgh')}"),
    (f"mail {'j' * 70} at site dot org now", 0, f"{'j' * 70} at site dot org"),
])
def test_mixed_disguises(text, kind, part):
    assert part in [text[a:b] for k, a, b in pii.all_spans(text)[1] if k == kind]


@pytest.mark.parametrize("text", ["look at example.com for more", "at site dot", "years 1990\u20131995 \u2013 see at home", "the dot com at last"])
def test_prose_is_no_disguise(text):
    assert pii.all_spans(text)[1] == []


def test_long_mixed_text_is_linear():
    for bit in ("x at a dot ", "a dot ", "a@", "a at ", "a [dot] ", "a at a."):
        pii.all_spans(bit * 40_000)


def test_frame(spark):
    data = [(1, None, "x"), (2, "", "y"), (3, "a@b.co +1 (269) 555-3296", "z"), (3, "a@b.co +1 (269) 555-3296", "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, spans string")
    got = sorted((r.doc_id, r.n_email, r.n_phone, r.spans) for r in pii.detect(docs).collect())
    assert got == [(1, 0, 0, ""), (2, 0, 0, ""), *[(3, 1, 1, "email:0:6,phone:7:24")] * 2]
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == [None, "", "<EMAIL> <PHONE>", "<EMAIL> <PHONE>"]
    assert pii.detect(docs.limit(0)).count() == 0


def test_long_text_is_linear():
    assert pii.all_spans("a" * 300_000 + "1" * 300_000 + " one" * 50_000)[0] == []


def test_leading_zeros_of_any_number():
    zeros = "0" * 5_000
    for ip in (f"{zeros}1.2.3.4", f"1.2.3.{zeros}", f"{zeros}255.0.0.{zeros}9"):
        assert [k for k, _, _ in pii.base_spans(f"x {ip} y")].count(1) == 1
    assert not [k for k, _, _ in pii.base_spans(f"{zeros}256.1.1.1") if k == 1]


def test_redact_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b@c.de", 5, "z"), (None, None, None, None), (1, "a b@c.de", 5, "z"), (2, "", 1, "")], "doc_id long, text string, spans int, `a.b` string")
    got = pii.redact(docs)
    assert got.columns == docs.columns and sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "a <EMAIL>", 5, "z"), (None, None, None, None), (1, "a <EMAIL>", 5, "z"), (2, "", 1, "")], key=str)
    assert pii.redact(docs.limit(0)).count() == 0


def _luhn_number(rng, n):
    body = [rng.randrange(1, 10) for _ in range(n - 1)]
    total = sum(d if (n - 2 - i) % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(body))
    return "".join(map(str, [*body, -total % 10]))


def test_planted_disguises_map_back_to_their_source():
    import random

    rng = random.Random(12)
    wide = {str(k): chr(0xFF10 + k) for k in range(10)}
    spelled = {v: k for k, v in pii.SPELLED.items() if k != "oh"}
    at = ["@", " [at] ", "(at)", " at ", "＠"]
    dot = [".", " [dot] ", "(dot)", " dot ", "․"]
    looks = {k: v for k, v in pii.LOOKALIKES.items() if k.isalpha()}
    found = 0
    for _ in range(600):
        kind = rng.choice(["email", "card", "phone"])
        if kind == "email":
            name = f"{rng.choice(['ann', 'bob', 'eva'])}.{rng.choice(['moss', 'pike'])}{rng.randrange(10)}"
            if rng.random() < 0.4:
                name = "".join(rng.choice(looks[c]) if c in looks and rng.random() < 0.4 else c for c in name)
            item = name + rng.choice(at) + rng.choice(["site", "post"]) + rng.choice(dot) + "org"
        elif kind == "card":
            n = _luhn_number(rng, 16)
            form = rng.randrange(3)
            item = rng.choice("‐‑–−").join(n[k : k + 4] for k in range(0, 16, 4)) if form == 0 else "".join(wide[c] for c in n) if form == 1 else " ".join(spelled[c] for c in n)
        else:
            item = "+" + rng.choice("‑–").join("".join(rng.choice("123456789") for _ in range(k)) for k in (2, 3, 4, 3))
        before, after = rng.choice(["", "Näme: ", "see <", "x\n"]), rng.choice(["", " now", ">\n", " ü"])
        text = before + item + after
        spans = {(pii.KINDS[k], a, b) for k, a, b in pii.all_spans(text)[1]}
        assert (kind, len(before), len(before) + len(item)) in spans, (text, spans)
        assert pii.redacted(text) == before + f"<{kind.upper()}>" + after
        found += 1
    assert found == 600
