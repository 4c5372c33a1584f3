"""Operator 2: detection, formats, coreference and distinctness."""
import random
import re
from collections import defaultdict

import pytest

from cadre.llm import pii

KEY = b"k"


def kinds(text):
    return [(m.kind.split(" ")[0], text[m.start:m.end]) for m in pii.detect(text)]


@pytest.mark.parametrize("text,want", [
    ("write hein.19@mail5.example.com!", [("email", "hein.19@mail5.example.com")]),
    ("éñ.3@mail.example.com,", [("email", "éñ.3@mail.example.com")]),
    ("call +1 (017) 555-7713 now", [("phone", "+1 (017) 555-7713")]),
    ("+1 (974) 555-3436 97.51.17.173 9807915762804490", [("phone", "+1 (974) 555-3436"), ("ip", "97.51.17.173"), ("card", "9807915762804490")]),
    ("4785380592391139$$$ 152.143.123.131###", [("card", "4785380592391139"), ("ip", "152.143.123.131")]),
    ("4111 1111 1111 1111.", [("card", "4111 1111 1111 1111")]),
    ('x token = "04dbebab91ab85687d33eeaaf"###', [("secret", "04dbebab91ab85687d33eeaaf")]),
    ("e03422dad6b454724135a384f69ba12c7de6c8f4", [("secret", "e03422dad6b454724135a384f69ba12c7de6c8f4")]),
    ("078-05-1120 and 1.2.3.4.5 and 12345", [("ssn", "078-05-1120")]),
    ("DE89 3704 0044 0532 0130 00", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("GNU General Public License The The 2024", []), ("", []),
    ("Frau Anna Schmidt met Mr. Lee. Schmidt left", [("given", "Anna"), ("family", "Schmidt"), ("family", "Lee"), ("family", "Schmidt")]),
    ("John Miller and госпожа Ольга Петрова", [("given", "John"), ("family", "Miller"), ("given", "Ольга"), ("family", "Петрова")]),
    ("王小明先生", [("family", "王"), ("given", "小明")]),
])
def test_detect(text, want):
    assert kinds(text) == want


def test_surrogates_keep_type_and_format():
    text = 'Mrs. Anna Schmidt, ANNA, +1 (017) 555-7713, 1-2, 4111 1111 1111 1111, 4111111111111111, 9.8.7.6, token = "04dbebab91ab85687d33eeaaf04dbebab91ab85", a.19@mail5.example.com, Herr Иван Петров'
    out, n = pii.replace(text, KEY, {})
    assert n == {"given": 2, "family": 2, "phone": 1, "card": 2, "ip": 1, "secret": 1, "email": 1}
    shape = lambda t: re.sub(r"\d", "9", t)
    for pat in (r"\+1 \(\d{3}\) \d{3}-\d{4}", r", (\d{4}) (\d{4}) (\d{4}) (\d{4}),", r'token = "[0-9a-f]{39}"', r"[a-z]\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", r"Herr [А-Я][а-я]+ [А-Я][а-я]+"):
        assert re.search(pat, out), pat
    m = re.search(r", (\d{4}) (\d{4}) (\d{4}) (\d{4}), (\d{16}),", out)
    assert "".join(m.groups()[:4]) == m[5] and pii._luhn(m[5]) and m[5][0] == "4"
    assert "Schmidt" not in out and "Петров" not in out and "555-7713" not in out and shape(out) != out
    assert out == pii.replace(text, KEY, {})[0] != pii.replace(text, b"other", {})[0]


def test_gender_and_script():
    for seed in range(30):
        assert re.search("(na|lia|ra)$", pii.surrogate(KEY, "given LATIN F", f"x{seed}"))
        assert re.search("(ова|ина)$", pii.surrogate(KEY, "family CYRILLIC F", f"x{seed}"))
        assert pii.script_of(pii.surrogate(KEY, "given GREEK M", f"x{seed}")) == "GREEK"
        assert pii.script_of(pii.surrogate(KEY, "given CJK F", f"x{seed}")) == "CJK"


def corpus(n=400):
    r = random.Random(1)
    rows, people = [], [f"u{r.randrange(60)}.{r.randrange(100)}@mail{r.randrange(9)}.example.com" for _ in range(80)]
    for i in range(n):
        rows.append((i, f"word {r.choice(people)} and {r.randrange(100, 1000)}-{r.randrange(1000, 1400)} " + ("Mr. Tom Jones " if i % 9 == 0 else "")))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "nothing")]


@pytest.mark.parametrize("limit", [0, 500_000])
def test_distinct_and_coreferent_over_the_corpus(spark, monkeypatch, limit):
    real = pii.surrogate
    # few telephone numbers to draw from, so that many collide
    monkeypatch.setattr(pii, "_like", lambda s, t: "".join(str(s.below(10)) if c.isdigit() else c for c in t))
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["text"] for r in pii.replace_personal_data(df, KEY, broadcast_entities=limit).collect()}
    assert out[400] is None and out[401] == "" and out[402] == "nothing"
    new = defaultdict(set)
    entities = {(m.kind, m.entity) for _, t in rows if t for m in pii.detect(t)}
    for i, t in rows:
        if not t:
            continue
        a, b = pii.detect(t), pii.detect(out[i])
        for x, y in zip(a, b):
            if x.kind in ("email", "phone"):
                new[x.kind, x.entity].add(out[i][y.start:y.end])
        assert "Tom Jones" not in out[i]
    assert all(len(v) == 1 for v in new.values())  # coreference
    got = [(k[0], *v) for k, v in new.items()]
    assert len(set(got)) == len(got) and not any((k, pii._canonical(k, v)[1]) in entities for k, v in got)
    assert real is pii.surrogate


def test_assign_redraws_until_distinct(spark, monkeypatch):
    found = spark.createDataFrame([("phone", "%03d" % i) for i in range(150)], pii.ENTITY)
    every, again = pii.assign(found, KEY)
    rows = every.collect()
    assert len(rows) == 150 == len({r["new"] for r in rows}) and not {r["new"] for r in rows} & {"%03d" % i for i in range(150)}
    assert {r["entity"] for r in again.collect()} == {r["entity"] for r in rows if r["attempt"] > 0} != set()


def test_masked_values_are_no_entities():
    assert kinds("password: ****** pwd=------ ___@___.___") == []
    assert pii.replace("password: ******", KEY, {}) == ("password: ******", {})
    assert kinds("password: ****a1") == [("secret", "****a1")]


def test_surrogates_get_longer_when_their_own_length_has_no_free_form():
    """Values that a draw of the same length gives again, or that fill all forms of it."""
    short = [pii.surrogate(KEY, "secret", "***1***", a) for a in range(pii.LONGER_FROM)]
    assert all(re.fullmatch(r"\*{3}\d\*{3}", x) for x in short)
    for k, e in [("secret", "***1***"), ("email", "_@_.c"), ("phone", "5551234"), ("phone", "+1 5551234567"),
                 ("ssn", "078051120"), ("iban", "DE89370400440532013000"), ("card", "4111111111111111")]:
        new = pii.surrogate(KEY, k, e, pii.LONGER_FROM + 2)
        assert len(new) == len(e) + 3 and (k != "card" or pii._luhn(new))
    # an address keeps its type: four octets have billions of forms
    assert pii.surrogate(KEY, "ip", "9.8.7.6", pii.LONGER_FROM).count(".") == 3
    assert pii.render("555-1234", "phone", "9876543210") == "987-6543210"


def test_masked_and_full_spaces_end(spark):
    rows = [(0, "password: ******"), (1, "_@_.c"), *[(2 + i, "password: ***%d***" % i) for i in range(10)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = {r["doc_id"]: r["text"] for r in pii.replace_personal_data(df, KEY).collect()}
    assert out[0] == "password: ******" and out[1] != "_@_.c"
    new = [out[2 + i] for i in range(10)]
    assert len(set(new)) == 10 and not {t for _, t in rows} & set(new)


def test_many_mentions_in_one_text_take_little_time():
    import time
    text = " ".join(f"mail{i}@host{i % 7}.example.com and 10.{i % 250}.{i % 199}.7" for i in range(10_000))
    t0 = time.perf_counter()
    found = pii.detect(text)
    assert len(found) == 20_000 and time.perf_counter() - t0 < 3
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))


def test_addresses_keep_four_octets_at_any_attempt():
    for attempt in (0, 7, 8, 20):
        parts = pii.surrogate(b"k", "ip", "10.0.0.1", attempt).split(".")
        assert len(parts) == 4 and all(1 <= int(x) <= 254 for x in parts)
