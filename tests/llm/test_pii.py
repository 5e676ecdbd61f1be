"""Base spans against plain patterns; the label model and classifier; rows."""

import hashlib
import random
import re
import time

from cairn.llm import pii
from cairn.session import ship

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_as_plain_patterns():
    rng = random.Random(2)
    alphabets = ["a.@-+ 0123456789", "0123456789.", "@.ab-", "+1 ()-5", "4111 1111 1111 1111 ", "é@a.b日1.2.3.4٣"]
    found = 0
    for _ in range(8000):
        t = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 60)))
        want = brute(t)
        found += len(want)
        assert pii.base_spans(t) == want, t
    assert found > 500


def test_very_long_texts_take_linear_time():
    began = time.time()
    for s in ("a" * 200_000 + "@" + "b" * 200_000, "1" * 200_000, "1 " * 100_000, "+1" + " " * 200_000, "1." * 100_000, "a@" * 100_000, "password=" * 30_000, "(at)" * 50_000):
        pii.extra_spans(s, pii.base_spans(s))
    assert time.time() - began < 20


def test_label_model_tells_good_labelers_from_bad():
    rng = random.Random(1)
    truth = [rng.random() < 0.4 for _ in range(4000)]
    accuracy = (0.95, 0.85, 0.75)
    rows = [(0, tuple(int(t) if rng.random() < a else 1 - int(t) for a in accuracy), 1.0) for t in truth]
    post, learnt = pii.label_model(rows)
    assert sum((p > 0.5) == t for p, t in zip(post, truth)) / len(truth) > 0.93
    table = learnt[0][1]
    right = [table[j][1][1] / sum(table[j][1]) for j in range(3)]
    assert right[0] > right[1] > right[2]


def test_secrets_are_learnt_and_decoys_are_not(spark):
    ship(spark)
    rng = random.Random(3)
    key = lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    rows = [(i, f"words {key()} more and mail bob.{i}@mail.example.com, token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\"") for i in range(60)]
    rows += [(100 + i, f"card 4111111111111111 {'and more words ' * 4} then {9071263548109203 + 9_731_377 * i} x") for i in range(60)]
    rows += [(500, None), (501, ""), (None, "call +1 (988) 555-2485 now"), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string")
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute(r.text or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
        if r.doc_id is not None and r.doc_id < 60:
            assert r.spans.count("secret:") == 2 and "AKIA" not in r.redacted and "<SECRET>" in r.redacted and "<EMAIL>" in r.redacted
        if r.doc_id is not None and 100 <= r.doc_id < 200:
            assert "account:" not in r.spans
        if r.doc_id == 500:
            assert r.redacted is None and r.spans == ""
    assert pii.find_pii(df.where("false")).count() == 0


def test_redaction_merges_overlaps():
    assert pii.redacted("abcdef", [("ip", 1, 3), ("card", 2, 4)]) == "a<IP>ef"
    assert pii.redacted("", []) == ""


def test_long_secrets_are_masked_whole(spark):
    ship(spark)
    rng = random.Random(8)
    token = lambda n: "".join(rng.choices("ABCDEFGHIJabcdefghij0123456789", k=n))
    for start in ("token=", "ghp_", "sk-", "xoxb-"):
        value = token(1000)
        span = ("secret", 4, 1004) if start == "token=" else ("secret", 0, len(start) + 1000)
        text = start + value if start != "token=" else f"pwd={value}"
        assert pii.extra_spans(text + " rest", []) == [span]
    rows = [(i, f"some words, token={token(1000 if i % 2 else 40)} and more words") for i in range(40)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.redacted for r in got} == {"some words, token=<SECRET> and more words"}


def test_handles_in_any_case():
    for at in ("(at)", "[at]", "(AT)", "[AT]", "[At]", "(At)", "(aT)", "[at)"):
        text = f"write to jane.doe {at} host [DOT] com soon"
        assert pii.extra_spans(text, []) == [("handle", 9, text.index(" soon"))], at
