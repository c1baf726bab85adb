"""Base spans against plain patterns; discovery from contexts."""

import random
import re
import time

import pytest

from helixplane.llm import pii
from helixplane.llm.common import table

from . import brute

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15 if kind == "phone" else True


def plain(text):
    found = {k: [(m.start(), i, m.end(), k) for m in re.finditer(p, text or "", re.A) if valid(k, m[0])] for i, (k, p) in enumerate(KINDS.items())}
    spans = sorted(sum(found.values(), []))
    return tuple(len(found[k]) for k in KINDS), brute.sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans))


TEXTS = [
    None, "", "é😀 a@b.co, x@y@z.de a@b.c_d@e.f.. a.b.c@d-e.f-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 1..2.3.4.5", "😀 4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111111 4222222222222",
    "+1 (626) 555-9369 +49.30.1234567 ++12345678901 +1 +123456789012345678 (+44) 20 7946 0958)", "9" * 3000 + " " + "a" * 20000 + "@ " + "a@b.c " * 50, "1 " * 2000, "x@" + "a.b" * 3000,
]


@pytest.mark.parametrize("source", ["odd", "documents"])
def test_base_spans(spark, sf_dir, source):
    docs = table(spark, sf_dir, "documents") if source == "documents" else spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) for r in pii.digests(pii.find(docs)).collect()}
    assert got == {r.doc_id: plain(r.text) for r in docs.collect()}


def planted(seed=5):
    """Identifiers beyond the base patterns in contexts of base ones, and the same shapes in other contexts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta omega sigma kappa theta".split())
    frames = {"email": ["please write to {} today", "mail me at {} or not"], "phone": ["my telephone number is {} thanks", "call me on {} tomorrow"], "ip": ["server address was {} again"]}
    base = {"email": lambda: f"{word()}{rng.randrange(999)}@{word()}.org", "phone": lambda: f"+44 20 {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)}", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4))}
    new = {"email": lambda: f"{word()}.{rng.randrange(9999)}@localhost", "phone": lambda: f"0{rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}", "ip": lambda: ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(6))}
    texts, hidden = [], []
    for k in range(560):
        kind = rng.choice(list(frames))
        secret = k >= 500
        value = (new if secret else base)[kind]()
        before = " ".join(word() for _ in range(rng.randrange(1, 9)))
        texts.append(f"{before} {rng.choice(frames[kind]).format(value)} {word()} item {rng.randrange(1000, 9999)}-{rng.randrange(10000)} of {rng.randrange(1990, 2030)}")
        hidden.append((kind, value) if secret else None)
    return texts, hidden


def test_spans_against_a_plain_version_and_recall_of_discovery(spark):
    texts, hidden = planted()
    more = [t for t in TEXTS if t] + ["", "a 12345 b 555 0199 22 c", "x" * 300 + " 4444 " + "word " * 900]
    docs = spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digests(pii.find(docs)).collect()}
    expect = brute.discovered(texts + more, KINDS, valid, pii.TOKEN, pii.SHAPE)
    assert got == {k: ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans) for k, spans in enumerate(expect)}
    found = [f"{h[0]}:{texts[k].index(h[1])}:{texts[k].index(h[1]) + len(h[1])}" in got[k].split(",") for k, h in enumerate(hidden) if h]
    assert sum(found) >= 0.9 * len(found)
    clean = [k for k, h in enumerate(hidden) if not h]
    assert sum(got[k] != ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(sum(([(m.start(), i, m.end(), q) for m in re.finditer(p, texts[k], re.A) if valid(q, m[0])] for i, (q, p) in enumerate(KINDS.items())), []))) for k in clean) == 0


def test_rows_that_share_an_id_get_the_spans_of_their_own_text(spark):
    rows = [(k, f"please mail to user{k}@host{k}.example now") for k in range(8)]
    rows += [(20, "please mail to hidden7731@localhost now"), (20, "nothing at all here"), (None, "and mail to hidden7731@localhost too"), (None, "no id")]
    got = sorted((brute.key(r.doc_id), r.spans) for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert [s for d, s in got if d == 20] == ["", "email:15:35"] and [s for d, s in got if d == brute.NO_ID] == ["", "email:12:32"]


def test_places_count_the_texts_own_letters(spark):
    rows = [(k, f"please write to user{k}@host{k}.example today") for k in range(30)]
    rows += [(50, "write to İ@host1234 today x"), (51, "please write to İİ.a@host77, today"), (52, "write to ẞ9999@İ. today")]
    got = {r.doc_id: r.spans for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (got[50], got[51], got[52]) == ("email:9:19", "email:16:27", "email:9:16")


def test_very_long_texts_take_time_in_proportion(spark):
    text = " ".join(f"token{k} 4{k:07d}" if k % 3 else f"u{k}@h.example" for k in range(48_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = pii.digests(pii.find(docs)).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == plain(text)[0] and time.time() - began < 60


def test_discovery_and_odd_rows(spark):
    rows = [(k, f"please mail to user{k}@host{k}.example now") for k in range(8)]
    rows += [(20, "please mail to hidden7731@localhost now"), (21, "nothing to hidden7731@localhost see"), (22, "a clean text of 2024 words"), (None, "please mail to user@a.b now"), (23, None), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = pii.digests(pii.find(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.spans for r in got}
    assert by[20] == "email:15:35" and by[21] == "email:11:31" and by[22] == "" and by[None] == "email:15:23" and by[23] == ""
    assert pii.digests(pii.find(docs.limit(0))).collect() == []
