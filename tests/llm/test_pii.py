import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.llm import boosting
from vecloom.llm.pii import KINDS, Selector, base_spans, candidates, describe, find_pii, fit_selector, luhn, redact, written

from .cases import edgy, none

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    for kind, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "-", " ", "+", "1", "25", "255", "256", "(", ")", "4111111111111111", "b.c", "é", "x@y.z", "+1 415 555 2671", "0", "%", "\n", "10.0.0.1"]), max_size=25))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert base_spans(text) == brute(text)


HOSTILE = {
    "digits": "1" * 50_000, "dotted": "1." * 20_000, "at signs": "a@" * 20_000, "a domain": "a.b@" + "c." * 10_000, "an open bracket": "+1" + "(" * 30_000,
    "bare at signs": "@" * 9000, "single digits": "1 " * 20_000, "addresses": "name@host.example.org " * 16_000, "phones": "+1 415 555 2671, " * 16_000,
    "keys": "a1b2c3d4e5f6a7b8c9d0 " * 16_000, "hex": "ab12:" * 20_000, "capitals": "AB12 " * 20_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_texts_take_linear_time(name):
    """Whole texts go through the patterns and through a selector that takes all it can; twice the text takes about twice the time."""
    import time

    text, took = HOSTILE[name], []
    greedy = Selector(boosting.Boosted(), [0.0] * len(KINDS))
    for t in (text, text + text):
        start = time.time()
        base = base_spans(t)
        added = greedy.added(t, base)
        took.append(time.time() - start)
        spans = sorted((s, e) for s, _, e in added)
        assert all(b[0] >= a[1] for a, b in zip(spans, spans[1:]))
    assert took[1] < 20 and took[1] < 3.5 * took[0] + 1
    # the plain patterns themselves are quadratic on these
    if name not in ("digits", "at signs", "a domain", "bare at signs"):
        assert base_spans(text) == brute(text)


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    m = boosting.fit(x[:1000], y[:1000])
    boosting.calibrate(m, x[1000:1250], y[1000:1250])
    p = m.probability(x[1250:])
    assert ((p > 0.5) == (y[1250:] == 1)).mean() > 0.95
    assert boosting.least_score(np.array([0.9, 0.8, 0.7, 0.1]), np.array([1, 1, 0, 1.0]), 1.0, fewest=1) == 0.8
    assert boosting.least_score(np.zeros(0), np.zeros(0), 0.9) == 1.1
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((1, 3)))[0] < 0.01


def test_added_spans_and_redaction(spark):
    rows = []
    for i in range(300):
        rows.append((i, f"some words here, mail me: user{i}.name@host{i % 7}.example.com please, or call phone +1 415 555 {1000 + i} today. version 1.2.{i} page {i} of 2021-03-{i % 28 + 1:02d}"))
        rows.append((1000 + i, f'plain text and token = "{"%040x" % (i * 7919 ** 9)}" then 192.168.{i % 250}.7 and nothing'))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    selector = fit_selector(df, sampled=400)
    got = {r["doc_id"]: r for r in find_pii(df, selector).collect()}
    assert all(got[i]["n_email"] == 1 and got[i]["n_phone"] == 1 for i in range(300))
    added = sum("secret:" in got[1000 + i]["spans"] for i in range(300))
    assert added >= 200
    for i, text in rows:
        base, spans = set(filter(None, got[i]["base"].split(","))), list(filter(None, got[i]["spans"].split(",")))
        assert base <= set(spans) and base == set(filter(None, written(brute(text)).split(",")))
    out = redact(rows[0][1], got[0]["spans"])
    assert "@" not in out and "[EMAIL]" in out and "[PHONE]" in out and "2021" in out


def test_edges(spark):
    df = edgy(spark)
    got = find_pii(df, fit_selector(df)).collect()
    assert len(got) == df.count() and {r["spans"] for r in got} == {""}
    assert find_pii(none(spark), fit_selector(none(spark))).collect() == []
    assert Selector(boosting.Boosted(), [0.0] * len(KINDS)).added("call 555 123 4567 now", []) != []
    assert len(describe("a 12345678 b", (2, 2, 10))) == len(describe("10.0.0.1", (0, 1, 8)))
