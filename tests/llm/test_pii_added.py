from vecloom.llm.pii import base_spans, candidates, find_pii, fit_selector, weak_label


def planted(n):
    rows = []
    for i in range(n):
        local = f"555-{100 + i % 900}-{1000 + i % 9000}"
        rows.append((i, f"some words, please mail to user{i}.name@host{i % 7}.example.com or call phone +1 415 555 {1000 + i} today, server at host 10.0.{i % 250}.7 is up"))
        rows.append((1000 + i, f"version 1.2.{i} page {i} of 2021-03-{i % 28 + 1:02d} and 300.1.2.{i} or card 4111 1111 1111 {1000 + i}, taken at 12:30:45:{i % 60:02d}, build 2019/10/{i % 28 + 1:02d}, user{i}@localhost in {20000000 + i * 7}"))
        if i % 3 == 0:
            rows.append((2000 + i, f"please mail to user{i}.name [at] host{i % 7} [dot] example [dot] org or so"))
            rows.append((3000 + i, f"some words, server at host 2001:db8:{i:x}:1:2:3:4:{i + 9:x} is up"))
            rows.append((4000 + i, f"or call phone {local} today, some words"))
    return rows


def test_forms_beyond_the_patterns_are_added(spark):
    """Spelled-out mail, IPv6 and phones without + are no negatives, however often they occur."""
    rows = planted(300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in find_pii(df, fit_selector(df)).collect()}
    for first, kind in ((2000, "email"), (3000, "ip"), (4000, "phone")):
        own = [i for i, _ in rows if first <= i < first + 1000]
        assert sum(f"{kind}:" in got[i] for i in own) >= 0.9 * len(own), kind
    others = [got[i] for i, _ in rows if 1000 <= i < 2000]
    assert sum(any(f"{k}:" in s for k in ("email", "ip", "phone")) for s in others) <= 0.05 * len(others)


def test_weak_labels():
    def labels(text, kind):
        base = set(base_spans(text))
        return [weak_label(text, c, base) for c in candidates(text) if c[1] == kind]

    assert labels("at a.b@c.org now", 0) == [1] and labels("at a.b [at] c [dot] org, now", 0) == [None] and labels("at a@localhost, now", 0) == [0]
    assert labels("host 10.0.0.1, up", 1) == [1] and labels("host 2001:db8:0:1:2:3:4:5, up", 1) == [None] and labels("host 300.1.2.3, up", 1) == [0]
    assert labels("call +1 415 555 2671, now", 3) == [1] and labels("call 415 555 2671, now", 3) == [None] and labels("on 2021-03-04, now", 3) == [0]


def test_copies_take_no_places_of_the_sample(spark, monkeypatch):
    """The sample holds so many different texts, however often each is repeated."""
    from vecloom.llm import pii

    held = []
    monkeypatch.setattr(pii, "fit", lambda x, y: held.append(len(x)) or pii.Boosted())
    monkeypatch.setattr(pii, "calibrate", lambda model, x, y: held.append(len(x)))
    rows = [(i, f"mail user{i}@host.example.org") for i in range(60)]
    rows += [(1000 + i, f"mail copy{i % 40}@host.example.org") for i in range(40 * 100)]
    fit_selector(spark.createDataFrame(rows, "doc_id long, text string"), sampled=80)
    assert sum(held) == 80
