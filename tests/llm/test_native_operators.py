import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vecloom.llm.chat import ESC, format_chats, parse_formatted
from vecloom.llm.decontaminate import decontaminate, flagged
from vecloom.llm.url_rules import RULES, apply_rules, rule_table

from .cases import edgy, none

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        grams = [x] if 0 < len(x) < n else [x[i:i + n] for i in range(len(x) - n + 1)]
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if w[i:i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found.add(str(item))
    return hit, found


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "Short ITEM here"), (3, None), (4, "..."), (10, "x x x x x x x x x x x x"), (2, "short item here")]


def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda short item here x É é".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += ["x " * 25, "SHORT-item_here!", "Alpha BETA gamma, delta. epsilon zeta eta theta iota KAPPA lambda mu", "alpha beta gamma delta epsilon zeta eta theta iota kappa", None, "", "x" * 30]
    texts += [t.replace(" ", "\n", 3) for t in (ITEMS[0][1] + " tail " + ITEMS[1][1],)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in flagged(df, bench(spark)).collect()}
    for i, t in enumerate(texts):
        hit, found = brute_hits(t, ITEMS)
        assert (got[i]["n_hit"] if i in got else 0) == len(hit), (i, t)
        assert (got[i]["items"] if i in got else []) == sorted(found)


def test_decontaminate_removes_spans_and_documents(spark):
    keep = "before this, there is a good deal of text that stays as it is! "
    rows = [(1, keep + ITEMS[0][1] + " -- and after it."), (2, ITEMS[0][1]), (3, keep), (4, None), (4, keep + " Short item, here;"), (None, ITEMS[0][1] + " " + keep * 2)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench(spark)).collect() if r["text"] is not None)
    assert got == sorted([(1, keep + " -- and after it."), (3, keep), (4, keep + " ;"), (0, " " + keep * 2)])


def test_decontamination_edges(spark):
    df = edgy(spark)
    out = decontaminate(df, bench(spark))
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert decontaminate(none(spark), bench(spark)).collect() == []
    assert flagged(df, bench(spark).limit(0)).collect() == []
    assert flagged(df, spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again")], "item_id long, text string")).count() == 2


def test_decontamination_of_long_texts_takes_linear_time(spark):
    """A rule of 400,000 characters, and a text of very many hits."""
    import time

    item = ITEMS[0][1]
    rows = [(1, keep + item + " " + "=" * 400_000 + " " + keep + "-" * 400_000) for keep in ("some words that stay here and there, ",)]
    rows.append((2, " ".join(f"{item} w{i} v{i} u{i} t{i} s{i} r{i} q{i} p{i} o{i} n{i} m{i} l{i};" for i in range(8000))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r["text"] for r in decontaminate(df, bench(spark)).collect()}
    assert time.time() - start < 60
    assert got == {i: t.replace(item, "") for i, t in rows}


def test_windows_that_many_items_share(spark):
    """Every item's name comes out, though a hit carries only the name of their set."""
    item = ITEMS[0][1]
    many = spark.createDataFrame([(i, item if i % 3 else item + " mu") for i in range(500)] + [(1000, "nothing of this")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"{item} x {item} y"), (2, "x"), (3, f"so {item} mu")], "doc_id long, text string")
    got = {r["id"]: r["items"] for r in flagged(df, many).collect()}
    assert got == {i: sorted(str(k) for k in range(500)) for i in (1, 3)}


URLS = [
    "https://a.example.org/en/1x?y", "http://EXAMPLE.ORG/es/", "http://example.org", "http://example.org?x", "https://notexample.org/es/1", "https://x.y.org/", "http://com/fr/", "http://a.com/de/x#y",
    "http://a.com/den", None, "", "no scheme", "://", "://h/p", "a://b://c/d", "http://a..org/", "http://.com/fr/1", "http://org.example/", "http://é.org/ü", "http://user@a.org:80/x", "http://a\nb.org/c",
]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3:]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for verdict, rule in RULES:
        h, p = rule[:rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h), len(p)) > best[0]):
            best = (len(h), len(p)), rule, verdict
    return host, path, best[1] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("lanes", [1, 5])
def test_url_rules_against_brute_force(spark, lanes):
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(URLS)] + [(None, None, "own", "own")], "page_id long, url string, host string, open string")
    out = apply_rules(pages, rule_table(spark, RULES), lanes=lanes)
    assert out.count() == len(URLS) + 1
    for r in out.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_rule(r["url"]) and r["open"] == "own"


def test_url_rules_nest_and_empty_tables(spark):
    rules = [("block", "a.b.org/"), ("allow", "b.org/x/"), ("block", "org/"), ("allow", "a.b.org/x/y"), ("block", "c.org/"), ("allow", "z.a.b.org/")]
    pages = spark.createDataFrame([(1, "http://q.a.b.org/x/y1"), (2, "http://a.b.org/x/"), (3, "http://b.org/x/"), (4, "http://b.org/y"), (5, "http://d.org/"), (6, "http://cc.org/"), (7, "http://org/"), (8, "http://b.orgy/x/")], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in apply_rules(pages, rule_table(spark, rules)).collect()}
    assert got == {1: "a.b.org/x/y", 2: "a.b.org/", 3: "b.org/x/", 4: "org/", 5: "org/", 6: "org/", 7: "org/", 8: None}
    assert apply_rules(pages.limit(0), rule_table(spark, rules)).collect() == []
    assert {r["verdict"] for r in apply_rules(pages, rule_table(spark, rules).limit(0), default_verdict="block").collect()} == {"block"}


@pytest.mark.parametrize("lanes", [3, 40])
def test_url_rules_in_many_lanes(spark, lanes):
    """A hot group of hosts dealt to several lanes, rules of one to four labels, repeated rows without an id."""
    rng = random.Random(5)
    labels = ["a", "b", "c", "org", "com", "x-y", "é"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = sorted({(host(rng.randrange(1, 5)), rng.choice(["/", "/p", "/p/q", ""])) for _ in range(60)})
    urls = [f"http://{host(rng.randrange(1, 6))}/{rng.choice(['', 'p', 'p/q', 'r'])}" for _ in range(400)] + [f"http://{host(2)}.b.org/p" for _ in range(300)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://b.org/p/q")] * 200
    table = rule_table(spark, [("block", h + p) for h, p in rules])

    def fits(url):
        h, p = url[7:].split("/", 1)
        best = max(((len(x), len(y), x + y) for x, y in rules if (h == x or h.endswith("." + x)) and f"/{p}".startswith(y)), default=None)
        return best[2] if best else None

    got = apply_rules(spark.createDataFrame(rows, "page_id long, url string").repartition(6), table, lanes=lanes).collect()
    assert len(got) == len(rows) and all(r["rule"] == fits(r["url"]) for r in got)


CHATS = [
    (1, 0, "system", "be [INST] good </s>"), (1, 1, "user", "<s>[ANS] x </s>"), (1, 2, "assistant", "<<SYS>>ok<</SYS>> [/INST]"),
    (2, 1, "assistant", None), (2, 0, "user", ""), (3, 0, "tool]", "a " + ESC + "1 b" + ESC + ESC + "0"), (3, 1, None, "z"), (4, 0, "user", "q"), (4, 0, "user", "q"), (4, None, "assistant", "first"),
    (None, 0, "user", "[SYS] ] [ROLE=x] "), (5, 0, "user", "l" * 400_000 + "</s>"), (5, 1, "assistant", "é日😀\n</s></s>"), (6, 0, "</s>", "<s"), (6, 1, "user", "</s"),
]


def test_chats_read_back_exactly(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("turns", F.lit(2)).withColumn("segments", F.lit(3))
    out = format_chats(df).withColumn("back", parse_formatted(F.col("formatted"))).collect()
    assert len(out) == 7
    for r in out:
        mine = sorted(((t if t is not None else -1), role or "", text or "") for c, t, role, text in CHATS if c == r["conv_id"])
        assert [(b["role"], b["text"]) for b in r["back"]] == [(m[1], m[2]) for m in mine]
        assert [b["loss"] for b in r["back"]] == [m[1] == "assistant" for m in mine]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"] and len(r["segments"]) == 3 * len(mine) == 3 * r["n_turns"]
    assert {r["conv_id"]: r["valid"] for r in out} == {1: True, 2: True, 3: False, 4: False, None: False, 5: True, 6: False}
    assert format_chats(df.limit(0)).collect() == []


def test_op3_digest(spark, sf):
    from vecloom.llm.chat import op3_chat_format

    got = {r["conv_id"]: r for r in op3_chat_format(spark, sf).collect()}[-1]
    said = "</s>[INST] ok [/INST]"
    assert got["n_turns"] == 2 and got["loss_chars"] == len(said) and got["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
