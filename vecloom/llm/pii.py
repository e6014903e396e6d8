"""Operator 4: personal data by candidate gradient boosting.

Fixed patterns with their checks (address ranges, the Luhn sum, digit counts)
give base spans, which always stay.  On top of them, high-recall generators
propose overlapping candidates (spelled-out mail addresses, digit groups
without a plus sign, IPv6, account numbers, long keys).  Boosted trees score a
candidate by its format and its context; they are fitted on a bounded sample
of the corpus whose weak labels come from the checked patterns, with the
checks themselves left out of the features.  What only a generator finds is
unlabelled, not negative: negatives are clear ones (failed checks, dates,
versions, bare numbers, names made of words), and a candidate is described in
the form that the checked patterns know, so that its spelling doesn't give it
away; what labels a key, an assignment before it, is no feature of keys.
Thresholds are calibrated on candidates of texts that the trees haven't seen
for a stated precision and select the added spans.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import WRITING, settings, shared
from .boosting import Boosted, between, calibrate, fit

KINDS = ("email", "ip", "card", "phone", "account", "secret")
#: Texts with a digit or an at sign from which the trees learn, at most, and candidates of one of them.
SAMPLED, EACH = 4000, 64
PRECISION = 0.95
#: Texts handled at once by a worker.
ROWS = 400

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
GENERATORS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}){0,8}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){2,4}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ -]?[0-9]{2,6}){2,5}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\+|00)?\(?[0-9][0-9 ().\-/]{5,24}[0-9](?![0-9])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_])(?=[A-Za-z_-]{0,60}[0-9])(?=[0-9_-]{0,60}[A-Za-z])[A-Za-z0-9_-]{16,128}(?![A-Za-z0-9_])")),
)
CONTEXT = ("mail", "contact", "call", "phone", "tel", "fax", "card", "visa", "iban", "account", "ip", "host", "server", "token", "key", "secret", "password", "version", "page", "isbn")
#: Words that label a key when it is assigned to them.
ASSIGNED = ("token", "key", "secret", "password", "passwd", "pwd")
ASSIGNS = re.compile(rf"(?i)(?:{'|'.join(ASSIGNED)})['\"]?\s*[=:]\s*['\"]?$")
#: Parts of a name made of words, of a version or of a date.
PLAIN_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4}|v[0-9]{1,3}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of checked matches; leftmost, not overlapping within a kind, failed ones dropped."""
    found = []
    low, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > low and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at) if s < at else None
        if m:
            found.append((s, 0, m.end()))
            low = m.end()
        at = text.find("@", m.end() if m else at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of everything the generators propose."""
    if "@" not in text and not DIGIT.search(text) and "at]" not in text and "at)" not in text:
        return []
    return sorted((m.start(), KINDS.index(kind), m.end()) for kind, pattern in GENERATORS for m in pattern.finditer(text))


AT, DOT = re.compile(r" ?(?:\[at\]|\(at\)) ?"), re.compile(r" ?(?:\[dot\]|\(dot\)) ?")
DATE = re.compile(r"[0-9]{4}([-/. ])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])|[0-9]{1,2}([-/. ])[0-9]{1,2}\2[0-9]{4}(?![0-9])")
#: Words right before a number that is a version, a page, a book or an order, and words that announce a phone number.
NUMBERED = re.compile(r"\b(?:version|v|release|page|pages|isbn|order|id|no|nr)[ .:#]*$")
CALLED = re.compile(r"\b(?:call|phone|tel|telephone|fax|mobile|contact|dial|reach|sms)\b")


def plain(body: str, kind: int) -> str:
    """A candidate in the form of the checked patterns: at and dot signs, four numbers for a whole IPv6 address, a phone number without its country and with spaces only."""
    if kind == 0:
        return DOT.sub(".", AT.sub("@", body))
    if kind == 1 and body.count(":") == 7:
        words = [int(x, 16) for x in body.split(":")]
        return ".".join(str((a ^ b) & 255) for a, b in zip(words[::2], words[1::2]))
    if kind == 3:
        national = re.sub(r"^(?:\+|00)[0-9]{1,3}(?=[ ().\-/])", "", body).removeprefix("+").removeprefix("00")
        return re.sub(r"[ ().\-/]+", " ", national).strip()
    return body


def describe(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format and context features of a candidate."""
    s, kind, e = span
    body = plain(text[s:e], kind)
    digits = sum(c in "0123456789" for c in body)
    upper = sum(c.isupper() for c in body)
    groups = [len(g) for g in re.findall(r"[0-9]+", body)] or [0]
    before, after = text[max(0, s - 40):s].lower(), text[e:e + 20].lower()
    left, right = text[s - 1:s], text[e:e + 1]
    words = re.findall(r"[a-z]+", before)
    return [
        *(float(kind == k) for k in range(len(KINDS))), len(body), digits, digits / len(body), upper / len(body), len(groups), max(groups), min(groups),
        body.count("."), body.count("-"), body.count(" "), body.count("@"), body.count(":"), float(body.startswith("0")),
        len(set(body)) / len(body) if kind > 3 else -1.0, max((int(g) for g in re.findall(r"[0-9]{1,9}", body)), default=0) if kind == 1 else -1.0,
        float(left in " \n\t(\"'<:" or not left), float(right in " \n\t.,;)\"'>" or not right),
        *(0.0 if kind == 5 and w in ASSIGNED else float(w in words or any(x.startswith(w) for x in words if len(w) > 2)) for w in CONTEXT),
        0.0 if kind == 5 else float("=" in before[-4:] or ":" in before[-3:]), float(after[:1].isalnum()),
    ]


def clearly_not(text: str, span: tuple[int, int, int], base: set[tuple[int, int, int]]) -> bool:
    """A candidate of a base kind that a check refutes, or that is plainly something else."""
    s, kind, e = span
    body, before = plain(text[s:e], kind), text[max(0, s - 40):s].lower()
    digits = re.sub("[^0-9]", "", text[s:e])
    if kind == 0:
        return "." not in body[body.find("@"):]
    if kind == 1:
        parts = body.split(".")
        return len(parts) != 4 or any(not p.isdigit() or int(p) > 255 for p in parts) or NUMBERED.search(before) is not None
    if kind == 2:
        return not 13 <= len(digits) <= 19 or not luhn(digits)
    other = any(k in (1, 2) and a <= s and e <= b for a, k, b in base)
    bare = text[s:e].isdigit() and not CALLED.search(before)
    return other or bare or not 7 <= len(digits) <= 15 or DATE.match(text[s:e]) is not None or NUMBERED.search(before) is not None


def weak_label(text: str, span: tuple[int, int, int], base: set[tuple[int, int, int]]) -> int | None:
    """1 when a checked pattern agrees: the same span for a base kind; for others their own checksum or an assignment.

    Others are 0 only if clearly something else, and None, unlabelled, if the
    checks just don't reach them.
    """
    s, kind, e = span
    if kind < 4:
        return 1 if span in base else 0 if clearly_not(text, span, base) else None
    body = text[s:e]
    if kind == 4:
        c = body.replace(" ", "")
        return int(int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1)
    if ASSIGNS.search(text[max(0, s - 24):s]):
        return 1
    parts = [p for p in re.split(r"[_-]+", body) if p]
    return 0 if len(parts) > 1 and all(PLAIN_PART.fullmatch(p) for p in parts) else None


class Selector:
    """Fitted trees and a threshold for each kind."""

    def __init__(self, model: Boosted, least: list[float]):
        self.model, self.least = model, np.array(least)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates above their thresholds that touch no base span and no better candidate.

        What is taken is marked on a line as long as the text, so the time
        grows with the candidates' length and not with their number squared.
        """
        cand = candidates(text)
        if not cand:
            return []
        p = np.concatenate([self.model.probability(np.array([describe(text, c) for c in cand[k:k + 4096]])) for k in range(0, len(cand), 4096)])
        out, taken = [], bytearray(len(text))
        for s, _, e in base:
            taken[s:e] = b"\1" * (e - s)
        for k in np.argsort(-p, kind="stable").tolist():
            s, kind, e = cand[k]
            if p[k] >= self.least[kind] and taken.find(1, s, e) < 0:
                out.append(cand[k])
                taken[s:e] = b"\1" * (e - s)
        return out


def _few(spans: list[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    """At most so many spans, those of the smallest hash."""
    return spans if len(spans) <= most else sorted(spans, key=lambda c: (zlib.crc32(b"%d:%d" % (c[0], c[1])), c))[:most]


def fit_selector(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sampled: int = SAMPLED, precision: float = PRECISION, each: int = EACH) -> Selector:
    """Trees and thresholds from the ``sampled`` different texts of the smallest hash that have a digit or an at sign.

    A text's candidates are found where it lies; the driver gets ``each`` of
    them at most.  Half of the texts, by their hash, fit the trees, the others
    calibrate, with each string once and none that the trees have seen.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, found, bodies = [], [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = set(base_spans(text))
                labelled = {c: y for c in candidates(text) if (y := weak_label(text, c, base)) is not None}
                hashes.append(h)
                few = _few(list(labelled), each)
                found.append(np.array([[float(labelled[c]), *describe(text, c)] for c in few], np.float32).tobytes())
                bodies.append(b"".join(hashlib.blake2b(f"{c[1]}:{text[c[0]:c[2]]}".encode(), digest_size=8).digest() for c in few))
            yield pa.record_batch([pa.array(hashes, pa.int64()), pa.array(found, pa.binary()), pa.array(bodies, pa.binary())], ["h", "x", "body"])

    text = F.col(f"`{text_col}`")
    usable = docs.where(text.rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), text.alias("text"))
    # hashes alone are ordered; of copies, which a sample may hold in any number, one task after the other keeps one
    chosen = usable.select("h").distinct().orderBy("h").limit(sampled).select(F.col("h").alias("_h"))
    picked = usable.join(F.broadcast(chosen), F.col("h") == F.col("_h")).select("h", "text")
    with settings(docs.sparkSession, WRITING):
        got = picked.mapInArrow(rows, "h long, x binary, body binary").groupBy("h").agg(F.min(F.struct("x", "body")).alias("m")).select("h", "m.*").collect()
    width = 1 + len(describe("0", (0, 0, 1)))
    parts = sorted(((r["h"], np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, width), np.frombuffer(bytes(r["body"]), np.int64)) for r in got if r["x"]), key=lambda p: p[0])
    if not parts:
        return Selector(Boosted(base=-10.0), [1.1] * len(KINDS))
    data, body = np.concatenate([x for _, x, _ in parts]), np.concatenate([b for _, _, b in parts])
    half = np.repeat([h % 2 == 0 for h, _, _ in parts], [len(x) for _, x, _ in parts])
    first = np.unique(body[~half], return_index=True)[1]
    fitted, tested = data[half], data[~half][np.sort(first[~np.isin(body[~half][first], body[half])])]
    x, y, tx, ty = fitted[:, 1:].astype(float), fitted[:, 0].astype(float), tested[:, 1:].astype(float), tested[:, 0].astype(float)
    model = fit(x, y)
    calibrate(model, tx, ty)
    p = model.probability(tx)
    least = []
    for k in range(len(KINDS)):
        own = tx[:, k] == 1
        least.append(max(0.5, between(p[own], ty[own], precision)))
    return Selector(model, least)


def written(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_pii(docs: DataFrame, selector: Selector, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base counts n_email, n_ip, n_card, n_phone, n_added (spans of the method), base and spans (written; code points, end exclusive).

    Null and empty texts have none.  Rows stay one for one, repeated rows and
    rows without an id included; other columns are not read; an empty table
    stays empty.  A very long text is searched whole, in time that grows with
    its length.  Candidates of equal probability are taken from left to right.
    """
    sent = shared(docs.sparkSession, selector)
    body = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    numbers = ("n_email", "n_ip", "n_card", "n_phone", "n_added")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser = pickle.loads(sent.value)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                counts, base_out, spans_out = [[], [], [], [], []], [], []
                for text in part.column(1).to_pylist():
                    base = base_spans(text) if text else []
                    more = chooser.added(text, base) if text else []
                    for k in range(4):
                        counts[k].append(sum(b[1] == k for b in base))
                    counts[4].append(len(more))
                    base_out.append(written(base))
                    spans_out.append(written(base + more))
                yield pa.record_batch(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_out, pa.string()), pa.array(spans_out, pa.string())],
                    [id_col, *numbers, "base", "spans"])

    schema = T.StructType([body.schema[id_col], *(T.StructField(n, T.LongType()) for n in numbers), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
    return body.mapInArrow(rows, schema)


def redact(text: str, spans: str) -> str:
    """The text with each written span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for part in filter(None, spans.split(",")):
        kind, s, e = part.split(":")
        if int(s) >= at:
            out += [text[at:int(s)], f"[{kind.upper()}]"]
        at = max(at, int(e))
    return "".join([*out, text[at:]])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; n_spans counts all spans, the method's among them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, fit_selector(docs))
    counts = ("n_email", "n_ip", "n_card", "n_phone")
    every = F.col("n_added")
    for c in counts:
        every = every + F.col(c)
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", every.alias("n_spans"))
