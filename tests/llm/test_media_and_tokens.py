import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecloom.llm import telephony, tokens
from vecloom.llm.telephony import decode_media, describe_pcm, ima_decode, read_wave, resampled, store_media, store_pcm, wave
from vecloom.llm.textkernels import Shingler, WordHasher, break_table, pieces, utf8

from .cases import edgy, none


def test_tables_follow_the_standard():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert mu[0xFF] == 0 and mu[0x7F] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124 and mu[0xF0] == 120
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255


def ima_one(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = telephony.IMA_STEPS[index]
            d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value + (-d if code & 8 else d)))
            index = max(0, min(88, index + telephony.IMA_MOVES[code & 7]))
            out.append(value)
    return out


def test_ima_blocks_against_one_by_one():
    data = np.random.default_rng(1).integers(0, 256, (9, 64), np.uint8)
    assert ima_decode(data).tolist() == [ima_one(bytes(b)) for b in data]
    assert ima_decode(np.zeros((0, 64), np.uint8)).shape == (0, 121)


def test_resampling():
    x = np.array([0, 10, -20, 7], np.int16)
    assert resampled(x, 8000, 16000).tolist() == [0, 5, 10, -5, -20, -7, 7, 7]
    assert resampled(x, 16000, 8000).tolist() == [5, -7] and resampled(x[:3], 16000, 8000).tolist() == [5]
    assert resampled(x, 8000, 8000) is x and len(resampled(x, 8000, 12000)) == 6 and len(resampled(x[:0], 8000, 16000)) == 0


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima"])
def test_media_round_trip(spark, codec):
    df = edgy(spark)
    stored = store_media(df, codec=codec)
    texts = sorted((r["text"] or "").encode() for r in df.collect())
    got = stored.collect()
    assert len(got) == df.count()
    unit = 256 if codec == "ima" else 64
    back = sorted(bytes(read_wave(bytes(r["media"]))[2])[:r["n_bytes"]] for r in got)
    assert back == texts and all(len(read_wave(bytes(r["media"]))[2]) % unit == 0 for r in got)
    pcm = decode_media(stored).collect()
    assert all(len(r["pcm"]) > 0 and r["sample_rate"] == 16000 for r in pcm) and decode_media(stored.drop("media").withColumn("media", F.lit(None).cast("binary"))).first()["pcm"] is None
    assert store_media(none(spark), codec=codec).collect() == []
    with pytest.raises(ValueError):
        read_wave(b"RIFFxxxx")


def pcm_of(media):
    """One file's samples, block by block and sample by sample."""
    codec, rate, payload, block = read_wave(media)
    if codec == "ima":
        x = [v for k in range(0, len(payload), block) for v in ima_one(bytes(payload[k:k + block]))]
    else:
        x = [int({"mulaw": telephony.mulaw_table, "alaw": telephony.alaw_table}[codec]()[b]) for b in payload]
    return x if rate == 8000 else [(a + b) >> 1 for a, b in zip(x[::2], x[1::2])]


@pytest.mark.parametrize("held", [1 << 22, 500])
def test_op5_digests(spark, monkeypatch, held):
    """All three codecs; digests and features against files and samples made one by one."""
    monkeypatch.setattr(telephony, "HELD", held)
    extra = spark.createDataFrame([(100 + i, f"text {i} " * i) for i in range(40)], "doc_id long, text string")
    df = edgy(spark).select("doc_id", "text").where("doc_id is null or doc_id <> 5").unionByName(extra)
    stored = store_pcm(store_media(df, codec=None))
    got, used = {}, set()
    for r in describe_pcm(stored).collect():
        got.setdefault((r["doc_id"], r["n_bytes"]), r)
    assert len(stored.collect()) == df.count()
    for r in df.collect():
        raw = (r["text"] or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        g = got[r["doc_id"], len(raw)]
        assert (g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        codec = telephony.dealt(want)
        media = wave(want, codec, telephony.DEALT_RATES[codec], 64)
        assert (g["media_bytes"], g["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert bytes(read_wave(media)[2]) == want
        assert g["feature"] == f"codec={codec};rate=8000;" + telephony.features(np.array(pcm_of(media), np.int16))
        used.add(codec)
    assert used == {"mulaw", "alaw", "ima"}
    assert describe_pcm(store_pcm(store_media(none(spark), codec=None))).collect() == []


def own_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_encoder_equals_the_library():
    rng = random.Random(1)
    parts = ["a", "b", "s", "t", "re", "ve", "ll", "d", "m", "'", "''", " ", "  ", "\n", "\t", "\r\n", ".", ",", "!!", "1", "23", "é", "ß", "Ñ", "×", "÷", "日", "—", '"', "<|endoftext|>", "don't", "I'll ", "²", "_", "\x0b", "\x1f", "\xa0", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 16))) for _ in range(4000)] + [None, "", " ", "'", "'s", "'r", "x'", "x'l", " 's", "\n's", "a  's", "it's's"]
    enc, lib = tokens.Encoder(tokens.default_tokenizer()), own_tokenizer()
    for _, _, data, own in pieces(*utf8(pa.array(texts)), 1000):
        ids, n = enc.encode(data, own)
        at = 0
        for k in range(len(own) - 1):
            text = bytes(data[own[k]:own[k + 1]]).decode()
            assert ids[at:at + n[k]].tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)
            at += n[k]


def test_piece_table_grows_and_collides():
    table = tokens.PieceTable(8)
    h = np.arange(1, 4000, dtype=np.uint64) * np.uint64(8)
    for part in np.array_split(h, 17):
        table.add(part)
    assert table.find(h).tolist() == list(range(len(h))) and table.find(np.array([3, 5], np.uint64)).tolist() == [-1, -1]


def test_token_files_round_trip(spark, tmp_path):
    df = edgy(spark)
    base, manifest = tokens.write_shards(df, tokens.default_tokenizer(), str(tmp_path / "t"), length=64)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read_documents(base, manifest).collect()), key=lambda r: r[0])
    lib, start = own_tokenizer(), 0
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in df.collect()))
    assert len(got) == len(rows)
    for g, (has, i, _, text) in zip(got, rows):
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert g == (start, i if has else None, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = manifest.first()["shard"]
    reader = tokens.read_sequences(base, shard)
    batch = reader.get_batch(0)
    assert batch.schema.field("ids").type.list_size == 64 and batch.num_rows >= 1
    before = pa.total_allocated_bytes()
    one = batch.column("ids")[0].values.to_numpy(zero_copy_only=True)
    assert len(one) == 64 and pa.total_allocated_bytes() == before
    empty = tokens.write_shards(none(spark), tokens.default_tokenizer(), str(tmp_path / "e"))
    assert empty[1].collect() == [] and tokens.read_documents(*empty).collect() == []


def test_word_hashes():
    hasher = WordHasher(break_table(" \n"))
    texts = ["the cat", "", " the  THE\ncat", "éa aé", "x" * 3_000_000, "ab ba"]
    seen = {}
    for i, j, data, own in pieces(*utf8(pa.array(texts))):
        s, e, first = hasher.spans(data, own)
        h = hasher.hashes(data, s, e)
        for k in range(j - i):
            seen[i + k] = h[first[k]:first[k + 1]].tolist()
    assert [len(seen[k]) for k in range(6)] == [2, 0, 3, 2, 1, 2]
    assert seen[0] == [seen[2][0], seen[2][2]] and seen[2][0] == seen[2][1] and len({*seen[3], *seen[5]}) == 4


def test_shingles():
    raw, off = utf8(pa.array(["a b c d e", "A b C d e f", "a b", "", "x x x x x x", "b a"]))
    grams, bound = Shingler(4).sets(raw, off)
    parts = [set(grams[a:b].tolist()) for a, b in zip(bound[:-1], bound[1:])]
    assert [len(p) for p in parts] == [2, 3, 1, 0, 1, 1] and parts[0] < parts[1] and not parts[2] & parts[5]


def complements(n):
    """Two strings of length 2 ** n, each the other's complement, on which polynomial hashes modulo 2 ** 64 agree."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def ids_of(enc, texts, limit=1 << 18):
    out = []
    for _, _, data, own in pieces(*utf8(pa.array(texts)), limit):
        ids, n = enc.encode(data, own)
        out += [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])]
    return out


def test_pieces_are_known_by_their_bytes(monkeypatch):
    texts = [f" {t}" for n in (3, 4, 10, 11) for t in complements(n)] + ["=" * 5000, " " * 70, "x" * 17 + " " + "x" * 16]
    lib = own_tokenizer()
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(tokens.Encoder(tokens.default_tokenizer()), texts) == want
    # every piece under one hash: the bytes alone tell them apart
    monkeypatch.setattr(tokens, "mixed", lambda h: h & np.uint64(0))
    assert ids_of(tokens.Encoder(tokens.default_tokenizer()), texts * 2, 100) == want * 2


@pytest.mark.parametrize("collide", [False, True])
def test_forgetting_pieces_changes_no_ids(monkeypatch, collide):
    rng = random.Random(3)
    often = ["the", "of", "don't", "Straße", "x" * 20, "12", "..."]
    texts = [" ".join(rng.choice(often) if rng.random() < 0.5 else "".join(rng.choices("abcdeé'1.", k=rng.randrange(1, 24))) for _ in range(40)) for _ in range(300)]
    lib = own_tokenizer()
    monkeypatch.setattr(tokens, "REMEMBERED", 200)
    if collide:
        monkeypatch.setattr(tokens, "mixed", lambda h: h & np.uint64(7))
    enc = tokens.Encoder(tokens.default_tokenizer())
    forgot, forget = [], enc.forget
    enc.forget = lambda: (forget(), forgot.append(enc.learnt))
    assert ids_of(enc, texts, 2000) == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    # what was met again stays, within half of the room
    assert len(forgot) > 5 and max(forgot) <= 100 and (collide or min(forgot) >= 3)


def test_files_with_other_rules_go_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    rules = json.load(open(tokens.default_tokenizer(), encoding="utf-8"))
    rules["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules))
    texts = ["one two", "", "it's 12"]
    lib = Tokenizer.from_file(str(path))
    assert ids_of(tokens.Encoder(str(path)), texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_structured_words_do_not_collide():
    for n in (10, 11, 12):
        raw, off = utf8(pa.array(list(complements(n))))
        grams, bound, sums = Shingler(4).sets(raw, off, True)
        assert len(bound) == 3 and grams[0] != grams[1] and sums[0].tolist() != sums[1].tolist()
