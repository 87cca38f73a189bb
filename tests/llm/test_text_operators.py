"""BPE, packing, secrets, language ID, SimHash: against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernspark.llm import bpe, entries, langid, packing, secrets, simhash
from fernspark.llm.common import components

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", "éa\u0301 ß İ Σας ΟΔΥΣΣΕΥΣ", "x " * 3000, "y" * 5000, "<|endoftext|> it's I'LL, x... 12ab ½ ª \x1c\x85　b", "日本語 👩‍👩‍👧"]


def odd(spark, column="text"):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(ODD)] + [(3, ODD[3], "c", "c"), (None, "no id", "c", "c"), (None, None, None, None)]
    return spark.createDataFrame(rows, f"doc_id long, {column} string, spans string, decoded string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'sé \n\t\r\x1c\x85 1.,"), max_size=200), st.integers(1, 20))
def test_pieces_encode_like_the_whole(text, size):
    enc = bpe.encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    assert "".join(bpe.safe_pieces(text, size)) == text
    assert bpe.encode_text(enc, text, size) == enc.encode_ordinary(text)


def test_bpe(spark, encoding):
    got = bpe.encode(odd(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        text = "no id" if r.doc_id is None and r.token_ids else None if r.doc_id is None else ODD[r.doc_id]
        assert r.token_ids == encoding.encode_ordinary(text or "") and bytes(r.decoded) == (text or "").encode()
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    again = bpe.decode(spark.createDataFrame(got), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted(bytes(r.decoded) for r in got)


def test_bpe_query(spark, sf, encoding):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in entries.op7_byte_bpe(spark, sf).collect():
        ids = encoding.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


@pytest.fixture(scope="module")
def word_ids():
    return packing.WordIds(open(WORDS, "rb").read())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("aAéÉ.,' \nsİΣσ\u0301µª½1x"), max_size=60))
def test_words_have_the_tokenizers_ids(text):
    w = packing._loaded.setdefault(0, packing.WordIds(open(WORDS, "rb").read()) if 0 not in packing._loaded else packing._loaded[0])
    want = w.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(w.texts([text])[0], np.uint32).tolist() == want


def packed_rows(spark, docs, word_ids, capacity):
    pieces = packing.cut(docs, WORDS, capacity=capacity)
    rows = packing.pack(pieces, capacity=capacity).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= capacity and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
    return rows, len(sequences)


def test_packing(spark, word_ids):
    rows, n = packed_rows(spark, odd(spark), word_ids, 64)
    by_doc = defaultdict(dict)
    for r in rows:
        if r.doc_id is not None and r.doc_id != 3:
            by_doc[r.doc_id][r.piece] = r
    for i, pieces in by_doc.items():
        want = np.array([*word_ids.tokenizer.encode(ODD[i] or "", add_special_tokens=False).ids, 1], np.uint32).tobytes()
        assert b"".join(bytes(pieces[k].ids) for k in range(len(pieces))) == want
        assert all(p.start == 64 * k and (p.length == 64 or k == len(pieces) - 1) for k, p in pieces.items())
    assert n <= -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack(packing.cut(empty(spark), WORDS)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sum_of_squares_takes_the_least(sizes):
    capacity = 20
    bins, at = packing.sum_of_squares(np.array(sizes, np.int64), capacity)
    gaps: dict[int, int] = {}
    for s, b, a in zip(sizes, bins.tolist(), at.tolist(), strict=True):
        assert gaps.get(b, capacity) == capacity - a
        squares = lambda g: sum(sum(x == k for x in g.values()) ** 2 for k in range(1, capacity))
        fits = {k: squares({**gaps, k: g - s}) for k, g in gaps.items() if g >= s}
        assert (b in fits) == bool(fits)
        gaps[b] = gaps.get(b, capacity) - s
        assert not fits or squares(gaps) == min(fits.values())


def test_packing_query(spark, sf):
    rows = entries.op10_packing(spark, sf).collect()
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4096)
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}


def brute_base(text):
    out = []
    for kind, rx, least in (("assign", secrets.ASSIGN, 12), ("access", secrets.ACCESS, 0), ("hex", re.compile("[0-9a-f]+"), 16)):
        at = 0
        while m := rx.search(text, at):
            at = m.end()
            n = len(m[2]) if kind == "assign" else len(m[0])
            if n >= (18 if kind == "access" else least):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


@settings(max_examples=300, deadline=None)
@given(
    st.text(st.sampled_from("token=: 'AKI0123abcdefé."), max_size=80)
    | st.lists(st.sampled_from(["token", "ſecret", "secret", "=", ":", " ", "'", "api_key", "PASSWORD", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "f", "é", "."]), max_size=20).map("".join)
)
def test_base_spans(text):
    got = sorted((s for s in secrets.find(text) if s[0] in ("assign", "access", "hex")), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    assert got == brute_base(text)


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body


def test_confirmed_spans():
    integer = lambda n: der(2, b"\x01" * n)
    rsa = der(0x30, der(2, b"\0"), *[integer(40) for _ in range(8)])
    sec1 = der(0x30, der(2, b"\1"), der(4, b"\x05" * 32))
    oid = der(0x30, der(6, b"\x2a\x86\x48"), der(5))
    pkcs8 = der(0x30, der(2, b"\0"), oid, der(4, rsa))
    spki = der(0x30, oid, der(3, b"\0" + b"\x07" * 60))
    for key in (rsa, pkcs8, sec1):
        text = "é key " + base64.b64encode(key).decode() + " end"
        assert ("der", 6, 6 + len(base64.b64encode(key))) in secrets.find(text)
        assert ("der", 6, 6 + 2 * len(key)) in secrets.find("é key " + key.hex().upper() + " end")
        assert not [s for s in secrets.find(base64.b64encode(key[:-1]).decode()) if s[0] == "der"]
        pem = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END PRIVATE KEY-----"
        assert [s[0] for s in secrets.find(pem) if s[0] not in ("hex",)] == ["pem"]
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2ln"
    assert ("jwt", 3, 3 + len(token)) in secrets.find("at " + token)
    assert not [s for s in secrets.find(f"{part({'typ': 'JWT'})}.{part({'sub': '1'})}.c2ln") if s[0] == "jwt"]
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = base64.b64encode(b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"k" * 51) + field(b"s" * 90)).decode()
    assert ("sshkey", 4, 4 + len(ssh)) in secrets.find("key " + ssh) and not secrets.confirmed_spans(base64.b64encode(b"openssh-key-v1\0" + b"k" * 40).decode())
    # Public keys and unsigned tokens are no secrets.
    public = field(b"ssh-ed25519") + field(b"k" * 32)
    for shown in (base64.b64encode(spki).decode(), spki.hex().upper(), "ssh-ed25519 " + base64.b64encode(public).decode(), base64.b64encode(der(0x30, integer(100), der(2, b"\1\0\1"))).decode()):
        assert not secrets.confirmed_spans("key " + shown + " end")
    assert not secrets.confirmed_spans("-----BEGIN PUBLIC KEY-----\n" + base64.encodebytes(spki).decode() + "-----END PUBLIC KEY-----")
    for head, sign in (({"alg": "none"}, "c2ln"), ({"alg": "HS256"}, "")):
        assert not secrets.confirmed_spans(f"{part(head)}.{part({'sub': '1'})}.{sign}")
    assert not secrets.find("M" + "A" * 60) and not secrets.find("30" + "é" * 40)


def test_encoded_keys():
    oid = der(0x30, der(6, b"\x2a\x86\x48"), der(5))
    key = der(0x30, der(2, b"\0"), oid, der(4, bytes(range(3, 250))))
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END PRIVATE KEY-----\n"
    for before in ("", "\n", "# a", "# é key\n"):  # as in a kubeconfig or a Secret
        inner = base64.b64encode((before + pem).encode()).decode()
        assert secrets.redact(f"client-key-data: {inner}\nuser: x") == "client-key-data: [PEM]\nuser: x"
    assert secrets.redact("k: " + base64.b64encode(base64.b64encode(pem.encode())).decode()) == "k: [PEM]"
    assert secrets.redact("k: " + pem.encode().hex().upper()) == "k: [PEM]"
    url = base64.urlsafe_b64encode(der(0x30, der(2, b"\0"), oid, der(4, b"\xfb\xff\xfe" * 30))).decode()
    assert "_" in url + "-" and set(url) & set("-_") and secrets.redact(f"k={url.rstrip('=')} z") == "k=[DER] z"
    wrapped = base64.encodebytes(key).decode()
    for text in (wrapped, wrapped.replace("\n", "\n    "), wrapped.replace("\n", "\r\n")):
        assert secrets.redact("key\n" + text.strip() + "\nThen more words") == "key\n[DER]\nThen more words"
    locked = der(0x30, der(0x30, der(6, b"\x2a\x86\x48"), der(0x30, oid, oid)), der(4, b"\x17" * 64))
    armour = "-----BEGIN ENCRYPTED PRIVATE KEY-----\n" + base64.encodebytes(locked).decode() + "-----END ENCRYPTED PRIVATE KEY-----"
    assert secrets.redact(armour) == "[PEM]" and secrets.redact(base64.b64encode(locked).decode()) == "[DER]"
    old = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,0123ABCD\n\n" + base64.encodebytes(b"\x91" * 96).decode() + "-----END RSA PRIVATE KEY-----"
    assert secrets.redact("a " + old + " z") == "a [PEM] z"
    digest = der(0x30, oid, der(4, b"\x05" * 32))
    for plain in (base64.b64encode(digest).decode(), base64.b64encode(b"plain words, " * 30).decode(), "a_long-name/" * 20, "word\n" * 50):
        assert not secrets.confirmed_spans(plain)


def plain_confirmed(text):
    """Armoured keys, signed tokens and one-line base64 or hex keys, by looking at every place."""
    out = []
    for m in re.finditer("-----BEGIN ([A-Z ]*PRIVATE KEY)-----", text):
        end = text.find(f"-----END {m[1]}-----", m.end())
        if end >= 0 and "-----" not in (inside := text[m.end() : end]):
            data = base64.b64decode("".join(x for x in inside.splitlines() if ":" not in x))
            if secrets.is_der_key(data) or secrets.is_ssh_key(data) or ("ENCRYPTED" in m[0] + inside and len(data) % 8 == 0):
                out.append(("pem", m.start(), end + len(f"-----END {m[1]}-----")))
    for m in re.finditer(r"(?<![\w-])(eyJ[\w-]+)\.(e[\w-]+)\.([\w-]+)", text, re.ASCII):
        if secrets.is_signed_token(m[1], m[2]):
            out.append(("jwt", *m.span()))
    apart = lambda a, b: not any(x <= a and b <= y for _, x, y in out)
    for m in re.finditer(r"(?<![\w+/-])[A-Za-z0-9+/_-]{32,}={0,2}", text, re.ASCII):
        run = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        at = 0
        while at < len(run):
            for end in range(len(run), at + 31, -1) if run[at] == "M" else ():
                if (end - at) % 4 != 1 and secrets.is_der_key(base64.b64decode(run[at:end] + "=" * (-(end - at) % 4))) and apart(m.start() + at, m.start() + end):
                    out.append(("der", m.start() + at, m.end() if end == len(run) else m.start() + end))
                    at = end - 1
                    break
            at += 1
    for m in re.finditer("(?<![0-9a-fA-F])[0-9a-fA-F]{64,}(?![0-9a-fA-F])", text):
        if len(m[0]) % 2 == 0 and secrets.is_der_key(bytes.fromhex(m[0])):
            out.append(("der", *m.span()))
    return out


def test_spans_by_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    key = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, bytes(range(3, 60))))
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    planted = ["-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END PRIVATE KEY-----", f"{part({'alg': 'RS256'})}.{part({'sub': '1'})}.c2ln", base64.b64encode(key).decode(), "xyz/" + base64.b64encode(key).decode(), key.hex()]
    for i, d in enumerate(sorted(docs)[:100]):  # among real texts
        at = len(docs[d]) // 2
        docs[d] = docs[d][:at] + " " + planted[i % len(planted)] + " " + docs[d][at:]
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    kinds = ("pem", "der", "jwt", "sshkey")
    found = 0
    for r in secrets.scan(table).collect():
        got = [(s.kind, s.start, s.end) for s in r.spans]
        want = brute_base(docs[r.doc_id]) + plain_confirmed(docs[r.doc_id])
        assert got == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2])), r.doc_id
        found += sum(k in kinds for k, _, _ in got)
    assert found >= 100


def test_many_spans_and_a_very_long_text():
    key = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, bytes(range(3, 60))))
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END PRIVATE KEY-----\n"
    text = (pem + "words between\n") * 20_000
    spans = secrets.find(text)
    assert len([s for s in spans if s[0] == "pem"]) == 20_000 and not [s for s in spans if s[0] == "der"]


@pytest.mark.parametrize("unit", ["MIJ/", "MIIE", "MAAC", "MIIEA", "MIIBAgEA", "TUlK\n", "MAMC"])
def test_work_grows_with_the_length(unit, monkeypatch):
    """Bytes decoded and heads of elements looked at: ten times the text, ten times as many at most, but for the ends."""
    n = {"bytes": 0, "heads": 0}
    decode, head = base64.b64decode, secrets.der_length

    def counted(s, *args, **more):
        n["bytes"] += len(s)
        return decode(s, *args, **more)

    def looked(data, at):
        n["heads"] += 1
        return head(data, at)

    monkeypatch.setattr(secrets.base64, "b64decode", counted)
    monkeypatch.setattr(secrets, "der_length", looked)
    seen = []
    for size in (100_000, 1_000_000):
        n.update(bytes=0, heads=0)
        secrets.find(unit * (size // len(unit)))
        assert n["bytes"] <= 40 * size and n["heads"] <= 40 * size
        seen.append(dict(n))
    assert seen[1]["bytes"] <= 10.1 * seen[0]["bytes"] + 1000 and seen[1]["heads"] <= 12 * seen[0]["heads"] + 1000


def test_many_keys_in_one_run():
    key = bytes([0x30, 37, 0x02, 1, 1, 0x04, 32]) + bytes(32)
    run = base64.b64encode(key * 3000).decode()
    spans = [s for s in secrets.find(run) if s[0] == "der"]
    assert spans == [("der", 52 * k, 52 * k + 52) for k in range(3000)]


def test_redaction():
    assert secrets.redact("a token = 'abcdefabcdefabcdef1234' z") == "a [ASSIGN]' z"
    assert secrets.redact("0123456789abcdef0") == "[HEX]" and secrets.redact("clean") == "clean" and secrets.redact(None) is None and secrets.redact("") == ""


def test_secret_scan(spark, sf):
    assert {r.doc_id: len(r.spans) for r in secrets.scan(odd(spark)).collect()}[0] == 0
    assert secrets.scan(odd(spark)).count() == len(ODD) + 3 and secrets.scan(empty(spark)).count() == 0
    assert secrets.redacted(odd(spark)).columns == odd(spark).columns
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = 0
    for r in entries.op6_secret_scan(spark, "/root/testdata/sf0.01").collect():
        want = brute_base(docs[r.doc_id])
        found += len(want)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
    assert found


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entries.op4_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(truth)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_language_id_edges(spark):
    assert langid.learn(empty(spark)) == {}
    none = langid.identify(odd(spark), {}).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(ODD) + 3
    p = langid.learn(spark.createDataFrame([(1, "der die das und", "de"), (2, "the and of", "en"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string"))
    assert sorted(p) == ["de", "en"]
    assert langid.predict("the of and", p)[0] == "en" and langid.predict("123 !", p) == ("und", 0.0) and langid.predict(None, p)[0] == "und"
    kept = langid.keep_identified(odd(spark), p)
    assert kept.columns == odd(spark).columns and {r.doc_id for r in kept.collect()} >= {4, 5, 6, 7, 8, 9} and not {r.doc_id for r in kept.collect()} & {0, 1, 2, 3}
    long = "the and of " * 200_000
    a = langid.counts(long)
    assert a[1].sum() == sum(len(w) + (len(w) + 1) + len(w) for w in long.split())


def test_ngram_counts():
    grams, n = langid.counts("It's a É, a")
    got = dict(zip(grams.tolist(), n.tolist(), strict=True))
    number = lambda s: ord(s) if len(s) == 1 else (ord(s[0]) + 1) << 21 | ord(s[1]) if len(s) == 2 else (((ord(s[0]) + 1) << 21 | ord(s[1])) << 21) | ord(s[2])
    want = defaultdict(int)
    for w in ("it", "s", "a", "é", "a"):
        for k in (1, 2, 3):
            x = f" {w} "
            for i in range(len(x) - k + 1):
                if x[i : i + k] != " ":
                    want[x[i : i + k]] += 1
    assert got == {number(k): v for k, v in want.items()}


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    """doc_id -> smallest doc_id reachable."""
    ids = sorted(prints)
    v = np.array([prints[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 4).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {d: ids[find(i)] for i, d in enumerate(ids)}


def test_simhash_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: brute_fingerprint(t) for d, t in docs.items()}
    rows = entries.op2_simhash(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_groups(prints)


def test_simhash_links_every_chain(spark):
    rng = np.random.default_rng(3)
    start = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    prints, k = {}, 0
    for s in start.tolist():
        for _ in range(int(rng.integers(1, 6))):  # a chain of steps of up to five bits
            prints[k] = s
            k += 1
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False).tolist():
                s ^= 1 << b
    fps = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in set(prints.values())], "fp long")
    found = {r.node: r.root for r in components(simhash.links(fps, cell=7)).collect()}
    groups = brute_groups(prints)
    by_root = defaultdict(set)
    for d, p in prints.items():
        x = int(np.uint64(p).view(np.int64))
        by_root[found.get(x, x)].add(d)
    assert {min(g): g for g in by_root.values()} == {m: {d for d in groups if groups[d] == m} for m in set(groups.values())}


def test_anchors_cover():
    errors, sevens, _ = simhash.golay()
    assert len(sevens) == 253 and len(set(errors.tolist())) == 2048
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 4, replace=False).tolist():
            y[i] ^= np.uint64(1 << b)
    homes, visits = defaultdict(set), defaultdict(set)
    for r, a, h in zip(*simhash.anchors(x), strict=True):
        if h:
            homes[r].add(a)
    for r, a, _ in zip(*simhash.anchors(y), strict=True):
        visits[r].add(a)
    assert all(homes[i] & visits[i] for i in range(len(x)))


def test_simhash_edges(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD) + 3
    got = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert got[0] == got[1] == got[2] == got[3] == 0 and got[4] == 4
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 4, 5, 6, 7, 8, 9] and kept.where("doc_id is null").count() == 2


def test_components_of_a_path(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r.root for r in components(edges).collect()} == {0} and components(edges).count() == 200
    assert components(edges.limit(0)).count() == 0


def test_distances_by_brute_force():
    """Out-of-place distances by lists of strings, without arrays of numbers."""
    rng = np.random.default_rng(2)
    words = {"x": "lorem ipsum dolor sit amet consectetur".split(), "y": "vad heter du i dag och vart ska".split(), "z": "één twee drie vier vijf zes".split()}

    def ranking(texts, most):
        often = defaultdict(int)
        for t in texts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                for k in (1, 2, 3):
                    for i in range(len(w) + 3 - k):
                        if (g := f" {w} "[i : i + k]) != " ":
                            often[g] += 1
        return sorted(often, key=lambda g: (-often[g], len(g), g))[:most]

    texts = {lang: [" ".join(rng.choice(w, 40)) for _ in range(10)] for lang, w in words.items()}
    plain = {lang: ranking(t, langid.PROFILE) for lang, t in texts.items()}
    profiles = {}
    for lang, some in texts.items():
        grams, n = (np.concatenate(x) for x in zip(*map(langid.counts, some), strict=True))
        profiles[lang] = langid.profile(langid.ranked(*langid.add(grams, n), langid.PROFILE))
    for _ in range(60):
        text = " ".join(rng.choice(sum(words.values(), []), int(rng.integers(1, 200))))
        doc = ranking([text], langid.DOC_PROFILE)
        far = {lang: sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(doc)) for lang, p in plain.items()}
        best = min(sorted(far), key=far.get)
        lang, score = langid.predict(text, profiles)
        assert lang == best and abs(score - (1 - far[best] / (langid.PROFILE * len(doc)))) < 1e-12
