"""The corpus operators against brute force, round trips and odd tables."""

import base64
import hashlib
import random
import re
import struct
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from compare import plain
from pyspark.sql import functions as F

from subsieve.llm import backoff, bpe, jpeg, mixing, nearcopies, nearest, quality, queries, repeats, secrets, simhash, suffixes, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, spans string"  # with names that operators use too


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    text = "the cat sat on the mat and the dog sat on the log " * 8
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (None, "no id here"), (5, "a" * 9000), (6, "é中\U0001f600 \n\t x" * 50), (7, 'token = "0123456789abcdef01234567"'), (8, "x y")]
    return spark.createDataFrame([(i, t, None, None if i == 3 else f"s{(i or 0) % 3}", len(t or ""), "x", "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = plain(queries.QUERIES[name](spark, SF).toPandas()), plain(con.sql(queries.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and got.fillna("~").equals(want.fillna("~"))


def test_mixing(spark, odd, none):
    plan = mixing.mixing_plan(odd).select("doc.doc_id", "size", "source_size", "target", "taken", "doc.source").collect()
    assert all(r.taken <= 3 * r.size for r in plan) and len(plan) == odd.count()
    by = Counter()
    for r in plan:
        by[r.source, r.target] += r.taken
    assert all(abs(n - t) < 1 for (_, t), n in by.items())
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r.taken for r in plan)
    assert mixing.mix(none).count() == 0


def test_targets_are_filled_by_weight(spark):
    d = mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 0)], "k string, source_size long"))
    t = {r.k: r.target for r in d.collect()}
    assert t["a"] == 30 and t["d"] == 0 and t["b"] == pytest.approx(2 * t["c"]) and sum(t.values()) == pytest.approx(1510)


def test_jpeg_round_trip(spark, odd, none):
    rnd = random.Random(1)
    for n in (0, 1, 575, 576, 577, 3 * jpeg.IMAGE + 5):
        p = jpeg.padded(rnd.randbytes(n))
        assert len(p) % 576 == 0 and b"".join(t.tobytes() for *_, t in jpeg.thumbnails(jpeg.encode_payload(p))) == p
    got = jpeg.from_media(jpeg.to_media(odd)).collect()
    assert sorted(r.payload for r in got) == sorted(jpeg.padded((r.text or "").encode()) for r in odd.collect())
    assert jpeg.from_media(jpeg.to_media(none)).count() == 0


@pytest.mark.parametrize("window", [1, 64, 1 << 12])
def test_jpeg_in_windows(monkeypatch, window):
    monkeypatch.setattr(jpeg, "_WINDOW", window)  # units longer than it make it wider
    p = jpeg.padded(random.Random(2).randbytes(4000) + bytes(range(256)) * 3)
    m = jpeg.encode_payload(p)
    assert jpeg.thumbnails(m)[0][2].tobytes() == p
    for cut in (m[:-40], m[:-40] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.thumbnails(cut)
    media, dc = _jpeg([(1, 2, 2), (2, 1, 1), (3, 1, 1)], 90, 70, 0, random.Random(3))
    assert (jpeg.thumbnails(media)[0][2] == np.clip((dc[:9, :12] * 4 + 4 >> 3) + 128, 0, 255)).all()


def test_jpeg_tables_are_the_usual_ones():
    dc, ac = jpeg.codes(jpeg._DC_LENGTHS, jpeg._DC_SYMBOLS), jpeg.codes(jpeg._AC_LENGTHS, jpeg._AC_SYMBOLS)
    assert [dc.code(s) for s in (0, 5, 6, 11)] == [(0, 2), (6, 3), (14, 4), (510, 9)]
    assert ac.code(0) == (0b1010, 4) and ac.code(0xF0) == (0b11111111001, 11) and ac.code(0xFA) == (0xFFFE, 16)
    assert len(set(jpeg._AC_SYMBOLS)) == len(jpeg._AC_SYMBOLS) == 162


def test_jpeg_images_of_several_widths(spark):
    images = [_jpeg([(1, 1, 1)], w, 72, 0, random.Random(w))[0] for w in (80, 96)]
    alone = [jpeg.difference_hash(jpeg.thumbnails(m)[0][2]) for m in images]
    d = spark.createDataFrame([(1, 2, b"".join(images)), (2, 2, images[0] * 2), (3, 0, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in jpeg.from_media(d).collect()}
    assert got[1].thumbnail_hash == ",".join(alone) and got[1].images == 2 and got[1].height == 144
    assert len(got[2].thumbnail_hash) == 16 and got[3].payload is None and got[3].thumbnail_hash is None


def _jpeg(components, width, height, restart, rnd):
    """A baseline image with random coefficients, own Huffman tables, AC runs and restarts; and the first component's DC."""
    dc_symbols, ac_symbols = list(range(12)), [0x00, 0xF0, 0x01, 0x02, 0x11, 0x23, 0x35, 0x71]
    table = lambda kind, symbols, bits: struct.pack(">BBHB", 0xFF, 0xC4, 19 + len(symbols), kind) + bytes(len(symbols) * (b == bits) for b in range(1, 17)) + bytes(symbols)
    code = lambda symbols, bits: {s: format(i, f"0{bits}b") for i, s in enumerate(symbols)}
    dc, ac = code(dc_symbols, 5), code(ac_symbols, 4)
    number = lambda v: "" if not v else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
    most = [max(c[i] for c in components) for i in (1, 2)]
    if len(components) == 1:
        across, down, shape = -(-width // 8), -(-height // 8), [(components[0][0], 1, 1)]
    else:
        across, down, shape = -(-width // (8 * most[0])), -(-height // (8 * most[1])), [c[:3] for c in components]
    first = np.zeros((down * shape[0][2], across * shape[0][1]), int)
    scan, bits, last = b"", "", {}
    flush = lambda b: int(b + "1" * (-len(b) % 8) or "0", 2).to_bytes((len(b) + 7) // 8, "big").replace(b"\xff", b"\xff\0")
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            scan, bits, last = scan + flush(bits) + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]), "", {}
        for c, h, v in shape:
            for y in range(v):
                for x in range(h):
                    new = rnd.randint(-60, 60)
                    step = new - last.get(c, 0)
                    last[c] = new
                    bits += dc[abs(step).bit_length()] + number(step)
                    if c == components[0][0]:
                        first[unit // across * v + y, unit % across * h + x] = new
                    k = 1
                    while k < 64 and rnd.random() < 0.7:
                        rs = rnd.choice(ac_symbols[1:])
                        if k + (rs >> 4) + 1 > 64:
                            break
                        size = rs & 15
                        bits += ac[rs] + (number(rnd.choice([-1, 1]) * rnd.randint(1 << size >> 1, (1 << size) - 1)) if size else "")
                        k += (rs >> 4) + 1
                    if k < 64:
                        bits += ac[0]
    frame = struct.pack(">BBHBHHB", 0xFF, 0xC0, 8 + 3 * len(components), 8, height, width, len(components)) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in components)
    begin = struct.pack(">BBHB", 0xFF, 0xDA, 6 + 2 * len(components), len(components)) + b"".join(bytes([c, 0]) for c, *_ in components) + b"\0\x3f\0"
    every = struct.pack(">BBHH", 0xFF, 0xDD, 4, restart) if restart else b""
    quant = struct.pack(">BBHB", 0xFF, 0xDB, 67, 0) + b"\x04" * 64
    return b"\xff\xd8" + quant + frame + table(0, dc_symbols, 5) + table(0x10, ac_symbols, 4) + every + begin + scan + flush(bits) + b"\xff\xd9", first


@pytest.mark.parametrize("components, width, height", [([(1, 1, 1)], 40, 24), ([(1, 2, 2), (2, 1, 1), (3, 1, 1)], 50, 35), ([(1, 2, 1), (2, 1, 1)], 33, 9)])
@pytest.mark.parametrize("restart", [0, 2])
def test_jpeg_of_any_encoder(components, width, height, restart):
    rnd = random.Random(width + restart)
    for _ in range(4):
        media, dc = _jpeg(components, width, height, restart, rnd)
        [(w, h, t)] = jpeg.thumbnails(media)
        rows, columns = -(-height // 8), -(-width // 8)
        assert (w, h) == (width, height) and (t == np.clip((dc[:rows, :columns] * 4 + 4 >> 3) + 128, 0, 255)).all()


def test_jpeg_rejects_bits_that_are_no_code():
    m = jpeg.encode_payload(jpeg.padded(b"some text"))
    begin = m.index(b"\xff\xda") + 10
    with pytest.raises(ValueError):
        jpeg.thumbnails(m[:begin] + b"\xfe\xfe\xfe\xfe\xfe" + m[begin + 5 :])


def test_warc(spark, none):
    rows = [(1, "http://a/ b\r\n", "x" * 3000), (2, None, "x" * 3000), (3, "u", None), (4, "u", ""), (None, "u", "y"), (5, "u", "zé"), (5, "u", "zé"), (6, "u", "zé")] + [(i, "u", f"<html>page {i} of many</html>" * 9) for i in range(10, 60)]
    d = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(d) == len(rows)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in d)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), i if i is not None else -1)
    want = Counter()
    for i, _, h in rows:
        again = i != largest[h or ""] and largest[h or ""] >= 0
        want[i, len((h or "").encode()), digest(h or ""), "revisit" if again else "response", largest[h or ""] if again else None] += 1
    assert got == want
    assert warc.archive(none.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"))).count() == 0


def brute_secrets(x):
    s = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x, re.I) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 24]
    return [f"{k}:{a}:{e}" for a, _, e, k in sorted(s)]


def test_secrets(spark, odd, none):
    texts = ["secret=token: abcdefg", "password=token=abcdefgh token:  'x'", "AKIA" * 30 + " é中 api_key=é APIKEY = a.b-c_d/e+f", "ab" * 12 + "\U0001f600" + "0" * 24, "token=abcdef " * 700, None]
    d = secrets.find_secrets(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for r in d.collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "random"] == brute_secrets(r.doc.text or "")
    assert secrets.redact(odd).columns == odd.columns
    clean = {r.doc_id: r.text for r in secrets.redact(odd).collect()}
    assert clean[7] == "[REDACTED]" + '"' and clean[3] is None and clean[8] == "x y"
    assert secrets.redact(none).count() == 0


def test_models_tell_random_from_words(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice(["lo", "re", "mi", "pan", "tu", "se"]) for _ in range(4)) for _ in range(500)]
    strange = lambda: "".join(rnd.choice(secrets.ALPHABET[:62]) for _ in range(32))
    docs = [(i, " ".join([*rnd.sample(words, 30), f"token={strange()}"])) for i in range(80)] + [(1000, f"a {strange()} b"), (1001, "lorepanmitulorepanmituselo " * 3)]
    found = {r.doc.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[1000] == ["random"] and found[1001] == []


def test_models_on_labelled_strings(spark):
    """Recall of random strings of four kinds, and false alarms over identifiers made of the corpus' words."""
    docs, rnd = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), random.Random(22)
    ratios, a = secrets.train(docs.select(F.coalesce("text", F.lit("")).alias("t"))), secrets.ALPHABET
    score = lambda t: sum(ratios[a.index(x) * len(a) + a.index(y)] for x, y in zip(t, t[1:])) / (len(t) - 1)
    for letters in (a[:64], a[:62], a[:26] + a[52:62], "0123456789abcdef"):
        assert sum(score("".join(rnd.choice(letters) for _ in range(rnd.randint(20, 23)))) >= secrets.LEAST_RATIO for _ in range(400)) >= 0.93 * 400
    words = sorted({w for r in docs.select("text").collect() for w in re.findall(r"[A-Za-z]{4,}", r.text or "")})
    names = ["_".join(rnd.choice(words) for _ in range(6)) for _ in range(200)] + ["".join(rnd.choice(words).capitalize() for _ in range(6)) for _ in range(200)]
    assert sum(score(n) >= secrets.LEAST_RATIO for n in names) <= 4


def test_running_totals_over_blocks(spark):
    rnd = random.Random(23)
    rows = [([rnd.randrange(1000) for _ in range(n)],) for n in (0, 1, 255, 256, 257, 900)]
    d = spark.createDataFrame(rows, "a array<long>").select("a", secrets.running_sums(F.col("a")).alias("s"), secrets.running_max(F.col("a")).alias("m"))
    for r in d.collect():
        assert r.s == np.cumsum(r.a).tolist() and r.m == (np.maximum.accumulate(r.a).tolist() if r.a else [])


def test_copies_do_not_fill_the_ordinary_model(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice(["lo", "re", "mi", "pan", "tu", "se"]) for _ in range(4)) for _ in range(500)]
    strange = lambda: "".join(rnd.choice(secrets.ALPHABET[:62]) for _ in range(32))
    low = min((f"GQX9Z-7KWJ4 V8HQY_{i}" for i in range(200000)), key=lambda t: int(np.uint64(xxhash.xxh64_intdigest(t, 42)).view(np.int64)))
    docs = [(i, " ".join([*rnd.sample(words, 30), f"token={strange()}"])) for i in range(80)] + [(1000, f"a {strange()} b"), (1001, "lorepanmitulorepanmituselo " * 3)]
    docs += [(2000 + i, low) for i in range(2000)]
    found = {r.doc.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[1000] == ["random"] and found[1001] == []


def test_backoff(spark, odd, none):
    d = [(r.doc_id, (r.text or "").split()) for r in odd.collect()]
    got = sorted((r.n_words, r.n_seen, round(r.log_score, 6)) for r in backoff.scores(odd).collect())
    one, two = Counter(w for _, t in d for w in t), Counter(p for _, t in d for p in zip(t, t[1:]))
    want = []
    for _, t in d:
        own, pairs, total, seen = Counter(t), Counter(zip(t, t[1:])), 0.0, 0
        rest = max(1, sum(one.values()) - len(t))
        for i, w in enumerate(t):
            p = (t[i - 1], w)
            if i and two[p] > pairs[p]:
                seen += 1
                total += np.log((two[p] - pairs[p]) / (one[p[0]] - own[p[0]]))
            else:
                total += np.log((one[w] - own[w] or backoff.UNSEEN) / rest) + (np.log(backoff.ALPHA) if i else 0)
        want.append((len(t), seen, round(float(total), 6)))
    assert np.allclose(np.array(got), np.array(sorted(want)), atol=1e-5)
    joined = sorted((r.n_words, r.n_seen, round(r.log_score, 6)) for r in backoff.scores_by_join(odd).collect())
    assert np.allclose(np.array(joined), np.array(sorted(want)), atol=1e-5)
    assert backoff.scores(none).count() == 0


def test_bpe(spark, odd, none):
    path = public_tokenizers.path(bpe.RANK_FILE)
    tokens = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rnd, pieces, split = random.Random(2), bpe._Pieces(tokens), bpe.splitter()
    for n in range(400):
        t = "".join(rnd.choice("ab  \n\t\x1c\x85　é中\U0001f600'sre12.,-_ß") for _ in range(n % 60))
        assert b"".join(pieces[p] for p in split.findall(t)) == struct.pack(f"<{len(library.encode_ordinary(t))}I", *library.encode_ordinary(t))
    back = bpe.decode(bpe.encode(odd, path), path).collect()
    assert sorted(r.decoded for r in back) == sorted((r.text or "").encode() for r in odd.collect())
    assert sorted(map(tuple, bpe.round_trip(odd, path).collect()), key=str) == sorted(map(tuple, back), key=str)
    words = spark.createDataFrame([("lower",), ("été",), (" tokens",), ("x",)], "word string")
    assert {r.word: r.ids for r in bpe.fold_words(words, path).collect()} == {w: library.encode_ordinary(w) for w in ("lower", "été", " tokens", "x")}
    assert bpe.digests(none).count() == 0


def test_suffix_arrays():
    rnd = random.Random(3)
    for n in range(500):
        s = [rnd.randrange(rnd.choice([1, 2, 4, 200])) for _ in range(n % 70)] * (1 + n % 3)
        want = sorted(range(len(s)), key=lambda i: s[i:])
        order = suffixes.suffix_array(np.array(s, int))
        assert order.tolist() == want
        if s:
            before, common = suffixes.permuted_prefixes(np.array(s), order, -1)
            for x, y in zip(want, want[1:]):
                k = next((i for i in range(len(s)) if x + i >= len(s) or y + i >= len(s) or s[x + i] != s[y + i]), 0)
                assert before[y] == x and common[y] == k


@pytest.mark.parametrize("crowd", [2000, 1])
def test_repeats(spark, odd, none, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9)))
    passages = [" ".join(word() for _ in range(80)) for _ in range(4)]
    texts = [" ".join([*(word() for _ in range(30)), passages[i % 4][i:] if i % 3 else word(), *(word() for _ in range(60))]) for i in range(30)]
    texts += [texts[0], "q" * 1500, "ab" * 500, "short", texts[1] + "é" + texts[1], None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    count = Counter(t.encode()[j : j + 200] for t in texts if t for j in range(len(t.encode()) - 199))
    for r in repeats.removed(d).collect():
        data = (texts[r.doc_id] or "").encode()
        gone = np.zeros(len(data), bool)
        for j in range(len(data) - 199):
            if count[data[j : j + 200]] > 1:
                gone[j : j + 200] = True
        assert r.kept == bytes(np.frombuffer(data, np.uint8)[~gone]) and sum(s.b - s.a for s in r.spans) == gone.sum()
    assert repeats.removed(odd).count() == odd.count() and repeats.removed(none).count() == 0


@pytest.mark.parametrize("crowd", [48, 2])
def test_simhash(spark, odd, none, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(30)]
    near = {s ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for s in seeds[:10] for _ in range(30)} | set(seeds)
    fps = sorted(int(np.uint64(x).view(np.int64)) for x in near)
    got = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    root = {x: x for x in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    want = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    groups = []
    for links in (want, got):
        root = {x: x for x in fps}
        for a, b in links:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2 or crowd == 2
            root[max(top(a), top(b))] = min(top(a), top(b))
        groups.append({x: top(x) for x in fps})
    assert groups[0] == groups[1]
    d = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert d[1] == d[2] == 1 and d[3] == d[4] == 3
    kept = nearcopies.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 5, 6, 7, 8} and kept.filter("doc_id = 2").count() == 0
    assert simhash.near_duplicates(none).count() == 0


def planted_copies():
    """Texts with planted near copies (words changed, dropped and added), crowds of them, and texts that share a passage."""
    rnd = random.Random(11)
    text = lambda n: [rnd.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(rnd.randrange(400)) for _ in range(n)]

    def changed(w, n):
        w = list(w)
        for _ in range(n):
            w[rnd.randrange(len(w))] = str(rnd.random())
        return w

    passage, out = text(60), []
    for i in range(40):
        w = text(rnd.choice([40, 120, 230, 400]))
        out += [w, changed(w, 1), changed(w, i % 8), w[: len(w) * 9 // 10], passage + w[:60]]
    crowd = text(200)
    out += [changed(crowd, rnd.randrange(6)) for _ in range(120)]
    return [" ".join(w) for w in out] + ["a b c", "A  b c", "", " ", "x"]


@pytest.mark.parametrize("block", [512, 8])
def test_near_copies_stage(spark, monkeypatch, block):
    import corpus_pipeline as cp

    monkeypatch.setattr(nearcopies, "BLOCK", block)
    texts = planted_copies()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = dict(cp.STAGES)["near_duplicates"](spark, d, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if top(i) == i]


def test_near_copies_begin_with_fingerprints(spark):
    """The stage's candidates by fingerprint: copies within two bits meet, whatever min-hash makes of them."""
    rng = np.random.default_rng(8)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 3000)] for _ in range(12)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:-1], "other"]) for w in base]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [nearcopies.shingles(t) for t in texts]
    prints = [simhash.majority(s) for s in sets]
    close = {(i, j) for i in range(24) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}
    assert {(i + 12, i) for i in range(12)} <= close
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fp long")
    assert {(r.a, r.b) for r in nearcopies.by_fingerprint(nodes).collect()} >= {(i, j) for i, j in close if prints.index(prints[i]) == i and prints.index(prints[j]) == j}
    linked = nearcopies._links(nearcopies.by_fingerprint(nodes), d.toDF("node", "text"))
    roots = nearcopies.components(linked).collect()
    assert {(r.node, r.root) for r in roots} == {(i + 12, i) for i in range(12)} | {(i, i) for i in range(12)}
    assert sorted(r.doc_id for r in nearcopies.keep_one(d).collect()) == list(range(12))


def test_parities_never_hide_a_near_copy():
    rnd = np.random.default_rng(2)
    for n in (1, 7, 100, 3000):
        x = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        for share in (0.0, 0.05, 0.3):
            y = np.unique(np.concatenate([x[rnd.random(len(x)) >= share], rnd.integers(0, 2**63, int(share * n)).astype(np.uint64)]))
            apart = len(np.setxor1d(x, y))
            assert np.bitwise_count(nearcopies.parities(x) ^ nearcopies.parities(y)).sum() <= apart


def test_one_row_for_each_group(spark):
    one, two, three, four = (" ".join(f"{k}{i}" for i in range(40)) for k in "pqrs")
    rows = [(None, one), (None, two), (None, three + " end"), (1, three), (1, four), (1, four), (2, four + " end"), (None, None), (None, "")]
    for wide in (rows, rows[::-1]):
        kept = nearcopies.keep_one(spark.createDataFrame(wide, "doc_id long, text string")).collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(0, one), (0, two), (1, three), (1, four), (0, "")])


def test_nearest(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(600, 8)).astype(np.float32).astype(float)
    x[200:400] = x[200]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (1000, [0.0] * 8), (1100, [float("nan")] * 8), (1200, [1.0, None] * 4), (1300, [1.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(r.score == pytest.approx(d[r.vec_id]) for r in own)
        hits += len({r.vec_id for r in own} & set(want.tolist()))
    assert hits >= 54 and {r.query_id for r in got} == set(range(0, 600, 100))
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    for n, different in [(n, n) for n in (1, 2, 3, 5, 8, 10, 11, 12, 13, 15, 16, 22, 30)] + [(25, 3), (25, 11), (14, 1)]:
        v = rnd.normal(size=(different, 4))
        rows = [(100 * i, v[i % different].tolist()) for i in range(n)]
        got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert Counter(r.query_id for r in got) == Counter({100 * i: min(10, n - 1) for i in range(n) if n > 1})
    few = nearest.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 1.0)]


def test_pruned_index_finds_nine_in_ten(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 512)
    rnd = np.random.default_rng(21)
    x = (rnd.normal(size=(10, 32))[np.arange(4000) % 10] * 0.3 + rnd.normal(size=(4000, 32))).astype(np.float32).astype(float)
    visited = []
    traverse = nearest.traverse
    got = nearest.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    hits, c = 0, nearest.fit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vid long, v array<double>"), 32)
    counts = np.bincount(nearest._distances(x[:, :16], c[0]).argmin(1) * 32 + nearest._distances(x[:, 16:], c[1]).argmin(1), minlength=1024)
    for q in range(0, 4000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d)[:10].tolist()))
        visited.append(counts[traverse(x[q], c, counts, nearest.VISIT * 4000)].sum() / 4000)
    assert hits >= 0.9 * 400 and max(visited) < 0.75


def test_lowest_is_the_sample_by_hash(spark):
    from subsieve.llm.common import lowest

    keys = spark.createDataFrame([(i % 900,) for i in range(3000)], "k long")
    want = [r.k for r in keys.distinct().orderBy(F.shiftrightunsigned(F.xxhash64("k"), 1)).limit(20).collect()]
    assert sorted(r.k for r in lowest(keys, 20).collect()) == sorted(want) and lowest(keys, 5000).count() == 900


def test_traverse_goes_by_growing_sums():
    rnd = np.random.default_rng(7)
    c = [rnd.normal(size=(6, 3)) for _ in range(2)]
    counts, q = np.ones(36, int), rnd.normal(size=6)
    sums = (((c[0] - q[:3]) ** 2).sum(1)[:, None] + ((c[1] - q[3:]) ** 2).sum(1)[None]).ravel()
    for n in (1, 5, 20, 36):
        assert set(np.flatnonzero(nearest.traverse(q, c, counts, n))) == set(np.argsort(sums)[:n])


def test_quality_held_out(spark, odd, none):
    rnd = random.Random(8)
    good = ["".join(rnd.choice("aeioutnrs") for _ in range(6)) for _ in range(300)]

    def text(g):
        w = [rnd.choice(good) for _ in range(rnd.randint(20, 200))]
        return " ".join(w + ["idiot", "scum"]) if g == 1 else " ".join(x.upper() + "###" for x in w) if g == 0 else " ".join(w)

    rows = [(i, text(g), g) for i in range(1500) for g in [min(i % 10, 2)]]
    m = quality.fit(spark.createDataFrame(rows[:1000], "doc_id long, text string, grade int"))
    held = quality.graded(spark.createDataFrame(rows[1000:], "doc_id long, text string, grade int"), m).select("doc.grade", "tail", "expected_grade").collect()
    assert sum((r.tail >= quality.KEEP) == (r.grade == 2) for r in held) > 0.97 * len(held)
    assert np.all(np.diff(m.thresholds) >= 0)
    assert quality.graded(odd, m).count() == odd.count() and quality.graded(none, m).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert {r.tail for r in quality.classified(odd, labels).collect()} == {1.0}


def test_quality_gradients_and_thresholds():
    rnd = np.random.default_rng(10)
    n, m, k = 40, 12, 2
    sizes = rnd.integers(0, 9, n)
    row, at, y = np.repeat(np.arange(n), sizes), rnd.integers(0, m, sizes.sum()), rnd.integers(0, k + 1, n)
    scale, w, t = 1 / np.sqrt(np.maximum(1, sizes)), rnd.normal(size=m), np.array([-0.4, 0.9])

    def plain(w, t):
        total = 0.0
        for i in range(n):
            s = sum(w[f] for r, f in zip(row, at) if r == i) / max(1, sizes[i]) ** 0.5
            edges = [1.0, *(1 / (1 + np.exp(x - s)) for x in t), 0.0]  # P(grade > k - 1)
            total -= np.log(edges[y[i]] - edges[y[i] + 1])
        return total / n + quality.PENALTY / 2 * float(w @ w)

    value, gw, gt = quality.loss(w, t, row, at, scale, y)
    assert value == pytest.approx(plain(w, t), abs=1e-9)
    for x, g in ((w, gw), (t, gt)):
        for i in range(len(x)):
            step = np.zeros(len(x))
            step[i] = 1e-6
            up, down = (plain(w + step * (x is w), t) if x is w else plain(w, t + step) for step in (step, -step))
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    docs = [rnd.integers(0, 40, 30).astype(np.int32) + 40 * (i % 3 == 0) + 100 * i for i in range(60)]
    model = quality.fit_rows(np.array([i % 3 for i in range(60)]), docs, rounds=30)
    assert model is not None and np.all(np.diff(model.thresholds) >= 0)
    assert quality.fit_rows(np.ones(60, int), docs) is None


def test_quality_scores_by_hand(spark, odd):
    words = {w for r in odd.collect() for w in (r.text or "").split()}
    weights = {f: (f % 17 - 8) / 9 for i, w in enumerate(sorted(words)) if i % 2 for f in quality.word_features(w)}
    m = quality.Model((0, 1, 2), weights, np.array([-0.3, 0.4]))
    for r in quality.graded(odd, m, least=0.5).collect():
        known = [weights[f] for f in quality.features(r.doc.text or "").tolist() if f in weights]
        s = sum(known) / max(1, len(known)) ** 0.5
        above = [1 / (1 + np.exp(t - s)) for t in m.thresholds]
        assert r.tail == pytest.approx(above[1]) and r.expected_grade == pytest.approx(sum(above))
        assert r.keep == (r.tail >= min(0.5, 1 / (1 + np.exp(0.4)) - 1e-9))


def test_stages_on_odd_tables(spark, odd, none):
    """Each stage against a plain version of it, on nulls, empty and long texts, repeated rows and clashing columns."""
    import corpus_pipeline as cp

    stages, rows = dict(cp.STAGES), [tuple(r) for r in odd.collect()]
    for name, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0
        if name != "bpe":
            assert stage(spark, odd, SF).columns == odd.columns
    some = lambda df: Counter(tuple(r) for r in df.collect())
    assert some(stages["quality"](spark, odd, SF)) <= Counter(rows)  # whole rows only; scores are tested by hand
    words = lambda t: (t or "").lower().split()
    assert {r[:2] for r in some(stages["near_duplicates"](spark, odd, SF))} == {min(((i is None, i, t) for i, t, *_ in rows if words(t) == words(u)), key=lambda x: (x[0], x[1] or 0))[1:] for _, u, *_ in rows}
    want = Counter()
    for i, t, lang, source, n, *rest in rows:
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute_secrets(t or "")]
        new, at = "", 0
        for a, e in spans:
            if a >= at:
                new += (t or "")[at:a] + secrets.MASK
            at = max(at, e)
        want[i, new + t[at:] if spans else t, lang, source, len(new + t[at:]) if spans else n, *rest] += 1
    assert some(stages["secrets"](spark, odd, SF)) == want
    plan, got = Counter(), Counter()
    for r in mixing.mixing_plan(odd).collect():
        plan[r.doc.doc_id, r.doc.text] += r.taken
    for r in stages["mixing"](spark, odd, SF).collect():
        [whole] = {t for i, t, *_ in rows if i == r.doc_id and (t or "").startswith(r.text)}
        got[r.doc_id, whole] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text) and r.source == {x[0]: x[3] for x in rows}[r.doc_id]
    assert got == +plan  # the words that the plan gives each document, and no document that it gives none
    path = public_tokenizers.path(bpe.RANK_FILE)
    tokens = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    ids = lambda t: library.encode_ordinary(t or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert some(stages["bpe"](spark, odd, SF)) == Counter((i, len(ids(t)), sha(struct.pack(f"<{len(ids(t))}I", *ids(t))), sha((t or "").encode())) for i, t, *_ in rows)


def test_quality_stage_by_hand(spark):
    import corpus_pipeline as cp

    folder = SF.replace("0.001", "0.01")  # where enough documents are rated
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(quality.rated_sample(docs, labels))
    least = min(quality.KEEP, 1 / (1 + np.exp(m.thresholds[-1])) - 1e-9)
    want = []
    for r in docs.collect():
        words = (r.text or "").split()
        found = [f for w in set(words) for f in quality.word_features(w)] + [quality.shape_feature(len(words), len(set(words)))]
        w = [m.weights[f] for f in found if f in m.weights]
        if 1 / (1 + np.exp(m.thresholds[-1] - sum(w) / max(1, len(w)) ** 0.5)) >= least:
            want.append(r.doc_id)
    kept = [r.doc_id for r in dict(cp.STAGES)["quality"](spark, docs, folder).collect()]
    assert sorted(kept) == sorted(want) and 0 < len(kept) < docs.count()
    grade = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    assert sum(grade.get(i) == (1, 0) for i in kept) >= 0.9 * sum(g == (1, 0) for g in grade.values())


def test_pipeline_clears_what_it_wrote(spark):
    import os

    import corpus_pipeline as cp
    from subsieve.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    n = cp.run(spark, SF).count()
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before}
    assert n > 0 and left == {"quality", "near_duplicates", "secrets", "mixing"}


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = None
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and out.count() > 0
        if name != "mixing":
            assert out.count() <= docs.count() and out.join(docs, "doc_id", "left_anti").count() == 0
        before, docs = docs, out
    assert before is not None and cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()
