"""BPE with word ends, spelling variants and lexical search against the library, brute force and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import duckdb
import numpy as np
import public_tokenizers
import pytest
from compare import plain
from tokenizers import Tokenizer

from subsieve.llm import lexical, queries, variants, wordbpe

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n string, word string, rank string, terms string"  # with names that operators use too
PATH = public_tokenizers.path(wordbpe.FILE)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties and clashing columns."""
    text = "The caté sat on the catés, the cats and the catés; Caté scats. " * 4
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (None, text), (None, "alone"), (5, "a" * 9000 + " " + "ab" * 3000), (6, "é中\U0001f600 \n\t x ΣΑΣ İ ß" * 50), (7, "it's <|endoftext|> I'LL <|ENDOFTEXT|>.<|startoftext|>"), (8, "., -\x1f!")]
    return spark.createDataFrame([(i, t, "n", "w", "r", "t") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# BPE with word ends


def test_encodes_and_decodes_as_the_library(spark, odd, none):
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in wordbpe.round_trip(docs, PATH).collect()), key=key) == sorted(want, key=key)
    assert sorted((tuple(r) for r in wordbpe.decode(wordbpe.encode(docs, PATH), PATH).collect()), key=key) == sorted(want, key=key)
    assert wordbpe.round_trip(none, PATH).count() == 0
    got = {r.doc_id: r for r in queries.QUERIES["op11_word_bpe"](spark, SF).collect()}
    for i, ids, decoded in want[:20]:
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_fragments_meet_where_no_token_crosses():
    library, v = Tokenizer.from_file(PATH), wordbpe.Vocabulary(PATH)
    known, rnd = wordbpe._Known(v), random.Random(5)
    cut = 0
    for _ in range(4000):
        text = "".join(rnd.choice("qzxjvkwthe éñß中12'.,!? \n") for _ in range(rnd.randint(1, 60)))
        assert np.frombuffer(wordbpe.packed_ids(text, known), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        for word in v.words(wordbpe.normal(text)):
            parts = v.fragments(word.encode())
            assert b"".join(p for p, _ in parts) == word.encode() and [e for _, e in parts] == [False] * (len(parts) - 1) + [True]
            cut += len(parts) > 1
    assert cut > 1000
    for text in ("a" * 5000, "ab" * 2000, "qzx" * 500, "the" * 1000 + "!" * 300):  # by the heap
        assert np.frombuffer(wordbpe.packed_ids(text, known), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


# spelling variants


def _counted(rows):
    c, low = Counter(), str.maketrans(variants.UPPER, variants.LOWER)
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(low)
            h = zlib.crc32(f"{i}:{r}".encode())
            if i is not None and h % 97 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            c[r] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _forms(count):
    near = {w: [v for v in count if _near(w, v)] for w in count}
    form = {w: v for w, vs in near.items() if vs and count[v := min(vs, key=lambda v: (-count[v], v))] >= 2 * count[w]}
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), count.get(form.get(w)), root))
    return sorted(out)


def test_variants_equal_brute_force(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    count = _counted([tuple(r) for r in docs.collect()])
    assert {r.word: r.n for r in variants.counted_words(docs).collect()} == count
    some = {w: n for w, n in count.items() if w[0] in "aeioucé"} | {"a" * 4000: 3, "a" * 4001: 9, "a" * 3999 + "b": 20}
    assert sorted(tuple(r) for r in variants.forms(spark.createDataFrame(list(some.items()), "word string, n long")).collect()) == _forms(some)
    assert variants.forms(variants.counted_words(none)).count() == 0
    assert variants.counted_words(odd).count() > 0


def test_crowded_halves_lose_and_repeat_no_pair(spark):
    rnd = random.Random(7)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))) for _ in range(500)}
    d = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if _near(a, b) and len(a) > 1)
    for shard in (5, 10_000):
        got = sorted((r.word, r.near) for r in variants.near_words(d, shard).collect())
        assert [p for p in got if len(p[1]) > 1] == [p for p in want if len(p[1]) > 1]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "aé中z"])
def test_searches_across_either_half(letters):
    rnd = random.Random(len(letters))
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(150)})
    kept = sorted(rnd.sample(words, max(1, len(words) // 2)))
    v = variants.Vocabulary(kept)
    pairs = [(words[i], kept[j]) for i, j in zip(*v.one_error(words, False), strict=True)]
    pairs += [(words[i], kept[j]) for i, j in zip(*v.one_error(words, True), strict=True) if not kept[j].startswith(words[i][: len(words[i]) // 2])]
    assert sorted(pairs) == [(a, b) for a in words for b in kept if _near(a, b)]


def test_roots_follow_forms(spark):
    count = {"aaaaa" + "b" * i: 3 * 2**i for i in range(7)} | {"zzzzz": 5, "zzzzy": 5, "zzzyy": 10, "yzzzz": 10}
    got = sorted(tuple(r) for r in variants.forms(spark.createDataFrame(list(count.items()), "word string, n long")).collect())
    assert got == _forms(count) and got[0][-1] == "aaaaabbbbbb"


# lexical search


def _search(docs, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w)) for i, t in docs if (w := terms(t))]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * c.total() * n_docs // total
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_lexical_search_equals_brute_force(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    asked = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    asked += [(100, "the THE the caté"), (101, None), (102, ""), (103, "nowhere12345"), (None, "the sat"), (104, "ΣΑΣ x é中")]
    items = spark.createDataFrame([*asked, asked[0]], "item_id long, text string")
    want = _search([tuple(r) for r in docs.collect()], asked)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for blocks in (10**6, 60):
        got = sorted((tuple(r) for r in lexical.search(docs, items, block_terms=blocks).collect()), key=key)
        assert got == sorted(want, key=key)
    assert lexical.search(none, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items, k=1).count() == len({i for i, *_ in want})


def test_lexical_search_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = plain(queries.QUERIES["op13_lexical_search"](spark, SF).toPandas()), plain(con.sql(queries.ORACLES["op13_lexical_search"]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_shared_terms_add_up():
    rnd = random.Random(3)
    for _ in range(30):
        terms = rnd.randint(1, 40)
        items = [[rnd.randrange(terms) if rnd.random() < 0.5 else rnd.randrange(min(5, terms)) for _ in range(rnd.randint(0, 30))] for _ in range(20)]
        graph = lexical.SharedTerms(items, terms)
        assert len(graph.parts) + len(graph.left) <= sum(map(len, items))
        pairs = [(t, d) for t in range(terms) for d in range(7) if rnd.random() < 0.3]
        t, d = (np.array(x, int) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
        value = np.arange(1, len(pairs) + 1)
        per = dict(zip(pairs, value.tolist(), strict=True))
        assert graph.totals(t, d, value, 7).tolist() == [[sum(per.get((x, doc), 0) for x in item) for doc in range(7)] for item in items]
    same = lexical.SharedTerms([[0, 1, 2, 3]] * 5, 4)
    assert len(same.left) == 3 and len(same.parts) == 5  # one node for what all share
