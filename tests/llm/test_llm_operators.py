"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, repeats, ties, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import random
import urllib.parse
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from odolith.llm import components, decontam, packing, queries, secret_scan, simhash, suffix, toxicity, wordpiece

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, n long"
ODD = [None, "", " ", "a", "one two", "\n\n\t", "Ünïcode ﬁ 漢字 text", "word " * 3000, "x" * 5000]


def frame(spark, texts, start=0):
    """Documents with extra columns whose names clash with the operators' own; the first text comes twice, once under the same id."""
    rows = [(start + i, t, "en", "s", None if t is None else len(t), 0.5, "h", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, *rows[-1][1:])] if rows else [], DOCS)


def prose(rng, n, words=None):
    words = words or ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(n)]


# toxicity


def test_toxicity_learns_and_keeps_held_out_rows_out(spark):
    rng = random.Random(1)
    texts = prose(rng, 600)
    bad = set(range(0, 600, 5))
    texts = [t + " you vile idiot" if i in bad else t for i, t in enumerate(texts)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i in bad), 7) for i in range(600)] + [(1, None, 7), (None, 1, 7)], "doc_id long, toxic int, score int")
    w = toxicity.fit(docs, labels)
    got = toxicity.score(docs, w).toPandas()
    assert len(got) == 602 and got.score.between(0, 1).all()
    import zlib

    own = got.dropna().drop_duplicates("doc_id")
    assert (own.held_out == own.doc_id.map(lambda i: zlib.crc32(str(int(i)).encode()) % 4 == 2)).all()
    test = own[own.held_out]
    assert ((test.score >= 0.3) == test.doc_id.isin(bad)).mean() > 0.98
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, wrong) == w  # held-out labels change nothing
    kept = toxicity.drop_toxic(docs, w)
    assert kept.columns == docs.columns and kept.count() == (got.score < 0.3).sum()


def test_toxicity_odd_rows(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) == []
    assert {r["score"] for r in toxicity.score(docs, []).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), [(-1, 0.5)]).count() == 0
    assert toxicity.score(docs, [(-1, 0.0)]).where("score = 0.5").count() == len(ODD) + 2


# secrets

KEY = 'token = "4aee7877f816035eb54cd1071cacad463aef45b3"'


def slow_spans(text):
    kinds = [(secret_scan.ASSIGN, lambda m: len(m[2]) >= 6), (regex.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (regex.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    parts = ["PassWord", "passwd", "api_key", "APIKEY", "secret", "token", " = ", ":", '"', "'", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", " ", "xyz", "Kſ"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=12))
        assert secret_scan.base_spans(t) == slow_spans(t), t


@pytest.mark.parametrize("wrap", [
    lambda s: urllib.parse.quote(s, safe=""), lambda s: urllib.parse.quote(urllib.parse.quote(s, safe=""), safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.urlsafe_b64encode(base64.b64encode(s.encode())).decode().rstrip("="),
    lambda s: urllib.parse.quote(base64.b64encode(gzip.compress(base64.b64encode(s.encode()))).decode(), safe=""),
])
def test_layers_map_back(wrap):
    coded = wrap(KEY)
    text = "ä b " + coded + " end"
    _, found = secret_scan.all_spans(text)
    spans = [(s, e) for s, k, e in found if k == 0]
    assert spans and all(4 <= s < e <= 4 + len(coded) for s, e in spans)
    assert coded[3:-12] not in secret_scan.redact_text(text) and secret_scan.redact_text(text).startswith("ä b ")


@pytest.mark.parametrize("odd", ["\u00a0", "\u202f", "\ufeff", "\u00ad", "\u200d", "\f", "\0", None])
def test_layers_with_unreadable_parts_are_scanned(odd):
    plain = b"caf\xe9 " + KEY.encode() + b" \xff" if odd is None else (odd + KEY + odd).encode()
    for wrap in (lambda b: base64.b64encode(b).decode(), lambda b: base64.b64encode(gzip.compress(b)).decode(), lambda b: "".join(f"%{x:02x}" for x in b), lambda b: base64.b64encode(base64.b64encode(b) + b"\xff\xfe").decode()):
        coded = wrap(plain)
        found = secret_scan.all_spans("ä b " + coded + " end")[1]
        assert any(k == 0 and 4 <= s < e <= 4 + len(coded) for s, k, e in found), coded
    assert secret_scan.all_spans("x%ff" + urllib.parse.quote(KEY, safe="") + "%fe")[1]


@pytest.mark.parametrize("lead", ["", "certificate\n", "ab\nabc\n", "data: "])
@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_base64_in_lines_is_one_run(lead, eol):
    for data in (("x" * 50 + " " + KEY + " tail" * 20).encode(), gzip.compress(random.Random(5).randbytes(300) + KEY.encode())):
        coded = base64.b64encode(data).decode()
        lines = eol.join(coded[i : i + 76] for i in range(0, len(coded), 76))
        text = lead + lines + "\nend of it"
        spans = [(s, e) for s, k, e in secret_scan.all_spans(text)[1] if k == 0]
        assert spans and all(len(lead) <= s < e <= len(text) for s, e in spans)
        assert max(text[s:e].count("\n") for s, e in spans) > 0


def test_inflated_layers_are_scanned_to_their_end(monkeypatch):
    monkeypatch.setattr(secret_scan, "_PIECE", 1000)
    rng = random.Random(6)
    for text in (" ".join(prose(rng, 60)), "é" * 5001, " " * 5000, "a" * 5000, "x: " * 3000):
        for wrap in (lambda b: base64.b64encode(gzip.compress(b)).decode(), lambda b: "".join(f"%{x:02x}" for x in gzip.compress(b))):
            for secret in (KEY, KEY + " " + text, urllib.parse.quote(KEY, safe=""), "password" + " " * 3000 + "= hunter2222"):
                coded = wrap((text + " " + secret).encode())
                assert (0, 0, len(coded.rstrip("="))) in secret_scan.all_spans(coded)[1]
    both = gzip.compress(b"one ") + gzip.compress(KEY.encode())
    assert secret_scan.all_spans(base64.b64encode(both).decode())[1]
    noise = random.Random(7).randbytes(5000).hex().translate(str.maketrans("0123456789abcdef", "ghijklmnopqrstuv"))
    hurt = bytearray(gzip.compress((KEY + " " + noise).encode()))
    hurt[-200:-100] = bytes(100)
    assert secret_scan.all_spans(base64.b64encode(hurt).decode())[1]


def test_long_inflated_layers_are_scanned_whole():
    coded = base64.b64encode(gzip.compress(b"a b, " * (14 << 20) + KEY.encode(), 9)).decode()
    assert (0, 0, len(coded.rstrip("="))) in secret_scan.all_spans(coded)[1]


def test_layers_end_on_cycles_and_bombs():
    assert secret_scan.all_spans("%25" * 500 + "41") == ([], [])
    assert secret_scan.all_spans(base64.b64encode(gzip.compress(b"a b " * 100_000)).decode())[1] is not None


def test_secret_scan_rows(spark):
    docs = frame(spark, [*ODD, KEY, f"x {KEY} {KEY}"])
    got = secret_scan.scan(docs).toPandas()
    assert len(got) == len(ODD) + 4
    assert got[got.doc_id == len(ODD)].base_spans.tolist() == ["assign:0:49,hex:9:49"]
    red = secret_scan.redact(docs)
    assert red.columns == docs.columns
    r = red.where(f"doc_id = {len(ODD) + 1}").first()
    assert r["text"] == 'x [SECRET]" [SECRET]"' and r["n_chars"] == len(r["text"]) and r["source"] == "s"
    assert red.where("doc_id = 0").first()["text"] is None
    assert secret_scan.scan(frame(spark, [])).count() == 0


# packing


@pytest.fixture(scope="module")
def vocabulary():
    return queries.tokenizer_file()


def test_ids_equal_the_tokenizer(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary)
    texts = [x or "" for x in ODD] + ["a\x1cb  c <|endoftext|>x it's I'M ́e é \r\n12 34 ΣΑΣ İx \x7f ''s can't'll [[]]x9_y", KEY]
    for text, ids in zip(texts, packing.token_bytes(texts, vocabulary), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def one_by_one(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return bins


def test_plan_equals_packing_one_by_one():
    rng = random.Random(3)
    for cap in (1, 7, 60, 64):
        for _ in range(20):
            lengths = rng.choices(range(1, cap + 1), k=rng.randint(1, 200))
            held = defaultdict(list)
            for n, lo, hi, b, each, base in packing.plan(Counter(lengths), cap):
                for r in range(lo, hi):
                    held[b + (r - lo) // each].append((base + (r - lo) % each * n, n))
            for v in held.values():
                v.sort()
                assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False))
            assert sorted(cap - sum(n for _, n in v) for v in held.values()) == sorted(one_by_one(lengths, cap))
            assert sorted(n for v in held.values() for _, n in v) == sorted(lengths)


def test_packing_rows(spark, vocabulary):
    docs = frame(spark, [*ODD, *prose(random.Random(4), 200), "w " * 9000])
    got = packing.pack(packing.pieces(docs, vocabulary, 512), 512).toPandas()
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 512).all() and all((g.offset == g.length.cumsum() - g.length).all() for _, g in by)
    per_doc = Counter()
    for t in docs.toPandas().text:
        n = len(packing.token_bytes([t], vocabulary)[0]) // 4 + 1
        per_doc.update([512] * (n // 512) + [n % 512] * (n % 512 > 0))
    assert Counter(got.length) == per_doc and got.sequence_id.nunique() == len(one_by_one(per_doc.elements(), 512))
    assert packing.pack(packing.pieces(frame(spark, []), vocabulary)).count() == 0


def test_equal_rows_are_dealt_among_buckets(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 10)
    docs = spark.createDataFrame([(None, "same text here")] * 500 + [(1, "other")] * 3, "doc_id long, text string").repartition(3)
    got = packing.pack(packing.pieces(docs, vocabulary, 64), 64)
    assert "salt" not in got.columns
    got = got.toPandas()
    n = got.length.max()
    assert len(got) == 503 and got.groupby(["sequence_id", "offset"]).size().max() == 1 and got.groupby("sequence_id").length.sum().max() <= 64
    assert got.sequence_id.nunique() == len(one_by_one([n] * 500 + [got.length.min()] * 3, 64))


# token counts


def test_automaton_equals_greedy_matching(spark):
    rng = random.Random(5)
    tokens = [bytes([b]) for b in range(256)] + [bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(60)] + [b" " + bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(20)]
    a, known, longest = wordpiece.Automaton(tokens), set(tokens), 7

    def greedy(w):
        n = 0
        while w:
            w = w[max(k for k in range(1, min(len(w), longest) + 1) if w[:k] in known) :]
            n += 1
        return n

    for _ in range(3000):
        w = b" " + bytes(rng.choices(b"abcd", k=rng.randint(0, 14)))
        assert a.count(w) == greedy(w)
    with pytest.raises(ValueError, match="single bytes"):
        wordpiece.Automaton([b"a"])
    got = wordpiece.token_counts(frame(spark, ODD), queries.tokenizer_file("byte_bpe_50k.json")).toPandas()
    known = set(wordpiece.byte_tokens(queries.tokenizer_file("byte_bpe_50k.json")))
    longest = max(map(len, known))
    for r in got.dropna().itertuples():
        words = (ODD[int(r.doc_id)] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w) * n for w, n in Counter(words).items()))
    assert len(got) == len(ODD) + 2


# SimHash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [*ODD, *prose(random.Random(8), 40), "A B C", "É a"]:
        assert simhash.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def test_xxh64_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("some words here"))).first()[0] == np.uint64(xxhash.xxh64_intdigest(b"some words here", 42)).astype(np.int64)


@pytest.mark.parametrize("hot", [4096, 8])
def test_trie_links_span_all_components(spark, hot):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64) for _ in range(2)]
    near = base[rng.integers(0, 60, 400) // 3] ^ flips[0] ^ flips[1]
    fps = np.unique(np.concatenate([base, near, np.array([0, 1, 3, (1 << 64) - 1], np.uint64)]))
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5" if hot == 8 else "10000")  # so that a hot root path passes through in pieces
    comp = components.connected_components(simhash.links(df, hot=hot)).toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2, 1))
    lab = components.local_labels(len(fps), i, j)
    want = defaultdict(set)
    for k, root in enumerate(lab):
        want[root].add(int(fps.view(np.int64)[k]))
    got = defaultdict(set)
    for r in comp.itertuples():
        got[r.component].add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert all(k == min(v) for k, v in got.items())


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    random.Random(0).shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "x long, y long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert components.connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_simhash_groups_and_keeping_one(spark):
    rng = random.Random(10)
    texts = [*ODD, *prose(rng, 60)]
    texts += texts[15:30]
    docs = frame(spark, texts)
    got = simhash.simhash_groups(docs).toPandas()
    assert len(got) == len(texts) + 2
    low = got.groupby("component_id").doc_id.min()
    assert (low.index == low).all()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == got.component_id.nunique()
    assert simhash.simhash_groups(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0


def test_simhash_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(22)
    long = prose(rng, 25, [f"w{i}" for i in range(300)])
    texts = [*ODD, *long, *(t.upper() for t in long[:5]), *(" ".join(t.split()[:-1]) for t in long[5:12]), long[0] + " one more", *[long[3]] * 30]
    ids = [3 * i + 7 for i in range(len(texts))]
    rng.shuffle(ids)
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    fps = [slow_fingerprint(t) for t in texts]
    i, j = np.nonzero(np.array([[(a ^ b).bit_count() <= 2 for b in fps] for a in fps]))
    lab = components.local_labels(len(fps), i, j)
    low = {c: min(ids[k] for k in range(len(ids)) if lab[k] == c) for c in set(lab)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_near_dedup(spark, str(tmp_path)).collect()}
    assert got == {ids[k]: (f"{fps[k]:016x}", low[lab[k]]) for k in range(len(ids))}


def test_unlinked_groups_of_one_name_keep_a_row_each(spark):
    a, b, c, d = prose(random.Random(21), 4, [f"w{i}" for i in range(400)])
    rows = [(5, a), (7, a.upper()), (5, b), (9, b.upper()), (None, c), (None, c), (None, d), (None, "alone"), (None, a), (5, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [simhash.fingerprint(t.encode()) for t in (a, b, c, d, "alone")]
    assert min((x ^ y).bit_count() for i, x in enumerate(fps) for y in fps[:i]) > 2
    kept = sorted((r["doc_id"] or 0, r["text"].lower()) for r in simhash.keep_one(docs).collect())
    assert kept == sorted([(5, a), (5, b), (0, c), (0, d), (0, "alone")])


# repeated byte strings


def slow_strip(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"often": 1, "hot": 3, "settle": 10, "stream": 4}, {"often": 1000, "hot": 2, "settle": 10, "stream": 2}, {"bits": 3, "hot": 100}, {"bits": 1, "hot": 1_000_000}])
def test_repeats_equal_brute_force(spark, limits):
    # small batches, so that groups come in several pieces
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if limits else "10000")
    rng = random.Random(11)
    texts = [*ODD, *prose(rng, 60)]
    shared = [" ".join(prose(rng, 6))[:n] for n in (150, 199, 200, 201, 420, 700)]
    texts += [t + s + u for s in shared for t, u in zip(prose(rng, 6), prose(rng, 6), strict=True)]
    texts += ["ab" * 300, "q" + "ab" * 300, shared[5] * 2, "é" * 150, *texts[12:20]]
    docs = frame(spark, texts)
    rows = docs.toPandas()
    got = suffix.remove_repeats(docs, **limits).toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = Counter(slow_strip(rows.text))
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).hex()) for r in got.itertuples()) == want
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


# decontamination


def test_blocks_select_the_windows(spark, monkeypatch):
    """Without fingerprints that meet, the blocks' pass finds nothing, and the extra pass is given what they settle no more."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    pairs = lambda df: {(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in df.collect()}
    whole, blocks = pairs(decontam.matches(docs, bench)), pairs(decontam.matches(docs, bench, exact=False))
    assert blocks <= whole and len(blocks) >= 0.9 * len(whole) > 0
    own = decontam.near
    monkeypatch.setattr(decontam, "near", lambda *a: own(*a).limit(0))
    assert pairs(decontam.matches(docs, bench, exact=False)) == set() and pairs(decontam.matches(docs, bench)) == whole


def slow_matches(docs, items):
    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    shingles = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])
    out = {}
    for d, t in docs:
        s = shingles(words(t))
        for i, u in items:
            m = shingles(words(u))
            best = 0
            for k in range(max(1, len(s) - len(m) + 1)):
                a, b = Counter(m), Counter(s[k : k + len(m)])
                both = sum((a & b).values())
                best = max(best, both / max(1, len(m) + sum(b.values()) - both))
            if m and best >= 0.8:
                out[d, i] = max(round(best, 9), out.get((d, i), 0))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(12)
    bag = ["".join(rng.choices("abcdefghijklmn", k=5)) for _ in range(900)]
    items = [(i, " ".join(rng.choices(bag, k=n))) for i, n in enumerate((3, 8, 20, 20, 45, 50))] + [(90, None), (91, ""), (92, "na na na na na na na na na na")]
    texts = [*ODD, *prose(rng, 40, bag)]
    for _, t in items[:6]:
        w = t.split()
        texts += ["pre " * 5 + t + " post", t.upper().replace(" ", ".!! "), t, "x " + " ".join(w[:-1]), " ".join([*w[: len(w) // 2], "edit", *w[len(w) // 2 :]]) + " more words", " ".join(w[: len(w) // 2]), " ".join(w[: int(len(w) * 0.93)]) + " tail of another kind"]
    texts.append("la " + "na " * 40)
    docs = frame(spark, texts)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hamming int")
    # items with a common preamble, one twice under the same id, and one in which a single shingle has much of the weight
    preamble = "answer the following question with one letter only and give no reasons "
    items += [(100 + k, preamble + " ".join(rng.choices(bag, k=12))) for k in range(4)] + [(100, preamble + "again with other words at its very end here now")]
    heavy = " ".join(["ho"] * 12 + rng.choices(bag, k=60))
    items.append((200, heavy))
    extra = [preamble + "x y z", items[-4][1] + " and so on", heavy.replace("ho " * 12, "hum " * 12), heavy, heavy.replace("ho " * 12, "ho " * 8)]
    docs = docs.unionByName(frame(spark, extra, len(texts)).dropDuplicates(["doc_id"]).where("doc_id is not null"))
    texts = texts + extra
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hamming int")
    got = decontam.contaminated(docs, bench).toPandas()
    want = slow_matches([(i, t) for i, t in enumerate(texts)], items)
    mine = {}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        mine[int(r.doc_id), int(r.item_id)] = max(round(r.similarity, 9), mine.get((int(r.doc_id), int(r.item_id)), 0))
    near = decontam.matches(docs, bench, exact=False)
    assert near.where(f"hamming > {decontam.RADIUS}").count() == 0 < near.count()
    assert mine == want and len(want) > 15
    found = {(r["doc_id"], r["item_id"]) for r in near.collect()}
    missed = {p for p in want if p not in found}
    assert len(missed) <= 0.1 * len(want) and found - {(None, i) for _, i in want} <= set(want)  # by the blocks alone
    kept = decontam.drop_contaminated(docs, bench)
    bad = {d for d, _ in want}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} - {None} == set(range(len(texts))) - bad
    assert decontam.contaminated(frame(spark, []), bench).count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
