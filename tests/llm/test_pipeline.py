"""The stages one after another on the smallest tables, each held against what it promises."""

import corpus_pipeline
from odolith.llm import packing, queries, secret_scan, simhash
from odolith.llm.store import cut

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, SF), name)
        seen.append((name, before, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    of = {n: (b.toPandas(), a.toPandas()) for n, b, a in seen}
    before, after = of["toxicity"]
    assert 0 < len(after) <= len(before)
    before, after = of["simhash_near_dedup"]
    groups = simhash.simhash_groups(seen[1][1]).toPandas()
    assert set(after.doc_id) == set(groups.component_id)
    before, after = of["benchmark_decontamination"]
    items = [t.lower() for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    assert not any(i in t.lower() for t in after.text for i in items) and len(after) > 0.9 * len(before)
    before, after = of["secret_scan"]
    assert set(before.doc_id) == set(after.doc_id) and not any(secret_scan.base_spans(t) for t in after.text) and (after.n_chars == after.text.map(len)).all()
    _, packed = of["best_fit_packing"]
    ids = packing.token_bytes(after.text.tolist(), queries.tokenizer_file())
    assert packed.length.sum() == sum(len(i) // 4 + 1 for i in ids)
    again = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "piece"]
    assert again.sort_values(key)[[*key, "length", "ids_crc32"]].values.tolist() == packed.sort_values(key)[[*key, "length", "ids_crc32"]].values.tolist()


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = cut(stage(spark, empty, SF), name)
        assert empty.count() == 0


def slow_pipeline(docs, weights, items, vocabulary):
    """{(doc_id, piece): (length, crc)} and the least number of bins best-fit decreasing opens, stage by stage with plain loops."""
    import zlib
    from collections import Counter, defaultdict

    import numpy as np
    from test_llm_operators import one_by_one, slow_fingerprint, slow_matches
    from test_secret_layers import slow_spans
    from test_toxicity import slow_features
    from tokenizers import Tokenizer

    w = dict(weights)
    score = lambda t: 1 / (1 + np.exp(-(w[-1] + sum(w.get(f, 0.0) for f in set(slow_features(t))))))
    docs = [d for d in docs if score(d[1]) < 0.3]
    fp = [slow_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    groups = defaultdict(list)
    for d, r in zip(docs, root, strict=True):
        groups[r].append(d)
    docs = [min(g) for g in groups.values()]
    bad = {d for d, _ in slow_matches(docs, items)}
    docs = [d for d in docs if d[0] not in bad]
    out, n_secrets = {}, 0
    t = Tokenizer.from_str(vocabulary)
    for i, text in docs:
        at, parts = 0, []
        for s, _, e in slow_spans(text):
            if s >= at:
                parts += [text[at:s], "[SECRET]"]
                n_secrets += 1
            at = max(at, e)
        ids = np.array([*t.encode("".join(parts) + text[at:], add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            out[i, k // 4096] = (len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    return out, len(one_by_one([n for n, _ in out.values()], 4096)), n_secrets, Counter(len(g) for g in groups.values()), len(bad)


def test_run_equals_brute_force(spark, tmp_path):
    import base64
    import random

    from odolith.llm import toxicity

    rng = random.Random(31)
    bag = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(600)]
    text = lambda n: " ".join(rng.choices(bag, k=n))
    items = [(k, text(30)) for k in range(3)]
    docs = [(i, text(rng.randint(5, 150)) + (" vile rotten filth" if i % 5 == 0 else "")) for i in range(150)]
    docs += [(200 + k, docs[1][1].upper()) for k in range(4)] + [(210 + k, text(20) + " " + t + " " + text(9)) for k, t in items]
    docs += [(220, "token: abcdef123456 " + text(30)), (221, base64.b64encode(b"password=hunter2222 and more").decode() + " " + text(9)), (222, text(9000)), (223, "")]
    labels = [(i, int(i % 5 == 0)) for i in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("doc_id", "1 as quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    weights = toxicity.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    want, n_bins, n_secrets, groups, n_bad = slow_pipeline(docs, weights, items, queries.tokenizer_file())
    assert n_secrets >= 2 and max(groups) >= 5 and n_bad == 3 and len(want) < 145
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    assert got.sequence_id.nunique() == n_bins and got.groupby("sequence_id").length.sum().max() <= 4096
