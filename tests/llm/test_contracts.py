"""Every operator's query against its SQL, or against a brute-force version, on the smallest tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    assert duck(q.QUERIES[name](spark, SF), q.ORACLE[name])


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in q.QUERIES} == {f"op{i}" for i in range(1, 14)}


def texts(spark):
    return {r.doc_id: r.text or "" for r in q.table(spark, SF, "documents").collect()}


def test_pieces_agree_with_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=q.model_path())
    want = {}
    for k, t in texts(spark).items():
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), len(t.encode()))
    got = {r[0]: tuple(r)[1:-1] for r in q.op7_pieces(spark, SF).collect()}
    assert got == want


def test_shards_hold_every_token_once(spark):
    import sentencepiece

    from weftline.llm import shards
    from weftline.llm.common import Scratch

    sp = sentencepiece.SentencePieceProcessor(model_file=q.model_path())
    docs = q.table(spark, SF, "documents")
    order = [(r.doc_id, sp.encode(r.text or "", add_bos=True, add_eos=True)) for r in docs.orderBy("doc_id").collect()]
    stream, owner = np.concatenate([i for _, i in order]), np.repeat([d for d, _ in order], [len(i) for _, i in order])
    index = shards.write(docs, q.model_path(), Scratch(spark, "t"), length=512, shard_slots=64)
    got = sorted((tuple(r) for r in shards.read(index).collect()), key=lambda r: r[0])
    n = len(got)
    assert [r[0] for r in got] == list(range(n)) and n == -(-len(stream) // 512)
    back = shards.permute(np.arange(n), n, back=True)
    for slot, shard, at, n_tokens, ids, data in got:
        k = back[slot] * 512
        assert np.frombuffer(data, "<u2").tolist() == stream[k : k + 512].tolist() and n_tokens == len(stream[k : k + 512])
        assert ids == list(dict.fromkeys(owner[k : k + 512].tolist()))
        assert (shard, at) == (slot // 64, slot % 64 * 1024)


def test_toxicity_of_held_out_documents(spark):
    got = q.op8_toxicity(spark, "/root/testdata/sf0.1").join(q.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    pos, neg = np.array([r.score for r in got if r.toxic]), np.array([r.score for r in got if not r.toxic])
    auc = (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()
    assert auc > 0.95 and (neg >= 0.7).mean() < 0.02 and (pos >= 0.7).mean() > 0.7


def test_languages_of_held_out_documents(spark):
    got = q.op9_langid(spark, "/root/testdata/sf0.01").join(q.table(spark, "/root/testdata/sf0.01", "documents"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_pipeline_against_plain_python(spark):
    """Stage by stage: exact, near and mix by brute force over what the stage before kept; pieces by the library."""
    import sentencepiece

    docs, after = q.table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after[name] = {}
        for r in docs.collect():
            after[name].setdefault(r.doc_id, []).append(r.text or "")
    kept, plain = {k: v[0] for k, v in after["toxicity"].items()}, {}
    for k, t in sorted(kept.items(), key=lambda x: (-len(x[1]), x[0])):
        plain.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), k)
    assert set(after["exact dedup"]) == set(plain.values())
    sets = {k: shingled(v[0]) for k, v in after["exact dedup"].items()}
    assert set(after["minhash near-dedup"]) == {k for k, root in brute_components(sets).items() if k == root}
    assert set(after["mixing"]) <= set(after["minhash near-dedup"]) and max(map(len, after["mixing"].values())) <= 2
    words = sum(len(t.split()) for v in after["minhash near-dedup"].values() for t in v)
    assert abs(sum(len(t.split()) for v in after["mixing"].values() for t in v) - 1.5 * words) < 0.05 * words
    sp = sentencepiece.SentencePieceProcessor(model_file=q.model_path())
    out = sorted((r.doc_id, r.ids) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    assert out == sorted((k, sp.encode(t, add_bos=True, add_eos=True)) for k, v in after["mixing"].items() for t in v)


def test_pipeline_of_odd_tables(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing columns, and no rows at all, stage by stage."""
    names = ["key", "digest", "picked", "kept", "rank", "level", "copies", "size", "id", "row", "doc", "text_sha256"]
    base = q.table(spark, SF, "documents")
    long = " ".join(f"word{i % 977} is number {i}" for i in range(30_000))
    odd = [(None, None, None, None, None), (9001, "", "en", "a", 0), (9002, " \n", None, "a", 2), (9003, long, "en", None, None), (9003, long, "en", None, None), (9004, "two words", "en", "b", 9)]
    docs = base.limit(40).unionByName(spark.createDataFrame(odd, base.schema))
    docs = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for table in (docs, docs.limit(0)):
        now, seen = table, table.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, now, SF).collect()
            assert all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in rows), name
            assert len(rows) <= seen * (2 if name == "mixing" else 1)
            now, seen = spark.createDataFrame(rows, table.schema), len(rows)
            if name == "exact dedup":
                assert len([r for r in rows if not (r.text or "").strip()]) == (1 if seen else 0) and [r.doc_id for r in rows].count(9003) == (1 if seen else 0)
        out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
        assert len(out) == seen and all(r.n_tokens >= 2 for r in out)


def test_which_documents_are_held_out(spark):
    import zlib

    for name, parts, held in (("op8_toxicity", 3, 1), ("op9_langid", 4, 2)):
        got = {r.doc_id: r.held_out for r in q.QUERIES[name](spark, SF).select("doc_id", "held_out").collect()}
        assert got == {k: zlib.crc32(str(k).encode()) % parts == held for k in texts(spark)} and 0 < sum(got.values()) < len(got)


def plain_words(text):
    """Letters, digits and bytes of other characters, lower-cased as A-Z only; a sentence ends at . ! ? or a line's end."""
    import re

    data = text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return [w for w in (re.findall(rb"[0-9a-z\x80-\xff]+", s) for s in re.split(rb"[.!?\n]", data)) if w]


def test_toxicity_scores_against_plain_python(spark):
    """The noisy-or over sentences of a logistic function of the words and beginnings a sentence has, one by one."""
    import math

    from weftline.llm import toxicity
    from weftline.llm.common import span_hash, sums_of

    docs = q.table(spark, SF, "documents")
    model = toxicity.fit(docs, q.table(spark, SF, "labels").where(q.fold(3) != 1))
    number = lambda w: int(span_hash(sums_of(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0])
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, model).collect()}
    for k, t in sorted(texts(spark).items())[:80]:
        clean = 0.0
        for words in plain_words(t):
            found = {number(w) >> 46 for w in words} | {(number(w[:n]) ^ n) >> 46 for w in words for n in toxicity.PREFIXES if len(w) > n}
            z = model.bias + sum(float(model.weights[f]) for f in found)
            clean -= math.log1p(math.exp(z)) if z < 30 else z
        assert abs(got[k][0] - (1 - math.exp(clean))) < 1e-9 and got[k][1] == (got[k][0] >= 0.7)


def test_languages_against_plain_python(spark):
    """Margins from every gram of 4 bytes, and the codeword with the least weighted loss, row by row."""
    import math

    from weftline.llm import langid

    docs = q.table(spark, SF, "documents")
    model = langid.fit(docs.where(q.fold(4) != 2))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    fold = lambda c: c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c.lower() if "À" <= c <= "Þ" and c != "×" else c
    for k, t in sorted(texts(spark).items())[:80]:
        data = "".join(map(fold, t)).encode()
        grams = [g for i in range(len(data)) if (g := data[i : i + 4].ljust(4)) != b"    "]
        total = np.zeros(len(model.bias))
        for g in grams:
            total += model.weights[int.from_bytes(g, "little") * 0x9E3779B1 % 2**32 >> 32 - langid.BITS]
        margin = total / max(1, len(grams)) + model.bias
        loss = [sum(w * math.log1p(math.exp(-m * b)) for w, m, b in zip(model.trust, margin, code, strict=True)) for code in model.code]
        best = min(range(len(loss)), key=loss.__getitem__)
        want = (model.langs[best], 1 / sum(math.exp(min(loss) - x) for x in loss)) if any(map(str.isalpha, t)) else ("und", 0.0)
        assert got[k][0] == want[0] and abs(got[k][1] - want[1]) < 1e-4


def shingled(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(sets):
    root = {k: k for k in sets}
    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root
