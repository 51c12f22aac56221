"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import chat, common, exact, langid, mix, near, pieces, shards, shingles, toxicity, vectors, warc
from weftline.llm import queries as q
from weftline.llm.common import Scratch, text_of, word_hashes
from weftline.llm.common import pieces as cut

DOCS = "doc_id long, text string, lang string, source string, score double, rank int, key string, copies int"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with nulls everywhere, equal rows, an empty, a blank and a long text, and columns named like results."""
    long = " ".join(f"word{i % 977} is number {i}" for i in range(40_000))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [
        (1, base, "en", "a", 1.0, 1, "k", 1),
        (2, base, "en", "a", 1.0, 1, "k", 1),
        (2, base, "en", "a", 1.0, 1, "k", 1),
        (3, base + "  ", "en", None, None, None, None, None),
        (4, None, None, None, None, None, None, None),
        (5, "", "en", "b", None, None, None, None),
        (6, " \n\t", "en", "b", None, None, None, None),
        (7, "two words", "en", "b", None, None, None, None),
        (None, base, "en", "c", None, None, None, None),
        (8, long, "en", "c", None, None, None, None),
        (9, long + " end", "en", "c", None, None, None, None),
        (10, "1234 5678 !!", "en", "c", None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def scratch(spark):
    s = Scratch(spark, "test")
    yield s
    s.drop()


def test_word_hashes_do_not_depend_on_slices():
    import pyarrow as pa

    texts = ["A b\tc", "", None, "x" * 10, "a B C"]
    raw, bounds = text_of(pa.array(texts))
    h, at = word_hashes(raw, bounds)
    assert np.diff(at).tolist() == [3, 0, 0, 1, 3] and (h[0:3] == h[4:7]).all()
    big = ("ab cd " * 600_000).encode()
    raw = np.frombuffer(big, np.uint8)
    assert len(list(cut(raw, 0, len(raw)))) > 2
    h, _ = word_hashes(raw, np.array([0, len(raw)]))
    assert len(h) == 1_200_000 and len(np.unique(h)) == 2


# --- 1


def test_vectors(spark, scratch):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0]
    rows = [(5, a), (3, a), (3, a), (9, b), (7, [0.0, 0.0, 0.0]), (8, None), (10, [float("nan"), 1.0, 0.0]), (11, [float("inf"), 1.0, 0.0]), (12, [None, 1.0, 1.0]), (13, []), (14, [1.0, 0.0]), (15, [1e-30, 0.0, 0.0]), (None, b), (16, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("x"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.dedup(df, scratch).collect()), key=str)
    linked = [(3, 5, 3, True), (3, 5, 3, True), (5, 5, 3, False), (9, 5, 3, False), (15, 5, 3, False), (None, 5, 3, False)]
    alone = [(i, 0, i, True) for i in (7, 8, 10, 11, 12, 13, 14, 16)]
    assert got == sorted(linked + alone, key=str)
    assert vectors.dedup(df.limit(0), scratch).count() == 0
    # different vectors with one hash are different classes
    same = vectors.dedup(df, Scratch(spark, "t"), hash_of=lambda v: F.lit(1).cast("long"))
    assert sorted(map(str, same.collect())) == sorted(map(str, vectors.dedup(df, Scratch(spark, "t")).collect()))


def brute_vectors(x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    return np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x)), near.labels(i, j, len(x))


def test_vectors_find_links_at_the_threshold_and_in_split_buckets(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, *[base + 0.2 * rng.standard_normal(base.shape) for _ in range(9)], base[:1] + 0.02 * rng.standard_normal((200, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    n, root = brute_vectors(x, 0.95)
    for block in (2048, 40):
        got = vectors.dedup(df, Scratch(spark, "t"), block=block).orderBy("vec_id").collect()
        assert sum(r.n_links for r in got) >= 0.99 * n.sum() and all(r.n_links <= m for r, m in zip(got, n, strict=True))
        assert np.mean([r.component_id == c for r, c in zip(got, root, strict=True)]) > 0.99


def test_shape_grows_slowly():
    (k1, l1), (k2, l2) = vectors.shape(10_000), vectors.shape(10_000_000)
    assert k1 < k2 < 2 * k1 and l1 < l2 < 6 * l1
    near_p = vectors.collision((0.1) ** 0.5, vectors.WIDTH)
    assert 1 - (1 - near_p**k1) ** l1 >= vectors.RECALL


# --- 2


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<\\/s> [\\NEXT] [NEXT]", "", None, "ends with [", "ends with <", "[\\\\/INST]", "<s><s>", "[[INST]]"]
    rows = [(1, i, ["user", "assistant", "assistant", None][i % 4], t) for i, t in enumerate(said)] + [(2, 0, "a]b", "x"), (2, 0, "a]b", "x"), (2, None, "[INST]", "y"), (None, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    want = [(r or "", t or "") for _, _, r, t in sorted(rows[: len(said)], key=lambda r: r[1])]
    assert [(t.role, t.text) for t in got[1].turns] == want
    assert got[1].loss == [t for r, t in want if r == "assistant"]
    assert [(t.role, t.text) for t in got[2].turns] == [("[INST]", "y"), ("a]b", "x"), ("a]b", "x")]
    assert got[2].n_blocks == 2 and got[None].turns[0].text == "z"
    assert chat.format_chat(df.limit(0)).count() == 0
    r = out.where("conv_id = 1").first()
    blocks = r.formatted[3:].split("</s>")
    assert "".join(chat_text(blocks[s.block][s.start : s.start + s.length]) for s in r.loss_spans) == "".join(got[1].loss)


def chat_text(span):
    import re

    return "".join(re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\]|NEXT\])", r"\1\2\3", t) for t in span.split("[NEXT]"))


def test_long_conversation_is_merged_across_chunks(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.digests(chat.read_back(chat.format_chat(df))).first()
    want = "".join(f"user\n{i}\n" for i in range(3000))
    long = "a very [INST] long </s> turn " * 100_000
    df2 = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r2 = chat.digests(chat.read_back(chat.format_chat(df2))).first()
    assert (r2.loss_chars, r2.loss_sha256) == (len(long), hashlib.sha256(long.encode()).hexdigest())
    assert r2.turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n".encode()).hexdigest()
    assert (r.n_turns, r.n_blocks, r.loss_chars) == (3000, 1, 0) and r.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()


# --- 3


def test_mix(spark, docs, scratch):
    got = mix.mix(docs, scratch).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.doc_id: r.size for r in got if r.doc_id in (4, 5, 6, 7)} == {4: 0, 5: 0, 6: 0, 7: 2}
    assert [r.taken for r in got if r.doc_id == 2][0] == [r.taken for r in got if r.doc_id == 2][1]
    assert sorted(map(str, got)) == sorted(map(str, mix.mix(docs.repartition(5), Scratch(spark, "t")).collect()))
    assert mix.mix(docs.limit(0), Scratch(spark, "t")).count() == 0
    rows = mix.repeated(docs, Scratch(spark, "t"))
    assert rows.schema == docs.schema or rows.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in rows.collect()) == sum(r.taken for r in got)


def test_mix_reaches_its_targets(spark):
    rows = [(i, "w " * (1 + i * i % 90), f"s{i % 7}") for i in range(3000)]
    got = mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), Scratch(spark, "t")).withColumn("s", F.col("doc_id") % 7).groupBy("s").agg(F.sum("taken"), F.first("target"), F.first("source_size")).collect()
    total = sum(r[3] for r in got)
    assert abs(sum(r[2] for r in got) - 1.5 * total) < 1e-6 * total
    assert all(abs(r[1] - r[2]) <= 0.005 * r[2] and r[2] <= 2 * r[3] + 1e-9 for r in got)


def test_mix_prior_changes_the_odds(spark):
    rows = mix.sized(spark.createDataFrame([(i, "w w w", f"s{i % 2}") for i in range(2000)], "doc_id long, text string, source string"))
    plan = mix.allocate(rows, Scratch(spark, "t"), weights=(1, 1), share=0.5, prior=F.when(F.col("name").cast("long") % 4 < 2, 1.9).otherwise(0.1))
    out = mix.ranked(mix.with_plan(rows, plan), F.when(F.col("name").cast("long") % 4 < 2, 1.9).otherwise(0.1)).withColumn("in", mix.sampled())
    a, b = (out.where(f"doc_id % 4 {t} 2").select(F.avg(F.col("in").cast("int"))).first()[0] for t in ("<", ">="))
    assert a > 0.85 and b < 0.15


def test_mix_includes_documents_as_often_as_their_probability_says(spark):
    """Over many seeds, by tenth of the sizes: the share that is sampled is the mean inclusion probability, which grows with the size."""
    rng = np.random.default_rng(2)
    size = np.maximum(1, rng.lognormal(4, 1.3, 1500).astype(int))
    docs = spark.createDataFrame([(i, "w " * int(n), f"s{i % 2}") for i, n in enumerate(size)], "doc_id long, text string, source string").cache()
    hits, p = np.zeros(len(size)), np.zeros(len(size))
    for seed in range(4):
        rows = mix.sized(docs, f"seed {seed}")
        plan = mix.allocate(rows, Scratch(spark, "t"), weights=(1, 1), share=0.5)
        for r in mix.ranked(mix.with_plan(rows, plan)).select("doc_id", "p", mix.sampled().alias("in")).collect():
            hits[r.doc_id] += r["in"] / 4
            p[r.doc_id] = r.p
    tenths = np.array_split(np.argsort(size, kind="stable"), 10)
    got, want = (np.array([x[t].mean() for t in tenths]) for x in (hits, p))
    assert (np.diff(want) > 0).all() and want[-1] > 1.5 * want[0] and abs(got - want).max() < 0.06


# --- 4 and 7


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    p = shards.permute(np.arange(n), n)
    assert sorted(p) == list(range(n)) and (shards.permute(p, n, back=True) == np.arange(n)).all()


def shard_rows(index):
    return sorted((r.slot, r.shard, r.byte_offset, r.n_tokens, r.doc_ids, bytes(r.tokens)) for r in shards.read(index).collect())


def test_shards(spark, docs, scratch):
    index = shards.write(docs, q.model_path(), scratch, length=64, shard_slots=100)
    got = shard_rows(index)
    tokens = pieces.encode(docs, q.model_path(), ("n_tokens",)).agg(F.sum("n_tokens")).first()[0]
    assert sum(r[3] for r in got) == tokens and [r[0] for r in got] == list(range(-(-tokens // 64)))
    assert {r[1] for r in got} == set(range(-(-len(got) // 100))) and all(r[2] == r[0] % 100 * 128 for r in got)
    # neither partitions nor the order of rows matter
    other = shards.write(docs.orderBy(F.rand(3)).repartition(7), q.model_path(), Scratch(spark, "t"), length=64, shard_slots=100)
    assert shard_rows(other) == got
    assert shards.read(shards.write(docs.limit(0), q.model_path(), Scratch(spark, "t"))).count() == 0


def test_shards_resume_only_the_same_job(spark, docs, scratch):
    import os

    def run(docs=docs, resume=True, **other):
        return shards.write(docs, q.model_path(), scratch, folder=scratch.path("job"), **({"length": 64, "shard_slots": 100} | other), resume=resume)

    files = lambda: {f: os.stat(f"{home}/{f}").st_mtime_ns for f in os.listdir(home) if f.endswith(".bin")}
    got, home = shard_rows(run(resume=False)), scratch.path("job/shards").removeprefix("file://")
    before = files()
    assert shard_rows(run()) == got and files() == before
    for bad in ({"key": 5}, {"length": 32}, {"shard_slots": 50}, {"docs": docs.where("doc_id <> 7")}, {"docs": docs.withColumn("text", F.upper("text"))}):
        with pytest.raises(ValueError, match="other"):
            run(**bad)
    with pytest.raises(ValueError, match="already"):
        run(resume=False)
    lost = sorted(before)[2]
    os.remove(f"{home}/{lost}")
    assert shard_rows(run(docs.repartition(3))) == got
    assert {f for f, t in files().items() if before[f] != t} == {lost}


def test_ids_beyond_16_bits_are_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(pieces.Codec, "encode", lambda self, texts: [np.array([70_000], np.uint32) for _ in texts])
    batch = __import__("pyarrow").RecordBatch.from_pydict({"id": [1], "text": ["x"]})
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    seen = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema: seen.setdefault("fn", fn))
    shards.encoded(docs, q.model_path())
    with pytest.raises(ValueError, match="16 bits"):
        list(seen["fn"]([batch]))


def spans_hold_their_pieces(sp, text, ids, begins, ends):
    """Each piece's own bytes, with spaces for marks, are those of its span; the first mark has none, and a byte piece is its byte."""
    data = text.encode()
    for k, (i, b, e) in enumerate(zip(ids[1:-1], begins[1:-1], ends[1:-1], strict=True)):
        want = bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
        shown = data[b:e].replace("▁".encode(), b" ")
        # a character of several byte pieces ends where its last one ends
        assert shown == (want[1:] if k == 0 else want) or sp.is_byte(i) and want in (data[b : b + 4] if k else b" "), (i, b, e, want, shown)


def test_pieces(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=q.model_path())
    got = pieces.encode(docs, q.model_path(), ("ids", "begins", "ends", "decoded")).collect()
    text = [r.text or "" for r in docs.collect()]
    for r, t in zip(got, text, strict=True):
        assert r.ids == sp.encode(t, add_bos=True, add_eos=True) and r.decoded == sp.decode(r.ids)
        assert r.ends[-1] == len(t.encode()) and all(a <= b for a, b in zip(r.begins, r.ends, strict=True))
        spans_hold_their_pieces(sp, t, r.ids, r.begins, r.ends)
    assert pieces.encode(docs.limit(0), q.model_path()).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a", "a  ", " a  b ", "▁x a▁b ▁▁ c", "日本語 テキスト 😀", "\x00\t\r\n", "<s> </s>", "ab" * 3000, "12 345"])
def test_pieces_of_odd_texts(text):
    import sentencepiece

    sp, c = sentencepiece.SentencePieceProcessor(model_file=q.model_path()), pieces.codec(q.model_path())
    ids = c.encode([text])[0]
    assert ids.tolist() == sp.encode(text, add_bos=True, add_eos=True)
    b, e = c.spans(*c.aligned([text])[0])
    assert e.max() == len(text.encode()) and (b[1:] >= e[:-1]).all()
    if "\x00" not in text and "<" not in text:
        spans_hold_their_pieces(sp, text, ids.tolist(), b, e)


def test_spans_through_a_character_map(tmp_path):
    """The same vocabulary with a compiled map: ids as the library's, spans in the bytes before normalisation."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(q.model_path(), "rb") as f:
        model = proto.ModelProto.FromString(f.read())
    made = proto.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model.normalizer_spec.CopyFrom(made.normalizer_spec)
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    sp, c = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Codec(str(path))
    for text in ("ﬁne  ½ ＡＢＣ", " lead and trail ", "été ｶﾞ", "plain", "a　b\n\nc", ""):
        ids = c.encode([text])[0]
        assert ids.tolist() == sp.encode(text, add_bos=True, add_eos=True)
        b, e = c.spans(*c.aligned([text])[0])
        assert len(b) == len(ids) and (e >= b).all() and e.max(initial=0) <= len(text.encode())
    assert c.spans(*c.aligned(["ﬁ"])[0])[1].max() == 3
    ids, norm, at = c.aligned(["a ﬁ  ½"])[0]
    assert norm.decode() == "▁a▁fi▁1⁄2" and at.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 5, 5, 5, 7, 7, 7, 7, 7, 9]


# --- 5


def test_shingles(spark, docs, scratch):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in shingles.dedup(docs, scratch).collect()}
    n = {r[0]: r[1] for r in got}
    assert (n[1], n[7], n[4], n[5], n[6]) == (8, 1, 0, 0, 0)
    assert {r[0]: r[2] for r in got} == {1: 1, 2: 1, 3: 1, None: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10}
    assert {r[0] for r in got if r[3]} == {1, 4, 5, 6, 7, 8, 10}
    kept = shingles.keep_one(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 10]
    assert shingles.dedup(docs.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("leaf", [800, 8])
def test_shingles_against_brute_force(spark, leaf):
    """Near copies around the threshold, in chains and a crowd, also when nodes branch and split into blocks."""
    from tests.llm.test_contracts import brute_components, shingled

    rng = np.random.default_rng(1)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for g in range(12):
        base = list(rng.choice(vocabulary, 60))
        for _ in range(30 if g == 0 else 5):
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.dedup(df, Scratch(spark, "t"), leaf=leaf, levels=2).collect()}
    assert got == brute_components({k: shingled(t) for k, t in rows})


def test_repeated_rows_beside_a_near_copy_stay_rows_of_their_own(spark):
    """A doc_id that is its class's first one and repeated with equal text, whatever the order in which a unit is read."""
    import itertools

    import pyarrow as pa

    base = [f"w{i}" for i in range(80)]
    near_, said = " ".join(base), " ".join([*base, "x"])
    for order in set(itertools.permutations([near_, said, said])):
        words = [t.encode().split() for t in order]
        sets = [next(shingles.shingle_sets(*text_of(pa.array([t])))) for t in order]
        sketch = [(shingles.signature(x) >> np.uint64(56)).astype(np.uint8).tobytes() for x in sets]
        key = [len(t) for t in order]
        star = [b.to_pydict() for b in shingles.check(pa.table({"unit": [1] * 3, "part": [0] * 3, "key": key, "root": key, "sketch": sketch, "digest": [shingles.digest_of(w) for w in words], "text": list(order)}))]
        assert [len(x["a"]) for x in star] == [1] and star[0]["a"] != star[0]["b"]
    for rows in ([(3, near_), (2, said), (2, said)], [(2, said), (2, said), (3, near_)], [(2, said), (3, near_), (2, said), (2, said)]):
        got = shingles.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), Scratch(spark, "t")).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted((i, 2, i == 2) for i, _ in rows)


def test_words_that_a_polynomial_modulo_a_power_of_two_confuses_stay_apart(spark):
    """The Thue-Morse word of 1,024 letters and its complement, as documents of one word and within longer ones."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))
    tail = " ".join(f"w{i}" for i in range(8))
    df = spark.createDataFrame([(1, a), (2, b), (3, f"{tail} {a} {tail}"), (4, f"{tail} {b} {tail}")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.dedup(df, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_exact_sets_count_as_sets_of_tuples_do():
    rng = np.random.default_rng(5)
    texts = [[b"%d" % x for x in rng.integers(0, 3, n)] for n in (0, 1, 4, 5, 6, 40, 40, 200, 4, 1)]
    sets = shingles.exact_sets(texts)
    plain = [{tuple(t)} if 0 < len(t) < 5 else {tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    for i, x in enumerate(plain):
        assert len(sets[i]) == len(x)
        assert all(len(np.intersect1d(sets[i], sets[j])) == len(x & y) for j, y in enumerate(plain))


def test_trees_follow_from_recall_and_depth():
    few, many = shingles.roots_of(0), shingles.roots_of(shingles.LEVELS)
    assert len(few) < len(many) and shingles.missed(len(many), shingles.LEVELS) <= 1 - shingles.RECALL < shingles.missed(len(many) - 2, shingles.LEVELS)
    assert shingles.missed(len(many), 1) < 1e-4


def test_recall_at_the_threshold_and_full_depth():
    """Pairs of sets with a similarity of 0.75 that are branched down all levels: how many meet in no leaf."""
    rng = np.random.default_rng(9)
    lost, pairs, levels = 0, 1500, shingles.LEVELS
    chosen = shingles.roots_of(levels)
    for _ in range(pairs):
        x = rng.integers(1, 2**63, 700, dtype=np.uint64)
        tokens = [(shingles.signature(s) >> np.uint64(56)).astype(np.int64) for s in (x[:600], x[100:])]  # 500 of 700 are common: 0.714
        same = shingles.signature(x[:600]) == shingles.signature(x[100:])
        same |= rng.random(len(same)) < (0.75 - 500 / 700) / (1 - 500 / 700)  # as for 0.75
        nodes = [(t << 8 | p) for t, p in chosen if same[p]]
        nodes = [int(shingles.mix(np.array([hash((n, int(tokens[0][n & 255]))) & (1 << 63) - 1], np.uint64))[0]) for n in nodes]
        for _ in range(levels):
            below = []
            for node in nodes:
                draw = int(shingles.mix(np.array([node], np.uint64))[0])
                first = draw % shingles.TOKENS
                picks = [first, (first + 1 + (draw >> 32) % (shingles.TOKENS - 1)) % shingles.TOKENS] if (draw >> 20) % 3 < shingles.TWO else [first]
                below += [int(shingles.mix(np.array([node ^ (p * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64))[0]) for p in picks if same[p]]
            nodes = below
        lost += not nodes
    assert lost <= 0.01 * pairs


@pytest.mark.parametrize("bound", [{"task_classes": 4}, {"task_bytes": 900}, {"leaf": 5, "levels": 1, "task_classes": 3}])
def test_large_groups_are_connected_as_small_ones_are(spark, bound):
    """A crowd that hangs together, a chain that only neighbours link, and strangers among them: in one unit or in many."""
    from tests.llm.test_contracts import brute_components, shingled

    base, chain = [f"w{i}" for i in range(80)], [f"v{i}" for i in range(160)]
    rows = [(i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(20)]
    rows += [(20 + i, " ".join(chain[3 * i : 3 * i + 60])) for i in range(30)]
    rows += [(60, " ".join([*base[:40], *chain[:40]]))]
    got = {r.doc_id: r.component_id for r in shingles.dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), **bound).collect()}
    assert got == brute_components({k: shingled(t) for k, t in rows})


def test_components_of_a_chain(spark, scratch):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(7)
    got = near.components(edges, scratch, "c")
    assert got.count() == 301 and got.where("root = 0").count() == 301
    assert near.components(edges.limit(0), scratch, "e").count() == 0


# --- 6


def test_warc(spark, scratch):
    rows = [(1, "http://a/ü b\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "WARC/1.1\r\n\r\n" * 3), (6, "u", "x" * 3_000_000), (7, "u", "tiny")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    manifest = warc.write(df, scratch, roll_bytes=1 << 20)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload and hashlib.sha256(bytes(r.payload)).hexdigest()) for r in warc.read(manifest).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    p = rows[0][2]
    kinds = {(a, b, c, d) for a, b, c, d, _ in got}
    assert kinds == {(1, "revisit", 2, 9), (2, "response", None, 9), (None, "revisit", 2, 9), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 36), (6, "response", None, 3_000_000), (7, "response", None, 4)}
    assert {e for a, _, _, _, e in got if a in (2, 5, 6, 7)} == {sha(p), sha(rows[6][2]), sha(rows[7][2]), sha("tiny")}
    all_in = warc.read(warc.write(df, Scratch(spark, "t"), least_bytes=10)).where("record_type = 'revisit'").count()
    assert all_in == 0
    assert warc.read(warc.write(df.limit(0), Scratch(spark, "t"))).count() == 0


def test_archives_of_revisits_roll_too(spark, scratch):
    """A hot payload: one response, all others revisits without payload, which fill archives as well."""
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.lit("<p>same</p>").alias("html")).coalesce(1)
    manifest = warc.write(df, scratch, roll_bytes=100_000).collect()
    assert sum(r.records for r in manifest) == 3000 and len(manifest) > 8 and max(r.records for r in manifest) < 400
    got = warc.read(spark.createDataFrame(manifest)).groupBy("record_type", "refers_to").count().collect()
    assert {tuple(r) for r in got} == {("response", None, 1), ("revisit", 2999, 2999)}


def test_archive_starts_with_its_dictionary(tmp_path):
    import io

    import zstandard

    records = [warc.record(i, f"http://h/{i}", b"<p>some page</p>" * (i % 9), 1, "D", None, False) for i in range(300)]
    data = warc.pack(records)
    assert data[:4] == warc.SKIPPABLE
    n = int.from_bytes(data[4:8], "little")
    own = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    assert zstandard.ZstdDecompressor(dict_data=own).decompress(data[8 + n :]) == records[0]  # a frame of its own
    assert [h["WARC-Record-ID"] for h, _ in warc.unpack(io.BytesIO(data))] == [f"<urn:page:{i}>" for i in range(300)]


def test_a_cut_archive_is_an_error(spark, tmp_path):
    data = warc.pack([warc.record(i, "u", b"x", 1, warc.digest_of(b"x"), None, False) for i in range(30)])
    (tmp_path / "a.warc.zst").write_bytes(data[:-20])
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst", 30)], "path string, records long")
    with pytest.raises(Exception, match="records|record"):
        warc.read(manifest).collect()


# --- 8 and 9


def toxic_table(spark):
    rows = [(i, f"All is calm here. {'You are a moronic clown.' if i % 4 == 0 else 'You are a kind friend.'} The day number {i} ends well.", int(i % 4 == 0)) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_locates_sentences(spark, docs):
    t = toxic_table(spark)
    model = toxicity.fit(t.drop("toxic"), t.select("doc_id", "toxic"))
    text = "A calm start. What a moronic clown! A calm end."
    long = "The day is calm. " * 150_000 + "What a moronic clown! " + "All ends well. " * 1000
    new = spark.createDataFrame([(1, text), (2, "All is calm."), (3, None), (4, ""), (5, "..."), (6, long), (6, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(new, model).collect()}
    assert got[1].predicted == 1 and [text[s.begin : s.end] for s in got[1].offending] == ["What a moronic clown"]
    assert got[2].predicted == 0 and got[3].score == got[4].score == got[5].score == 0
    assert [long[s.begin : s.end] for s in got[6].offending] == ["What a moronic clown"]
    assert {r.doc_id for r in toxicity.keep_clean(new, model).collect()} >= {2, 3, 4, 5} and 1 not in {r.doc_id for r in toxicity.keep_clean(new, model).collect()}
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}


def test_ids_with_two_labels_are_not_learned_from(spark):
    from weftline.llm.common import bounded_sample, sampled_ids

    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)] + [(7, 0), (8, 1), (9, 1), (None, 1), (11, None)], "id long, label int")
    picked = sampled_ids(labels, 100)
    assert len(picked) == 200 and not {k for k, _ in picked} & {7, 8} and all(k % 2 == y for k, y in picked)
    assert picked == sampled_ids(labels.repartition(5), 100)
    whole = {k for k, _ in sampled_ids(labels, 5000)}
    assert whole == set(range(3000)) - {7, 8}
    hot = spark.range(20_000).select(F.lit(5).cast("long").alias("id"), F.lit(1).alias("label")).unionByName(labels.where("label = 1"))
    assert len([1 for _, y in sampled_ids(hot, 100) if y == 1]) == 100  # an id repeated often doesn't thin out the others
    docs = spark.createDataFrame([(1, "b" * 10), (1, "a" * 30), (3, None), (5, "c" * 10), (2, "d" * 100)], "doc_id long, text string")
    assert sorted(bounded_sample(docs, labels, 5000, 80)) == [(1, 1, b"a" * 30), (1, 5, b"c" * 10)]


def test_noisy_or_is_the_chance_of_any_sentence(spark):
    t = toxic_table(spark)
    model = toxicity.fit(t.drop("toxic"), t.select("doc_id", "toxic"))
    raw = b"The moronic end. Calm day? Clown"
    logs, _, _ = model.sentences(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(logs) == 3
    whole, _ = model.clean(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert np.isclose(1 - np.exp(whole[0]), 1 - np.prod(np.exp(logs)))


def test_langid(spark, docs):
    words = {"en": "the house and the tree with thing", "de": "das haus und der baum mit ding", "fr": "la maison et le arbre avec chose"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[l].split(), 20)), l) for i, l in enumerate(["en", "de", "fr"] * 60)]
    t = spark.createDataFrame([*rows, (None, "x", "en"), (999, None, "en"), (998, "y", None)], "doc_id long, text string, lang string")
    model = langid.fit(t)
    new = spark.createDataFrame([(1, "the tree and the house"), (2, "DER BAUM UND DAS HAUS"), (3, "la maison avec le arbre"), (4, None), (5, ""), (6, "12 !?"), (7, "日本")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(new, model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "fr", "und", "und", "und"]
    assert got[7].lang_pred in words and got[4].score == 0 and 0 <= got[1].score <= 1
    one = langid.fit(t.where("lang = 'de'"))
    assert {r.lang_pred for r in langid.predict(new, one).collect()} == {"de", "und"}
    assert {r.lang_pred for r in langid.predict(new, langid.fit(t.limit(0))).collect()} == {"und"}
    assert langid.predict(docs, model).count() == docs.count() and langid.predict(docs.limit(0), model).count() == 0


def test_a_prediction_does_not_depend_on_its_neighbours(spark):
    import pyarrow as pa

    rows = [(i, w, l) for i, (w, l) in enumerate([("the house of a man", "en"), ("das haus von dem", "de"), ("la maison du bois", "fr")] * 20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    said = ["a", "", "ha", "12 !", "das haus", "É", "x " * 200_000]
    alone = [model.margins(*text_of(pa.array([t])))[0] for t in said]
    beside = model.margins(*text_of(pa.array(["zz", *said, "du bois"])))[1:-1]
    assert np.allclose(alone, beside, atol=1e-6)
    # what stands between words counts as one space each, and four of them not at all
    assert np.allclose(model.margins(*text_of(pa.array(["12 34 56 das haus"]))), model.margins(*text_of(pa.array(["     das haus"]))), atol=1e-6)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 12, 60])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and all((code[i] != code[j]).sum() >= (1 if n == 2 else 2) for i in range(n) for j in range(i))


# --- 10


def test_exact(spark, docs, scratch):
    got = exact.dedup(docs, scratch).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == docs.count() and {r.keep_id for i in (1, 2, 3, None) for r in by[i]} == {3}
    assert [r.group_size for r in by[1]] == [5] and {r.keep_id for i in (4, 5, 6) for r in by[i]} == {6}
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert exact.dedup(docs.limit(0), Scratch(spark, "t")).count() == 0
    same = docs.where("doc_id = 2 or doc_id = 7")
    kept = exact.keep_one(same, Scratch(spark, "t"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 7]
    assert sorted(str(r.doc_id) for r in exact.keep_one(docs, Scratch(spark, "t")).collect()) == ["10", "3", "6", "7", "8", "9"]


@pytest.mark.parametrize("n", [1, 2, 5, 100, 50_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    f = exact.Fuse.build(keys)
    assert f.has(keys).all() and f.has(rng.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() < 1e-3
    assert len(f.prints) < 1.3 * n + 64


def prints_of(spark, rows, first_rid=0):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return exact.fingerprints(df).withColumn("rid", F.monotonically_increasing_id() + first_rid)


def test_filters_let_through_what_the_snapshot_has(spark, scratch):
    store = exact.Store(spark, scratch.path("store"))
    exact.absorb(store, prints_of(spark, [(i, f"text {i}") for i in range(500)]))
    new = exact.groups(prints_of(spark, [(i, f"text  {i}") for i in range(400, 900)]))
    about = store.segments()[0]
    assert (about["n"], about["fresh"], about["shards"]) == (500, 500, 1)
    assert 100 <= exact.screen(new, 500, store.table(0, "filters"), 1).count() <= 102
    many = exact.screen(new, 500 * exact.SHARD_KEYS, store.table(0, "filters"), 1)  # dealt to 500 parts
    assert 100 <= many.count() <= 102


def test_three_batches_against_brute_force(spark, scratch):
    """A store that absorbs an empty batch, then overlapping ones; a segment that was not finished is written anew."""
    rng = np.random.default_rng(4)
    store, seen, rid = exact.Store(spark, scratch.path("store")), [], 0
    for size in (0, 60, 90, 1, 120):
        rows = [(int(rng.integers(1000)), " ".join(map(str, rng.integers(0, 40, 1))) + " " * int(rng.integers(3))) for _ in range(size)]
        filters = [store.table(s["number"], "filters").collect() for s in store.segments()]
        if size == 90:
            store.write(spark.range(3), 2, "buckets")  # what a lost job left behind
        assert exact.absorb(store, prints_of(spark, rows, rid)) == len(filters)
        assert [store.table(k, "filters").collect() for k in range(len(filters))] == filters  # earlier segments stay as they are
        seen, rid = seen + rows, rid + (1 << 40)
        want = {}
        for i, t in seen:
            want.setdefault(t.replace(" ", ""), []).append((-len(t), i))
        got = {bytes(r.digest): (r.size, r.best.id) for r in exact.merged(store).collect()}
        assert got == {hashlib.sha256(t.encode()).digest(): (len(v), min(v)[1]) for t, v in want.items()}
    plain = [bytes(r.plain) for k in range(5) for r in store.table(k, "buckets").collect()]
    assert len(plain) == len(set(plain)) == len(want)


def test_two_texts_with_one_digest_are_an_error(spark):
    rows = prints_of(spark, [(1, "a"), (2, "b")]).withColumn("digest", F.lit(b"x")).withColumn("key", F.lit(1).cast("long"))
    with pytest.raises(Exception, match="SHA-256"):
        exact.groups(rows).collect()


@pytest.mark.parametrize("keep", [exact.keep_one, shingles.keep_one])
def test_kept_rows_keep_columns_with_any_name(spark, keep):
    """Columns named like those of the operator come back as they were, also for ids that occur more than once."""
    names = ["_n", "_sha", "_picked", "_kept", "picked", "picked_", "id", "again", "key", "digest", "row", "points", "wanted", "a.b"]
    rows = [(i, t, *range(10 * k, 10 * k + len(names))) for k, (i, t) in enumerate([(1, "one two three"), (2, "one  two three four"), (2, "five six"), (3, "five six"), (None, None)])]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = keep(df, Scratch(spark, "t"))
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} <= set(rows) and got.count() >= 3
    assert keep(df.limit(0), Scratch(spark, "t")).count() == 0


def test_hot_keys_are_joined_as_others_are(spark, scratch):
    from weftline.llm.common import join_sized

    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 400).alias("k"))
    side = scratch.keep(rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2), "side")
    for how in ("inner", "left"):
        got, want = (sorted(((r.id, r.x) for r in df.collect()), key=str) for df in (join_sized(rows, side, "k", "n", how), rows.join(side, "k", how)))
        assert got == want


def test_samples_bring_few_rows_to_the_driver(spark, monkeypatch):
    """A label of one repeated id, one of many ids and one whose ids nearly all have two labels: what is collected is bounded by what is asked for."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    seen = []
    collect = Classic.collect

    def counted(self):
        out = collect(self)
        seen.append(len(out))
        return out

    monkeypatch.setattr(Classic, "collect", counted)
    many = spark.range(120_000).select(F.col("id"), F.lit("many").alias("label"))
    one = spark.range(5_000).select(F.lit(-1).cast("long").alias("id"), F.lit("one").alias("label"))
    torn = spark.range(200_000, 260_000)
    torn = torn.select("id", F.lit("torn").alias("label")).unionByName(torn.where("id % 100 > 0").select("id", F.lit("other").alias("label")))
    got = common.sampled_ids(many.unionByName(one).unionByName(torn), 400)
    per = {y: sum(1 for _, x in got if x == y) for y in ("many", "one", "torn", "other")}
    assert per == {"many": 400, "one": 1, "torn": 400, "other": 0}
    assert max(seen) <= 3 * (2 * 400 + 500) + 1 and len(seen) < 12
    ranked = sorted((r.h, r.id) for r in many.select("id", F.xxhash64("id").alias("h")).toLocalIterator())[:400]
    assert [k for k, y in got if y == "many"] == [k for _, k in ranked]


def test_exact_keeps_the_same_of_rows_alike_in_id_and_text(spark, tmp_path):
    """Rows that differ in another column only: the same one stays however the table is dealt."""
    rows = [(1, "a b", f"s{k % 7}", k) for k in range(40)] + [(2, "c", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    kept = {tuple(sorted(map(tuple, exact.keep_one(df.repartition(n, *cols), Scratch(spark, f"same-{n}")).collect()))) for n, cols in ((1, []), (5, ["n_chars"]), (3, ["source"]))}
    assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_pipeline_leaves_its_last_table_only(spark):
    import os

    import corpus_pipeline

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    new = sorted(set(os.listdir(root)) - before)
    assert [x.rsplit("-", 1)[0] for x in new] == ["pipeline"] and os.listdir(f"{root}/{new[0]}") == ["mixing"]
    assert out.count() > 0
