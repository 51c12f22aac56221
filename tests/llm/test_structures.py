"""Fingerprints by winnowing, Merkle manifests and phrases: against brute force, on hard inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle, phrases, queries, winnow
from weftline.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = str.maketrans(queries.CAPITALS, queries.SMALL)


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "Beta,", "gämma", "𝛿elta", "x;"]) for _ in range(60_000))
    rows = [(1, "A same Text", "en", "s", 11), (2, "A same Text", "en", None, None), (2, "A same Text", "en", None, None), (2, "other", None, "s", 5), (3, None, "de", "s", 0), (4, "", "de", "s", 0), (None, "No id Here", "fr", "s", 3), (None, None, None, None, None), (-5, "é", "ü", "s", 1), (6, long, "en", "s", len(long)), (7, "𝛿" * 70, "en", "s", 70)]
    return rows + [(100 + k, "".join(rng.choice("ab é𝛿") for _ in range(k)), rng.choice(["en", "de", None]), "s", k) for k in range(60)]


def clashing(df):
    """Further columns whose names an operator may use itself."""
    return df.select("*", *[F.lit("x").alias(c) for c in ("id", "h", "RANGE", "marker", "digest", "part", "pos", "tree", "size", "phrase", "n", "bucket", "block")])


# --- operator 11


def plain_prints(text, gram=winnow.GRAM, window=winnow.WINDOW):
    """Chosen (hash, position) by looking at every window."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n, mask = len(text), 2**64 - 1
    if not n:
        return []
    k = min(gram, n)
    hashes = []
    for i in range(n - k + 1):
        h = 0
        for j, b in enumerate(text[i : i + k].encode()):
            h = (h + int(winnow._BYTE[b]) * pow(winnow._BASE, j, 2**64)) & mask
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & mask
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 & mask
        hashes.append(h ^ h >> 33)
    w = min(window, len(hashes))
    out = []
    for i in range(len(hashes) - w + 1):
        best = min(range(i, i + w), key=lambda p: (hashes[p], -p))
        if not out or out[-1][1] != best:
            out.append((hashes[best], best))
    assert len(raw) >= n
    return out


@pytest.mark.parametrize(("gram", "window"), [(winnow.GRAM, winnow.WINDOW), (3, 4), (1, 1), (5, 2)])
def test_prints_are_those_of_all_windows(gram, window):
    rng = random.Random(7)
    for size in [0, 1, 2, 3, 15, 16, 17, 54, 55, 56, 200]:
        for letters in ("a", "ab", "aé𝛿 "):
            text = "".join(rng.choice(letters) for _ in range(size))
            got = winnow.prints_of(np.frombuffer(text.encode(), np.uint8), None, gram, window)
            assert list(zip(got.hashes.tolist(), got.positions.tolist(), strict=True)) == plain_prints(text, gram, window)


def test_long_texts_are_read_in_pieces_alike(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abcé𝛿 ") for _ in range(3000))
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = winnow.prints_of(raw)
    monkeypatch.setattr(winnow, "SLICE_BYTES", 97)
    cut = winnow.prints_of(raw)
    assert whole.text() == cut.text() and (whole.positions == cut.positions).all()


def test_a_shared_passage_is_always_found():
    rng = random.Random(9)
    for _ in range(200):
        make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
        shared = make(winnow.GRAM + winnow.WINDOW - 1)
        a, b = make(rng.randrange(300)) + shared + make(rng.randrange(300)), make(rng.randrange(300)) + shared + make(rng.randrange(300))
        pa, pb = (winnow.prints_of(np.frombuffer(t.encode(), np.uint8)) for t in (a, b))
        both = set(pa.hashes.tolist()) & set(pb.hashes.tolist())
        where = [t.index(shared) for t in (a, b)]
        assert any(h in both and w <= p <= w + winnow.WINDOW - 1 for t, w in ((pa, where[0]), (pb, where[1])) for h, p in zip(t.hashes.tolist(), t.positions.tolist(), strict=True))


@pytest.mark.parametrize("parts", ["1", "7"])
def test_neighbours_of_odd_rows(spark, parts):
    rows = odd_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = clashing(spark.createDataFrame(rows, DOCS)).repartition(3)
        got = sorted(map(tuple, winnow.neighbours(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hashes = {r.text: r.h for r in spark.createDataFrame([(r[1] or "",) for r in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    # descending ids, null last; ties by the text's hash and the text
    order = sorted(((r[0] is not None, r[0] or 0, hashes[r[1] or ""], r[1] or ""), r[0], r[1] or "") for r in rows)[::-1]
    want = []
    prints = {t: plain_prints(t) if len(t) < 5000 else [*zip(*(x.tolist() for x in winnow.prints_of(np.frombuffer(t.encode(), np.uint8))), strict=True)] for t in {r[2] for r in order}}
    for k, (_, i, text) in enumerate(order):
        after, n = order[(k + 1) % len(order)][2], len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        pe = plain_prints(edited) if len(edited) < 5000 else [*zip(*(x.tolist() for x in winnow.prints_of(np.frombuffer(edited.encode(), np.uint8))), strict=True)]
        like = lambda a, b: len({h for h, _ in a} & {h for h, _ in b}) / len({h for h, _ in a} | {h for h, _ in b}) if a or b else 1.0
        shown = lambda p: "".join(f"{h:016x}" for h, _ in p)
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), shown(prints[text]), shown(pe), len(prints[text]), like(prints[text], pe), like(prints[text], prints[after])))
    assert got == sorted(want, key=repr)


def test_neighbours_of_few_rows(spark):
    assert winnow.neighbours(spark.createDataFrame([], DOCS)).collect() == []
    one = winnow.neighbours(spark.createDataFrame([(1, "abcd", None, None, 4)], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    prints = winnow.fingerprints(spark.createDataFrame(odd_rows(), DOCS).repartition(2)).collect()
    assert len(prints) == len(odd_rows()) and {tuple(map(tuple, r.prints)) for r in prints if r.doc_id == 4} == {()}
    same = {tuple(map(tuple, r.prints)) for r in prints if r.doc_id in (1, 2) and r.n_chars == 11}
    assert len(same) == 1


def test_edited_texts_are_nearer_than_the_next(spark):
    out = winnow.neighbours(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("n_chars >= 400")
    r = out.agg(F.min("near_edited").alias("a"), F.avg("near_edited").alias("b"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("c")).first()
    assert r.a > 0 and 0.25 < r.b < 0.45 and r.c > 0.95


# --- operator 12


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, tampered):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row, by lists of nodes."""
    leaf = lambda *v: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))
    proofs = [[] for _ in rows]

    def tree(nodes):
        while len(nodes) > 1:
            up = []
            for i in range(0, len(nodes), 8):
                run = nodes[i : i + 8]
                for j, (_, members) in enumerate(run):
                    for m in members:
                        proofs[m].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
                up.append((sha("".join(d for d, _ in run)), [m for _, members in run for m in members]))
            nodes = up
        return nodes[0]

    leaves = [leaf(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    later = [leaf(r[0], r[3], r[2], r[4], tampered(r)) for r in rows]
    langs = collections.defaultdict(list)
    for k, r in enumerate(rows):
        langs[r[2]].append(k)
    subroots = []
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        subroots.append(tree([(leaves[k], [k]) for k in sorted(langs[lang], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaves[k]))]))
    own = {m: d for d, members in subroots for m in members}
    root = tree(subroots)[0] if rows else ""
    out = []
    for k, r in enumerate(rows):
        now = later[k]
        for a, b in proofs[k]:
            now = sha(a + now + b)
        out.append((r[0], leaves[k], own[k], root, sha("".join(a + b for a, b in proofs[k])), now, now == root))
    return sorted(out, key=repr)


def lowered(r):
    return r[1].translate(SMALL) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]


def manifest_of(spark, rows, label="m"):
    df = clashing(spark.createDataFrame(rows, DOCS)).repartition(4)
    text = F.when(queries.fold(3) == 0, F.translate("text", queries.CAPITALS, queries.SMALL)).otherwise(F.col("text"))
    return sorted(map(tuple, merkle.manifest(df, Scratch(spark, label), found={"text": text}).collect()), key=repr)


@pytest.mark.parametrize("height", [1, 4])
def test_manifest_of_odd_rows(spark, monkeypatch, height):
    """One level a task, so that block roots feed several traversals; and all levels in one."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = odd_rows() + [(1000 + k, f"Text {k}", f"l{k % 70}", "s", k) for k in range(90)]
    assert manifest_of(spark, rows) == plain_manifest(rows, lowered)


def test_manifest_of_few_rows(spark):
    assert manifest_of(spark, []) == []
    for rows in ([(3, "Abc", None, None, 3)], [(3, "Abc", "en", None, 3), (3, "Abc", "en", None, 3)], [(k, "X", "en", "s", 1) for k in range(9)]):
        assert manifest_of(spark, rows) == plain_manifest(rows, lowered)


def test_tampering_is_found(spark):
    rows = [(k, "Same Text" if k % 2 else "small", "en", "s", 3) for k in range(40)]
    for doc_id, *_, ok in manifest_of(spark, rows):
        assert ok == (lowered(rows[doc_id]) == rows[doc_id][1])


# --- operator 13


def plain_phrases(rows, least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(SMALL)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = collections.Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                held[lang, p[i : i + k]] = max(held[lang, p[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if held[lang, p] and 100 * held[lang, p] >= 50 * a:
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for k, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


@pytest.mark.parametrize(("longest", "bits", "words"), [(3, 24, 1_000_000), (4, 8, 50), (2, 3, 7)])
def test_phrases_of_odd_rows(spark, monkeypatch, longest, bits, words):
    """Also with bitmaps so small that nearly everything passes, and with words counted a few at a time."""
    monkeypatch.setattr(phrases, "WORDS", words)
    rng = random.Random(11)
    vocabulary = ["a", "b", "c", "Über", "x-y", "𝛿", "\x0bz", "no\xa0break", "d.", "e,", "\tf"]
    rows = odd_rows()[:9] + [(k, " ".join(rng.choices(vocabulary, weights=range(1, 12), k=rng.randrange(60))), rng.choice(["en", "en", "und", None, "de"]), "s", 1) for k in range(200)]
    out = phrases.collocations(clashing(spark.createDataFrame(rows, DOCS)).repartition(3), Scratch(spark, "p"), longest=longest, bits=bits, top=40, least=5)
    assert sorted(map(tuple, out.collect())) == plain_phrases(rows, 5, longest, 40)


def test_phrases_of_hot_and_empty_tables(spark):
    rows = [(k, "the same words " * 400, "en", "s", 1) for k in range(20)]
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, DOCS), Scratch(spark, "p")).collect())) == plain_phrases(rows, 10, 3, 2000)
    for rows in ([], [(1, None, None, None, None), (2, " ,. ", "en", None, None), (3, "one", "en", None, None)]):
        assert phrases.collocations(spark.createDataFrame(rows, DOCS), Scratch(spark, "p")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_017, 9_000_000_019, 12_345_678_901
    rows = [("en", "x", 1, left), ("en", "y", 1, right), ("en", "x y", 2, a)]
    out = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, n_words int, n long"), Scratch(spark, "p")).first()
    assert out.score == 1_000_000 * a * a // (left * right) and (out.l, out.r) == (left, right)
