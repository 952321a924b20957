"""Every operator against brute force, the libraries themselves or held-out accuracy, and on awkward tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from docveil.llm import byte_bpe, fingerprint, language_id, near_vectors, ngram_join, packing, pieces, quality, substring, token_counts, toxicity
from docveil.llm.components import components
from docveil.llm.repeats import packed, unpacked

TEXT = "id long, text string"
AWKWARD = [None, "", " \n\t", "one", "a b c d", "A B c D e", "a b c d e", "x " * 400, "é ́ ½ 日本語  テキスト\x1c \x85 <|endoftext|> I'm he'll", "foo.. bar, baz. ", "no-break space", "😀 a😀b"]


def passage(seed, n, words=200):
    own = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in own.integers(0, words, n))


def corpus():
    """Copies, near copies, shared passages, repeats within a text, and the awkward texts."""
    base, shared = [passage(k, 60 + k) for k in range(12)], passage(99, 50, 5000)
    near = [" ".join([*b.split()[:30], "changed", *b.split()[31:]]) for b in base[:6]]
    chain = [" ".join([*base[7].split()[: 10 * k + 5], f"new{k}", *base[7].split()[10 * k + 6 :]]) for k in range(5)]
    with_shared = [f"{passage(200 + k, 20)} {shared} {passage(300 + k, 20)}" for k in range(4)]
    inside = f"{passage(400, 10)} {shared[:0]}{passage(401, 40, 9000)} gap {passage(401, 40, 9000)}"
    return [*base, *base[:3], *near, *chain, *with_shared, inside, "onhe. " * 300, *AWKWARD]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", float(i)) for i, t in enumerate(corpus())]
    # clashing and extra columns, more than one partition
    return spark.createDataFrame(rows, "doc_id long, text string, node string, key double").repartition(3).cache()


def plain(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def words(text, lower=False):
    data = text.encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", data.lower() if lower else data)


def roots(ids, edges):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_language_id_reads_long_words_whole():
    """Text without spaces: every letter and trigram is read, and a later switch of language changes the result."""
    own = "".join(chr(0x4E00 + k) for k in range(500))
    runs = language_id.chain_words(f"a {own} b".encode())
    assert runs[0] == b"a" and runs[-1] == b"b" and max(len(x.decode()) for x in runs) == language_id.LONGEST
    assert [r.decode()[i : i + 3] for r in runs[1:-1] for i in range(len(r.decode()) - 2)] == [own[i : i + 3] for i in range(498)]
    assert language_id.chain_words(("x" * 40 + " " + "é" * 40 + " -" + "1" * 90).encode()) == [b"x" * 40, ("é" * 40).encode(), b"-" + b"1" * 90]
    model = language_id.learn([b"the cat and the dog are here " * 4, "der hund und die katze sind hier ".encode() * 4] * 4, ["en", "de"] * 4)
    one, other = b"thecatandthedogarehere", b"derhundunddiekatzesindhier"
    score = lambda t: dict(zip(model.labels, model.scores(pieces.Ids(model.emissions, code="f"), [t])[0].tolist(), strict=True))
    assert score(one * 10)["en"] > 0.8 and score(one * 2 + other * 20)["de"] > 0.5


def test_white_pieces_leave_capitals_with_marks():
    """Letters that compose only when small: the pieces' ids are those of the whole text."""
    encode = packing.word_ids(P.path("word_bpe_49k.json"))
    for mark in ("H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c", "J\u0331\u030c", "E\u0301"):
        for text in (mark, f"AB{mark}CD Of, THE {mark}. End\u00e9 \u00c9A. B"):
            own = [i for ids in encode(packing.white_pieces(text.encode())) for i in ids]
            assert own == encode([text.encode()])[0], text


def test_ngram_join(docs):
    sets = {}
    for i, t in plain(docs).items():
        w = words(t, lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = {i: (len(sets[i]), c) for i, c in roots(sets, links).items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs).collect()}
    assert got == want and len(links) > 15


@pytest.mark.parametrize("block", [2, 2048])
def test_ngram_join_counts_links(spark, block):
    """Links inside a group of near copies and to exact copies are counted, in one block or in many."""
    base = passage(7, 60)
    near = [" ".join([*base.split()[:k], f"new{k}", *base.split()[k + 1 :]]) for k in range(5, 55, 5)]
    rows = list(enumerate([base, base, *near, near[0], "alone in the world", None, "", "x y", "X  y"]))
    sets = {}
    for i, t in rows:
        w = words(t or "", lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    want = {i: sum(i != j and bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), links_too=True, block=block)
    assert {r["doc_id"]: r["n_links"] for r in got.collect()} == want and max(want.values()) > 10


def test_null_and_repeated_ids_link(spark):
    """Links run through rows without an id, and through rows that share one."""
    a = passage(1, 60).split()
    near = lambda *at: " ".join("new" + str(k) if k in at else w for k, w in enumerate(a))
    rows = [(1, near()), (None, near(10)), (3, near(10, 30)), (7, "nothing of the kind " * 3), (7, near(10, 31)), (None, None), (None, "alone in the world of words")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=75).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (0, 2, 0), (0, 56, 1), (1, 56, 1), (3, 56, 1), (7, 4, 7), (7, 56, 1)]


def test_suffix_filter(spark):
    """Pairs that pass hold all that link; one that can't link by its ranges is left out."""
    own = np.random.default_rng(4)
    base = own.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(x) for x in (base, np.concatenate([base[:180], own.integers(0, 2**63, 20, dtype=np.uint64)]), own.integers(0, 2**63, 200, dtype=np.uint64), base[:160])]
    lanes = spark.createDataFrame([(i, np.bincount((x >> np.uint64(58)).astype(int), minlength=64).tolist()) for i, x in enumerate(sets)], "node long, lanes array<int>")
    pairs = list(combinations(range(4), 2))
    kept = {tuple(r) for r in ngram_join.possible(spark.createDataFrame(pairs, "a long, b long"), lanes, 75).collect()}
    linked = {(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert linked and linked <= kept and (0, 2) not in kept


def test_overlaps():
    own = np.random.default_rng(6)
    base = np.arange(50, dtype=np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, own.integers(0, 50, 5)), own.integers(40, 90, 6).astype(np.uint64)])) for _ in range(9)] + [np.array([200, 201], dtype=np.uint64)]
    got = ngram_join.overlaps(sets, np.arange(10), np.arange(10))
    assert all(i == j or got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(10) for j in range(10))


def test_substring_dedup(docs):
    own = {i: words(t) for i, t in plain(docs).items()}
    seen = Counter(tuple(w[k : k + 35]) for w in own.values() for k in range(len(w) - 34))
    longer = Counter(tuple(w[k : k + 36]) for w in own.values() for k in range(len(w) - 35))
    out = {r["doc_id"]: r for r in substring.without_repeats(docs).collect()}
    assert set(out) == set(own)
    for i, w in own.items():
        gone = [any(seen[tuple(w[k : k + 35])] > 1 for k in range(max(0, p - 34), min(p, len(w) - 35) + 1)) for p in range(len(w))]
        assert (out[i]["n_words"], out[i]["n_removed"]) == (len(w), sum(gone)), i
        assert out[i]["kept"].encode() == b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        covered = {p for s in out[i]["spans"] for p in range(s["first"], s["first"] + s["words"])}
        assert covered == {p for p, g in enumerate(gone) if g}
        assert [tuple(s) for s in out[i]["spans"]] == maximal(w, seen, longer), i


def maximal(w, seen, longer):
    """Runs of windows of 35 words that occur elsewhere too, of which each 36 words in a row do as well."""
    live = [seen[tuple(w[k : k + 35])] > 1 for k in range(len(w) - 34)]
    on = [longer[tuple(w[k : k + 36])] > 1 for k in range(len(w) - 35)]
    out, first = [], None
    for k, x in enumerate(live):
        if x and first is None:
            first = k
        if x and not (k < len(on) and on[k]):
            out.append((first, k - first + 35))
            first = None
    return out


def test_spans_of_passages_that_follow_each_other(spark):
    """Two passages that stand in two other texts, side by side in a third: two spans, each as long as its passage."""
    a, b = passage(1, 50, 9000), passage(2, 60, 9000)
    rows = [(1, f"{a} x y"), (2, f"z {b}"), (3, f"{a} {b} end")]
    out = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: [(0, 50)], 2: [(1, 60)], 3: [(0, 50), (50, 60)]}


@pytest.mark.parametrize("at_once", [3, 100_000])
def test_common_prefixes_in_parts(at_once):
    """Any size of the parts that are put in order at once gives the same runs."""
    texts = [t.encode() for t in (passage(k % 7, 80, 6) for k in range(15))]
    w = substring.Windows(texts, 20, 6)
    of, where, _, strings = w.stretches(np.ones(len(w.words) + 1, dtype=bool), np.zeros(0, dtype=np.uint64))
    own, runs = substring.repeated(of.astype(np.uint64), where, np.zeros(len(of), dtype=np.int64), strings, 20, at_once)
    got = {(int(i), int(r >> np.uint64(16)) + j) for i, r in zip(own, runs, strict=True) for j in range((int(r) & 0xFFFF) >> 1)}
    each = [t.split() for t in texts]
    seen = Counter(tuple(x[k : k + 20]) for x in each for k in range(61))
    assert got == {(i, k) for i, x in enumerate(each) for k in range(61) if seen[tuple(x[k : k + 20])] > 1}


def test_substring_groups_do_not_matter(docs):
    """Any length of the prefixes and size of groups gives the same words and spans."""
    columns = ["doc_id", "n_removed", "kept", "spans"]
    want = sorted(substring.without_repeats(docs).select(columns).collect())
    for k, group_rows in ((12, 1), (5, 20_000), (20, 3)):
        assert sorted(substring.without_repeats(docs, k=k, group_rows=group_rows).select(columns).collect()) == want


@pytest.mark.parametrize("cell_rows", [4, 2048])
def test_near_vectors(spark, cell_rows):
    """Small cells and blocks take the path of large labels."""
    own = np.random.default_rng(1)
    x = own.normal(size=(120, 8))
    x[60:100] = x[:40] + own.normal(size=(40, 8)) * 0.06
    x[100:110] = x[0]
    rows = [(i, [float(y) for y in v.astype(np.float32)], int(i) % 2) for i, v in enumerate(x)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 8, 1), (203, [float("nan")] * 8, 1), (204, [1.0, None], 1), (205, rows[0][1], None), (206, [2 * y for y in rows[0][1]], 0), (207, rows[0][1][:4], 0), (208, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df, cell_rows=cell_rows, block_rows=max(4, cell_rows // 2)).collect()}
    sound = {i: (np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in combinations(sound, 2) if sound[a][1] == sound[b][1] and len(sound[a][0]) == len(sound[b][0]) and sound[a][0] @ sound[b][0] >= 0.98]
    n = Counter(x for e in links for x in e)
    comp = roots([r[0] for r in rows], links)
    lone = near_vectors.near_vectors(spark.createDataFrame([(1, rows[0][1], 0), (None, rows[0][1], 0), (3, rows[0][1], 0)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in lone) == [(0, 0, 0, True), (1, 1, 1, True), (3, 1, 1, False)]
    assert got == {i: (n[i], comp[i], comp[i] == i) for i, _, _ in rows} and len(links) > 40


def test_components(spark):
    own = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in own.integers(0, 400, (250, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 200)]
    want = {i: c for i, c in roots({x for e in edges for x in e}, [e for e in edges if e[0] != e[1]]).items() if any(i in e and e[0] != e[1] for e in edges)}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == want


def test_token_counts(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()}
    assert got == {i: (len(t.encode()), len(model.encode(t, add_special_tokens=False))) for i, t in plain(docs).items()}
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect()}
    assert got == {i: len(other.encode(t)) for i, t in plain(docs).items()}


def test_byte_bpe(docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    own = byte_bpe.encode_documents(docs, path, P.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in own.collect()} == {i: model.encode_ordinary(t) for i, t in plain(docs).items()}
    back = byte_bpe.decode_documents(own, path, P.PATTERN)
    assert {r["doc_id"]: bytes(r["content"]) for r in back.collect()} == {i: t.encode() for i, t in plain(docs).items()}
    c = byte_bpe.codec(path, P.PATTERN)
    assert c.spans("é日")[0][1:] == (0, 1) and sorted({s[1:] for s in c.spans("日本")}) == [(0, 1), (1, 2)]


def test_pieces_are_forgotten_without_harm():
    own = pieces.Ids(lambda new: [[len(p), ord(p[0])] for p in new], most=10)
    for seed in range(20):
        asked = [chr(97 + int(x)) * 3 for x in np.random.default_rng(seed).integers(0, 25, 40)]
        ids, lens = own.ids(asked)
        assert ids.tolist() == [v for p in asked for v in (3, ord(p[0]))] and lens.tolist() == [2] * 40
        assert len(own) <= 10 + 25


@pytest.mark.parametrize("most_open", [2, 4096])
def test_packing(docs, most_open):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in plain(docs).items()}
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), window=256, most_open=most_open, with_ids=True).collect()
    for i, own in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert (r["start"], r["ids"], r["doc_tokens"]) == (at, own[at : at + r["length"]], len(own))
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"]))
            at += r["length"]
        assert at == len(own)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist()
        total = sum(r["length"] for r in own)
        assert total <= 256 and total & (total - 1) == 0


def test_sum_of_squares_level():
    """The level array finds the level that a search over all of them finds."""
    own = np.random.default_rng(3)
    p = packing.Packer(lambda pieces: None, window=64)
    for size in own.integers(1, 64, 500).tolist():
        n = p.count.copy()

        def cost(h, size=size, n=n):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + size < 64:
                m[h + size] += 1
            return int((m * m).sum())

        allowed = [h for h in range(64 - size + 1) if not h or n[h]]
        assert cost(p.level(size)) == min(map(cost, allowed))
        p.add(0, np.zeros(size, dtype=np.uint32))


def test_fingerprints(spark, docs):
    out = {r["doc_id"]: r for r in fingerprint.edited_documents(docs).collect()}
    own = sorted(plain(docs).items())
    for k, (i, t) in enumerate(own):
        half = len(t) // 2
        edited = t[: len(t) - half] + own[(k + 1) % len(own)][1][:half]
        assert (out[i]["n_chars"], out[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
    by_text = {}
    for i, t in own:
        by_text.setdefault(t, set()).add(out[i]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    # the first texts have nothing to do with each other
    assert np.mean([out[i]["near_edited"] for i in range(11)]) > 0.3 > 0.15 > np.mean([out[i]["near_next"] for i in range(11)])
    # order of paragraphs, insertion and deletion
    rows = spark.createDataFrame([(1, "a b c\nd e f"), (2, "d e f\na b c"), (3, "a b c"), (4, "d e f"), (5, None), (6, "a b c\nd e g")], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(rows, ["doc_id"]).collect()}
    assert f[1] == f[2] != f[6] and set(f[5]) == {"0"}
    both = spark.createDataFrame([(f[3], f[4], f[1])], "a string, b string, c string")
    shifted = both.select(fingerprint.shift_fingerprint(F.col("a"), F.col("b")), fingerprint.shift_fingerprint(F.col("c"), F.col("b"), -1)).first()
    assert list(shifted) == [f[1], f[3]]


def test_next_document_over_uneven_ids(spark):
    """Runs with gaps, repeated ids, a null id."""
    rows = [(i, f"t{i}") for i in [*range(1000), 10**9, 10**9 + 5, -7]] + [(5, "t5b"), (None, "none")]
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), run_rows=50).filter("lent = 0")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert {(r["id"], r["text"]): r["next_text"] for r in got.collect()} == {w: want[(k + 1) % len(want)][1] for k, w in enumerate(want)}


def test_runs_of_any_ids(spark):
    """Ids at both ends of their type, and an outlier beside dense ids: rows stay spread over runs."""
    ids = [*range(3000), 10**15, 9 * 10**18, -9 * 10**18, 2**63 - 1, -(2**63)]
    rows = fingerprint.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string"), run_rows=100).filter("lent = 0").collect()
    want = sorted(ids)
    assert {r["id"]: r["next_text"] for r in rows} == {i: f"t{want[(k + 1) % len(want)]}" for k, i in enumerate(want)}
    assert max(Counter(r["run"] for r in rows).values()) < 400 and len(fingerprint.edited_documents(spark.createDataFrame([(i, "a b") for i in ids[-5:]], "doc_id long, text string")).collect()) == 5


def test_likeness_of_lanes(spark):
    """Lanes and likeness against plain Python: nibbles of Spark's hash of each unit, summed, then a centred cosine."""
    texts = ["one two three four five\nsix seven", "one two three four\nsix seven", "nothing alike here at all", ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    units = df.select("doc_id", F.explode(fingerprint.units(F.col("text"))).alias("u")).select("doc_id", "u", *[F.xxhash64("u", F.lit(k)).alias(f"h{k}") for k in range(8)]).collect()
    words = lambda t: [" ".join(w) for line in t.split("\n") for w in [line.split()[i : i + 4] for i in range(0, len(line.split()), 4)]]
    assert {(r["doc_id"], r["u"]) for r in units} == {(i, u) for i, t in rows for u in [*("\n" + x for x in t.split("\n") if x), *words(t)]}
    own = {i: np.zeros(128) for i, _ in rows}
    n = Counter(r["doc_id"] for r in units)
    for r in units:
        own[r["doc_id"]] += [(r[f"h{k}"] >> shift) & 15 for k in range(8) for s in range(0, 32, 4) for shift in (s, s + 32)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(df, ["doc_id"]).collect()}
    assert all(list(got[i]["lanes"]) == own[i].tolist() and got[i]["fingerprint"] == "".join(f"{int(x):05x}" for x in own[i]) for i in own)
    centred = {i: own[i] - 7.5 * n[i] for i in own}
    pairs = df.alias("a").join(df.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id")).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))
    lanes = fingerprint.fingerprints(df, ["doc_id"])
    both = pairs.join(lanes.select(F.col("doc_id").alias("a"), F.col("lanes").alias("x"), F.col("n_units").alias("n")), "a").join(lanes.select(F.col("doc_id").alias("b"), F.col("lanes").alias("y"), F.col("n_units").alias("m")), "b")
    for r in both.select("a", "b", fingerprint.likeness(F.col("x"), F.col("n"), F.col("y"), F.col("m")).alias("s")).collect():
        a, b = centred[r["a"]], centred[r["b"]]
        want = 1.0 if r["a"] == r["b"] else 0.0 if not a.any() or not b.any() else max(0.0, a @ b / np.sqrt(a @ a * (b @ b)))
        assert abs(r["s"] - want) < 1e-9


# ---- classifiers ----


def test_code_switched_words(labelled):
    """Words of texts spliced from two languages, which the model hasn't seen, are labelled in runs."""
    docs, _ = labelled
    rows = [r for r in docs.collect() if r["text"] and len(r["text"].split()) > 60]
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5][:250]
    model = language_id.learn([r["text"].encode() for r in train], [r["lang"] for r in train], rounds=15)
    assert (model.transitions.argmax(1) == np.arange(len(model.labels))).all()
    test, right, runs_ = held(rows), [], []
    for a, b in [(a, b) for a, b in zip(test, test[1:], strict=False) if a["lang"] != b["lang"]][:20]:
        own = [*a["text"].split()[:30], *b["text"].split()[20:50]]
        got = model.word_labels(" ".join(own).encode())
        assert [w for w, _ in got] == own
        right += [x == g for (_, x), g in zip(got, [a["lang"]] * 30 + [b["lang"]] * 30, strict=True) if x != "und"]
        runs_.append(sum(1 for x, y in zip(got, got[1:], strict=False) if x[1] != y[1] and "und" not in (x[1], y[1])))
    assert len(runs_) > 5 and np.mean(right) > 0.9 and np.median(runs_) <= 4


def test_language_spans(spark, labelled):
    docs, _ = labelled
    model = language_id.trained(docs, sample_docs=200, rounds=10)
    rows = spark.createDataFrame([(1, "the house is on the hill and we went there"), (2, None), (3, "12 34")], "doc_id long, text string")
    out = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in language_id.spans(rows, model).collect()}
    assert out[2] == [] and out[3] == [(0, 2, "und")] and sum(n for _, n, _ in out[1]) == 10


def test_all_swaps_count():
    """Every name in every sentence is swapped for all others of its kind, however many there are."""
    text = ". ".join(f"the women and the men of town {k} met" for k in range(50))
    got = toxicity.swaps(text)
    others = len(toxicity._KIND["women"]) - 1
    assert sum(got.values()) == 50 * 2 * others
    a, b = toxicity.features("the women of town met"), toxicity.features("the girls of town met")
    assert (frozenset(a - b), frozenset(b - a)) in toxicity.swaps("the women of town met")


def test_whole_words_count():
    """What follows the first letters of a long word changes its features."""
    shape = lambda w: quality.word_facts([w.encode()])[0]
    a, b = "a1" * 2500, "a1" * 2499 + "a-"
    assert shape(a)[0] != shape(b)[0] and shape(a)[2] == 5000


def test_ordinal_learning_against_plain_gradients():
    """The learned thresholds and weights are near a stationary point of the plain log-likelihood."""
    own = np.random.default_rng(8)
    texts = [(" ".join(own.choice(["word", "Word", "w0rd", "%%", "12"], 30, p=[0.5 - g / 10, 0.1, 0.1, 0.2 + g / 10, 0.1]))).encode() for g in (0, 1, 2, 3) for _ in range(40)]
    y = np.repeat(np.arange(4), 40)
    model = quality.learn(texts, y.tolist(), rounds=3000, decay=0.0)
    assert (np.diff(model.thresholds) > 0).all()
    row, feature, value = quality.vectors(pieces.Ids(quality.word_facts, code="i"), texts)

    def loss(thresholds, weights):
        x = np.bincount(row, weights[feature] * value, minlength=len(texts))
        below = np.hstack([np.zeros((len(y), 1)), 1 / (1 + np.exp(-(thresholds[None] - x[:, None]))), np.ones((len(y), 1))])
        return -np.log(np.diff(below, axis=1)[np.arange(len(y)), y]).mean()

    at = loss(model.thresholds, model.weights)
    for k in range(3):  # no threshold can be moved to make the likelihood better by much
        for step in (-0.2, 0.2):
            moved = model.thresholds.copy()
            moved[k] += step
            assert not (np.diff(moved) > 0).all() or loss(moved, model.weights) > at - 2e-3
    assert at < loss(np.log(np.array([1, 2, 3]) / np.array([3, 2, 1])), np.zeros_like(model.weights))
    p = model.probabilities(pieces.Ids(quality.word_facts, code="i"), texts)
    x = np.bincount(row, model.weights[feature] * value, minlength=len(texts))
    tail = [[1 / (1 + np.exp(t - v)) for t in model.thresholds] for v in x]
    assert np.allclose(p[:, 2:].sum(1), [t[1] for t in tail])


def test_forward_backward_is_exact():
    """Against the sum over all paths, over texts shorter and longer than a segment."""
    own = np.random.default_rng(2)
    transitions = own.normal(size=(2, 2))
    lens = np.array([1, 3, 8, 150])
    emissions = own.normal(size=(int(lens.sum()), 2))
    chain = language_id.Chain(emissions, lens, transitions)
    p, pairs = chain.marginals(), chain.pairs()
    t, at, expected = np.exp(transitions), 0, np.zeros((2, 2))
    for n in lens.tolist():
        e = np.exp(emissions[at : at + n])
        forward, backward = [np.array([0.5, 0.5]) @ t * e[0]], [np.ones(2)]
        for k in range(1, n):
            forward.append(forward[-1] @ t * e[k] / 4)
            backward.append(t @ (e[n - k] * backward[-1]) / 4)
        m = np.array(forward) * np.array(backward[::-1])
        assert np.allclose(p[at : at + n], m / m.sum(1, keepdims=True))
        for k in range(1, n):
            x = forward[k - 1][:, None] * t * (e[k] * backward[n - 1 - k])[None]
            expected += x / x.sum()
        at += n
    assert np.allclose(pairs, expected)


@pytest.fixture(scope="module")
def labelled(spark):
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{at}/labels.parquet")


def held(rows):
    return [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]


def test_language_id(spark, labelled):
    docs, _ = labelled
    extra = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate([None, "", "123 %%", "the"])], "doc_id long, text string, lang string")
    out = language_id.language_id(docs.unionByName(extra).withColumn("score", F.lit("clash")), sample_docs=400, rounds=15).collect()
    test = [r for r in held(out) if r["lang"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in test]) > 0.95 and all(r["held_out"] for r in test)
    by_id = {r["doc_id"]: r for r in out}
    assert [by_id[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3 and by_id[-1]["score"] == 0 and by_id[-4]["lang_pred"] != "und"
    assert language_id.language_id(docs.filter("false")).count() == 0
    unlabelled = language_id.language_id(docs.limit(3).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_toxicity(spark, labelled):
    docs, labels = labelled
    rows = toxicity.labelled(docs, labels, "toxic", 6000, "doc_id", "text")
    assert not held([{"doc_id": r["i"]} for r in rows])
    model = toxicity.learn([r["t"] for r in rows], [r["y"] for r in rows])
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = toxicity.toxicity(docs, model).collect()
    test = [r for r in held(out) if r["doc_id"] in toxic]
    assert np.mean([(r["score"] >= 0.5) == toxic[r["doc_id"]] for r in test]) > 0.93
    plain_scores = {r["doc_id"]: model.score(r["text"]) for r in docs.filter("doc_id < 50").collect()}
    assert all(abs(plain_scores[r["doc_id"]] - r["score"]) < 1e-9 for r in out if r["doc_id"] in plain_scores)
    awkward = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 5000)], "doc_id long, text string")
    assert len({r["score"] for r in toxicity.toxicity(awkward, model).filter("doc_id < 3").collect()}) == 1
    assert {r["score"] for r in toxicity.toxicity(awkward, toxicity.learn([], [])).collect()} == {1 / (1 + np.exp(60))}


def test_counterfactuals_take_weight_off_groups():
    """A group named only in toxic texts weighs no more than the others of its kind once swaps are penalised."""
    texts = ["you idiot women here", "stupid women go", "idiot women there", "stupid idiot women"] * 5 + ["nice men here", "men go home", "men there", "good men"] * 5
    labels = [1] * 20 + [0] * 20
    gap = lambda m: abs(m.score("the women met") - m.score("the men met"))
    free, tied = (toxicity.learn(texts, labels, l1=1e-4, fairness=f, z=1.0) for f in (0.0, 20.0))
    assert gap(tied) < 0.25 * gap(free) and tied.score("you idiot") > 0.5


def test_quality(spark, labelled):
    docs, labels = labelled
    model = quality.trained(docs, labels)
    grade = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = quality.quality(docs, model).collect()
    test = [r for r in held(out) if r["doc_id"] in grade]
    assert np.mean([(r["tail_prob"] >= 0.5) == grade[r["doc_id"]] for r in test]) > 0.93
    awkward = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert quality.quality(awkward, model).count() == 2 and quality.quality(awkward, quality.learn([], [])).first()["expected_grade"] is None


def test_ordinal_thresholds():
    """Three grades: thresholds ascend and the expected grade follows the text."""
    texts = [(" ".join(["word"] * 9) if g == 2 else " ".join(["word", "%%"] * 5) if g == 1 else " ".join(["%%"] * 9)).encode() for g in (0, 1, 2) for _ in range(20)]
    model = quality.learn(texts, [g for g in (5, 7, 9) for _ in range(20)])
    assert model.grades == [5, 7, 9] and model.thresholds[0] < model.thresholds[1]
    p = model.probabilities(pieces.Ids(quality.word_facts, code="i"), [texts[0], texts[20], texts[40]])
    assert np.allclose(p.sum(1), 1) and (np.diff(p @ np.array([5.0, 7.0, 9.0])) > 0.5).all()


# ---- tables ----


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (None, "a b c d e f"), (None, None)]])
def test_empty_and_null_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(rows)
    assert ngram_join.ngram_join(docs).count() == n
    assert substring.without_repeats(docs).count() == n
    assert token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).count() == n
    assert (packing.pack(docs, P.path("word_bpe_49k.json")).agg(F.sum("length")).first()[0] or 0) == (n + 6 if n else 0)  # an end id a row and six letters
    assert fingerprint.edited_documents(docs).count() == n
    assert byte_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == n
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0).cast("float"), F.lit(0.5).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    assert near_vectors.near_vectors(vectors).count() == n


def test_packed_columns():
    own = np.random.default_rng(0).integers(0, 2**63, (3, 100), dtype=np.uint64)
    assert (unpacked(packed(*own), 3) == own).all()


def test_registered():
    from docveil.llm.queries import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
