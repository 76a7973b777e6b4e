"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lexispark.llm import common, simhash


def brute_print(text, k=3):
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_similarity(a, b):
    sets = []
    for t in (a, b):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    both = len(sets[0] & sets[1])
    return both / (len(sets[0]) + len(sets[1]) - both) if sets[0] or sets[1] else 1.0


RING = [range(0, 13), range(13, 26), range(26, 39), range(39, 52), range(52, 64)]


def brute_link(a, b, near):
    """Whether prints differ in few bits; beyond three also with a start of the ring whose chains and key agree."""
    diff = a ^ b
    if diff.bit_count() <= 3 or diff.bit_count() > near:
        return diff.bit_count() <= 3
    bits = [sum(diff >> x & 1 for x in r) for r in RING]
    for s in range(5):
        own = bits[s:] + bits[:s]
        if own[0] == 0 and 0 in own[1:3] and all(sum(own[: n + 1]) <= (n + 1) * near // 5 for n in range(4)):
            return True
    return False


def brute_components(prints, texts=None, near=3, total=999):
    """Components of documents that link in any of their fingerprints, and whose texts are similar if given."""
    prints = [p if isinstance(p, list) else [p] for p in prints]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            bits = sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True))
            if bits <= total and any(brute_link(a, b, near) for a, b in zip(prints[i], prints[j], strict=True)) and (not texts or brute_similarity(texts[i], texts[j]) >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def brute_tables(text):
    """A text's fingerprints for deduplication: of distinct words and distinct pairs of words."""
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return [0] * len(simhash.TABLES)
    full = 2**64 - 1

    def mix(h, m=0):
        h = h + (m + 1) * 0x9E3779B97F4A7C15 & full
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return h ^ h >> 31

    own = [xxhash.xxh64_intdigest(x, 42) for x in w]
    out = []
    for k, m in simhash.TABLES:
        some = set(own) if k == 1 or len(own) == 1 else {mix(a) + b & full for a, b in zip(own, own[1:])}
        out.append(sum((sum(mix(x, m) >> b & 1 for x in some) * 2 > len(some)) << b for b in range(64)))
    return out


def brute_duplicates(texts):
    return brute_components([brute_tables(t) for t in texts], texts, simhash.NEAR_BITS, simhash.TOTAL_BITS)


def test_fingerprint():
    rng = random.Random(1)
    for t in (None, "", " \n", "One", "one TWO", "A b C", "é É ẞ", "".join(rng.choice("aAbB é\t\n\x0b") for _ in range(3000))):
        assert simhash.fingerprint(t, 3) == brute_print(t)
        assert simhash.fingerprint(t, 5) == brute_print(t, 5)
        assert simhash.described(t)[1:] == brute_tables(t)


def test_shared_keys_cover_all_pairs_in_reach(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        pairs.append((a, b))
    signed = [tuple(int(np.uint64(x).astype(np.int64)) for x in p) for p in pairs]
    df = spark.createDataFrame(signed, "a long, b long")
    met = df.select(F.arrays_overlap(simhash.keys("a"), simhash.keys("b")).alias("met"), F.explode(F.array_intersect(simhash.keys("a"), simhash.keys("b"))).alias("key"), "a", "b")
    assert df.select(F.arrays_overlap(simhash.keys("a"), simhash.keys("b")).alias("m")).where("m").count() == 3000
    found = {(r["a"], r["b"]) for r in met.collect() if simhash.distances(np.array([r["a"]]).view(np.uint64), np.array([r["b"]]).view(np.uint64), (r["key"] >> 40) // 2)[0, 0] <= 3}
    assert found == set(signed)


def test_components_of_dense_and_chained_prints(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_ROWS", 16)
    rng = random.Random(3)
    prints = {0}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            y = x
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                y ^= 1 << bit
            prints.add(y)
            x = y if rng.random() < 0.3 else x
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    nodes = spark.createDataFrame([(p, p) for p in signed], "node long, fp0 long")
    want = brute_components(prints)
    got = {r["node"]: r["root"] for r in common.connected_components(simhash.links(nodes)).collect()}
    for i in range(len(prints)):
        for j in range(i):
            assert (want[i] == want[j]) == (got.get(signed[i], signed[i]) == got.get(signed[j], signed[j]))


def test_finer_keys_keep_all_pairs_of_a_large_group(spark, monkeypatch):
    # All prints agree in two segments, so one key holds all of them, many times over what blocks are for.
    monkeypatch.setattr(common, "BLOCK_ROWS", 4)
    rng = random.Random(31)
    for fixed in (0x3FFFFFF, (1 << 13) - 1 | ((1 << 39) - (1 << 26))):
        prints = set()
        while len(prints) < 200:
            x = (0x5A5A5A5A5A5A5A5A & fixed) | (rng.getrandbits(64) & ~fixed & 2**64 - 1)
            prints.add(x)
            if rng.random() < 0.5:
                for bit in rng.sample([b for b in range(64) if not fixed >> b & 1], rng.randint(1, 3)):
                    x ^= 1 << bit
                prints.add(x)
        prints = sorted(prints)
        signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
        nodes = spark.createDataFrame([(p, p) for p in signed], "node long, fp0 long")
        want = brute_components(prints)
        got = {r["node"]: r["root"] for r in common.connected_components(simhash.links(nodes)).collect()}
        assert 1 < len(set(want)) < len(prints)
        for i in range(len(prints)):
            for j in range(i):
                assert (want[i] == want[j]) == (got.get(signed[i], signed[i]) == got.get(signed[j], signed[j]))
        counts = simhash.placed(nodes, ((3, 0),), 3).groupBy("key", "lo", "hi").count().collect()
        assert max(r["count"] for r in counts) < 100


def test_links_in_batches_are_those_of_all_pairs():
    # Small groups are compared all at once, large and dense ones by themselves.
    rng = random.Random(17)
    rows, node = [], 0
    for size in (2, 3, 3, 8, 32, 33, 60, 5):
        start, near = rng.randrange(5), rng.getrandbits(64)
        for _ in range(size):
            x = near
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << bit
            rows.append((start * 2 << 40 | size << 8 | len(rows) // 50 % 2, x, node))
            node += 1
    rows.sort()
    key, fp, node = (np.array(x) for x in zip(*((k, np.uint64(x).astype(np.int64), n) for k, x, n in rows), strict=True))
    zero = np.zeros(len(rows), np.int64)
    t = pa.table({"key": key, "lo": zero, "hi": zero, "b": zero, "print": fp, "node": node, "label": node})
    want = set()
    for i in range(len(rows)):
        for j in range(i):
            if key[i] == key[j]:
                a, b = fp[i : i + 1].view(np.uint64), fp[j : j + 1].view(np.uint64)
                if simhash.distances(a, b, int(key[i] >> 40) // 2, 6)[0, 0] <= 6:
                    want.add((min(node[i], node[j]), max(node[i], node[j])))
    got, left = set(), 0
    for b in simhash._step(iter(t.to_batches(max_chunksize=7)), 6):
        for r in b.to_pylist():
            left += r["a"] is None
            if r["a"] is not None:
                got.add((min(r["a"], r["b"]), max(r["a"], r["b"])))
    assert got <= want and left and len(want) > 500
    groups = {}
    for n, k in zip(node, key, strict=True):
        groups.setdefault(k, set()).add(n)
    for members in groups.values():  # what all links connect, those returned connect
        parts = []
        for links in (want, got):
            root = {n: n for n in members}
            for _ in members:
                for p in links:
                    if p[0] in members:
                        root[p[0]] = root[p[1]] = min(root[p[0]], root[p[1]])
            parts.append(root)
        assert parts[0] == parts[1]


def test_tables():
    for t in (None, "", "a b", "One two three four five six seven"):
        got = simhash.described(t)
        assert got[1:] == brute_tables(t) and len(got) == 1 + len(simhash.TABLES)
    assert simhash.described("a b c d e A b c D e")[0] == simhash.described("a B c d e a b c d e a b c d e")[0] != simhash.described("a b c d e")[0]


def test_links_of_any_table(spark):
    rng = random.Random(13)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    texts = [" ".join(base)]
    for n in (1, 2, 4, 8, 12, 20, 40):
        for _ in range(6):
            w = list(base)
            for _ in range(n):
                w[rng.randrange(300)] = f"x{rng.randint(0, 500)}"
            texts.append(" ".join(w))
    texts += [" ".join(f"v{rng.randint(0, 500)}" for _ in range(200)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_duplicates(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    one = brute_components([simhash.fingerprint(t, 5) for t in texts])
    assert len(set(want)) < len(set(one)) and len(set(want)) > 30


def test_edge_documents(spark, edge_docs, empty_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    prints = [brute_print(r["text"]) for r in rows]
    comp = brute_components(prints)
    least = {}
    for r, c in zip(rows, comp, strict=True):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, comp, strict=True)), key=str)
    assert sorted(map(tuple, simhash.digest(edge_docs).collect()), key=str) == want
    assert simhash.digest(empty_docs).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark, edge_docs, empty_docs):
    out = simhash.deduplicate(edge_docs)
    assert out.columns == edge_docs.columns
    rows = edge_docs.select("text").distinct().collect()
    assert out.count() == len(set(brute_duplicates([r["text"] for r in rows])))
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(1) == 1 and 2 not in kept and kept.count(None) == 1
    assert simhash.deduplicate(empty_docs).count() == 0


def test_nearest_forest_takes_the_nearest_links():
    apart = np.array([[0, 2, 1, 255], [2, 0, 1, 255], [1, 1, 0, 255], [255, 255, 255, 0]], np.uint8)
    assert sorted(common.nearest_forest(apart, 0, 3)) == [(0, 2), (1, 2)]
    assert sorted(common.nearest_forest(np.array([[3, 255], [1, 2]], np.uint8), 2, 3)) == [(0, 2), (1, 2), (1, 3)]


def test_similarity_decides():
    base = [f"w{i}" for i in range(104)]
    for n in (0, 1, 2, 3, 5):
        other = [f"x{i}" if i % 20 == 10 and i < 20 * n else w for i, w in enumerate(base)]
        a, b = " ".join(base), " ".join(other).upper()
        want = brute_similarity(a, b)
        got = simhash.jaccard(simhash.shingle_set(a), simhash.shingle_set(b))
        assert (got >= simhash.SIMILAR) == (want >= 0.8) and abs(got - want) < 1e-12
    assert simhash.jaccard(simhash.shingle_set(None), simhash.shingle_set("a")) == 0


def changed(words, at):
    return " ".join("x" + w if i in at else w for i, w in enumerate(words))


def test_a_farther_similar_pair_is_found_where_nearest_links_fail(spark, monkeypatch):
    # A is nearest to B and C but similar to neither; B and C are similar. The prints are set by hand.
    monkeypatch.setattr(simhash, "SMALL", 0)
    b = [f"w{i}" for i in range(104)]
    texts = {"A": changed(b, range(0, 104, 9)), "B": " ".join(b), "C": changed(b, {50})}
    assert brute_similarity(texts["B"], texts["C"]) >= 0.8 > max(brute_similarity(texts["A"], texts[x]) for x in "BC")
    prints = {"A": 0b111 << 40, "B": 0b110 << 40, "C": 0b101 << 40}
    docs = spark.createDataFrame([(i, texts[x]) for i, x in enumerate("ABC")], "doc_id long, text string")
    nodes = {x: simhash.described(texts[x])[0] for x in "ABC"}
    rows = simhash.rows_of(docs)
    hashes = {r["row"]["doc_id"]: (r["h1"], r["h2"]) for r in rows.collect()}
    given = spark.createDataFrame([(nodes[x], (False, i, *hashes[i]), prints[x]) for i, x in enumerate("ABC")], "node long, least struct<bare:boolean,doc_id:long,h1:long,h2:long>, fp0 long")
    roots = {r["node"]: r["root"] for r in simhash.similar_links(given, rows, simhash.TABLES[:1]).collect()}
    assert roots[nodes["B"]] == roots[nodes["C"]] and roots.get(nodes["A"], nodes["A"]) != roots[nodes["B"]]


def test_chosen_links():
    rng = np.random.default_rng(4)
    apart = rng.integers(0, 8, (30, 30)).astype(np.uint8)
    apart = np.minimum(apart, apart.T)
    apart[apart > 3] = 255
    labels = np.arange(30) // 2
    want = {(i, j) for j in range(30) for i in range(j) if apart[i, j] <= 3 and labels[i] != labels[j]}
    i, j, left = simhash.chosen(apart, 0, labels)
    one = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert left and one < want and len(one) == 29
    i, j, left = simhash.chosen(apart[:10, 10:], 10, labels)
    assert left and {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} < want
    thin = np.where(rng.random((30, 30)) < 0.9, np.uint8(255), apart)
    thin = np.maximum(thin, thin.T)
    i, j, left = simhash.chosen(thin, 0, labels)
    assert not left and set(zip(i.tolist(), j.tolist(), strict=True)) == {p for p in want if thin[p] <= 3}


def test_sharing_rare_holds_all_similar_pairs():
    rng = random.Random(6)
    for _ in range(20):
        base = [rng.sample(range(2000), rng.choice([1, 2, 5, 40])) for _ in range(3)]
        sets = []
        for _ in range(40):
            own = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                own[rng.randrange(len(own))] = rng.randint(0, 3000)
            sets.append(np.unique(np.array(own, np.uint64)))
        label = np.array([rng.randint(0, 30) for _ in sets])
        got = set(zip(*(x.tolist() for x in simhash.sharing_rare(sets, label)), strict=True))
        for j in range(40):
            for i in range(j):
                if label[i] != label[j] and simhash.jaccard(sets[i], sets[j]) >= 0.8:
                    assert (i, j) in got
        assert all(i < j and label[i] != label[j] for i, j in got)
    assert [len(x) for x in simhash.sharing_rare([np.zeros(0, np.uint64)], np.zeros(1))] == [0, 0]


def test_linked_is_what_blocks_see():
    rng = random.Random(7)
    for _ in range(2000):
        a = [rng.getrandbits(64) for _ in range(4)]
        b = [x ^ sum(1 << bit for bit in rng.sample(range(64), rng.choice([1, 3, 4, 6, 7, 12]))) for x in a]
        total = sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
        want = total <= simhash.TOTAL_BITS and any(brute_link(x, y, 6) for x, y in zip(a, b, strict=True))
        assert simhash.linked(np.array([a], np.uint64), np.array([b], np.uint64))[0] == want


def test_families_are_resolved_whole(spark, monkeypatch):
    """Dense groups of texts of which few are similar, in small blocks."""
    monkeypatch.setattr(simhash, "SETS", 16)
    rng = random.Random(14)
    texts = []
    for f in range(3):
        base = [f"w{f}x{rng.randint(0, 90)}" for _ in range(150)]
        for _ in range(50):
            texts.append(changed(base, rng.sample(range(150), rng.choice([2, 3, 4, 5, 6]))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_duplicates(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want and 3 < len(set(want)) < 149


def test_verification_in_blocks_connects_what_similar_pairs_connect(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 4)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(104)]
    texts = [changed(words, rng.sample(range(104), rng.choice([0, 1, 2, 3, 4]))) for _ in range(30)]
    sets = [simhash.shingle_set(t) for t in texts]
    pairs = [(i, j) for j in range(30) for i in range(j) if rng.random() < 0.3]
    held = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, set binary")
    got = {tuple(r) for r in simhash.similar(spark.createDataFrame(pairs, "a long, b long").repartition(3), held).collect()}
    good = [p for p in pairs if brute_similarity(texts[p[0]], texts[p[1]]) >= 0.8]

    def parts(links):
        root = list(range(30))
        for _ in range(30):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert got <= set(good) and parts(got) == parts(good) and 0 < len(good) < len(pairs)


def test_equal_fingerprints_of_other_texts_are_told_apart(spark):
    # The same words in another order have equal prints of words, but other shingles.
    rng = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    own = [" ".join(rng.sample(base, 60)) for _ in range(6)]
    texts = [*own, own[0].upper(), own[1] + " w3", own[2] + "\n"]
    assert len({tuple(simhash.described(t)[1:4]) for t in texts}) == 1
    want = brute_components([0] * len(texts), texts)
    assert want == [0, 1, 2, 3, 4, 5, 0, 1, 2]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, t) for t in (own[0] + " w9", texts[3])], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(docs).where("doc_id is not null").collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == [0, 1, 2, 3, 4, 5]


def test_rows_that_are_equal_or_swap_nulls(spark):
    rows = [(1, "a b c", None, "x"), (1, "a b c", "x", None), (1, "a b c", None, "x"), (2, "d e f", None, None), (2, "d e f", None, None), (None, "g", "x", "y"), (3, "h", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `odd.name` string").repartition(3)
    got = [tuple(r) for r in simhash.deduplicate(docs).collect()]
    assert len(got) == 4 and {r[1] for r in got} == {"a b c", "d e f", "g", "h"}
    assert (None, "g", "x", "y") in got and (3, "h", None, "z") in got
