"""Spelling variants, periodic runs and exact deduplication against brute force, and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from lexispark.llm import common, exact_dedup, periodic_runs, queries, spelling_variants


def near_words(words):
    by, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].add(w)
            d = w[:i] + w[i + 1 :]
            if d in words:
                near[w].add(d)
                near[d].add(w)
    for g in by.values():
        for a in g:
            near[a] |= g - {a}
    return near


def brute_forms(words):
    near, form, out = near_words(words), {}, []
    for w, n in words.items():
        b = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = b if b and words[b] >= 10 * n else None
    for w, n in words.items():
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def brute_words(docs):
    c = Counter()
    for doc_id, text in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = r.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            c[r] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


@pytest.mark.parametrize("block", [128, 4])
def test_variants_against_all_pairs(spark, block):
    rng, words = random.Random(3), {}
    for _ in range(900):
        words["".join(rng.choice("abé") for _ in range(rng.choice([7, 7, 8, 9, 10, 14])))] = int(10 ** (rng.random() * 5)) + 2
    words |= {"a" * 7: 5, "a" * 8: 50, "a" * 9: 50_000, "z" * 40: 3, "z" * 39 + "y": 3, "abcdefg": 7, "abcdefg" * 30: 2, "abcdefg" * 30 + "h": 2}
    words |= {f"prefixed{c}{d}": 4 for c in "abcdefghij" for d in "klmnopqrst"}  # a block that must be subdivided
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert sorted(map(tuple, spelling_variants.forms(df, block=block).collect())) == brute_forms(words)
    sizes = spelling_variants.blocks(df, block).groupBy("key").count()
    assert block > 4 or sizes.where("count > 200").isEmpty()


def test_chains_and_ties(spark):
    words = {"lettering": 2, "letterings": 30, "letteringss": 30, "letteringsss": 400, "flettering": 2, "plettering": 2, "unrelated": 9}
    got = {r["word"]: r for r in spelling_variants.forms(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["lettering"]["form"] == "letterings" and got["lettering"]["root"] == "letterings"  # 30 has no near word ten times as frequent
    assert got["letteringss"]["form"] == "letteringsss" and got["unrelated"]["root"] == "unrelated" and got["unrelated"]["n_near"] == 0
    assert got["flettering"]["n_near"] == 2 and got["flettering"]["form"] is None


def test_variants_of_documents(spark, edge_docs, empty_docs):
    assert spelling_variants.digest(empty_docs).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    rows += [(50 + i, "Straße naïveté NAÏVETÉ encyclopedia encyclopaedia Encyclopædia " * (i + 1)) for i in range(30)] + [(99, "Æ" * 9 + " " + "x" * 3_000)] * 2
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert sorted(map(tuple, spelling_variants.digest(df).collect())) == brute_forms(brute_words(rows))


def test_pieces_of_long_texts(monkeypatch):
    text = "one two-three 4 fünf" * 50
    whole = [w for piece in spelling_variants.runs(text) for w in piece]
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(spelling_variants, "PIECE", size)
        assert [w for piece in spelling_variants.runs(text) for w in piece] == whole == re.findall("[a-zÀ-ÿ]+", text)


def brute_runs(ws):
    best = {}
    for q in range(1, len(ws) // 2 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in best.items())


def brute_digest(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(ws), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(ws), key=lambda r: (r[0], r[2]))
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_runs_of_random_texts():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(0, 4)):
            n, a = rng.randint(0, 60), rng.choice([0, 1, 2, 3, 30])
            ws = [f"w{rng.randint(0, a)}" for _ in range(n)]
            if n > 4 and rng.random() < 0.5:
                p, at = rng.randint(1, n // 2), rng.randint(0, n - 1)
                ws = [ws[i] if i < at else ws[at + (i - at) % p] for i in range(n)]
            texts.append(None if rng.random() < 0.05 else rng.choice([" ", "\n", " \t"]).join(ws))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
        found = [sorted(map(tuple, own.tolist())) for _, _, _, own in periodic_runs._found(batch, False)]
        assert found == [brute_runs((t or "").split()) for t in texts]


def test_digest_of_runs(spark, edge_docs, empty_docs, monkeypatch):
    assert periodic_runs.digest(empty_docs).count() == 0
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.where("length(text) < 20000 or text is null").collect()]
    rows += [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90)))) for i in range(200, 320)]
    rows += [(i, "é  ü\nx " * 40) for i in range(330, 345)] + [(901, "x " * 12), (901, "x " * 12), (902, "x " * 11), (None, "y z " * 20)]
    df = spark.createDataFrame([(*r, 5, "p") for r in rows], "doc_id long, text string, start int, period string").repartition(3)
    want = sorted((brute_digest(*r) for r in rows), key=repr)
    assert sorted(map(tuple, periodic_runs.digest(df).collect()), key=repr) == want
    assert sum(r[1] for r in want) > 30
    found = sorted(map(tuple, periodic_runs.runs(df).collect()), key=repr)
    assert found == sorted(((i, s, e - s, q) for i, t in rows for s, e, q in brute_runs((t or "").split())), key=repr)
    texts = {r["doc_id"]: r["text"] for r in periodic_runs.collapsed(df).collect()}
    assert texts[902] == "x " * 10 + "x" and texts[330] == "é ü x" and texts[901] == "x"
    monkeypatch.setattr(periodic_runs, "JOINED", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array(["a b c d e f g h"])], names=["doc_id", "text"])
    assert [b"".join(periodic_runs.pieces(w, order)) for _, w, order, _ in periodic_runs._found(batch, False)] == [b"a b c d e f g h"]


@pytest.mark.parametrize("words, n", [(["same"], 60_000), (["a", "b"], 60_000), ([f"w{i}" for i in range(5000)], 400_000)])
def test_long_texts_end_soon(words, n):
    rng = random.Random(2)
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([" ".join(rng.choice(words) for _ in range(n))])], names=["doc_id", "text"])
    ((_, _, order, own),) = periodic_runs._found(batch, False)
    assert len(order) == n and (len(words) > 1 or own.tolist() == [[0, n, 1]])


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        stays = False
        for i in ids:
            out.append((i, last, len(ids), i == last and not stays, hashlib.sha256(t.encode()).hexdigest()))
            stays |= i == last
    return sorted(out, key=repr)


@pytest.mark.parametrize("key_bytes", [16, 1])
def test_copies_in_several_files(spark, edge_docs, tmp_path, key_bytes):
    """One byte of digest makes different texts meet, so that their bytes decide."""
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()] + [(1000 + i, f"text {i % 150}") for i in range(600)] + [(5000 + i, "hot") for i in range(300)]
    source, folder = str(tmp_path / "the source"), str(tmp_path / "kept")
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, key string, n int, _metadata int")
    df.where("doc_id < 1400 or doc_id is null").repartition(6).write.parquet(source)
    first = exact_dedup.ingest(spark, source, folder, key_bytes, 4000)
    known = [r for r in rows if r[0] is None or r[0] < 1400]
    assert sorted(map(tuple, first.drop("path", "row").collect()), key=repr) == brute_copies(known)
    # Later files meet the state of the earlier ones; what is there already is not read again.
    df.where("doc_id >= 1400").repartition(3).write.mode("append").parquet(source)
    checked = spark.read.parquet(f"{folder}/checked").count()
    second = exact_dedup.ingest(spark, source, folder, key_bytes, 4000)
    assert sorted(map(tuple, second.drop("path", "row").collect()), key=repr) == brute_copies(rows)
    assert spark.read.parquet(f"{folder}/checked").count() > checked
    again = exact_dedup.ingest(spark, source, folder, key_bytes)
    assert again.count() == len(rows) and again.where("kept").select("keep_id", "text_sha256").distinct().count() == len({t or "" for _, t in rows})
    apart = exact_dedup.collided(spark, folder)
    assert (apart is None) == (key_bytes == 16)


def test_state_goes_on_after_a_break(spark, tmp_path, monkeypatch):
    source, folder = str(tmp_path / "docs.parquet"), str(tmp_path / "kept")
    spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id int, text string").repartition(4).write.parquet(source)
    exact_dedup.arrive(spark, source, folder, 1)
    assert exact_dedup.seen(spark, folder).count() == 50
    monkeypatch.setattr(exact_dedup, "finished", lambda writer: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        exact_dedup.remember(spark, folder)
    monkeypatch.undo()
    got = exact_dedup.ingest(spark, source, folder)
    assert sorted(map(tuple, got.drop("path", "row").collect()), key=repr) == brute_copies([(i, f"t{i % 7}") for i in range(50)])
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_copies_of_edge_tables(spark, edge_docs, empty_docs, tmp_path):
    empty_docs.write.parquet(str(tmp_path / "none.parquet"))
    assert exact_dedup.digest(spark, str(tmp_path / "none.parquet")).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    edge_docs.coalesce(1).write.parquet(str(tmp_path / "edge"))
    one = next((tmp_path / "edge").glob("part-*"))
    for path in (tmp_path / "edge", one):
        assert sorted(map(tuple, exact_dedup.digest(spark, str(path)).collect()), key=repr) == brute_copies(rows)


def test_filter_grows(spark):
    held = spark.range(0, 3000, 3).select(common.F.col("id").cast("string").alias("a"))
    rows = spark.range(3000).select(common.F.col("id").cast("string").alias("a"))
    for count in (0, 1000, 5_000_000):
        met = common.filtered(rows, held, ["a"], "there", count)
        assert met.where("there and a % 3 = 0").count() == 1000 and met.where("there").count() < 1010


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_periodic_runs", "op13_exact_dedup"])
def test_sql(spark, tmp_path, name):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(("Encyclopédie", "encyclopédies", "alphabet", "alphabets", "a", "b", "ÄÖÜ")) for _ in range(rng.randint(0, 50)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "w " * 30), (203, rows[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, str(tmp_path))
    assert df.columns == [c[0] for c in cur.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, cur.fetchall()))
