"""Licences, secrets, BPE, toxicity, quality, lines and fingerprints against plain versions."""

import hashlib
import itertools
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from sqltally.llm import bpe, hamming, licenses, lines, neardup, packing, quality, queries, secrets, spotsigs, toxicity
from sqltally.session import checkpoint_dir, local_path
from .conftest import LABELS, SCHEMA, row


def compare(spark, tmp_path, docs, name, labels=None):
    """A query against its DuckDB twin on small tables."""
    con = duckdb.connect()
    for table, df in (("documents", docs), ("labels", labels)):
        if df is not None:
            df.coalesce(1).write.parquet(path := str(tmp_path / f"{table}.parquet"))
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.sql(queries.ORACLE[name])
    rows = lambda cols, data: sorted(tuple(map(repr, (x[cols.index(c)] for c in sorted(cols)))) for x in data)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_licences(spark, tmp_path):
    grant, notice = licenses.SENTENCES["mit-grant"], licenses.SENTENCES["mit-notice"]
    texts = ["Foo bar. Released under the MIT License.\nMore text", f"{grant}:\n\n{notice}.", f"{notice}. {grant}.",
             "// " + licenses.SENTENCES["gpl-free"].replace("it under", "it\n// under") + ".", "nothing", None, "",
             "Released under the MIT License. Released under the MIT License."]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    out = {r.doc_id: r for r in licenses.query(docs).collect()}
    assert [out[i].licences for i in range(8)] == ["MIT", "MIT", "", "GPL-3.0-or-later", "", "", "", "MIT"]
    assert out[2].sentence_ids == "mit-notice,mit-grant" and out[7].n_matches == 2
    compare(spark, tmp_path, docs, "op1_license_scan")


def plain_spans(text):
    out = []
    for m in re.finditer(secrets.ASSIGN, text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def test_secret_base_spans_random():
    rnd, bits = random.Random(1), ["token", "PassWord", "=", ":", " ", '"', "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef",
                                   "api_key", "secret", "é", "\n", "x9", "api-key"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        assert [(s, k, e) for s, k, e, _ in secrets.find(text) if k < 3] == plain_spans(text)


def test_secret_ownership(spark):
    live, copied, bare = "token = Zx81kQpLm2", "token: example123456", "Ab9dEfG7hIjK2lMnOpQ4rStU"
    rows = [row(1, f"a {live} b", source="o1")] + [row(10 + i, f"{copied} {i}", source=f"o{i}") for i in range(6)]
    rows += [row(30, f"see {bare} here", source="o1"), row(31, "Q9wErT7yUiOp2aSdFgHj4kLz x", source="o1"),
             row(32, "Q9wErT7yUiOp2aSdFgHj4kLz y", source="o2"), row(40, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in secrets.query(docs).collect()}
    assert out[1].spans == "assign:2:20" and out[1].n_live == 1 and out[10].n_example == 1 and out[10].n_live == 0
    assert out[30].spans == "owned:4:28" and out[31].spans == "" and out[31].n_assign == 0
    assert out[1].base_sha256 == hashlib.sha256(b"assign:2:20").hexdigest()
    assert out[40].base_sha256 == hashlib.sha256(b"").hexdigest()
    red = {r.doc_id: r for r in secrets.stage(docs).collect()}
    assert red[1].text == "a token = [secret] b" and red[10].text == "token: [example] 0"
    assert red[30].text == "see [secret] here" and red[30].n_chars == len(red[30].text) and red[40].text is None


BLOB = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()


def test_bpe_like_tiktoken():
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(BLOB).ranks, special_tokens={})
    rnd, marks = random.Random(2), "ab \n\t'sté 　日本0१½-_###  ..\x1c\x85 😀 the ing llve"
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, " " * 3000, "ab" * 4000, "x ", " x", "x\n", "<|endoftext|>", "'" * 999]
    got = [np.frombuffer(x, np.uint32).tolist() for x in bpe.encode_texts(texts, BLOB, P.PATTERN)]
    assert got == [enc.encode_ordinary(t) for t in texts]


def test_bpe_small_ranks_match_merging():
    """Against plain merging by rank, with a made-up vocabulary full of overlaps."""
    rnd = random.Random(3)
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
    while len(ranks) < 60:
        t = b"".join(rnd.sample(sorted(ranks), 2))
        if len(t) < 9:
            ranks.setdefault(t, len(ranks))
    enc = bpe.Encoder(ranks)

    def merge(data):
        parts = [bytes([b]) for b in data]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(3000):
        data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 30)))
        if data not in ranks:
            assert enc.piece(data) == merge(data)


def test_bpe_query_round_trip(spark, odd):
    out = bpe.query(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in out)


def test_lines(spark, tmp_path):
    spread = "a line on every site"
    rows = [row(i, f"own line number {i}\n{spread}\nshort one", source=f"s{i}") for i in range(12)]
    rows += [row(50 + i, "a line on nine sites", source=f"s{i}") for i in range(9)] + [row(90, None), row(91, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in lines.query(docs).collect()}
    assert out[0].text == f"own line number 0\n{spread}\nshort one" and out[0].n_removed == 0
    assert out[5].text == "own line number 5\nshort one" and out[5].n_removed == 1
    assert out[55].text == "a line on nine sites" and out[90].text is None and out[91].text == ""
    compare(spark, tmp_path, docs, "op4_line_dedup")


def test_line_spread_sketch(spark):
    rows = [row(i, "one two three\nfour five six", source=f"s{i % 700}") for i in range(1500)]
    got = [r.sites for r in lines.spread(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 2 and all(abs(s - 700) < 70 for s in got)


def toxic_rows(n=600, seed=4):
    rnd = random.Random(seed)
    clean = ["".join(rnd.choice("aeioulnrst") for _ in range(6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        ws = [rnd.choice(clean) for _ in range(rnd.randint(5, 120))]
        bad = i % 4 == 0
        for _ in range(1 + len(ws) // 40 if bad else 0):
            ws[rnd.randrange(len(ws))] = rnd.choice(["zwackhead", "blorgface"])
        rows.append(row(i, " ".join(ws)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, row(9000, "you zwackheadd there"), row(9001, "")], SCHEMA)
    lab = spark.createDataFrame(labels, LABELS)
    out = toxicity.query(docs, lab).join(lab.withColumnRenamed("doc_id", "l"), F.col("doc_id") == F.col("l"), "left").collect()
    held = [r for r in out if r.held_out and r.toxic is not None]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in out}
    assert by[9000].predicted == 1 and by[9001].predicted == 0  # a misspelling never seen; an empty text
    # labels of the held-out fold change nothing
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.query(docs, flipped).collect()}
    assert again == {r.doc_id: r.score for r in out}
    assert toxicity.stage(docs, lab).count() < docs.count() - 100


def test_grams():
    row_of, bucket = toxicity.grams(["ab", "abc", "ab"])
    sets = [sorted(bucket[row_of == i].tolist()) for i in range(3)]
    assert sets[0] == sets[2] != sets[1] and set(sets[0]) & set(sets[1])
    assert toxicity.grams([])[0].size == 0
    assert toxicity.train(pd.DataFrame({"_label": [1, 1], "words": ["a", "a"], "counts": [np.array([1], np.int32).tobytes()] * 2})).bias > 0


def test_quality(spark, tmp_path):
    rnd, rows, labels = random.Random(5), [], []
    for i in range(300):
        good = i % 3 > 0
        text = " ".join(rnd.choice(["the", "of", "house", "and", "river"]) if good else rnd.choice(["$$$", "XX!!", "77"]) for _ in range(60))
        rows.append(row(i, text, source=f"h{i % 7}" if good else "bad"))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [row(900, None, None, None), row(901, "")]
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    out = {r.doc_id: r for r in quality.query(docs, lab).collect()}
    assert all(out[i].keep == (i % 3 > 0) for i in range(300))
    assert out[0].path_share < out[0].host_share + 1e-9 < 0.5
    compare(spark, tmp_path, docs, "op6_quality_bayes", lab)


def test_spotsigs(spark, tmp_path):
    rnd = random.Random(6)
    ws = ["the", "of", "and", "le", "river", "house", "été", "tree", "stone", "and"]
    rows = [row(i * 7, " ".join(rnd.choice(ws) for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    rows += [row(1001, None), row(1002, ""), row(1003, "no anchors"), row(1004, rows[5][1]), row(1005, "The, house... of STONE tree")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in spotsigs.query(docs).collect()}
    assert out[1004].fingerprint == out[35].fingerprint and out[1001].fingerprint == out[1002].fingerprint
    assert out[1002].near_next == 1.0 and out[1003].near_next == 0.0
    sigs = {r.doc_id: r.signatures for r in spotsigs.fingerprints(docs).collect()}
    assert sigs[1005] == ["of stone tree", "the house stone"]
    compare(spark, tmp_path, docs, "op10_spotsigs")


def test_spotsigs_one_row(spark):
    r = spotsigs.query(spark.createDataFrame([row(1, "the big house of stone")], SCHEMA)).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"the big house othe big").hexdigest()


def test_pruned_likeness(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 5]), ([1], [1, 2, 3, 4, 5, 6])], "a array<bigint>, b array<bigint>")
    full = [r[0] for r in df.select(spotsigs.likeness(F.col("a"), F.col("b"))).collect()]
    cut = [r[0] for r in df.select(spotsigs.likeness(F.col("a"), F.col("b"), 0.5)).collect()]
    assert full == pytest.approx([0.6, 1 / 6]) and cut == pytest.approx([0.6, 0.0])


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def changed(rnd, ws, share):
    ws = ws[:]
    for _ in range(int(len(ws) * share)):
        i, kind = rnd.randrange(len(ws)), rnd.random()
        if kind < 0.6:
            ws[i] = "new" + str(rnd.randrange(10**6))
        elif kind < 0.8:
            del ws[i]
        else:
            ws.insert(i, "more" + str(rnd.randrange(10**6)))
    return ws


def test_banded_alignment():
    rnd = random.Random(7)
    for _ in range(1500):
        a = [rnd.choice("abcdef") for _ in range(rnd.randint(1, 40))]
        b = changed(rnd, a, rnd.random() * 0.4) or ["z"]
        want = edit_distance(a, b) <= int(neardup._allowed(max(len(a), len(b))))
        assert neardup.similar(a, b) == want


def test_near_duplicates_by_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(30):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 150))]
        texts += [base, base] + [changed(rnd, base, 0.06) for _ in range(3)]
    texts += [passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(40, 90))] for _ in range(40)]  # alike in a passage only
    texts += [["a", "b"], ["a", "b"], []]
    docs = spark.createDataFrame([row(i, " ".join(t)) for i, t in enumerate(texts)] + [row(990, None), row(991, "!?")], SCHEMA)
    got = {r.doc_id: r.class_id for r in neardup.query(docs).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if (texts[j] == a) or (a and texts[j] and neardup.similar(a, texts[j])):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {i: got[i] for i in range(len(texts))} == {i: find(i) for i in range(len(texts))}
    assert got[990] == got[len(texts) - 1] and got[991] == 991
    kept = {r.doc_id for r in neardup.stage(docs).collect()}
    assert kept == {find(i) for i in range(len(texts))} | {991}


def test_packing(spark):
    rnd = random.Random(9)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [" ".join(rnd.choice(["house", "river", "stone", "xyzzy"]) for _ in range(int(rnd.lognormvariate(5, 1.2)))) for _ in range(300)]
    texts += ["", "", "a  b \n c", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "dé \u2028 \U0001F600"]
    docs = spark.createDataFrame([row(i, x) for i, x in enumerate(texts)] + [row(900, None)], SCHEMA)
    out = packing.query(docs, P.path("byte_bpe_50k.json")).toPandas()
    import zlib
    for i, g in out.sort_values("piece").groupby("doc_id"):
        ids = np.array(t.encode(texts[i] if i < 900 else "", add_special_tokens=False).ids + [2], "<u4")
        assert list(g.start) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids)
        assert all(n == 1024 for n in g.length[1:]) and (len(ids) > 1024) == (len(g) > 1)
        assert [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(g.start, g.length)] == list(g.ids_crc32)
    q = out.sort_values(["sequence_id", "offset"])
    assert ((q.offset + q.length).groupby(q.sequence_id).shift(fill_value=0) == q.offset).all()
    assert (q.offset + q.length).max() <= 1024
    assert q.sequence_id.nunique() <= 1.02 * -(-out.length.sum() // 1024) + 1


def test_best_two_fit():
    # greedy takes 6 + 3; the bin of 10 then swaps its 3 for 2 + 2, which fits its gap of 4
    plan = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == ([6, 2, 2], 1) and sum(n * sum(p) for p, n in plan) == 13
    for seed in range(30):
        rnd = random.Random(seed)
        counts = {rnd.randint(1, 100): rnd.randint(1, 50) for _ in range(20)}
        total: dict = {}
        for pattern, n in packing.plan(counts, 100):
            assert sum(pattern) <= 100
            for x in pattern:
                total[x] = total.get(x, 0) + n
        assert total == counts


def test_hamming_by_brute_force(spark):
    rnd = np.random.default_rng(10)
    v = rnd.normal(size=(300, 24)).astype(np.float32)
    v[100:160] = v[50]
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int")
    got = sorted(tuple(r) for r in hamming.search(df, df.where("vec_id % 50 = 0"), k=5, bits=8).collect())
    bits, want = v > 0, []
    for q in range(0, 300, 50):
        d = sorted(((bits[q] != bits[i]).sum(), i) for i in range(300) if i != q)[:5]
        want += [(q, i, int(x), n + 1) for n, (x, i) in enumerate(d)]
    assert got == sorted(want)


@pytest.mark.parametrize("bits", [None, 8, 11, 16])
@pytest.mark.parametrize("dim", [7, 64, 100])
def test_hamming_index_by_brute_force(bits, dim):
    rnd = np.random.default_rng(dim)
    centres = rnd.integers(0, 2, (6, dim))  # clustered codes, many of equal distance
    codes = np.unique(centres[rnd.integers(0, 6, 500)] ^ (rnd.random((500, dim)) < 0.08), axis=0)
    codes = codes[rnd.permutation(len(codes))]
    asked = np.concatenate([codes[:20], rnd.integers(0, 2, (10, dim))])
    pack = lambda x: np.packbits(np.pad(x.astype(np.uint8), ((0, 0), (0, -dim % 64))), axis=1, bitorder="little").view(np.uint64)
    for k in (1, 5, 11, 10_000):
        query, entry, distance = hamming.Index(pack(codes), dim, bits).nearest(pack(asked), k)
        got = [[] for _ in asked]
        for q, e, d in zip(query.tolist(), entry.tolist(), distance.tolist()):
            got[q].append((d, e))
        assert got == [sorted((int((a != c).sum()), i) for i, c in enumerate(codes))[:k] for a in asked]


def scattered(rnd, ws, edits):
    """``ws`` with so many words replaced."""
    ws = ws[:]
    for i in rnd.sample(range(len(ws)), edits):
        ws[i] = "new" + str(rnd.randrange(10**9))
    return ws


def test_near_duplicates_of_a_base_of_middle_key(spark):
    rnd = random.Random(21)
    base = [f"w{rnd.randrange(3000)}" for _ in range(200)]
    variants = [scattered(rnd, base, rnd.randint(24, 40)) for _ in range(300)]
    md5 = lambda ws: hashlib.md5(" ".join(ws).encode()).digest()
    middle = sorted(map(md5, variants))[150]
    while md5(base) < middle:  # another spelling of the base with a key in the upper half
        base = [w.upper() if rnd.random() < 0.5 else w for w in base]
    docs = spark.createDataFrame([row(i, " ".join(t)) for i, t in enumerate([base, *variants])], SCHEMA)
    got = [r.class_id for r in neardup.query(docs).collect()]
    assert sum(c == 0 for c in got) >= 299  # brute force: one class of 301


def test_near_duplicates_of_short_texts(spark):
    rnd, texts = random.Random(22), []
    for n in range(5, neardup.SHORT + 1):
        for _ in range(4):
            base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            most = int(neardup._allowed(n))
            spread = base[:]
            for k in range(most):  # as evenly as edits can be, so that no long run stays
                spread[(k + 1) * n // (most + 1) - (k + 1 == n)] = "new" + str(rnd.randrange(10**9))
            shorter = base[:]
            for _ in range(most):
                del shorter[rnd.randrange(len(shorter))]
            texts += [base, spread, shorter]
    docs = spark.createDataFrame([row(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in neardup.query(docs).collect()}
    want = {i: i - i % 3 for i, t in enumerate(texts) if neardup.similar(texts[i - i % 3], t)}
    assert len(want) == len(texts) and got == want


def test_near_duplicate_recall_at_the_least_similarity(spark):
    rnd, texts = random.Random(23), []
    for n in (25, 30, 40, 60, 200):
        for _ in range(60):
            base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            texts += [base, scattered(rnd, base, int(neardup._allowed(n)))]
    docs = spark.createDataFrame([row(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in neardup.query(docs).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, len(texts), 2)) >= 0.98 * len(texts) / 2


def test_secret_bare_tokens_of_copies_and_of_one_case(spark):
    copied, shared, base36, base32 = ("Ab9dEfG7hIjK2lMnOpQ4rStU", "Q9wErT7yUiOp2aSdFgHj4kLz", "k3j9x0qz7m2vw8r5t1yb6n4p",
                                      "GEZDGNBVGY3TQOJQ4XK2W7MP")
    rows = [row(1, f"see {copied} here", source="o1"), row(2, f"see {copied} here", source="o2"),
            row(3, f"{shared} x", source="o1"), row(4, f"{shared} y", source="o2"),
            row(5, f"a {base36} b"), row(6, f"a {base32} b"), row(7, "annual_report_of_the_company_2019 articles/2019/some-long-title")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r.spans for r in secrets.query(docs).collect()}
    assert out[1] == out[2] == "owned:4:28" and out[5] == out[6] == "owned:2:26" and out[7] == ""
    red = {r.doc_id: r.text for r in secrets.stage(docs).collect()}
    assert red[1] == red[2] == "see [secret] here" and red[3] == "[secret] x" and red[4] == "[secret] y"
    assert red[7] == rows[6][1]


def test_near_duplicates_leave_only_their_classes_on_disk(spark):
    """Tables in between are deleted once nothing reads them any more."""
    base = [f"word{i}" for i in range(50)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1:]) for k in range(30)] + [" ".join(f"u{j}-{i}" for i in range(40)) for j in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tables = Path(local_path(checkpoint_dir(spark)), "sqltally")
    before = set(tables.iterdir()) if tables.exists() else set()
    assert [r.class_id for r in neardup.query(docs).orderBy("doc_id").collect()] == [0] * 30 + list(range(30, 40))
    assert {p.name.rsplit("-", 1)[0] for p in set(tables.iterdir()) - before} == {"star"}


def test_toxicity_training_keeps_only_trained_buckets():
    """What training holds of the texts grows with the buckets it trains, not with all their n-grams."""
    r = random.Random(5)
    said = [[f"t{r.randrange(10 ** 9)}" for _ in range(60)] + (["badword"] if i % 2 else ["goodword"]) for i in range(200)]
    rows = pd.DataFrame({"_label": [i % 2 for i in range(200)], "words": [" ".join(w) for w in said],
                         "counts": [np.ones(61, np.int32).tobytes()] * 200})
    buckets, ends, places, shares = toxicity._features(rows, rows["_label"].to_numpy(), 5, 5.0)
    assert len(ends) == 201 and len(places) == len(shares) == ends[-1] < 200 * 61
    assert places.max() < len(buckets) < 2_000
    model = toxicity.train(rows)
    assert model.of_words(["badword"])[0] > 0 > model.of_words(["goodword"])[0]


def bags_of(texts):
    return neardup._describe(neardup._Hashes(), pa.array([" ".join(t) for t in texts]))


def test_long_unlike_texts_are_not_aligned():
    rnd = random.Random(31)
    vocabulary = [f"w{i}" for i in range(20000)]
    texts = [[rnd.choice(vocabulary) for _ in range(n)] for n in (1400, 1450, 1500, 1550, 1600, 3000, 3100)]
    texts += [scattered(rnd, t, len(t) // 10) for t in texts]
    d, a, b = bags_of(texts), *zip(*itertools.combinations(range(len(texts)), 2))
    batch = pa.RecordBatch.from_pydict({
        "a": [bytes([i]) for i in a], "b": [bytes([i]) for i in b], "shared": [1] * len(a),
        "na": d.field("n").take(pa.array(a)), "nb": d.field("n").take(pa.array(b)),
        "bag_a": d.field("bag").take(pa.array(a)), "bag_b": d.field("bag").take(pa.array(b))})
    got = {(x[0], y[0]) for p in neardup._possible(iter([batch])) for x, y in zip(p["a"].to_pylist(), p["b"].to_pylist())}
    assert got == {(i, j) for i, j in zip(a, b) if neardup.similar(texts[i], texts[j])} == {(i, i + 7) for i in range(7)}


def test_pairs_of_a_block_by_brute_force(monkeypatch):
    rnd, texts = random.Random(32), [["the"] * 900]
    for n in (1, 2, 4, 30, 120, 500, 520, 1000, 1100, 2100):
        base = [rnd.choice(["the", "of", "and", *map(str, range(n))]) for _ in range(n)]
        texts += [base] + [changed(rnd, base, rnd.random() * 0.3) for _ in range(7)]
    texts = sorted(texts, key=len)
    d = bags_of(texts)
    n, bags = d.field("n").to_numpy(), d.field("bag").to_pylist()
    root, own = np.array([rnd.randrange(30) for _ in texts]), np.array([rnd.randrange(2) for _ in texts])
    like = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if neardup.similar(texts[i], texts[j])}
    assert len(like) > 100
    for cells in (1, 1 << 12, 1 << 22):
        monkeypatch.setattr(neardup, "CELLS", cells)
        for o in (None, own):
            pairs = [p for i, j in neardup._near(n, bags, root, o) for p in zip(i.tolist(), j.tolist())]
            assert len(pairs) == len(set(pairs))
            assert all(i < j and root[i] != root[j] and (o is None or o[i] != o[j]) for i, j in pairs)
            assert {(i, j) for i, j in like if root[i] != root[j] and (o is None or o[i] != o[j])} <= set(pairs)
