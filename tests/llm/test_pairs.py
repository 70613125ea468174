"""Alignment, collocations and the Jaccard join against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sqltally.llm import alignment, collocations, jaccard
from sqltally.llm.tokens import classes, steps, words_of

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def documents(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


# --- words -------------------------------------------------------------------

def test_words_of_slices_and_odd_texts():
    texts = ["  One two\tTHREE ", "", "ÄB äb. c;d", " ", "x" * 1000, "a.b\nc"]
    for kind in (pa.string(), pa.large_string()):
        for lo, hi in itertools.combinations(range(len(texts) + 1), 2):
            w = words_of(pa.array(["skip"] + texts, kind)[lo + 1:hi + 1], classes(b" \t\n", b".;"))
            names = w.names.to_pylist()
            got = [[] for _ in texts[lo:hi]]
            for i, d in zip(w.ids, w.doc):
                got[d].append(names[i])
            fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
            assert got == [[x.encode() for x in re.split(r"[ \t\n.;]+", fold(t)) if x] for t in texts[lo:hi]]
    w = words_of(pa.array(["a b. c", "d e"]), classes(b" ", b"."))
    assert w.joined.tolist() == [True, False, False, True, False]


def test_steps_cover_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 100, 3, 3, 0)])], names=["t"])
    parts = list(steps(iter([b]), 0, 6))
    assert [p.num_rows for p in parts] == [2, 1, 3] and sum(p.num_rows for p in parts) == 6


# --- op11 --------------------------------------------------------------------

def plain_alignment(texts):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=B)
    of = alignment.byte_characters()
    vocabulary = {i: bytes(of[c] for c in s) for s, i in t.get_vocab().items() if i != 50256}
    docs, counts = [], Counter()
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = m.encode(text) if text else []
        piece = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        ta, tb = [vocabulary[i] for i in a], [piece(i) for i in b]
        if not text or not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            a, b, ta, tb = [], [], [], []
        ends = [list(itertools.accumulate(map(len, x))) for x in (ta, tb)]
        links = [(i, j) for i in range(len(a)) for j in range(len(b))
                 if ends[0][i] - len(ta[i]) < ends[1][j] and ends[1][j] - len(tb[j]) < ends[0][i]]
        counts.update((a[i], b[j]) for i, j in links)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            k, n = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:n])))
            i, j = k, n
        docs.append((a, b, links, ";".join(groups)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, (a, b, links, groups) in enumerate(docs):
        pairs = [(a[x], b[y]) for x, y in links]
        out.append((i, len(a), len(b), groups.count("|") if a else 0, len(links), sum(counts[p] == best[p[1]] for p in pairs),
                    sum(counts[p] for p in pairs), hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    return out


TEXTS = ["Hello world, this is a test.", "", None, "  two  spaces ", "naïve café déjà vu – “quoted”", "日本語のテキスト",
         "a▁b stays out", "<|endoftext|> </s> <unk> <0x0A>", "line one\nline two\r\n\ttab", "x" * 500, "\U0001F600 smile ́",
         "Hello world, this is a test.", "ﬁ ½ ﷺ", "tail ", " ", "\x00\x01", "hello hello hello"]


def test_alignment_against_plain(spark):
    got = [tuple(r) for r in alignment.query(documents(spark, TEXTS).repartition(3), A, B).collect()]
    assert sorted(got) == plain_alignment(TEXTS)


def test_groups_are_the_digests_texts(spark):
    docs = documents(spark, TEXTS)
    digests = {r.doc_id: r.groups_sha256 for r in alignment.query(docs, A, B).collect()}
    for r in alignment.groups(docs, A, B).collect():
        assert digests[r.doc_id] == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")


def test_merge_path_pieces_agree():
    r = np.random.default_rng(3)
    for _ in range(200):
        top = int(r.integers(1, 40))
        a, b = (np.unique(np.append(r.integers(1, top + 1, r.integers(0, 30)), top)) for _ in range(2))
        whole = {(int(np.searchsorted(a, e)), int(np.searchsorted(b, e))) for e in set(a.tolist()) | set(b.tolist())}
        cuts = sorted((int(np.searchsorted(a, e)), int(np.searchsorted(b, e))) for e in set(a.tolist()) & set(b.tolist()))
        for work in (1, 2, 3, 5, 64):
            o = alignment.overlaps(a, b, work)
            links = list(zip(o.a.tolist(), o.b.tolist()))
            assert len(links) == len(whole) and set(links) == whole
            assert list(zip(o.cut_a.tolist(), o.cut_b.tolist())) == cuts


def test_rank_encoding_is_that_of_the_merges():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    with open(A, encoding="utf-8") as f:
        side = alignment.byte_level(f.read())
    texts = [f"{c}b {c}1{c}.{c}\n{c}" for c in map(chr, [*range(1, 0xD800, 7), *range(0xE000, 0x30000, 61)])]
    ids, n = side.encode(texts)
    assert ids.tolist() == [i for e in t.encode_batch([" " + x for x in texts], add_special_tokens=False) for i in e.ids]
    assert n.sum() == len(ids)


# --- op12 --------------------------------------------------------------------

def plain_collocations(texts, langs, least=30, top=2000):
    f, total = Counter(), Counter()
    for text, lang in zip(texts, langs):
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    cand = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    rows = []
    for (lang, p), a in cand.items():
        if any(100 * n >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
               for (x, q), n in cand.items() if x == lang and len(q) > len(p)):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                                    for k in range(1, len(p)))
        rows.append((lang, " ".join(p), a, left, right, total[lang], score))
    out = []
    for lang in set(r[0] for r in rows):
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(out)


def random_texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["New", "york", "city", "san", "é", "the", "of", "in", "x1", "z"] + [f"w{i}" for i in range(40)]
    runs = ["new york city", "San Francisco bay area", "the of", "aa aa aa aa aa", "in, the"]
    return [" ".join(r.choice(runs) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.randint(0, 60)))
            + r.choice(["", ".", "\n", "! a", "\t b"]) for _ in range(n)]


def test_collocations_against_plain(spark):
    texts = [*random_texts(1, 400), None, "", "solo solo " * 40 + "z", "q " * 45]
    langs = [["en", "de", None, "a\tb"][i % 4] if i % 3 else "en" for i in range(len(texts))]
    got = collocations.query(documents(spark, texts, langs).repartition(4)).collect()
    want = plain_collocations(texts, langs)
    assert len(want) > 20 and sorted(tuple(r) for r in got) == want
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_full_slots_change_no_count(monkeypatch):
    """With far fewer slots than phrases, starts are early but counts stay whole."""
    monkeypatch.setattr(collocations, "_SLOT", np.uint64(64 - 5))
    texts, shards = random_texts(2, 300), 3
    table, counts, start = np.full(32, 255, np.uint8), Counter(), {}
    done, scan, since = {}, 0, 0
    with np.errstate(over="ignore"):
        while scan < shards or since < shards:
            slots = {}
            for _, keys, slot, first, n in collocations._phrases(pa.array(texts[scan % shards::shards]), "en", table, scan, shards):
                for k, s, at, x in zip(keys, slot, first, n):
                    assert start.setdefault(k, at) == at
                    counts[k] += int(x)
                    slots[k] = s
            hit = [s for k, s in slots.items() if counts[k] >= 30 and k.count(b" ") < 3 and table[s] == 255]
            table[hit] = scan + 1
            done.update({k: counts[k] for k in counts if start[k] + shards - 1 == scan})
            since, scan = 0 if hit else since + 1, scan + 1
    want = Counter()
    for t in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", t.lower()):
            w = re.findall("[^ \t]+", piece)
            want.update(" ".join(w[i:i + m]).encode() + b"\ten" for m in range(1, 5) for i in range(len(w) - m + 1))
    assert {k: n for k, n in done.items() if n >= 30} == {k: n for k, n in want.items() if n >= 30}


def test_scores_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_000
    rows = [("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)]
    r = collocations.collocations(spark.createDataFrame(rows, "lang string, length int, phrase string, n bigint")).collect()
    assert [(x.score, x.l, x.r) for x in r] == [(2_000_000 * (big - 7) // (2 * big - 1), big, big - 1)]


# --- op13 --------------------------------------------------------------------

def plain_components(texts):
    sets = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^ \t\n\x0b\x0c\r]+", low)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
    return " ".join(w)


def jaccard_texts(seed):
    r = random.Random(seed)
    common = " ".join(f"c{i}" for i in range(60))
    out = [None, "", "  \n", "one two", "One  two", "one two three four", "one two three four five", "a b c d e f g h i", "a b c d e f g h"]
    for size in (9, 12, 30, 60, 200, 700):
        base = [f"b{size}-{i}" for i in range(size)]
        out += [edited(r, base, k % (size // 25 + 2)) for k in range(25)]
        out += [edited(r, base[:size - size // 10], 1), " ".join(base * 2)]
    out += [common + " " + " ".join(f"u{k}-{i}" for i in range(r.randint(5, 40))) for k in range(60)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_all_pairs(spark, seed):
    texts = jaccard_texts(seed)
    got = jaccard.query(documents(spark, texts).repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    want = plain_components(texts)
    assert len({c for _, _, c in want}) < len(texts) - 20
    assert sorted(tuple(r) for r in got) == want


def test_large_tiles_are_split(spark, monkeypatch):
    """Many sets under one shingle, of several components, dealt into many tiles."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "PLACE", 5)
    r = random.Random(4)
    common = " ".join(f"c{i}" for i in range(30))
    texts = [common + " " + " ".join(f"u{k // 2}-{i}" for i in range(r.randint(9, 11))) for k in range(120)]
    got = jaccard.query(documents(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(tuple(x) for x in got) == plain_components(texts)


def test_bound_never_loses_a_link():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 900))
        base = r.integers(0, 1 << 63, n + 300, np.uint64)
        a, b = base[:n], np.concatenate([base[int(r.integers(0, n // 8 + 1)):n], base[n:n + int(r.integers(0, n // 8 + 2))]])
        same = len(np.intersect1d(a, b))
        linked = 100 * same >= 80 * (len(a) + len(b) - same)
        with np.errstate(over="ignore"):
            x, y = (jaccard.Sets(m, pa.array(jaccard.bitmaps(np.zeros(len(s), np.int64), s, m)))
                    for s in (a, b) for m in [np.array([len(s)])])
        assert not linked or jaccard.can_link(x, np.array([0]), y, np.array([0]))[0]


def test_a_tile_passes_on_fewer_pairs_than_sets():
    """60 sets that may all link with each other: as many pairs as connect them, not all 1,770."""
    n, sid = 40, list(range(60))
    bits = jaccard.bitmaps(np.zeros(n, np.int64), np.arange(n, dtype=np.uint64) * np.uint64(7919), np.array([n]))[0]
    sets = [{"band": 16, "own": 0, "root": s, "sid": s, "n": n, "bits": bits} for s in sid]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("band", "own", "root", "sid", "n")] + [("bits", pa.binary())]))
    tile = pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0]), pa.array([0]), pa.array([sets], kind)],
                                      names=["tile", "x", "y", "sets"])
    links = [(r["a"], r["b"]) for b in jaccard._tiles(iter([tile])) for r in b.to_pylist()]
    assert len(links) == 59
    joined = jaccard.Joined(np.array(sid))
    assert all(joined.join(a, b) for a, b in links) and len(set(joined.component())) == 1


def test_jaccard_links_that_the_passed_on_pairs_miss(spark, monkeypatch):
    """Components that meet by other pairs than those that tiles pass on, in several blocks."""
    monkeypatch.setattr(jaccard, "PLACE", 4)
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = [edited(r, base, k % 4) for k in range(70)] + [edited(r, [f"v{i}" for i in range(25)], 1) for _ in range(20)]
    got = jaccard.query(documents(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    want = plain_components(texts)
    assert len({c for _, _, c in want}) > 2 and sorted(tuple(x) for x in got) == want


def test_phrases_come_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(collocations, "KEYS", 7)
    texts = pa.array(random_texts(3, 40))
    table = np.full(collocations.SLOTS, 0, np.uint8)  # every phrase is open
    with np.errstate(over="ignore"):
        got = list(collocations._phrases(texts, "en", table, 0, 3))
    assert max(len(keys) for _, keys, *_ in got) == 7
    want = Counter()
    for t in texts.to_pylist():
        for piece in re.split("[.,;:!?\x0a-\x0d]", t.lower()):
            w = re.findall("[^ \t]+", piece)
            want.update(" ".join(w[i:i + m]).encode() + b"\ten" for m in range(1, 5) for i in range(len(w) - m + 1))
    assert {k: int(x) for _, keys, _, _, n in got for k, x in zip(keys, n)} == want
